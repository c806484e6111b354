import random
from collections import defaultdict

from sessionlake.operators import brokers


def plain(trades, n_side, n_day):
    sums = defaultdict(lambda: [0, 0])
    for code, broker, is_sell, volume in trades:
        sums[code, broker][is_sell] += volume
    lists = defaultdict(list)
    for (code, broker), (buy, sell) in sums.items():
        lists[code, "buyers" if buy >= sell else "sellers"].append((-abs(buy - sell), broker, buy, sell))
        if buy > 0 and sell > 0:
            lists[code, "daytraders"].append((-min(buy, sell), broker, buy, sell))
    return sorted(
        (code, side, pos, broker, buy, sell, buy - sell)
        for (code, side), rows in lists.items()
        for pos, (_, broker, buy, sell) in enumerate(sorted(rows)[: n_day if side == "daytraders" else n_side], 1)
    )


def test_trades_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    """A stock with half of all trades, many ties, and a list of day-traders that is longer than the others."""
    monkeypatch.setattr(brokers, "TASK_ROWS", 50, raising=False)
    rng = random.Random(3)
    trades = [(rng.choice((1, rng.randrange(40))), rng.randrange(60), rng.random() < 0.5, rng.randrange(9)) for _ in range(3000)]
    table = spark.createDataFrame(trades, "code long, broker long, is_sell boolean, volume long")
    for n_side, n_day in ((15, 10), (2, 4)):
        got = brokers.top_brokers(table, ["code"], n_side, n_day)
        assert got.rdd.getNumPartitions() == 60
        assert sorted(map(tuple, got.collect())) == plain(trades, n_side, n_day)
    assert brokers.top_brokers(table.limit(0), ["code"]).collect() == []
