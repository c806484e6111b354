"""The stream of sessions: late ticks count, state and files stay bounded, batches that run again count once."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sessionlake.functions import dates
from sessionlake.operators import sessions
from sessionlake.streaming import sessions as stream
from sessionlake.streaming.current import CurrentTable

TICKS = "tick_id long, collected_at timestamp_ntz, symbol string, price double, provider string, open double, prev_close double, high double, low double, came timestamp"


def tick(i, at, came, symbol="tx"):
    return (i, at, symbol, float(i), "p", i + 0.5, i + 0.25, float(i), -float(i), came)


def files_under(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_late_ticks_count_with_bounded_state_and_files(spark, tmp_path):
    """Thirty daily batches; each brings its day's ticks and one for a session weeks back."""
    first = datetime(2026, 3, 2, 16)
    parts = table = query = None
    seen_files, seen_state = [], []
    for n in range(30):
        day = first + timedelta(days=n)
        rows = [tick(100 * n + i, day + timedelta(minutes=i), day, "tx" if i % 2 else None) for i in range(4)] + [tick(100 * n + 50, first - timedelta(days=20), day)]
        rows += [tick(100 * n + 60, None, day)] * (n == 4)
        spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
        if n % 6 == 5:  # six batches a run
            parts = stream.session_parts(stream.read_ticks(spark, f"{tmp_path}/in/*", TICKS, "parquet", files_per_trigger=1), arrived=F.col("came"))
            table = stream.session_table(spark, f"{tmp_path}/table", spread=2)
            query = stream.run_available(parts, f"{tmp_path}/state", table)
            seen_files.append(files_under(f"{tmp_path}/table"))
            seen_state.append(max(p.stateOperators[0].numRowsTotal for p in query.recentProgress))
            assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress) == 0
    got = stream.merge_parts(table.read(parts.schema))
    stored = spark.read.schema(TICKS).parquet(f"{tmp_path}/in/*").withColumn("session_ts", dates.session_date(F.col("collected_at")).cast("timestamp"))
    want = sessions.assemble_session(stored, keys=("symbol", "session_ts"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.n_points for r in got.filter(F.col("session_ts") == dates.session_date(F.lit(first - timedelta(days=20)))).collect()} == {30}
    assert max(seen_state) <= 20  # the sessions of about three days of arrivals
    assert seen_files[-1] <= 24  # buckets of the months, in at most two versions, and manifests; not 30 batches


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    schema = "k string, v long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table = CurrentTable(spark, f"{tmp_path}/t", ["k"], F.coalesce(F.col("k"), F.lit("none")))
    assert table.read(schema).count() == 0
    table.upsert(rows(("a", 1), ("b", 1), (None, 1)), 0)
    table.upsert(rows(("a", 2), ("c", 2)), 1)
    table.upsert(rows(("a", 3), (None, 3)), 2)
    want = [("None", 3), ("a", 3), ("b", 1), ("c", 2)]
    read = lambda: sorted((str(r.k), r.v) for r in table.read(schema).collect())
    assert read() == want
    table.upsert(rows(("a", 3), (None, 3)), 2)
    assert read() == want
    table.upsert(rows(), 3)
    assert read() == want
    table.upsert(rows(("b", 4)), 7)
    assert read() == [("None", 3), ("a", 3), ("b", 4), ("c", 2)]
    assert len(os.listdir(f"{tmp_path}/t/manifests")) <= 4  # two folders and their checksum files
