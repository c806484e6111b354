import hashlib
import math
import re
from collections import defaultdict

from sessionlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def by_rounds(sizes: dict) -> dict:
    """Targets by the rule as stated: share by weight, stop at three times, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed, free = sum(sizes.values()), {}, set(names)
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}
        free -= over
    return fixed


def expected(rows):
    sizes, members = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r[3]] += size(r[1])
        text = hashlib.md5((r[1] or "").encode()).hexdigest()
        key = hashlib.md5(f"0:{'null' if r[0] is None else r[0]}:{text}".encode()).hexdigest()
        members[r[3]].append((key, size(r[1]), (r[0] is not None, r[0] or 0), r[0]))
    targets, out = by_rounds(sizes), []
    for source, docs in members.items():
        budget, total, before = math.floor(targets[source]), sizes[source], 0
        whole = budget // total if total else 0
        for _, n, _, doc_id in sorted(docs, key=lambda d: d[:3]):
            out.append((doc_id, source, n, whole * n + max(0, min(n, budget - whole * total - before))))
            before += n
    return targets, out


def ordered(rows):
    return sorted(rows, key=repr)


def test_takes_as_the_plain_loop(docs, rows):
    targets, out = expected(rows)
    for width in (20_000, 10):  # one range, and many
        got = mixing.mix(docs, range_rows=width).collect()
        assert ordered((r.doc_id, r.source, r.size, r.taken) for r in got) == ordered(out)
        for r in got:
            assert abs(r.target - targets[r.source]) < 1e-6 and r.taken <= 3 * r.size


def test_each_source_meets_its_target(docs):
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_targets_with_every_source_capped_or_empty(spark):
    for sizes in ({"a": 0}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1000}, {"a": 5, None: 5}, {"a": 1, "b": 100, "c": 1, "d": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = by_rounds(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def test_mixed_corpus_has_the_words_of_the_plan(docs, rows):
    got = mixing.take_mix(docs)
    assert got.columns == docs.columns
    words = defaultdict(int)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in got.collect():
        words[r.doc_id] += size(r.text)
        assert (texts[r.doc_id] or "").startswith(r.text) or r.text.startswith(texts[r.doc_id])
    plan = defaultdict(int)
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.taken
    repeated = {rows[5][0]}  # rows that repeat a boundary document are cut alike
    assert {k: v for k, v in words.items() if v and k not in repeated} == {k: v for k, v in plan.items() if v and k not in repeated}


def test_reruns_agree_and_extra_columns_and_empty_tables_do_no_harm(docs, wide, no_docs):
    first = ordered(map(tuple, mixing.mix(docs).collect()))
    assert first == ordered(map(tuple, mixing.mix(docs.repartition(7)).collect())) == ordered(map(tuple, mixing.mix(wide).collect()))
    assert mixing.mix(no_docs).collect() == [] and mixing.take_mix(no_docs).collect() == []
    assert mixing.take_mix(wide).columns == wide.columns


def test_one_row_repeated_and_one_id_on_many_texts(spark):
    """A third of the rows repeat one row, a third share a null id; every copy has its own place."""
    table = [(1, "a b c", "hot")] * 10_000 + [(None, f"text {i} of none", "hot") for i in range(3000)] + [(i, "x y", "cold") for i in range(10, 3000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mix(docs, range_rows=500).collect()
    assert len(got) == len(table) and all(0 <= r.taken <= 3 * r.size for r in got)
    for source in ("hot", "cold"):
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 1
    copies = [r.rest for r in got if r.doc_id == 1]
    assert copies == sorted(copies, reverse=True) and sum(0 < x < 3 for x in copies) <= 1
    assert len({r.key for r in got if r.doc_id is None}) == 3000


def test_a_mix_that_ends_in_repeated_rows_is_the_same_however_the_rows_lie(spark):
    rows = [(1, "a b c d e f g", "x")] * 5 + [(2, "k l m", "y"), (3, "n o p q", "y")]
    schema = "doc_id long, text string, source string"
    runs = [sorted(map(tuple, mixing.take_mix(spark.createDataFrame(r, schema).repartition(n), seed=4).collect())) for r, n in ((rows, 1), (rows[::-1], 3), (rows, 7))]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_words_are_counted_in_one_python_worker_for_a_task(spark, docs, capsys):
    """Two Python steps in one stage take two workers a task, which stay and hold their memory for all that follows."""
    mixing.take_mix(docs).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [") == 1
    texts = [None, "", " \t\n\x0b\x0c\r", "\x00", "\u00a0", "\u2003\x1c", " a ", "\x85", "\n\U0001f600\n"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = table.select("text", mixing.has_words(table.text).alias("has"), mixing.word_count(table.text).alias("n")).collect()
    assert [r.has for r in got] == [r.n > 0 for r in got] == [size(r.text) > 0 for r in got]
