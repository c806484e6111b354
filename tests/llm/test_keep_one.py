import pytest

from sessionlake.llm import nearcopies, simhash


@pytest.mark.parametrize("keep", [simhash.keep_one, nearcopies.keep_one])
def test_each_group_keeps_one_of_its_own_rows(spark, keep):
    table = spark.createDataFrame([(5, "z"), (5, "b"), (3, "b"), (6, "a"), (6, "c"), (7, "d"), (7, "d")], "doc_id long, text string")
    assert sorted(map(tuple, keep(table).collect())) == [(3, "b"), (5, "z"), (6, "a"), (6, "c"), (7, "d")]
