"""Intermediate tables: where they lie and when they go."""

import threading
from types import SimpleNamespace

import pytest

from sessionlake import scratch


def test_only_the_tables_of_a_block_are_freed(spark):
    with scratch.owned() as outer:
        with scratch.owned() as inner:
            one = scratch.materialize(spark.range(3), "one")
        two = scratch.materialize(one, "two")
    other = scratch.materialize(spark.range(2), "other")
    inner.free(spark)
    assert two.count() == 3 and other.count() == 2
    with pytest.raises(Exception, match="NOT_EXIST"):
        one.collect()
    outer.free(spark)
    with pytest.raises(Exception, match="NOT_EXIST"):
        two.collect()
    assert other.count() == 2


def test_threads_own_their_tables(spark):
    made, start, stop = {}, threading.Barrier(2), threading.Barrier(2)

    def work(name):
        with scratch.owned() as tables:
            start.wait()
            made[name] = scratch.materialize(spark.range(4), name)
            stop.wait()
        if name == "a":
            tables.free(spark)

    threads = [threading.Thread(target=work, args=(name,)) for name in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made["b"].count() == 4
    with pytest.raises(Exception, match="NOT_EXIST"):
        made["a"].collect()


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    if fine:
        assert scratch.shared_folder(session) == scratch.shared_folder(session)
    else:
        with pytest.raises(ValueError):
            scratch.shared_folder(session)
