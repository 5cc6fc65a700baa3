from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from readloom.llm.common import materialize, scratch


def test_queries_in_two_threads_keep_their_own_tables(spark):
    """A query that ends first removes none of another's tables."""

    def path(d):
        return Path(d.inputFiles()[0].removeprefix("file://")).parent

    with ThreadPoolExecutor(1) as pool, scratch(spark):
        mine = materialize(spark.range(5), "mine")

        def other():
            with scratch(spark):
                d = materialize(spark.range(3), "other")
                return path(d), path(materialize(spark.range(2), "kept", keep=True))

        gone, kept = pool.submit(other).result()
        assert not gone.exists() and kept.exists()
        assert mine.count() == 5
        with scratch(spark):
            inner = path(materialize(spark.range(4), "inner"))
        assert not inner.exists() and mine.count() == 5
        last = path(mine)
    assert not last.exists()
