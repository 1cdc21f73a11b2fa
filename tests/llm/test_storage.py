import os
import subprocess
import sys
import textwrap

from flowlattice.llm import storage
from flowlattice.llm.workers import kept


def test_paths_made_in_a_block_are_collected(spark):
    with storage.collecting() as outer:
        a = storage.materialise(spark.range(3), "a")
        with storage.collecting() as inner:
            b = storage.materialise(spark.range(4), "b")
    storage.materialise(spark.range(1), "c")
    assert len(outer) == len(inner) == 1 and (a.count(), b.count()) == (3, 4)
    storage.delete(spark, inner[0])
    assert not os.path.exists(inner[0].removeprefix("file://")) and a.count() == 3


def test_intermediates_go_with_the_application(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from flowlattice.llm import storage
        from flowlattice.sources.scratch import cut_lineage
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
        assert storage.materialise(spark.range(3), "x").count() == 3 and cut_lineage(spark.range(2)).count() == 2
        assert sum(len(f) for _, _, f in __import__("os").walk("{tmp_path}")) > 0
        spark.stop()
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=root, timeout=120)
    assert [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")] == []


def test_worker_state_is_made_once_per_key():
    made = []
    for key in ("a", "a", "b", "a"):
        assert kept("test slot", key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "a"]
