import pytest

from readloom.queries import core
from tests.oracle import same

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    same(spark, data, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, data, name):
    df = core.queries()[name](spark, data)
    assert df.columns
    df.collect()


def test_workers_find_the_package_from_anywhere(tmp_path, data):
    """Another folder, no path in the environment: the package is shipped."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["kmer5"](spark, {data!r}).count(), e.entry(spark).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1024 True" in out.stdout, out.stderr[-2000:]
