"""Small helpers shared by all operators: reading tables, cleaning text, cutting lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, removed from the ends of sequences.
WHITE = " \t\n\r\x0b\x0c"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application, wherever they run."""
    sc = spark.sparkContext
    name = f"readloom-{sc.applicationId}.zip"
    if name in sc._python_includes:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"readloom/{p.relative_to(root).as_posix()}")
        shipped = Path(tempfile.gettempdir()) / name  # the driver serves the file from here
        shutil.copy(f"{folder}/{name}", shipped)
    sc.addPyFile(str(shipped))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_seq(col: str | Column) -> Column:
    """Upper case without white space at the ends; null stays null."""
    return F.upper(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE)))


def _warn_of_scheme(folder: str) -> None:
    warnings.warn(f"spark.checkpoint.dir is {folder}, without a scheme: it must be a folder that all executors share", stacklevel=3)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where none is set (tests on one machine) a local folder is made."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if "://" not in shared and not spark.sparkContext.master.startswith("local") and not conf.get("spark.hadoop.fs.defaultFS", None):
            _warn_of_scheme(shared)
        return shared
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="readloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably: the rows are written once to the shared folder and read from there.

    Unlike cached blocks, these files survive the loss of an executor.
    """
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


#: Tables that this process has written to the shared folder.
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; `drop_written` deletes what is put there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/readloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Delete shuffle files at the end of an execution, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a compressed table to the shared folder and read it back; smaller than a checkpoint and columnar.

    It stays until `drop_written` is called, since later plans read it. What was shuffled for it goes at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.mode("overwrite").parquet(path)  # a new plan, which takes the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Delete the tables that `written` left (from the given one on, up to but not the last); results made from them can't be
    computed again. How many there were."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = _WRITTEN[first:last]
    del _WRITTEN[first:last]
    for name in gone:
        path = hadoop.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def count_written() -> int:
    return len(_WRITTEN)


def delivered_once(df: DataFrame, id_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Each row once. Rows are delivered again under the same id, so only ids shuffle, and the rows of ids that occur twice.

    A null id is a value like any other. Ids that occur twice are broadcast if they are few; else both sides shuffle.
    """
    twice = materialize(df.groupBy(F.col(id_col).alias("__twice")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__twice"))
    small = broadcast_if_small(twice, twice.count(), broadcast_rows)
    same = F.col(id_col).eqNullSafe(F.col("__twice"))
    return df.join(small, same, "left_anti").unionByName(df.join(small, same, "left_semi").distinct())


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` leaves inside the block are deleted at its end; take results out (write or collect them) before."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        drop_written(spark, before)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast only behind a check of the counted size; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df
