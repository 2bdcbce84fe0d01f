"""Where intermediate results go: tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (single-machine tests).
UNSET_DIR = "/tmp/checkpoints/simloom"


#: Paths of the tables written in the innermost scratch block.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the one that the job has set on its context.

    Where neither is set a local session gets one of our own; on a cluster that is an error, as
    a folder of the driver's machine is not what executors see.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(UNSET_DIR)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/simloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; `by` names columns to lay it out by.

    This cuts the lineage: a lost executor costs no more than a reread, and plans that use a result
    several times don't compute it again. Inside a scratch block the table goes when the block ends.
    """
    return _stored(df, label, _written.get(), by)


def _stored(df: DataFrame, label: str, owner: list[str] | None, by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, label)
    if owner is not None:
        owner.append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class scratch:
    """A block whose materialized tables are deleted when it ends, but for those written by keep()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        self._outer, self._own = _written.get(), []
        self._token = _written.set(self._own)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """materialize for what is used after the block: it belongs to the block around, if there is one."""
        return _stored(df, label, self._outer)

    def free_but_last(self) -> None:
        """Delete all tables of this block but the one written last."""
        while len(self._own) > 1:
            _delete(self.spark, self._own.pop(0))

    def __exit__(self, *_: object) -> None:
        _written.reset(self._token)
        for path in self._own:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has materialized."""
    _delete(spark, f"{shared_dir(spark)}/simloom-{spark.sparkContext.applicationId}")


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put what was written at `staged` in the place of `path`, by renames alone.

    What was at path stands at path.old until the new one is in place, so a crash leaves one of the two
    whole; recover() brings the old one back where the crash fell between the renames.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, target, old = fs_path(staged), fs_path(path), fs_path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, path)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, target):
        recover(spark, path)
        raise OSError(f"{staged} can't take the place of {path}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """If a swap ended between its renames, the table that was there stands at path again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, old = fs_path(path), fs_path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)


def join_small(df: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", rows: int = 100_000) -> DataFrame:
    """Join with a side that is usually small: broadcast if its counted rows are at most `rows`, else shuffled.

    `small` is counted, so it should be materialized and narrow.
    """
    return df.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark shall not broadcast.

    Its estimates come from the sizes of compressed files and miss what explode and collect_list add, so that a
    side that grows with the corpus can look small enough to be collected in the driver.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
