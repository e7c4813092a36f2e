"""Tables handed from one job to the next through the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []
_kept: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own, but on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallymark-"))
    return _own[0]


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


@atexit.register
def _sweep() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            target, fs = _path(spark, path)
            fs.delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name, which goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``hand_over``, and what its shuffles left on the executors' disks goes at once, not when the driver happens to collect its garbage."""
    out = hand_over(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def version(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of every file in the folders (or of the files) ``paths``: what a stored result depends on."""
    out = []
    for path in paths:
        target, fs = _path(spark, path)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.globStatus(target) or []]
        if fs.getFileStatus(target).isDirectory():
            out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)]
    return tuple(out)


def once(spark: SparkSession, name: str, inputs: list[str], make):
    """What ``make`` gives, made once for each state of its input files and session."""
    key = (spark.sparkContext.applicationId, name, version(spark, inputs))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def kept(spark: SparkSession, name: str, inputs: list[str], make) -> DataFrame:
    """The table that ``make`` gives, written once for each state of its input files and session, and read from then on."""
    return once(spark, name, inputs, lambda: settle(make(), name))
