"""What the operators share: tables, the shared folder, words and row keys."""

from __future__ import annotations

import atexit
import os
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of ``[^\x20\x09-\x0D]+`` words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it; on a cluster it is shipped with ``--py-files`` or installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where unset (tests, local mode) an own one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), "checkpoints", f"docloom-{os.getpid()}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return posixpath.join(shared_dir(spark), "docloom", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def opened(uri: str):
    """(pyarrow file system, path) of a URI or plain path, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, write) -> str:
    """``write(stream)`` into ``uri/name``; the file gets its name only when whole, so a lost attempt leaves no half file under it."""
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        write(out)
    system.move(part, f"{path}/{name}")
    return f"{uri}/{name}"


def text_of(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of ``[^\\x20\\x09-\\x0D]+`` words; empty for a text without one."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def n_words_of(text: Column) -> Column:
    """Number of those words, as long."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
