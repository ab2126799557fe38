"""Tables written once to the shared folder, and small checks shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text, for SQL functions: runs without space, tab, line feed and their kin.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, removed when the driver ends.

    Without that setting (tests, a local session) it is a temporary folder; a cluster must name one.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = f"file://{tempfile.mkdtemp(prefix='flowsentry-')}"
        _folders[app] = f"{named.rstrip('/')}/llm-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this module's own making; a session that has ended leaves it."""
    if spark.sparkContext._jsc is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the gateway may be gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads."""
    _remove(df.sparkSession, df._written_path)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column doc, so that added columns cannot clash with its own; `doc.*` unpacks it."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), *(c.alias(n) for n, c in more.items()))


def with_row(df: DataFrame, name: str) -> DataFrame:
    """df with a unique number in column row, written once so that the numbers stay the same."""
    return written(df.withColumn("row", F.monotonically_increasing_id()), name)


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
