"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out for engines whose ``\s`` is ASCII.
WHITE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_chunks_sample")


def word_count(text: Column) -> Column:
    """Words between Unicode white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local session (tests) that names none gets one of its own; elsewhere executors could not read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fields(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, value) for text and metadata.heading_context; null values are left out."""
    pairs = F.array(
        F.struct(F.lit("text").alias("field"), F.col("text").alias("value")),
        F.struct(F.lit("heading_context").alias("field"), F.col("metadata.heading_context").alias("value")),
    )
    return df.select(key, F.inline(pairs)).where(F.col("value").isNotNull())


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; the folder is a parameter (environment TOKENIZERS_DIR)."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def spool(df: DataFrame) -> DataFrame:
    """Written as a table into the shared checkpoint folder and read back: compressed, survives lost executors.

    It is there until :func:`drop_spools` or the end of the driver's Python, as the
    frames made from it are read later.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/spool-{uuid.uuid4().hex}"
    if not _SPOOLS:
        atexit.register(drop_spools, spark)
    _SPOOLS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SPOOLS: list[str] = []


def drop_spools(spark: SparkSession) -> None:
    """Delete the tables that operators wrote in between; for when their results have been stored."""
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        while _SPOOLS:
            path = jvm.org.apache.hadoop.fs.Path(_SPOOLS.pop())
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone, and with it the way to the folder
        _SPOOLS.clear()
