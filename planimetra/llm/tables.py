"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="planimetra-")
    return _OWN[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read again, so that later steps do not recompute it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in an Arrow batch at most. Texts are a few kilobytes and some far longer, so more rows would fill a task's memory.
BATCH_ROWS = 400


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest long), row_key (of the id and the text) and text ('' for null).

    Rows that repeat both id and text share their key and get the same answer.
    """
    small_batches(docs.sparkSession)
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), text.alias("text"))


def public_id(name: str = "doc_id"):
    """The id as it was before keyed()."""
    return F.when(F.col(name) != F.lit(-(2**63)), F.col(name)).alias(name)
