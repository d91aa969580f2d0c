"""What the corpus operators share: table access, checkpoints, ASCII text rules."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank and the control characters tab to carriage return.
WS = b" \t\n\r\x0b\x0c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="latticework-")
    context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 marks held-out documents."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


#: What tells rows apart: the doc_id, null or not, and 128 bits of the text.
ROW = ("unnamed", "id", "v1", "v2")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """ROW of a doc_id and a text, none of them null: rows may then be joined by plain equality. A null text is as an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = (doc_id.isNull(), F.coalesce(doc_id.cast("long"), F.lit(0)), F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text))
    return [c.alias(name) for c, name in zip(found, ROW, strict=True)]


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no other column's name can meet theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of whole_row, those in changed replaced."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in columns])
