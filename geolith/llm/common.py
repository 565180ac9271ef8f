"""What the operators of this subpackage share: checkpoints, Arrow batch sizes, word rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.session import drop, prepared, written

#: Words are maximal runs of anything but these six bytes; bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch: bounds the memory of a Python worker whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session, where it can checkpoint. Arrow batches are bounded, unless the caller has bounded them: the settings belong to
    the session, as plans that run later need them still."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    return prepared(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later steps neither
    recompute it nor depend on an executor that may be lost."""
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WORD", "cut", "drop", "fold", "session", "table", "written"]


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus` (a null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
