"""Retry planning from a log of attempts: chunk_id, outcome, ts.

Outcomes: 'transient' (may be tried again), 'success', anything else is still in flight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default limits.
MAX_ATTEMPTS = 5
MAX_WAIT_SECONDS = 300
EXPONENTIAL_BASE = 2


def attempt_summary(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, max_wait: int = MAX_WAIT_SECONDS
) -> DataFrame:
    """Tries, retries, time and outcome per chunk, in one aggregate over the log."""
    transient = F.col("outcome") == "transient"
    per_chunk = attempts.groupBy("chunk_id").agg(
        F.count_if(transient).alias("failures"),
        F.bool_or(F.col("outcome") == "success").alias("succeeded"),
        F.unix_seconds(F.min("ts").cast("timestamp")).alias("_first"),
        F.unix_seconds(F.max("ts").cast("timestamp")).alias("_last"),
    )
    seconds = F.col("_last") - F.col("_first")
    spent = (F.col("failures") >= max_attempts) | (seconds >= max_wait)
    gave_up = ~F.col("succeeded") & (F.col("failures") > 0) & spent
    # The last failure of a chunk that was given up was not tried again.
    retries = F.col("failures") - gave_up.cast("int")
    return per_chunk.select(
        "chunk_id",
        "failures",
        retries.alias("retries"),
        seconds.alias("elapsed_seconds"),
        "succeeded",
        gave_up.alias("gave_up"),
    )


def retry_queue(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    max_wait: int = MAX_WAIT_SECONDS,
    base: int = EXPONENTIAL_BASE,
) -> DataFrame:
    """Chunks to try again and the longest wait before: the backoff step, within the time left."""
    summary = attempt_summary(attempts, max_attempts, max_wait)
    open_chunks = summary.where(~F.col("succeeded") & ~F.col("gave_up") & (F.col("failures") > 0))
    step = F.pow(F.lit(float(base)), F.col("failures") - 1)
    wait = F.least(step, (F.lit(max_wait) - F.col("elapsed_seconds")).cast("double"))
    return open_chunks.select("chunk_id", "failures", "elapsed_seconds", wait.alias("next_wait_seconds"))
