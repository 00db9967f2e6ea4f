"""Running read statistics over a stream of FASTQ records, by the same mergeable counters as the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandforge.operators import fastq, flagstat


def running_stats(reads: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Counters of all reads so far, per group; write with output mode complete or update. State is one row a group."""
    return fastq.partial_stats(reads, groups)


def windowed_stats(reads: DataFrame, at: str = "sequenced_at", length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counters per time window; windows close, and drop later rows, once the watermark has passed them."""
    timed = reads.withWatermark(at, late).withColumn("window", F.window(at, length))
    return fastq.partial_stats(timed, ["window"])


def running_flagstat(alignments: DataFrame) -> DataFrame:
    """Flag counters so far (output mode complete)."""
    return flagstat.flagstat(alignments)


def start(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """The query into a table in memory, for tests and consoles."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
