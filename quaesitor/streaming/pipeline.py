"""Run-to-completion streams: pointer events to units, units to signals, with replay that changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate
from ..sources import landing

Batch = Callable[[DataFrame, int], None]


def stream_lines(spark: SparkSession, path: str, files_at_once: int = 100, delete_read: bool = False) -> DataFrame:
    """Lines of the files that arrive in a folder; files read may be deleted by the source."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once)
    if delete_read:
        reader = reader.option("cleanSource", "delete")
    return reader.load(path)


def events(lines: DataFrame) -> DataFrame:
    """Well-formed pointer events; malformed lines are passed over."""
    return lines.select(landing.parse_events(F.col("value")).alias("e")).select("e.*").filter(F.col("item_id").isNotNull())


def run(stream: DataFrame, batch: Batch, checkpoint: str) -> StreamingQuery:
    """Reads all that is there, in micro-batches, and stops."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup(pointers: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): the documents that events point to, and the events that point to none."""
    found = pointers.join(documents, pointers["mongo_id"] == documents["_id"])
    return found, pointers.join(documents, pointers["mongo_id"] == documents["_id"], "left_anti")


def append_new(target: str, keys: list[str]) -> Batch:
    """A sink that adds the rows whose keys the target lacks: a replayed batch adds nothing."""

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.dropDuplicates(keys)
        try:
            known = spark.read.schema(df.schema).parquet(target).select(*keys)
        except AnalysisException:  # nothing has been written yet
            known = None
        if known is not None:
            df = df.join(known, keys, "left_anti")
        df.write.mode("append").parquet(target)

    return write


def two_stages(spark: SparkSession, units_in: str, out: str, version: str = "0.2") -> None:
    """Units arrive as JSON lines; stage one stores them, stage two, begun when it has ended, annotates what is stored."""
    schema = "text_unit_id string, parent_id string, parent_type string, role string, position int, text string, lang string"
    lines = stream_lines(spark, units_in).select(F.from_json("value", schema).alias("u")).select("u.*").filter(F.col("text_unit_id").isNotNull())
    run(lines, append_new(f"{out}/text_units", ["text_unit_id"]), f"{out}/_units").awaitTermination()
    stored = spark.readStream.schema(schema).parquet(f"{out}/text_units")

    def annotate_batch(df: DataFrame, number: int) -> None:
        append_new(f"{out}/signals", ["signal_id"])(annotate.signals(df, version), number)

    run(stored, annotate_batch, f"{out}/_signals").awaitTermination()


def progress(query: StreamingQuery) -> dict:
    """Rows read and per second, of the last micro-batch."""
    p = query.lastProgress
    return {"rows": p["numInputRows"], "per_second": p.get("processedRowsPerSecond")} if p else {"rows": 0, "per_second": None}
