"""Ingestion of what is new: files of a source, each read once, as far as they go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest(spark: SparkSession, path: str, kind: str, schema: T.StructType, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d, **options: str) -> int:
    """Read all files of a folder that no earlier call has read, and append them to ``target``; returns their rows.

    The checkpoint remembers what was read, so a call that fails is made up for by the next.
    """
    stream = spark.readStream.schema(schema).options(**options).format(kind).load(path)
    query = change(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    rows: dict[int, int] = {}  # Spark keeps the reports of the last batches only, so they are gathered as it goes
    done = False
    while not done:
        done = query.awaitTermination(1)
        rows |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
    return sum(rows.values())


def latest_per_key(spark: SparkSession, path: str, schema: T.StructType, key: str, moment: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Micro-batches of a folder's Parquet files with the latest row of each key, handed to ``write`` with their number."""
    from pyspark.sql import functions as F

    def batch(df: DataFrame, number: int) -> None:
        rows = F.struct(F.col(moment), *[F.col(c) for c in df.columns if c not in (key, moment)])
        latest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rows).alias("_row")).select("_row.*")
        write(latest, number)

    query = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
