"""What the corpus operators share: bounded Arrow batches, sizes, and joins with small tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.sources.shared import dropped, stored  # noqa: F401


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of ``column``; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # the worker lives on, beside those of other stages


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts, for sizing partitions; 0 for an empty table."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context: they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_trustweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="trustweave-")) / "trustweave_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._trustweave_shipped = True


#: Bytes in an Arrow batch between the JVM and a Python worker, for each of which both hold it: rows may be long texts.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.isdigit() or int(held) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not among ``ids`` (one column, best from a stored table); null ids stay."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return df.join(small(gone), df[id_col] == F.col("_gone"), "left_anti")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and, as ``count``, how many rows of ``left`` have it.

    Keys with more than one in ``share`` of these rows, fewer than ``share`` by that, are broadcast, so that none of them
    is one task; the others are shuffled. Both sides are read twice, so they had better be stored.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(count) * share > total))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) * share <= total), keys, how)
    return left.join(hot, keys).unionByName(rest)
