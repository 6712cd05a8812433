"""Reading sources and writing results: views over files, and tables that appear whole or not at all."""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trustweave.model import ModelError

#: Compression codecs. Fixed values.
CODECS = ("snappy", "zstd", "gzip", "lz4", "uncompressed")
#: Writers of the newest version keep so many versions before it.
KEEP = 2
#: So many numbered states are kept, and a claim of a writer counts for so many seconds.
KEEP_STATES, CLAIM_S = 10, 60


class Conflict(ModelError):
    """Another writer was first."""


class _Files:
    """The file system of a path, by way of Hadoop, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def write(self, p: str, text: str) -> None:
        """Written beside its place and then moved there, over what is there, in one step where the store has one."""
        beside = self._beside(p, text)
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(beside, self.path(p), options)

    def write_new(self, p: str, text: str) -> bool:
        """Written only where nothing is; whether it was."""
        beside = self._beside(p, text)
        if not self.exists(p) and self.fs.rename(beside, self.path(p)):
            return True
        self.fs.delete(beside, False)
        return False

    def _beside(self, p: str, text: str) -> Any:
        beside = self.path(f"{p}.{uuid.uuid4().hex}")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        return beside

    def claim(self, p: str) -> bool:
        """Make an empty file; False if it is there and no older than a claim counts."""
        try:
            self.fs.create(self.path(p), False).close()
            return True
        except Py4JJavaError as e:
            if not any(said in str(e) for said in ("AlreadyExists", "AlreadyBeingCreated")):
                raise
        held = self.fs.globStatus(self.path(p))  # empty where it has gone in between
        if held and time.time() - held[0].getModificationTime() / 1000 > CLAIM_S:
            self.delete(p)
        return False

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


# Reading


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Cells as text unless a schema says otherwise; an empty cell is null, a quoted empty one an empty text."""
    reader = spark.read.option("header", True).option("emptyValue", "").option("nullValue", None).option("mode", "FAILFAST")
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One file, a folder or a glob; columns are united by name, and ``source=x`` folders give a column."""
    return spark.read.option("mergeSchema", True).parquet(path)


READERS = {"csv": read_csv, "parquet": read_parquet, "json": lambda s, p: s.read.json(p), "orc": lambda s, p: s.read.orc(p)}


def read_location(spark: SparkSession, location: str, kind: str | None = None, **options: Any) -> DataFrame:
    """A location by its scheme: catalog:// and iceberg:// name tables, jdbc: is a database, the rest are files."""
    for scheme in ("catalog://", "iceberg://"):
        if location.startswith(scheme):
            return spark.table(location.removeprefix(scheme).replace("/", "."))
    if location.startswith(("jdbc:", "pg://")):
        url = location if location.startswith("jdbc:") else "jdbc:postgresql://" + location.removeprefix("pg://")
        return spark.read.format("jdbc").options(url=url, **options).load()
    path = location.removeprefix("lake://")
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind not in READERS:
        raise ModelError(f"no reader for {location!r}")
    return READERS[kind](spark, path)


def find_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` as Parquet if it is there, else as CSV."""
    files = _Files(spark, folder)
    for kind in ("parquet", "csv"):
        if files.exists(f"{folder}/{name}.{kind}"):
            return READERS[kind](spark, f"{folder}/{name}.{kind}")
    raise FileNotFoundError(f"neither Parquet nor CSV for {name!r} in {folder}")


def mount(spark: SparkSession, folder: str, kind: str = "parquet") -> list[str]:
    """A temporary view for each file of a kind, named as the file; returns the names."""
    names = [n.rpartition(".")[0] for n in _Files(spark, folder).names(folder) if n.endswith("." + kind)]
    for n in names:
        READERS[kind](spark, f"{folder}/{n}.{kind}").createOrReplaceTempView(n)
    return names


def views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def columns(df: DataFrame) -> dict[str, str]:
    """Names and types of a table's columns."""
    return dict(df.dtypes)


class Tables:
    """Where the table of each class lives: catalog, schema and table."""

    def __init__(self, places: dict[str, tuple[str, str, str]]) -> None:
        self.places = places

    def name(self, cls: str) -> str:
        if cls not in self.places:
            raise ModelError(f"no table for class {cls!r}")
        return ".".join(f"`{p}`" for p in self.places[cls] if p)

    def frame(self, spark: SparkSession, cls: str) -> DataFrame:
        return spark.table(self.name(cls))


# Writing


class Lake:
    """A folder of versioned tables. A table is a pointer to one version, which is switched once all is written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)

    def _table(self, name: str) -> str:
        if not re.fullmatch(r"[\w./=-]+", name) or ".." in name:
            raise ModelError(f"{name!r} is no name for a table")
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy", partition_by: tuple[str, ...] = ()) -> str:
        """Write a version and switch to it; a failure leaves the table as it was, and no files."""
        if codec not in CODECS:
            raise ModelError(f"unknown compression {codec!r}; it can be {', '.join(CODECS)}")
        table = self._table(name)
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        path = f"{table}/{version}"
        try:
            writer = df.write.option("compression", codec)
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        except BaseException:
            self.files.delete(path)
            raise
        self.files.write(f"{table}/_current", json.dumps({"version": version}))
        for old in [n for n in self.files.names(table) if n.startswith("v")][: -1 - KEEP]:
            self.files.delete(f"{table}/{old}")
        return path

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{self._table(name)}/_current")

    def path(self, name: str) -> str:
        """The folder of the current version."""
        table = self._table(name)
        if not self.exists(name):
            raise FileNotFoundError(f"no table {name!r}")
        return f"{table}/{json.loads(self.files.read(f'{table}/_current'))['version']}"

    def read(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.path(name))

    def write_json(self, name: str, value: Any) -> None:
        self.files.write(f"{self._table(name)}.json", json.dumps(value, indent=1, sort_keys=True))

    def read_json(self, name: str, default: Any = None) -> Any:
        path = f"{self._table(name)}.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else default

    def json_names(self, folder: str) -> list[str]:
        """The names, without their ending, of the values in a folder."""
        return [n.removesuffix(".json") for n in self.files.names(self._table(folder)) if n.endswith(".json")]

    def read_state(self, name: str, default: Any = None) -> tuple[int, Any]:
        """The newest of a value's numbered states, with its number; 0 and the default if there is none."""
        numbers = [n for n in self.json_names(name) if n.isdigit()]
        return (int(numbers[-1]), json.loads(self.files.read(f"{self._table(name)}/{numbers[-1]}.json"))) if numbers else (0, default)

    def write_state(self, name: str, value: Any, after: int) -> None:
        """The state that follows the one numbered ``after``; a Conflict if that is no longer the newest.

        Two writers are told apart by a store that creates a file only once, as HDFS does. Local folders look first and
        create then, so two processes that write within the same instant may both go on there.
        """
        folder, number = self._table(name), f"{after + 1:012d}"
        if not self.files.claim(f"{folder}/{number}.claim"):
            raise Conflict(f"{name}: another writer is at {number}")
        try:
            if self.read_state(name)[0] != after or not self.files.write_new(f"{folder}/{number}.json", json.dumps(value, indent=1, sort_keys=True)):
                raise Conflict(f"{name}: {after} is no longer the newest")
        finally:
            self.files.delete(f"{folder}/{number}.claim")
        for old in [n for n in self.json_names(name) if n.isdigit()][:-KEEP_STATES]:
            self.files.delete(f"{folder}/{old}.json")


def create_view(df: DataFrame, name: str, replace: bool = True) -> None:
    df.createOrReplaceTempView(name) if replace else df.createTempView(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested values as JSON."""
    from pyspark.sql import functions as F

    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def publish_table(df: DataFrame, name: str) -> None:
    """Replace a catalog table, of whatever format the catalog writes."""
    df.writeTo(name).createOrReplace()
