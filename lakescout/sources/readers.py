"""Readers of the lake: files of several kinds and databases, each a table by name."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescout.functions.text import STOP_WORDS


@dataclass(frozen=True)
class SourceConfig:
    name: str
    source_type: str
    config: dict = field(default_factory=dict)


def csv(spark: SparkSession, path: str, sep: str = ",", drop_malformed: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """The same rows for the same data: those with the smallest hashes."""
    return df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(rows)


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def socrata(spark: SparkSession, path: str) -> DataFrame:
    """The visible columns of an export with ``meta.view.columns`` and ``data``."""
    doc = spark.read.schema("meta struct<view struct<columns array<struct<name string, flags array<string>>>>>, data array<array<string>>").json(path, multiLine=True)
    # One short list of columns for each file.
    columns = [c for c in doc.select(F.explode("meta.view.columns").alias("c")).select("c.name", "c.flags").collect()]
    rows = doc.select(F.explode("data").alias("r"))
    return rows.select(*(F.col("r")[i].alias(c["name"]) for i, c in enumerate(columns) if "hidden" not in (c["flags"] or [])))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """The properties of each feature."""
    return spark.read.json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*")


def jdbc(spark: SparkSession, url: str, table: str, schema: str = "public", fetch: int = 1000, **options) -> DataFrame:
    return spark.read.jdbc(url, f"{schema}.{table}", properties={"fetchsize": str(fetch), **options})


def hive(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def kinds_of_files(spark: SparkSession, path: str, max_gb: float = 10) -> DataFrame:
    """(path, length, kind): csv, json or text by a file's first kilobyte; larger files than the limit are left out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= int(max_gb * (1 << 30)))
    head = F.decode(F.substring("content", 1, 1024), "UTF-8")
    first = F.element_at(F.split(head, "\n"), 1)
    kind = F.when(F.ltrim(head).rlike(r"^[\[{]"), "json").when(first.rlike(r"[,\t|;]"), "csv").otherwise("text")
    return files.select("path", "length", kind.alias("kind"))


def text_tokens(df: DataFrame, key: str, text: str, max_values: int) -> DataFrame:
    """(key, token): a text's words of four letters or more that aren't stop words, once each as first written."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\b[a-zA-Z]{4,}\b"), F.lit(0))
    each = df.select(key, F.posexplode(found).alias("pos", "token")).where(~F.lower("token").isin(STOP_WORDS))
    first = each.groupBy(key, F.lower("token").alias("lower")).agg(F.min_by("token", "pos").alias("token"), F.min("pos").alias("pos"))
    from pyspark.sql import Window

    return first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_r") <= max_values).select(key, "token")


def admitted(df: DataFrame) -> DataFrame | None:
    """The columns with usable names; nothing of a table of fewer than two rows."""
    import re

    if len(df.limit(2).collect()) < 2:
        return None
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not re.fullmatch(r"column\d+", c) and len(c) <= 255))


#: Readers by source type; more can be added.
READERS: dict[str, Callable[..., DataFrame]] = {"csv": csv, "json": json_rows, "socrata": socrata, "geojson": geojson, "parquet": parquet, "postgres": jdbc, "mysql": jdbc, "sqlserver": jdbc, "hive": hive}


def read(spark: SparkSession, source: SourceConfig) -> DataFrame:
    if source.source_type not in READERS:
        raise ValueError(f"unknown source type {source.source_type!r}")
    return READERS[source.source_type](spark, **source.config)


def files_under(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the files below a folder of any file system that end in the suffix, in order."""
    start = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = start.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(start, True)
    found = []
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.lower().endswith(suffix):
            found.append(path)
    return sorted(found)


#: Source types whose path may be a folder of which each file is a table, and what their files end in.
FILES = {"csv": ".csv", "json": ".json", "socrata": ".json", "geojson": ".geojson"}


def discover(spark: SparkSession, sources: list[SourceConfig]) -> Iterator[tuple[str, str, DataFrame]]:
    """(database, table, frame) of all tables of all sources. An unknown type is an error before anything is read; a
    file that can't be read, or has fewer than two rows, is left out with a warning."""
    unknown = [s.source_type for s in sources if s.source_type not in READERS]
    if unknown:
        raise ValueError(f"unknown source types {unknown}")

    def found():
        for source in sources:
            path, suffix = source.config.get("path", ""), FILES.get(source.source_type)
            paths = [path] if suffix is None or path.lower().endswith(suffix) else files_under(spark, path, suffix)
            for at in paths:
                config = {**source.config, "path": at} if at else source.config
                try:
                    frame = admitted(READERS[source.source_type](spark, **config))
                except PySparkException as error:
                    warnings.warn(f"{at or source.name} is left out: {type(error).__name__}", stacklevel=2)
                    continue
                if frame is None:
                    warnings.warn(f"{at or source.name} is left out: fewer than two rows", stacklevel=2)
                else:
                    yield source.name, at.rsplit("/", 1)[-1] if at else config.get("table", source.name), frame

    return found()


def combined(first: DataFrame, sampled_from: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """(uri): all of the first list and as many of the second as are missing to the total, in an order that only the
    seed decides. The sample is of the rows with the smallest hashes, so a lost task can't change it."""
    missing = max(0, total - first.count())
    order = F.xxhash64(F.lit(seed), "uri")
    more = sampled_from.select("uri").orderBy(order, "uri").limit(missing)
    return first.select("uri").union(more).orderBy(F.xxhash64(F.lit(seed + 1), "uri"), "uri")
