"""Readers of hits, payloads, logs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import HITS


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Recorded search results as JSON lines or Parquet."""
    reader = spark.read.schema(HITS)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def latest_log(spark: SparkSession, folder: str) -> str | None:
    """The newest *.log of a folder, by time of change; None without one."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return files.select("path", "modificationTime").agg(F.max_by("path", "modificationTime")).first()[0]  # names and times alone are read


def parse_log(lines: DataFrame) -> DataFrame:
    """(ts, level, logger, message); all null but the message for continuation lines."""
    parts = r"^(\S+(?: \S+)?) \| (\w+) \| ([^|]+) \| (.*)$"
    is_record = F.col("value").rlike(parts)
    field = lambda i: F.when(is_record, F.regexp_extract("value", parts, i))
    return lines.select(field(1).alias("ts"), field(2).alias("level"), field(3).alias("logger"), F.when(is_record, F.regexp_extract("value", parts, 4)).otherwise(F.col("value")).alias("message"))


class _Query(InputPartition):
    def __init__(self, rank: int, query: str):
        super().__init__(rank)
        self.rank, self.query = rank, query


class _SearchReader(DataSourceReader):
    def __init__(self, queries: list[str], provider, n: int):
        self.queries, self.provider, self.n = queries, provider, n

    def partitions(self):
        return [_Query(i, q) for i, q in enumerate(self.queries)]

    def read(self, partition):
        for i, url in enumerate(self.provider(partition.query, self.n)[: self.n]):
            yield partition.rank, partition.query, i, url


def search_source(provider, n: int) -> type[DataSource]:
    """A data source `search` over provider(query, n) -> URLs, a partition for each query.

    Queries are the option `queries`, one in a line. Register with spark.dataSource.register().
    """

    class SearchSource(DataSource):
        @classmethod
        def name(cls):
            return "search"

        def schema(self):
            return HITS

        def reader(self, schema):
            return _SearchReader([q for q in self.options.get("queries", "").split("\n") if q], provider, n)

    return SearchSource
