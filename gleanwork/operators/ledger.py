"""The decision ledger: an append-only Parquet table with unique URLs."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DISCARD
from ..functions.hashing import hash_prefix
from ..functions.media import mime_to_ext
from ..functions.text import slugify
from ..functions.url import url_stem
from ..runtime import cut, global_rank
from ..schemas import LEDGER
from .discovery import first_of, not_recorded


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; no rows where none is yet. Reading creates nothing."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def create_ledger(spark: SparkSession, table: str) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def new_rows(batch: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Insert or ignore: the first row of each URL that the ledger doesn't have. Null URLs never clash."""
    named, unnamed = batch.filter("url is not null"), batch.filter("url is null")
    return not_recorded(first_of(named, "url", order), ledger).unionByName(unnamed.select(*named.columns))


def append(batch: DataFrame, path: str, created_at: str, order: list[str]) -> DataFrame:
    """Appends new_rows() under ids that go on from the last, all or none, and returns them."""
    spark = batch.sparkSession
    ledger = read_ledger(spark, path)
    last = ledger.agg(F.max("id")).first()[0] or 0
    rows = global_rank(new_rows(batch, ledger, order), [F.col(c) for c in order], "_place")
    rows = rows.withColumn("id", F.col("_place") + last).withColumn("created_at", F.lit(created_at))
    rows = cut(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER]))
    rows.write.mode("append").parquet(path)
    return rows


def in_order(ledger: DataFrame) -> DataFrame:
    """Oldest first, without the id."""
    return ledger.orderBy("created_at", "id").drop("id")


def newest_kept(ledger: DataFrame, n: int) -> DataFrame:
    """Columns for an audit of the newest n kept rows with a file."""
    kept = ledger.filter(F.col("filepath").isNotNull() & (F.col("category") != DISCARD))
    return kept.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("filepath", "url", "category", "created_at")


def phashes(ledger: DataFrame) -> DataFrame:
    return ledger.filter("phash is not null and phash <> ''").select("phash")


def file_paths(kept: DataFrame, root: Column, taken: DataFrame | None = None) -> DataFrame:
    """Adds filepath: root/category/prefix_slug.ext, the extension by the content type.

    The prefix of the hash has 12 digits, and 4 more while an earlier row of the category
    or a file that is `taken` (filepath) has the same name. From (url, sha256,
    content_type, category, discovery_rank).
    """
    sizes = (12, 16, 20, 24)  # of hashes that agree in 24 digits the whole is used
    # written, as each step below would spell these names again
    named = cut(kept.withColumn("_slug", slugify(url_stem(F.col("url")))).withColumn("_ext", mime_to_ext(F.col("content_type"))))
    path = lambda prefix: F.concat_ws("/", root, "category", F.concat(prefix, F.lit("_"), "_slug", "_ext"))
    named = named.withColumn("_n", F.lit(None).cast("int")).withColumn("_paths", F.array(*[path(hash_prefix(F.col("sha256"), n)) for n in sizes]))
    if taken is not None:
        met = named.select("discovery_rank", F.explode("_paths").alias("filepath")).join(taken.select("filepath"), "filepath", "left_semi")
        named = named.join(met.groupBy("discovery_rank").agg(F.collect_set("filepath").alias("_taken")), "discovery_rank", "left")
    else:
        named = named.withColumn("_taken", F.lit(None).cast("array<string>"))
    named = cut(named)
    for i, n in enumerate(sizes):
        named = named.withColumn("_path", F.col("_paths")[i])
        free = F.col("_n").isNull() & ~F.coalesce(F.array_contains("_taken", F.col("_path")), F.lit(False))
        first = Window.partitionBy("_path", free).orderBy("discovery_rank")
        named = named.withColumn("_n", F.when(free & (F.row_number().over(first) == 1), n).otherwise(F.col("_n")))
    digits = F.coalesce("_n", F.lit(64))
    return named.withColumn("filepath", path(F.substring("sha256", F.lit(1), digits))).select(*kept.columns, "filepath")


def write_blobs(kept: DataFrame, payloads: DataFrame, folder: str) -> None:
    """Bytes of kept rows as a table with a folder for each category; bytes join late, by URL."""
    kept.select("url", "category", "filepath").join(payloads.select("url", "content"), "url").write.mode("append").partitionBy("category").parquet(folder)


def save_files(kept: DataFrame, payloads: DataFrame) -> None:
    """Bytes of kept rows as files under their filepath, in folders that all executors mount."""

    def save(rows):
        for row in rows:
            target = Path(row["filepath"])
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(row["content"])

    kept.select("url", "filepath").join(payloads.select("url", "content"), "url").foreachPartition(save)


def manifest_items(ledger: DataFrame) -> DataFrame:
    """(created_at, url, item) in ledger order: a JSON object for each row."""
    fields = [f.name for f in LEDGER if f.name != "id"]
    item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return ledger.orderBy("created_at", "id").select("created_at", "url", item.alias("item"))


def write_manifest_table(ledger: DataFrame, path: str) -> None:
    """The items as JSON lines in many files, written by the executors: the form for large ledgers."""
    fields = [f.name for f in LEDGER if f.name != "id"]
    ledger.orderBy("created_at", "id").select(*fields).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(ledger: DataFrame, path: str, generated_at: str) -> int:
    """{generated_at, count, items}: rows stream to the driver's one file, a partition at a time. See write_manifest_table()."""
    count = ledger.count()
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{\n  "generated_at": "{generated_at}",\n  "count": {count},\n  "items": [')
        for i, row in enumerate(manifest_items(ledger).toLocalIterator()):
            out.write(("," if i else "") + "\n    " + row["item"])
        out.write("\n  ]\n}\n")
    return count
