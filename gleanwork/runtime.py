"""What every operator needs of a session: the package on executors, checkpoints, ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators rely on, where a session doesn't set it itself: shuffle files go when the
#: query that made them ends, as nothing reads them again, and a batch on its way to a Python
#: worker is bound by bytes, so that long texts don't add up.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}
#: Row groups of tables that are read again soon: a writer holds one of them in memory.
ROW_GROUP_BYTES = 16 << 20

_SENT: set[str] = set()
_OWN: dict[str, list[str]] = {}


def attach(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, and sets SETTINGS."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="gleanwork-")  # the driver's alone: Spark sends the file on
        atexit.register(shutil.rmtree, folder, True)
        path = Path(folder, f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SENT.add(sc.applicationId)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gleanwork-")
        atexit.register(shutil.rmtree, folder, True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, or that of the workspace it is in. It goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = [f"{checkpoint_folder(spark)}/gleanwork-{app}"]
        atexit.register(_discard, spark, _OWN[app][0])
    return _OWN[app][-1]


@contextmanager
def workspace(spark: SparkSession):
    """Removes the tables that were written within it: for whoever writes the results elsewhere before it ends."""
    folder = f"{own_folder(spark)}/space-{uuid.uuid4().hex}"
    kept = _OWN[spark.sparkContext.applicationId]
    kept.append(folder)
    try:
        yield
    finally:
        kept.remove(folder)
        delete(spark, folder)


def _discard(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM has ended before; the cluster cleans its folder
        pass


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes `df` as Parquet and returns the table: its lineage ends there, and its size is known."""
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of tables in the shared folder; drop() removes one, close() all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.made = spark, 0
        self.folder = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Computes `df` once and returns the written table."""
        return write_table(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        delete(self.spark, self.folder)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once into a table of the shared folder, for what is returned or used to the end."""
    return write_table(df, f"{own_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use yet (Spark compares them without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def global_rank(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Adds the 1-based position of each row in a total order, without one task for all rows.

    Rows are dealt by range and sorted within partitions; the counts of earlier
    partitions, one number for each, are added to the place within a partition.
    """
    at = fresh(df, "_at")
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for k, n in counts:
        before[k] = total
        total += n
    bases = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _base long")
    ranked = placed.join(bases, part == F.col("_part"))  # a row for each partition, whose size Spark knows
    return ranked.withColumn(into, F.col("_base") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_base", at)
