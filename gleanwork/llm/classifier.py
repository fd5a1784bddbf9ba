"""A quality classifier: random Fourier features of document statistics, ridge, isotonic.

Statistics of a text alone are its inputs. They are standardised with fixed
centres and scales, mapped to random Fourier features of a Gaussian kernel, and
fitted by ridge regression from normal equations that each partition sums. The
sums are integers (features are rounded to 2**-14), so neither the order of
tasks nor a task that runs twice changes a weight. Rows that the fit doesn't
use give the isotonic map from margin to probability.

Null texts are empty texts, which get a score like any other. Labels of ids
without documents, null labels and null ids count for nothing; of a repeated id
each row counts. Without any usable label every score is 0.5. Equal texts have
equal scores. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import batch_of, slices, utf8
from .textstats import base_counts

N_FEATURES = 384
GAMMA = 0.04
RIDGE = 1.0
SEED = 7
BINS = 1_024
MARGIN = 0.5  # margins outside -0.5 .. 1.5 share the first and the last bin
GRAIN = 1 << 14
#: Rows with labels that a fit reads at most. Beyond it, a hash of the id picks about so many.
MAX_LABELLED = 2_000_000

# Centre and scale of each statistic.
STATISTICS = {
    "log_words": (5.5, 1.2), "mean_size": (5.5, 0.8), "spread_size": (3.6, 0.8), "upper": (0.03, 0.08), "digits": (0.0, 0.02), "symbols": (0.0, 0.05),
    "marks": (0.025, 0.02), "bangs": (0.0, 0.03), "bars": (0.0, 0.03), "wide": (0.03, 0.05), "distinct": (0.8, 0.12), "short": (0.4, 0.1), "long": (0.06, 0.05),
    "dup_lines": (0.0, 0.15), "repeats": (0.0, 0.15), "closed": (0.9, 0.2), "line_words": (3.2, 0.8),
}
VECTOR = pa.schema([("doc_id", pa.int64()), ("vector", pa.list_(pa.float32()))])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Standardised statistics, a row for each text, clipped to -4 .. 4."""
    c = base_counts(data, offsets)
    words, size, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    mean = c["word_chars"] / words
    raw = {
        "log_words": np.log(words), "mean_size": mean, "spread_size": np.sqrt(np.maximum(c["sum_square"] / words - mean * mean, 0)), "upper": c["n_upper"] / size,
        "digits": c["n_digits"] / size, "symbols": c["n_symbols"] / size, "marks": c["n_marks"] / size, "bangs": c["n_bangs"] / size, "bars": c["n_bars"] / size,
        "wide": c["n_wide"] / size, "distinct": c["n_distinct"] / words, "short": c["n_short"] / words, "long": c["n_long"] / words, "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words, "closed": c["n_closed"] / lines, "line_words": np.log1p(words / lines),
    }
    return np.column_stack([np.clip((raw[k] - centre) / scale, -4, 4) for k, (centre, scale) in STATISTICS.items()])


def projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.normal(0, math.sqrt(2 * GAMMA), (len(STATISTICS), N_FEATURES)), rng.uniform(0, 2 * math.pi, N_FEATURES)


def fourier(x: np.ndarray) -> np.ndarray:
    """cos(xW + b) and a constant, on the grain."""
    w, b = projection()
    z = np.cos(x @ w + b)
    return np.rint(np.column_stack([z, np.ones(len(x))]) * GRAIN) / GRAIN


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel(), pa.float32()))
            yield batch_of(VECTOR, doc_id=batch.column(0), vector=lists)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, vector array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def normal_equations(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of rows (vector, label): a fixed number of sums, whatever the rows."""
    d = N_FEATURES + 1
    upper = np.triu_indices(d)

    def run(batches):
        zz, zy = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if len(batch):
                z = np.rint(fourier(_matrix(batch.column(0))) * GRAIN)
                zz += z.T @ z  # exact: integers below 2**53 for 2**25 rows
                zy += z.T @ np.asarray(batch.column(1), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + d)), pa.array(np.rint(np.concatenate([zz[upper], zy * GRAIN]) / GRAIN).astype(np.int64))], names=["at", "value"])

    found = rows.select("vector", F.col("label").cast("double")).mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(len(upper[0]) + d)
    flat[found["at"].to_numpy()] = found["value"].to_numpy() / GRAIN
    zz = np.zeros((d, d))
    zz[upper] = flat[: len(upper[0])]
    return zz + np.triu(zz, 1).T, flat[len(upper[0]) :]


def pool_adjacent(labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to labels / counts, by least squares."""
    out: list[list[float]] = []
    for y, n in zip(labels, counts, strict=True):
        out.append([y, n, 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            y2, n2, k2 = out.pop()
            out[-1] = [out[-1][0] + y2, out[-1][1] + n2, out[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for y, n, k in out]) if out else np.zeros(0)


def _bin(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + MARGIN) / (1 + 2 * MARGIN) * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the map from margin to probability, from sums over a fixed number of bins."""

    def run(batches):
        for batch in batches:
            if len(batch):
                b = _bin(fourier(_matrix(batch.column(0))) @ weights)
                y = np.asarray(batch.column(1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(np.bincount(b, minlength=BINS)), pa.array(np.bincount(b, y, BINS).astype(np.int64))], names=["bin", "n", "y"])

    found = rows.select("vector", F.col("label").cast("long")).mapInArrow(run, "bin long, n long, y long").filter("n > 0").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").toPandas()
    if not len(found):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    n, y = found["n"].to_numpy(float), found["y"].to_numpy(float)
    level = pool_adjacent(y, n)
    at = (found["bin"].to_numpy() + 0.5) / BINS * (1 + 2 * MARGIN) - MARGIN
    # one knot for each level, at the mean margin of its bins; between knots a straight line
    same = np.concatenate([[0], np.cumsum(np.diff(level) > 0)])
    total = np.bincount(same, n)
    return np.bincount(same, at * n) / total, np.maximum.accumulate((np.bincount(same, y) + 0.01) / (total + 0.02))


def score_documents(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.7, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    `train`: over doc_id, whether a label may be learned from. Every fourth of
    those ids, by hash, calibrates; the others fit the weights.
    """
    found = cut(vectors(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(train)
    n_known = known.count()
    if n_known > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) < F.lit(int(1_000_003 * max_labelled / n_known)))
    rows = cut(found.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))))
    zz, zy = normal_equations(rows.filter("fold > 0"))
    weights = np.linalg.solve(zz + RIDGE * np.eye(len(zy)), zy)
    knots, levels = isotonic(rows.filter("fold = 0"), weights)
    if not zz[-1, -1]:
        levels = np.full(len(knots), 0.5)

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1)) if len(batch) else np.zeros((0, len(STATISTICS)))
            score = np.interp(fourier(x) @ weights, knots, levels)
            yield batch_of(schema, doc_id=batch.column(0), score=pa.array(score), predicted=pa.array((score >= threshold).astype(np.int32)))

    return found.mapInArrow(run, "doc_id long, score double, predicted int")


def may_train(doc_id: Column) -> Column:
    """Whether the contract's fold lets labels of this id be learned."""
    return F.crc32(doc_id.cast("string")) % 4 != 2
