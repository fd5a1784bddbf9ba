"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells of source, language and topic. Raking scales the
tokens of cells until each dimension's shares meet their targets. A document is
kept with a probability of at most 1, the product of a multiplier for each of its
categories, such that the expected tokens meet the targets and a budget; cells at 1
stay there while the others are raked again. Where the targets can't be met within
the budget it is lowered, to LEAST_SHARE at most; mix_shares() tells the shares
wanted and expected. A hash of the id decides, so a run repeats.

Tokens are those of the byte-level vocabulary; words or a column of counts are
options. A topic is three majority bits over the hashes of a text's
words of five bytes or more, unless a topic column is given. Nulls in source,
language or topic are a category of their own; null texts are empty. Rows with
equal ids share one fate within a cell, and ties can't occur in a draw that depends on
the id alone. Documents without tokens are kept. A very long text counts as all its
tokens, which are found part by part. An empty table gives no rows. Columns of any name pass through mix() untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch, cut, fresh
from .common import slices, texts_of, utf8
from .textkit import digests, split_words, text_of_word
from .vocabularies import byte_vocabulary, vocabulary_path

TOPIC_BITS = 3
#: Powers of a category's own share: 1 keeps the shares, 0 makes them equal.
EXPONENTS = {"source": 0.7, "lang": 0.85, "topic": 0.85}
KEEP_SHARE = 0.8
#: Cells whose sums the driver holds; sums of more are held by the executors. Either way the steps
#: and where they stop are the same.
MAX_CELLS = 100_000
#: Raking ends when no category is further from its goal than this, relatively, or after so many rounds.
ROUNDS, TOLERANCE = 200, 1e-9
#: The budget is lowered to this share of the tokens at most; categories that are too small even then are kept whole.
LEAST_SHARE = 0.2
#: A budget's goals count as met at this relative distance.
REACHED = 1e-3
CELL_OPTIONS = ("text_col", "source_col", "lang_col", "topic_col", "tokens_col", "count_words", "json_path", "ranks_path", "added")
SEED = 11


def lexical_topics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and topic of each text."""
    starts, ends, first = split_words(data, offsets)
    long = ends - starts >= 5
    hashes = digests(data, starts[long], ends[long])[0]
    text = text_of_word(first)[long]
    topic = np.zeros(len(offsets) - 1, np.int64)
    for bit in range(TOPIC_BITS):
        votes = np.where((hashes >> np.uint64(60 - bit)) & np.uint64(1), 1, -1)
        topic += (np.bincount(text, votes, len(topic)) > 0).astype(np.int64) << bit
    return np.diff(first), topic


def with_cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens_col: str | None = None, count_words: bool = False, json_path: str | None = None, ranks_path: str | None = None, added: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns for source, lang, topic and tokens, and the names of these.

    Tokens are counted by the vocabulary, unless a column holds them (null is 0) or words shall count.
    """
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
    names = {}
    for k in ("source", "lang", "topic", "tokens"):
        names[k] = fresh(docs, f"_{k}_{len(names)}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["tokens"], T.LongType()), T.StructField(names["topic"], T.StringType())])

    def run(batches):
        vocabulary = None if tokens_col or count_words else byte_vocabulary(json_path, ranks_path, added)
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            parts = [lexical_topics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            tokens, topics = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))
            if vocabulary:
                tokens = [len(vocabulary.ids(text)) for text in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array([f"t{x}" for x in topics], pa.string())], names=[*batch.schema.names, names["tokens"], names["topic"]])

    out = docs.mapInArrow(run, schema)
    if tokens_col:
        out = out.withColumn(names["tokens"], F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)))
    for k, column in (("source", source_col), ("lang", lang_col), ("topic", topic_col)):
        if column:
            out = out.withColumn(names[k], F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null")))
    return out, names


def targets_of(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raised = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells (a column for each dimension, and tokens) whose shares meet the targets.

    A target for a category without tokens is left out and the rest scaled up.
    """
    weight = cells["tokens"].to_numpy(float).copy()
    if not weight.sum():
        return weight
    total = weight.sum()
    codes, wanted = {}, {}
    for dim, target in targets.items():
        codes[dim], names = pd.factorize(cells[dim])
        has = np.bincount(codes[dim], weight) > 0
        share = np.array([target.get(k, 0.0) for k in names]) * has
        wanted[dim] = share / share.sum() * total if share.sum() else np.bincount(codes[dim], weight)
    for _ in range(rounds):
        worst = 0.0
        for dim in targets:
            now = np.bincount(codes[dim], weight)
            factor = np.divide(wanted[dim], now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0.0)))
            weight *= factor[codes[dim]]
        if worst < tolerance:
            break
    return weight


def probabilities(tokens: np.ndarray, weight: np.ndarray, keep_share: float = KEEP_SHARE) -> np.ndarray:
    """min(1, s * weight / tokens) with s such that the expected tokens are the share."""
    factor = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    low, high, goal = 0.0, 1.0, keep_share * tokens[factor > 0].sum()
    if not goal:
        return np.ones(len(tokens))
    while (np.minimum(1, high * factor) * tokens).sum() < goal and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * factor) * tokens).sum() < goal else (low, mid)
    return np.where(tokens > 0, np.minimum(1, high * factor), 1.0)


def full_at(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """min(tokens, x * share) of the categories of a dimension, with x such that they sum up to the budget."""
    capped = np.zeros(len(tokens), bool)
    while True:
        rest = share[~capped].sum()
        goal = np.where(capped, tokens, share * (max(0.0, budget - tokens[capped].sum()) / rest if rest else 0.0))
        more = ~capped & (goal > tokens * (1 + 1e-12))
        if not more.any():
            return goal
        capped |= more


def step(want, full, free, whole):
    """What brings a category's expected tokens to `want`: by the tangent, or from below if that leads nowhere."""
    up = (want > full) & (free > 0)
    by_tangent = np.divide(want - full, free, out=np.ones_like(want), where=up)
    return np.where(up, by_tangent, np.where(want < full, np.divide(want, whole, out=np.ones_like(want), where=whole > 0), 1.0))


def calibrate(cells: pd.DataFrame, targets: dict[str, dict[str, float]], weight: np.ndarray, budget: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Probabilities min(1, product of a multiplier for each category) whose expected tokens meet targets and budget.

    Cells at 1 stay there and the others are raked again. Starts from the raked
    weights. Also returns the largest relative distance from a category's goal.
    """
    tokens = cells["tokens"].to_numpy(float)
    rate = np.divide(weight * (budget / max(1.0, weight.sum())), tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    codes, want = {}, {}
    for dim, target in targets.items():
        codes[dim], names = pd.factorize(cells[dim])
        have = np.bincount(codes[dim], tokens)
        share = np.array([target.get(k, 0.0) for k in names]) * (have > 0)
        want[dim] = full_at(have, share if share.sum() else have, budget)
    def distance() -> float:
        kept = np.minimum(1, rate) * tokens
        return max((float((np.abs(np.bincount(codes[d], kept, len(want[d])) - want[d])[want[d] > 0] / want[d][want[d] > 0]).max(initial=0.0)) for d in targets), default=0.0)

    for _ in range(rounds):
        for dim in targets:
            at = rate >= 1
            sums_of = lambda x: np.bincount(codes[dim], x, len(want[dim]))  # noqa: B023, E731
            rate *= step(want[dim], sums_of(tokens * at), sums_of(tokens * rate * ~at), sums_of(tokens * rate))[codes[dim]]
        if (worst := distance()) < TOLERANCE:
            break
    return np.where(tokens > 0, np.minimum(1, rate), 1.0), worst


def budgets(total: float, room: float, safe: float, keep_share: float, least_share: float) -> list[float]:
    """Expected tokens to try, largest first: the whole budget or as much as every category has room for, then what clips no cell."""
    first = min(keep_share * total, max(room, least_share * total))
    second = min(first, max(safe, least_share * total))
    return [first] if second >= first else [first, second]


def goals(cells: DataFrame, dim: str, exponent: float, given: dict[str, float] | None = None) -> DataFrame:
    """(category, tokens, target share) of a dimension, of categories with tokens."""
    have = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have")).filter("have > 0")
    if given is None:
        total = have.agg(F.sum("have")).first()[0] or 1.0
        share = have.withColumn("p", F.pow(F.col("have") / F.lit(total), F.lit(exponent)))
    else:
        weights = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, p double")
        share = have.join(weights, dim, "left").na.fill(0.0, ["p"])
    share = cut(share)
    every, whole = share.agg(F.sum("p"), F.sum("have")).first()
    return share.select(dim, "have", (F.col("p") / F.lit(every) if every else F.col("have") / F.lit(whole or 1.0)).alias("share"))


def rake_on_executors(cells: DataFrame, wanted: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The same raking by aggregations, for more cells than a driver should hold.

    `wanted`: goals() by dimension. Adds the column weight.
    """
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("weight")).first()[0] or 0.0
    with Scratch(cells.sparkSession, "raking") as scratch:
        for n in range(rounds):
            worst = 0.0
            for dim, goal in wanted.items():
                now = cells.groupBy(dim).agg(F.sum("weight").alias("now")).join(goal, dim).select(dim, F.try_divide(F.col("share") * total, "now").alias("f"))
                now = scratch.write(now, f"{n}-{dim}-f")
                worst = max(worst, now.agg(F.max(F.abs(F.col("f") - 1))).first()[0] or 0.0)
                cells = scratch.write(cells.join(now, dim, "left").withColumn("weight", F.col("weight") * F.coalesce("f", F.lit(1.0))).drop("f"), f"{n}-{dim}")
            if worst < TOLERANCE:
                break
            if n:
                scratch.drop(*[f"{n - 1}-{d}{x}" for d in wanted for x in ("", "-f")])
        return cut(cells)


def calibrate_on_executors(cells: DataFrame, wanted: dict[str, DataFrame], budget: float, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """calibrate() by aggregations. Adds the column probability."""
    scale = budget / max(1.0, cells.agg(F.sum("weight")).first()[0] or 0.0)
    cells = cells.withColumn("rate", F.coalesce(F.try_divide(F.col("weight") * scale, "tokens"), F.lit(0.0)))
    want = {}
    for dim, goal in wanted.items():
        goal, capped = goal.withColumn("capped", F.lit(False)), -1
        while True:
            rest, taken, n = goal.agg(F.sum(F.when(~F.col("capped"), F.col("share"))), F.sum(F.when(F.col("capped"), F.col("have"))), F.sum(F.col("capped").cast("long"))).first()
            x = max(0.0, budget - (taken or 0.0)) / rest if rest else 0.0
            goal = goal.withColumn("want", F.when(F.col("capped"), F.col("have")).otherwise(F.col("share") * x))
            if n == capped:
                break
            capped = n
            goal = cut(goal.withColumn("capped", F.col("capped") | (F.col("want") > F.col("have") * (1 + 1e-12))))
        want[dim] = cut(goal.select(dim, "want"))
    t, r = F.col("tokens"), F.col("rate")
    with Scratch(cells.sparkSession, "calibration") as scratch:
        for n in range(rounds):
            for dim in want:
                now = cells.groupBy(dim).agg(F.sum(F.when(r >= 1, t).otherwise(0)).alias("full"), F.sum(F.when(r < 1, t * r).otherwise(0.0)).alias("free"), F.sum(t * r).alias("whole")).join(want[dim], dim)
                f = F.when((F.col("want") > F.col("full")) & (F.col("free") > 0), F.try_divide(F.col("want") - F.col("full"), "free")).when(F.col("want") < F.col("full"), F.try_divide("want", "whole"))
                now = scratch.write(now.select(dim, f.alias("f")), f"{n}-{dim}-f")
                cells = scratch.write(cells.join(now, dim, "left").withColumn("rate", r * F.coalesce("f", F.lit(1.0))).drop("f"), f"{n}-{dim}")
            far = [cells.groupBy(d).agg(F.sum(t * F.least(F.lit(1.0), r)).alias("kept")).join(want[d], d).agg(F.max(F.when(F.col("want") > 0, F.try_divide(F.abs(F.col("kept") - F.col("want")), "want")))).first()[0] for d in want]
            if (worst := max([x or 0.0 for x in far], default=0.0)) < TOLERANCE:
                break
            if n:
                scratch.drop(*[f"{n - 1}-{d}{x}" for d in want for x in ("", "-f")])
        return cut(cells.withColumn("probability", F.when(t > 0, F.least(F.lit(1.0), r)).otherwise(1.0)).drop("rate")), worst


def named(targets: dict[str, dict] | None, lexical: bool) -> dict[str, dict[str, float]]:
    """Targets by the names of categories in cells; the key None is null."""
    plain = lambda d, k: "null" if k is None else k if lexical and d == "topic" else f"={k}"
    return {d: {plain(d, k): float(v) for k, v in t.items()} for d, t in (targets or {}).items()}


def cells_of(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return cut(found.groupBy(*[F.col(names[d]).alias(d) for d in EXPONENTS]).agg(F.sum(names["tokens"]).alias("tokens")))


def cell_probabilities(found: DataFrame, names: dict[str, str], exponents: dict[str, float] | None = None, keep_share: float = KEEP_SHARE, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, lang, topic, weight, probability) of every cell. `targets`: from named()."""
    exponents, targets = exponents or EXPONENTS, targets or {}
    dims = list(exponents)
    spark = found.sparkSession
    cells = cells_of(found, names)
    n = cells.count()
    if n <= max_cells:
        here = cells.orderBy(*dims).toPandas()
        total = max(1, here["tokens"].sum())
        have = {d: here.groupby(d)["tokens"].sum() for d in dims}
        wanted = {d: targets_of((have[d] / total).to_dict(), exponents[d]) if d not in targets else targets[d] for d in dims}
        here["weight"] = rake(here, wanted, rounds)
        tokens, weight = here["tokens"].to_numpy(float), here["weight"].to_numpy(float)
        room = float("inf")
        for d in dims:
            share = pd.Series(wanted[d], dtype=float).reindex(have[d].index).fillna(0.0) * (have[d] > 0)
            share = share[share > 0] / max(share.sum(), 1e-300)
            room = min(room, (have[d][share.index] / share).min()) if len(share) else room
        some = tokens[weight > 0]
        factor = weight[weight > 0] / some
        tried = budgets(some.sum(), room, weight.sum() / factor.max() if len(some) else 0.0, keep_share, least_share)
        for budget in tried:
            here["probability"], far = calibrate(here, wanted, weight, budget, rounds)
            if far < REACHED:
                break
        rows = [tuple(r) for r in here[[*dims, "tokens", "weight", "probability"]].itertuples(index=False)]
        return spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", tokens long, weight double, probability double").hint("broadcast")
    wanted = {d: goals(cells, d, exponents[d], targets.get(d)) for d in dims}
    cells = rake_on_executors(cells, wanted, rounds)
    room = min((x for d in dims if (x := wanted[d].filter("share > 0").agg(F.min(F.col("have") / F.col("share"))).first()[0]) is not None), default=float("inf"))
    some, weight, most = cells.filter("weight > 0").agg(F.sum("tokens"), F.sum("weight"), F.max(F.col("weight") / F.col("tokens"))).first()
    for budget in budgets(float(some or 0), room, weight / most if most else 0.0, keep_share, least_share):
        out, far = calibrate_on_executors(cells, wanted, budget, rounds)
        if far < REACHED:
            break
    return out


def mix_shares(docs: DataFrame, exponents: dict[str, float] | None = None, targets: dict[str, dict] | None = None, **options) -> DataFrame:
    """One row per category with tokens: dim, category, and its shares: own, target, and expected of what is kept."""
    cell_options = {k: options.pop(k) for k in CELL_OPTIONS if k in options}
    exponents, given = exponents or EXPONENTS, named(targets, not cell_options.get("topic_col"))
    found, names = with_cells(docs, **cell_options)
    found = cut(found.select(*[F.col(c).alias(k) for k, c in names.items()]))
    table = cut(cell_probabilities(found, {k: k for k in names}, exponents, targets=given, **options))
    every, every_kept = table.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    out = None
    for dim, exponent in exponents.items():
        kept = table.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("probability")).alias("kept"))
        rows = goals(table, dim, exponent, given.get(dim)).join(kept, dim)
        rows = rows.select(F.lit(dim).alias("dim"), F.col(dim).alias("category"), F.try_divide("have", F.lit(float(every or 0))).alias("own"), F.col("share").alias("target"), F.try_divide("kept", F.lit(every_kept or 0.0)).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, factor, probability, kept. Options as of mix()."""
    need = [c for c in dict.fromkeys([id_col, options.get("text_col", "text"), options.get("source_col", "source"), options.get("lang_col", "lang"), options.get("topic_col"), options.get("tokens_col")]) if c]
    cell_options = {k: options.pop(k) for k in CELL_OPTIONS if k in options}
    options["targets"] = named(options.get("targets"), not cell_options.get("topic_col"))
    found, names = with_cells(docs.select(*need), **cell_options)
    found = cut(found.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(k) for k, c in names.items()]))
    table = cell_probabilities(found, {k: k for k in names}, **options)
    joined = found.join(table.withColumnRenamed("tokens", "cell_tokens"), ["source", "lang", "topic"])
    return joined.select("doc_id", "source", "lang", "topic", "tokens", F.when(F.col("cell_tokens") > 0, F.col("weight") / F.col("cell_tokens")).otherwise(1.0).alias("factor"), "probability", drawn("doc_id", F.col("probability")).alias("kept"))


def drawn(id_col: str, probability):
    u = F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col(id_col).cast("long"), F.lit(-1))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return u < probability


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the draw keeps, with the columns of docs.

    `targets`: by dimension (source, lang, topic), the weight of each category, whose
    sum may be any; one that is not named has none, and its documents with tokens
    are dropped. A dimension without targets gets them from its exponent.
    """
    cell_options = {k: options.pop(k) for k in CELL_OPTIONS if k in options}
    options["targets"] = named(options.get("targets"), not cell_options.get("topic_col"))
    found, names = with_cells(docs, **cell_options)
    found = cut(found)  # the tokens of a text are counted once
    table = cell_probabilities(found, names, **options)
    keep = fresh(found, "_probability")
    joined = found.join(table.select(*[F.col(k).alias(names[k]) for k in ("source", "lang", "topic")], F.col("probability").alias(keep)), [names[k] for k in ("source", "lang", "topic")])
    return joined.filter(drawn(id_col, F.col(keep))).select(*docs.columns)
