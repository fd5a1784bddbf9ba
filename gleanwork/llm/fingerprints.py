"""Canonical exact fingerprints, with DataFrame functions only.

A text's canonical form is NFKC, full case folding, NFKC again, then every run
of white space as one space and none at the ends. Its digest is four 64-bit
xxhash lanes. Equal canonical forms have equal digests; where one digest holds
canonical forms that differ byte for byte, they get the digest and a rank, so
fingerprints are equal exactly where canonical forms are.

Null texts are empty texts. A null id counts as the largest id. Rows may repeat;
of equal ids the order is that of a hash of the text, so ties have a fixed order. A
very long text is one value in every stage. Rows of one id are in one range, which
Spark sorts outside memory where it must. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, cut
from .common import keyed, public_id

LANES = 4
ROWS_PER_RANGE = 2_048
MAX_RANGES = 65_536


def canonical(text: Column) -> Column:
    def icu(name: str, method: str, value: Column) -> Column:
        return F.reflect(F.lit(name), F.lit(method), value, F.lit(True))

    composed = icu("com.ibm.icu.text.Normalizer", "compose", text)
    folded = icu("com.ibm.icu.lang.UCharacter", "foldCase", composed)
    again = icu("com.ibm.icu.text.Normalizer", "compose", folded)
    return F.trim(F.regexp_replace(again, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+", " "))


def digest(canon: Column, bits: int = 64) -> Column:
    """`bits`: of each lane that count; fewer only in tests, to force collisions."""
    lanes = [F.xxhash64(F.lit(lane), canon) for lane in range(LANES)]
    if bits < 64:
        lanes = [x.bitwiseAND(F.lit((1 << bits) - 1)) for x in lanes]
    return F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in lanes])


def buckets(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(digest, n_rows, first_kid, collided): the byte comparison inside equal digests.

    All forms of a digest are the same bytes if the least equals the greatest. Both
    are combined before the shuffle, so copies meet as one row for each task.
    """
    forms = keyed(docs).select("kid", canonical(F.col("text")).alias("canon")).select("kid", "canon", digest(F.col("canon"), bits).alias("digest"))
    return forms.groupBy("digest").agg(F.count("*").alias("n_rows"), F.min("kid").alias("first_kid"), (F.min("canon") != F.max("canon")).alias("collided"))


def _rank(forms: DataFrame, collided: DataFrame) -> DataFrame:
    """(digest, canon, rank) of the digests that hold several canonical forms."""
    some = forms.join(collided.select("digest"), "digest", "left_semi").groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    return some.select("digest", "canon", F.dense_rank().over(Window.partitionBy("digest").orderBy("canon")).alias("rank"))


def _suffixed(df: DataFrame, ranks: DataFrame | None, digest_col: str, canon_col: str, into: str) -> DataFrame:
    if ranks is None:
        return df.withColumn(into, F.col(digest_col))
    named = ranks.select(F.col("digest").alias(digest_col), F.col("canon").alias(canon_col), "rank")
    return df.join(named, [digest_col, canon_col], "left").withColumn(into, F.concat_ws("-", digest_col, F.col("rank").cast("string"))).drop("rank")


def fingerprint_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, group_size, first_id (least id of its group)."""
    forms = keyed(docs).select("kid", canonical(F.col("text")).alias("canon")).select("kid", "canon", digest(F.col("canon"), bits).alias("digest"))
    found = cut(buckets(docs, bits))
    collided = found.filter("collided")
    if collided.isEmpty():
        rows = forms.select("kid", F.col("digest").alias("fingerprint"))
        groups = found.select(F.col("digest").alias("fingerprint"), F.col("n_rows").alias("group_size"), F.col("first_kid"))
    else:
        rows = _suffixed(forms, _rank(forms, collided), "digest", "canon", "fingerprint").select("kid", "fingerprint")
        groups = rows.groupBy("fingerprint").agg(F.count("*").alias("group_size"), F.min("kid").alias("first_kid"))
    return rows.join(groups, "fingerprint").select(public_id(F.col("kid")).alias("doc_id"), "fingerprint", "group_size", public_id(F.col("first_kid")).alias("first_id"))


def _ranges(keys: DataFrame, rows_per_range: int) -> list[int]:
    """Upper ends, all of them ids that occur, of ranges with about that many rows."""
    n = keys.count()
    if not n:
        return []
    k = max(1, min(MAX_RANGES, n // rows_per_range))
    at = keys.agg(F.percentile_approx("kid", [i / k for i in range(1, k + 1)], max(10_000, 8 * k)).alias("p"), F.max("kid").alias("m")).first()
    return sorted({*at["p"], at["m"]})


def with_next(rows: DataFrame, carry: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows (kid, tid, ...) with next_<c> of the next row in descending kid, cyclic.

    Ids are cut into ranges. The largest id of a range, which follows the least of
    the range above, is sent there as a guest, so each range is complete alone.
    """
    ends = _ranges(rows.select("kid"), rows_per_range)
    if not ends:
        ends = [0]
    width = max(1, int(len(ends) ** 0.5))

    def longs(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s < F.col("kid")))

    block = below(longs([ends[min(i + width, len(ends)) - 1] for i in range(0, len(ends), width)]))
    found = rows.withColumn("_block", block).withColumn("_range", F.col("_block") * width + below(F.slice(longs(ends), F.col("_block") * width + 1, F.lit(width))))
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest"))
    above = F.struct(((F.col("_range") + 1) % len(ends)).alias("at"), F.lit(1).alias("guest"))
    is_end = F.element_at(longs(ends), F.col("_range") + 1) == F.col("kid")
    dealt = found.withColumn("_to", F.explode(F.when(is_end, F.array(own, above)).otherwise(F.array(own))))
    order = Window.partitionBy("_to.at").orderBy("_to.guest", F.desc("kid"), "tid")
    nexts = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return nexts.filter("_to.guest = 0").drop("_block", "_range", "_to")


def edit_probe(docs: DataFrame, bits: int = 64, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of each text and of its edited text; likeness is 1 for equal, else 0.

    An exact fingerprint knows no degrees: likeness is 1.0 where digests and then
    canonical bytes agree, else 0.0. Empty texts have the fingerprint of "". Digests
    are ranked where texts of the table collide; edited texts follow those ranks.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    collided = scratch.write(buckets(docs, bits).filter("collided").select("digest"), "collided")
    rows = keyed(docs).withColumn("_canon", canonical(F.col("text"))).withColumn("digest", digest(F.col("_canon"), bits)).drop("_canon")
    both = with_next(rows, ["text", "digest"], rows_per_range)
    n = F.char_length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("_k", F.floor(F.col("n_chars") / 3).cast("int"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _k)"), F.expr("substring(next_text, 1, _k)")))
    both = both.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_digest", digest(F.col("edited_canon"), bits))

    def like(other_digest: str, other_canon: Column) -> Column:
        return F.when(F.col("digest") != F.col(other_digest), 0.0).when(canonical(F.col("text")) == other_canon, 1.0).otherwise(0.0)

    both = both.withColumn("near_edited", like("edited_digest", F.col("edited_canon"))).withColumn("near_next", like("next_digest", canonical(F.col("next_text"))))
    ranks = None
    if not collided.isEmpty():
        both = both.withColumn("canon", canonical(F.col("text")))
        forms = both.select("digest", "canon").union(both.select("edited_digest", "edited_canon").toDF("digest", "canon"))
        ranks = cut(_rank(forms, collided))
    scratch.close()
    both = _suffixed(_suffixed(both, ranks, "digest", "canon", "fingerprint"), ranks, "edited_digest", "edited_canon", "edited_fingerprint")
    return both.select(
        public_id(F.col("kid")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
