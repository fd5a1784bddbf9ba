"""Near-duplicate documents by BagMinHash signatures and verified multiset overlap.

A document is the multiset of its shingles of five words (of all its words, if
it has fewer). Two documents are linked if their weighted Jaccard similarity is
at least 0.8; classes are the connected components of links. Documents of the
same words are one text, which is compared once.

Signatures: an element of weight w owns the levels 0..w of an axis, cut at the
powers of two. Each cut interval has a Poisson process of points whose rate is
its length; a point has a time, a slot and, by halving the interval again and
again, a level. Points over the weight don't count. Each slot keeps its first
point, so two signatures agree in a slot with a probability that is the weighted
Jaccard similarity. Points after the last slot's first are never made.

Texts that share a band of slots are candidates. Each is first verified against
the centre of its bucket, the text that meets most others in all its buckets: the
original of a group of copies meets more of them than they meet each other. Of buckets in which texts of several components
remain, the texts are then joined by an exact prefix filter: in an order of all
elements, the rarer first, two texts alike enough share one of their first
elements, and what follows it suffices. Pairs that the filter can't exclude, of
different components, are verified. So neither a frequent passage nor a group of
texts alike makes pairs of all its texts.

Null texts are empty. A document without words is a class of its own. A null id
is the largest id; of equal texts in a class the least id names it, so ties don't
matter. Repeated rows fall into one class. A very long text is one row of all
stages, with memory in proportion to it. An empty table gives no rows.
near_duplicates() ignores other columns; keep_first() returns them untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, cut, fresh
from .common import batch_of, keyed, public_id, slices, utf8
from .components import components
from .textkit import digests, inside, mix, split_words, text_digests, text_of_word, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares one of 36 bands of 6 slots but for 2 in 100,000.
BANDS, ROWS = 36, 6
#: Counters by which the prefix filter tells rare elements; any number gives the same links.
COUNTERS = 1 << 16
_U = np.uint64

SIGNED = pa.schema([("kid", pa.int64()), ("tid", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])
NODES = pa.schema([("id", pa.int64()), ("payload", pa.binary())])
PREFIXES = pa.schema([("element", pa.int64()), ("id", pa.int64()), ("comp", pa.int64()), ("size", pa.int32()), ("rest", pa.int32())])


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, hash, weight) of distinct shingles by text and hash, words of each text, and a digest of their sequence."""
    starts, ends, first = split_words(data, offsets)
    both = digests(data, starts, ends)
    words = both[0]
    n = np.diff(first)
    text = text_of_word(first)
    at = inside(first, k)
    owner, hashes = text[at], window_hashes(words, k)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = [window_hashes(words[first[i] : first[i + 1]], int(n[i]))[0] for i in few]
        owner, hashes = np.concatenate([owner, few]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(owner)))
    return owner[at], hashes[at], weight, n, text_digests(both, first)


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """A row of slots for each text: time (float32 bits) and identity of the first point."""
    signature = np.full(n_texts * slots, np.iinfo(np.uint64).max, np.uint64)
    # one row for each element and dyadic interval of levels that its weight reaches into
    roots = [(owner, hashes, weight, 0, 1)]
    low = 1
    while (some := weight > low).any():
        roots.append((owner[some], hashes[some], weight[some], low, 2 * low))
        low *= 2
    owner = np.concatenate([r[0] for r in roots])
    seed = np.concatenate([mix(r[1] ^ mix(np.full(len(r[1]), r[3] + 1, np.uint64))) for r in roots])
    weight = np.concatenate([r[2] for r in roots])
    low = np.concatenate([np.full(len(r[0]), r[3], np.int64) for r in roots])
    span = np.concatenate([np.full(len(r[0]), r[4] - r[3], np.int64) for r in roots])
    time, made, width = np.zeros(len(owner)), 0, 1
    while len(owner):
        step = (np.arange(made, made + width, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        u = mix(seed[:, None] + step)
        gaps = -np.log(((u >> _U(11)).astype(np.float64) + 1.0) / (1 << 53)) / span[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        v = mix(u ^ _U(0x2545F4914F6CDD1D))
        slot = ((v >> _U(40)) * _U(slots) >> _U(24)).astype(np.int64)
        level = low[:, None] + (v & (span[:, None] - 1).astype(np.uint64)).astype(np.int64)
        packed = (times.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (mix(v) >> _U(32))
        counts = level < weight[:, None]
        np.minimum.at(signature, (owner[:, None] * slots + slot)[counts], packed[counts])
        time, made = times[:, -1], made + width
        live = np.unique(owner)
        last = np.full(n_texts, 0, np.uint64)
        last[live] = signature.reshape(n_texts, slots)[live].max(axis=1)
        go = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) <= last[owner]
        owner, seed, weight, low, span, time = (x[go] for x in (owner, seed, weight, low, span, time))
        width = min(64, 2 * made) if len(owner) < 4_096 else 1
    return signature.reshape(n_texts, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band, which differs between bands."""
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        h = mix(h ^ parts[:, :, r])
    return h


def sign(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(kid, tid, node, bands) of rows (kid, tid, text): node is the digest of the words, bands are empty without words."""

    def run(batches):
        for batch in batches:
            kid, tid = batch.column(0), batch.column(1)
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                owner, hashes, weight, n, digest = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h = band_hashes(signatures(owner, hashes, weight, hi - lo, bands * rows), bands, rows)
                size = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[n > 0].ravel().view(np.int64)))
                yield batch_of(SIGNED, kid=kid.slice(lo, hi - lo), tid=tid.slice(lo, hi - lo), node=digest, bands=lists)

    return texts.mapInArrow(run, "kid long, tid long, node binary, bands array<long>")


def elements(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle is an element."""
    occurrence = np.arange(weight.sum(), dtype=np.int64) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.unique(mix(np.repeat(hashes, weight) + occurrence.astype(np.uint64) * _U(0x9FB21C651E98DF25)))


def payloads(texts: DataFrame) -> DataFrame:
    """(id, payload) of rows (id, text): the elements as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                owner, hashes, weight, _, _ = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                out = [elements(hashes[a:b], weight[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield batch_of(NODES, id=batch.column(0).slice(lo, hi - lo), payload=out)

    return texts.mapInArrow(run, "id long, payload binary")


def _elements_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def verify(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of rows (a, b, pa, pb, ...) those whose payloads are alike, without payloads."""
    rest = [c for c in pairs.columns if c not in ("pa", "pb")]

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_elements_of(batch.column(0)), _elements_of(batch.column(1)), strict=True):
                shared = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
                keep.append(bool(shared >= similarity * (len(x) + len(y) - shared) - 1e-9))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[2:]], names=rest)

    return pairs.select("pa", "pb", *rest).mapInArrow(run, ", ".join(f"{c} long" for c in rest))


def with_payloads(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Adds pa and pb to pairs (a, b, ...)."""
    pairs = pairs.join(payload.select(F.col("id").alias("b"), F.col("payload").alias("pb")), "b")
    return pairs.join(payload.select(F.col("id").alias("a"), F.col("payload").alias("pa")), "a")


def element_counts(payload: DataFrame) -> np.ndarray:
    """How many elements fall on each counter, summed by partitions: a fixed number of sums."""
    shift = _U(64 - COUNTERS.bit_length() + 1)

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in _elements_of(batch.column(0)):
                total += np.bincount(x >> shift, minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    found = payload.select("payload").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(rows: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(element, id, comp, size, rest) of the first elements of rows (id, comp, payload), the rarer first.

    rest: how many elements follow. Of n elements the first n - ceil(similarity * n) + 1
    hold one of any set that is alike enough.
    """
    shift = _U(64 - COUNTERS.bit_length() + 1)

    def run(batches):
        for batch in batches:
            sets = _elements_of(batch.column(2))
            size = np.array([len(x) for x in sets], np.int64)
            first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            every = [x[np.lexsort((x, counts[x >> shift]))[:n]] for x, n in zip(sets, first, strict=True)]
            row = np.repeat(np.arange(len(sets)), first)
            place = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first)
            flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
            yield batch_of(PREFIXES, element=pa.array(flat.view(np.int64)), id=batch.column(0).take(pa.array(row)), comp=batch.column(1).take(pa.array(row)), size=pa.array(size[row], pa.int32()), rest=pa.array(size[row] - place - 1, pa.int32()))

    return rows.select("id", "comp", "payload").mapInArrow(run, "element long, id long, comp long, size int, rest int")


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b, ca, cb) of prefixes() in different components that size and place don't exclude."""
    side = lambda s: rows.select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "size", "rest")])
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    alike = (least >= similarity * most - 1e-9) & (1 + F.least("rest_a", "rest_b") >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    met = side("a").join(side("b"), "element").filter((F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & alike)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb")).distinct()


def centred(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, id, leader) of rows (band, id, n), n texts in a band: it is led by its text that meets most, the least id of them.

    Any leader gives the same classes; one that is linked to most others leaves the fewest to compare.
    """
    mates = met.groupBy("id").agg(F.sum("n").alias("mates"))
    leader = met.join(mates, "id").groupBy("band").agg(F.max_by("id", F.struct("mates", -F.col("id"))).alias("leader"))
    return met.join(scratch.write(leader, "leaders"), "band").select("band", "id", "leader")


def classes(buckets: DataFrame, payload: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, comp) of texts that a chain of links joins to another, comp the same for all of a class.

    buckets: (band, id, leader) of bands with several texts, see centred(); payload: (id, payload).
    """
    others = buckets.filter("id <> leader")
    first = others.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.write(verify(with_payloads(first, payload), similarity), "links")
    labels = components(links).withColumnsRenamed({"node": "id", "component": "comp"})

    # what remains: buckets whose other texts, all verified against the leader, are of several components
    labelled = scratch.write(others.join(labels, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp")), "labelled")
    mixed = scratch.write(labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band"), "mixed")
    rows = scratch.write(labelled.join(mixed, "band").select("id", "comp").distinct().join(payload, "id"), "rows")
    near = scratch.write(prefixes(rows, element_counts(rows), similarity), "prefixes")
    pairs = scratch.write(prefix_pairs(near, similarity), "pairs")
    more = scratch.write(verify(with_payloads(pairs, payload), similarity).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "more")
    if more.isEmpty():
        return labels
    joined = components(more).withColumnsRenamed({"node": "comp", "component": "new"})
    every = labels.unionByName(joined.select(F.col("comp").alias("id"), "comp")).distinct()
    return every.join(joined, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(kid, tid, class_kid, class_tid) of each row of docs: the least kid and tid of its class."""
    texts = keyed(docs, id_col, text_col)
    with Scratch(docs.sparkSession, "near") as scratch:
        signed = scratch.write(sign(texts, bands, rows), "signed")
        # one row for each distinct text; its number is fixed once it is written
        nodes = signed.groupBy("node").agg(F.min(F.struct("kid", "tid")).alias("first"), F.any_value("bands").alias("bands"))
        nodes = scratch.write(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
        flat = nodes.select("id", F.explode("bands").alias("band"))
        shared = scratch.write(flat.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        met = scratch.write(flat.join(shared, "band").select("band", "id", "n"), "met")
        buckets = scratch.write(centred(met, scratch), "buckets")
        wanted = scratch.write(buckets.select("id").distinct().join(nodes, "id").select("id", "first.kid", "first.tid"), "wanted")
        found = texts.join(wanted.hint("shuffle_hash"), ["kid", "tid"]).dropDuplicates(["kid", "tid"])
        payload = scratch.write(payloads(found.select("id", "text")), "payloads")
        labels = classes(buckets, payload, similarity, scratch)
        members = nodes.join(labels, "id", "left").select("node", "first", F.coalesce("comp", "id").alias("comp"))
        members = scratch.write(members, "members")
        least = scratch.write(members.groupBy("comp").agg(F.min("first").alias("least")), "least")
        named = scratch.write(members.join(least, "comp").select("node", "least"), "named")
        # texts without words have one node, but each is alone in its class
        out = signed.select("kid", "tid", "node", (F.size("bands") == 0).alias("bare")).join(named, "node")
        return cut(out.select("kid", "tid", *[F.when(F.col("bare"), F.col(c)).otherwise(F.col(f"least.{c}")).alias(f"class_{c}") for c in ("kid", "tid")]))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of its class)."""
    return classify(docs, **options).select(public_id(F.col("kid")).alias("doc_id"), public_id(F.col("class_kid")).alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each class: the one with the least id."""
    first = classify(docs.select(id_col, text_col), id_col, text_col, **options).filter("kid = class_kid and tid = class_tid")
    kid, tid, n = (fresh(docs, c) for c in ("_kid", "_tid", "_n"))
    first = cut(first.groupBy(F.col("kid").alias(kid), F.col("tid").alias(tid)).agg(F.count("*").alias(n)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumn(kid, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).withColumn(tid, F.xxhash64(text))
    once = named.join(first.filter(F.col(n) == 1).hint("shuffle_hash"), [kid, tid], "left_semi").select(*docs.columns)
    # of rows that repeat an id and its text one stays; copies meet as one row for each task
    row = fresh(docs, "_row")
    many = named.join(first.filter(F.col(n) > 1), [kid, tid], "left_semi")
    many = many.groupBy(kid, tid).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    return once.unionByName(many.select(f"{row}.*"))
