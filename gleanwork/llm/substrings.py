"""Substring deduplication by a log-structured index of window fingerprints.

A window is 13 consecutive words of one document. A word is removed if a window
over it also starts in a document with a smaller id. Windows are judged on the
input, not on what is left.

The fingerprint of a window is the least hash among its nine shingles of five
words, so equal windows have equal fingerprints and neighbours mostly share one:
a document has about a fifth as many as words. The index keeps sorted, immutable
runs in buckets: fingerprints with their owner, and the windows of fingerprints that
several documents have. A new batch becomes a run of its own, which is
merge-joined with the earlier ones without moving them. Where a fingerprint has
a second owner, the windows of both are compared by 128-bit digests of all their
words, and go into a run. Too many runs are compacted into one. A lasting index,
in a folder of its own, is opened again by later sessions.

Documents of equal words are compared by the digest of all their words, and
beyond the first only counted. Null texts have no words. A null id is the largest
id. Rows that repeat an id don't remove each other's words, so ties remove nothing.
A very long text is one row of every stage, with memory in proportion to it. An
empty table gives no rows. The report ignores other columns; remove_repeats()
returns them untouched.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, cut, delete, fresh
from .common import MAX_LONG, batch_of, public_id, slices, utf8
from .textkit import covered, digests, inside, mix, split_words, text_digests, text_of_word, window_hashes

WINDOW = 13
SHINGLE = 5
#: Batches of ascending ids that a call adds to its index, and runs that an add meets at most.
BATCHES = 3
MAX_RUNS = 1

ANCHORS = pa.schema([("rid", pa.int64()), ("kid", pa.int64()), ("copy", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64()))])
WINDOWS = pa.schema([("wa", pa.int64()), ("wb", pa.int64()), ("rid", pa.int64()), ("kid", pa.int64()), ("pos", pa.int32())])


def window_anchors(words: np.ndarray) -> np.ndarray:
    """For each WINDOW consecutive words the least hash of a shingle in them."""
    h = window_hashes(words, SHINGLE)
    reach = WINDOW - SHINGLE + 1
    n = len(h) - reach + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # running minima over 1, 2, 4, ... shingles
    size, least = 1, h
    while 2 * size <= reach:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[reach - size : reach - size + n])


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rid, kid, copy, n_words, anchors) of rows (rid, kid, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = split_words(part, cuts)
                words = digests(part, starts, ends)
                at, text = inside(first, WINDOW), text_of_word(first)
                found, owner = window_anchors(words[0]), text[at]
                found = found[at] if len(at) else np.zeros(0, np.uint64)
                # neighbours share an anchor: keep it once, then once for each text
                new = np.ones(len(at), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                found, owner = found[new], owner[new]
                order = np.lexsort((found, owner))
                found, owner = found[order], owner[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                found, owner = found[new], owner[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(found.view(np.int64)))
                yield batch_of(ANCHORS, rid=batch.column(0).slice(lo, hi - lo), kid=batch.column(1).slice(lo, hi - lo), copy=text_digests(words, first), n_words=pa.array(np.diff(first)), anchors=lists)

    return rows.mapInArrow(run, "rid long, kid long, copy binary, n_words long, anchors array<long>")


def windows(texts: DataFrame) -> DataFrame:
    """(wa, wb, rid, kid, pos) of the windows whose anchor is among a row's keys, from (rid, kid, text, keys)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            for lo, hi in slices(offsets, 2 << 20):
                part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = split_words(part, cuts)
                words = digests(part, starts, ends)
                at = inside(first, WINDOW)
                if not len(at):
                    continue
                owner = text_of_word(first)[at]
                keys = lists.slice(lo, hi - lo)
                key = mix(np.asarray(keys.flatten()).view(np.uint64) ^ mix(np.repeat(np.arange(hi - lo), np.asarray(keys.value_lengths())).astype(np.uint64)))
                hit = np.isin(mix(window_anchors(words[0])[at] ^ mix(owner.astype(np.uint64))), key)
                at, owner = at[hit], owner[hit]
                wa, wb = (window_hashes(w, WINDOW)[at] for w in words)
                rid, kid = (np.asarray(batch.column(i).slice(lo, hi - lo))[owner] for i in (0, 1))
                yield batch_of(WINDOWS, wa=pa.array(wa.view(np.int64)), wb=pa.array(wb.view(np.int64)), rid=pa.array(rid), kid=pa.array(kid), pos=pa.array((at - first[:-1][owner]).astype(np.int32)))

    return texts.select("rid", "kid", "text", "keys").mapInArrow(run, "wa long, wb long, rid long, kid long, pos int")


class FingerprintIndex:
    """Runs in a folder of the shared store. `folder`: that of a lasting index, which may exist; else one that close() removes.

    keys-*     (key, rid, many): a fingerprint and its owner, or that it has several
    windows-*  (wa, wb, kid, most): windows of fingerprints with several owners, the least and the largest id
    copies-*   (copy, kid, first, n): the words of a whole text, the least id, a row of it, and how many rows
    texts-*    rows of each batch under their number rid; these are not compacted

    A run counts from the moment that a file names it, so an add that fails leaves the
    index as it was.
    """

    BY = {"keys": ["key"], "windows": ["wa", "wb"], "copies": ["copy"], "texts": ["rid"]}

    def __init__(self, spark: SparkSession, folder: str | None = None, max_runs: int = MAX_RUNS, buckets: int | None = None):
        self.spark, self.max_runs, self.lasting = spark, max_runs, folder is not None
        self.work = Scratch(spark, "substrings")
        self.folder = folder.rstrip("/") if folder else f"{self.work.folder}/index"
        self.name = f"gleanwork_{uuid.uuid4().hex}"
        self.tables: dict[str, DataFrame] = {}
        state = self._state()
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches, self.generation = state.get("batches", 0), state.get("generation", 0)
        self.runs: dict[str, list[str]] = state.get("runs", {kind: [] for kind in self.BY})
        for kind, names in self.runs.items():
            for name in names:
                self._open(kind, name, state["schemas"][name])

    # what counts

    def _state(self) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        last = max((n for n in names if n.startswith("state-") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))), default=None)
        return json.loads(self.spark.read.text(f"{self.folder}/{last}").first()["value"]) if last else {}

    def _commit(self) -> None:
        self.generation += 1
        if not self.lasting:
            return
        said = json.dumps({"buckets": self.buckets, "batches": self.batches, "generation": self.generation, "runs": self.runs, "schemas": {n: t.schema.toDDL() for n, t in self.tables.items()}})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.folder}/state-{self.generation:09d}")

    # tables in buckets

    def _open(self, kind: str, name: str, schema: str) -> None:
        by, table = ", ".join(self.BY[kind]), f"{self.name}_{name.replace('-', '_')}"
        sort = "" if kind == "texts" else f"SORTED BY ({by})"
        self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) {sort} INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        self.tables[name] = self.spark.table(table)

    def _write(self, kind: str, rows: DataFrame) -> DataFrame:
        """A table in buckets of its key. rows: dealt by that key, as after a groupBy(), where partitions are as many as buckets."""
        by, name = self.BY[kind], f"{kind}-{self.generation:06d}-{uuid.uuid4().hex[:8]}"
        if kind == "texts" or int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, *by)
        writer = rows.write.format("parquet").option("path", f"{self.folder}/{name}").option("parquet.block.size", 16 << 20).bucketBy(self.buckets, *by)
        table = f"{self.name}_{name.replace('-', '_')}"
        (writer if kind == "texts" else writer.sortBy(*by)).saveAsTable(table)
        self.runs[kind].append(name)
        self.tables[name] = self.spark.table(table)
        return self.tables[name]

    def _forget(self, kind: str, names: list[str]) -> None:
        self.runs[kind] = [n for n in self.runs[kind] if n not in names]
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name.replace('-', '_')}")
            self.tables.pop(name, None)

    def _of(self, kind: str) -> list[DataFrame]:
        return [self.tables[n] for n in self.runs[kind]]

    def _meet(self, kind: str, new: DataFrame, older: list[DataFrame], columns: list[str]) -> DataFrame | None:
        """Rows of older runs under keys of the new one, by a merge join of buckets for each run."""
        by = self.BY[kind]
        out = None
        for run in older:
            met = new.select(*by).hint("merge").join(run, by).select(*by, *columns)
            out = met if out is None else out.unionByName(met)
        return out

    def compact(self) -> None:
        """One run of each kind instead of all; the old ones go once the new ones count."""
        merged = {
            "keys": lambda d: d.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.bool_or("many").alias("m")).select("key", F.col("lo").alias("rid"), (F.col("m") | (F.col("lo") != F.col("hi"))).alias("many")),
            "windows": lambda d: d.groupBy("wa", "wb").agg(F.min("kid").alias("kid"), F.max("most").alias("most")),
            "copies": lambda d: d.groupBy("copy").agg(F.min("kid").alias("kid"), F.min_by("first", "kid").alias("first"), F.sum("n").alias("n")),
        }
        old = {kind: list(self.runs[kind]) for kind in merged}
        for kind, merge in merged.items():
            every = None
            for run in self._of(kind):
                every = run if every is None else every.unionByName(run)
            if every is not None:
                self._write(kind, merge(every))
        for kind, names in old.items():
            self._forget(kind, names)
        self._commit()
        for names in old.values():
            for name in names:
                delete(self.spark, f"{self.folder}/{name}")

    # a batch

    def add(self, rows: DataFrame, id_col: str = "kid", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Adds a batch: its rows under numbers `rid`, and (rid, starts, all_words) of those that lose words.

        starts: first words of the windows to remove; all_words: whether the whole text
        goes, as a copy of one with a smaller id. Columns of rows pass through, beside
        rid, kid and text (of which rows must not have other ones).
        """
        if len(self.runs["keys"]) > self.max_runs:
            self.compact()
        work, mark = self.work, f"{self.generation}-"
        older = {kind: self._of(kind) for kind in self.BY}
        first_rid = self.batches << 52  # partition and place of a row in a batch take 52 bits
        texts = self._write("texts", rows.withColumn("rid", F.monotonically_increasing_id() + F.lit(first_rid)))
        printed = work.write(fingerprint(texts.select("rid", "kid", "text")), mark + "printed")

        # texts of equal words: the first of the least id stands for all
        long = printed.filter(F.col("n_words") >= WINDOW).select("rid", "kid", "copy")
        groups = self._write("copies", long.groupBy("copy").agg(F.min("kid").alias("kid"), F.min_by("rid", "kid").alias("first"), F.count("*").alias("n")))
        known = self._meet("copies", groups, older["copies"], ["kid"])
        several = groups.filter("n > 1").select("copy", "kid", "first")
        if known is not None:
            known = known.groupBy("copy").agg(F.min("kid").alias("known"))
            several = several.unionByName(groups.join(known, "copy").select("copy", F.least("kid", "known").alias("kid"), F.when(F.col("kid") <= F.col("known"), F.col("first")).alias("first")))
            several = several.groupBy("copy").agg(F.min("kid").alias("kid"), F.max("first").alias("first"))
        several = work.write(several.withColumnRenamed("kid", "least"), mark + "several")
        others = work.write(long.join(several, "copy").filter("kid > least or rid <> first").select("rid", (F.col("kid") > F.col("least")).alias("all_words"), "first"), mark + "others")

        owned = printed.filter(F.size("anchors") > 0).join(others.select("rid"), "rid", "left_anti").select("rid", F.explode("anchors").alias("key"))
        keys = owned.groupBy("key").agg(F.min("rid").alias("rid"), F.max("rid").alias("hi")).select("key", "rid", (F.col("rid") != F.col("hi")).alias("many"))
        keys = self._write("keys", keys)
        known = self._meet("keys", keys, older["keys"], ["rid", "many"])
        shared = keys.filter("many").select("key", F.lit(None).cast("long").alias("owner"))
        if known is not None:
            # an owner that is alone so far brings its windows now; several have done so before
            known = known.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.bool_or("many").alias("m"))
            known = known.select("key", F.when(~F.col("m") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("owner"))
            shared = shared.unionByName(known).groupBy("key").agg(F.max("owner").alias("owner"))
        shared = work.write(shared, mark + "shared")
        met = owned.join(shared.select("key"), "key").select("rid", "key").union(shared.filter("owner is not null").select("owner", "key"))
        lists = work.write(met.groupBy("rid").agg(F.collect_list("key").alias("keys")), mark + "lists")
        every = None
        for table in [texts, *older["texts"]]:
            some = windows(table.join(lists.hint("shuffle_hash"), "rid"))
            every = some if every is None else every.unionByName(some)
        every = work.write(every, mark + "windows")
        run = self._write("windows", every.groupBy("wa", "wb").agg(F.min("kid").alias("kid"), F.max("kid").alias("most")))
        known = self._meet("windows", run, older["windows"], ["kid"])
        if known is not None:
            run = run.join(known.groupBy("wa", "wb").agg(F.min("kid").alias("known")), ["wa", "wb"], "left").withColumn("kid", F.least("kid", "known"))
        # written, so that the join below meets two exchanges and Spark can split a hot window
        least = work.write(run.filter("kid < most").select("wa", "wb", F.col("kid").alias("least")), mark + "least")
        later = every.filter(F.col("rid") >= first_rid).join(least, ["wa", "wb"]).filter("kid > least")
        lost = work.write(later.groupBy("rid").agg(F.collect_list("pos").alias("starts")), mark + "lost")
        work.drop(*[mark + x for x in ("printed", "several", "shared", "lists", "windows", "least")])
        self.batches += 1
        self._commit()
        again = others.filter("not all_words").select("rid", "first").join(lost.withColumnRenamed("rid", "first"), "first").select("rid", "starts")
        out = lost.unionByName(again).withColumn("all_words", F.lit(False))
        return texts, out.unionByName(others.filter("all_words").select("rid", F.array().cast("array<int>").alias("starts"), "all_words"))

    def forget_runs(self) -> None:
        """Removes all but the rows that were added: no batch can follow."""
        for kind in ("keys", "windows", "copies"):
            names = list(self.runs[kind])
            self._forget(kind, names)
            for name in names:
                delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Ends the use of the tables; removes the folder unless the index is lasting. Results of add() go with it."""
        for kind, names in list(self.runs.items()):
            for name in list(names):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name.replace('-', '_')}")
        self.work.close()


def _numbered(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, dict[str, str]]:
    """Rows (kid, text) and, if carried, the columns of docs under numbered names, which never clash; and these names."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)} if carry else {}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kid = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG))
    return docs.select(kid.alias("kid"), text.alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in names.items() if c != text_col]), names


def repeats(rows: DataFrame, index: FingerprintIndex, batches: int = BATCHES) -> DataFrame:
    """rows (kid, text, ...) with starts and all_words, null where nothing is lost. See FingerprintIndex.add().

    They are added in batches of ascending ids, or, to a lasting index, as one batch.
    """
    at = rows.agg(F.percentile_approx("kid", [i / batches for i in range(1, batches)], 10_000).alias("p")).first()["p"] if batches > 1 and not index.lasting else []
    ends, out = sorted(set(at or [])), None
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = rows.filter(F.lit(True) if low is None else F.col("kid") > low).filter(F.lit(True) if high is None else F.col("kid") <= high)
        texts, lost = index.add(part)
        joined = texts.join(lost.hint("shuffle_hash"), "rid", "left")
        out = joined if out is None else out.unionByName(joined)
    if not index.lasting:
        index.forget_runs()
    return out


def _kept(batch_text: pa.Array, starts: pa.Array, everything: pa.Array):
    """(n_words, n_removed, kept text in bytes) of each text."""
    for text, at, whole in zip(batch_text, starts, everything, strict=True):
        words = (text.as_py() or "").encode().split()
        if whole.as_py():
            yield len(words), len(words), b""
        elif at.is_valid and len(words):
            gone = covered(len(words), np.asarray(at.values), WINDOW)
            yield len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        else:
            yield len(words), 0, b" ".join(words)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, max_runs: int = MAX_RUNS, folder: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256. `folder`: a lasting index to add docs to."""
    index = FingerprintIndex(docs.sparkSession, folder, max_runs)
    rows, _ = _numbered(docs, id_col, text_col, False)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            n, removed, digest = [], [], []
            for a, b, text in _kept(batch.column(1), batch.column(2), batch.column(3)):
                n.append(a)
                removed.append(b)
                digest.append(hashlib.sha256(text).hexdigest())
            yield batch_of(schema, doc_id=batch.column(0), n_words=n, n_removed=removed, kept_sha256=digest)

    found = repeats(rows, index, batches).select(public_id(F.col("kid")).alias("doc_id"), "text", "starts", "all_words")
    out = cut(found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
    index.close()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", batches: int = BATCHES, max_runs: int = MAX_RUNS, folder: str | None = None) -> DataFrame:
    """docs with the kept words, joined by one space, as text; a text without loss stays as it is.

    n_chars, where docs has it, becomes the length of the new text. Documents of
    which nothing is left go. A null text stays null.
    """
    was_null = fresh(docs, "_was_null")
    rows, names = _numbered(docs.withColumn(was_null, F.col(text_col).isNull()), id_col, text_col, True)
    found = repeats(rows, FingerprintIndex(docs.sparkSession, folder, max_runs), batches).filter(~F.coalesce("all_words", F.lit(False))).drop("rid", "kid", "all_words")
    at, starts = found.columns.index("text"), found.columns.index("starts")
    counted = next((found.columns.index(k) for k, c in names.items() if c == n_chars_col and k in found.columns), None)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts, chars, keep = [], [], []
            nothing = pa.array([False] * len(batch))
            for old, (_, removed, left), size in zip(columns[at], _kept(columns[at], columns[starts], nothing), columns[counted] if counted is not None else [None] * len(batch), strict=True):
                new = left.decode() if removed else old.as_py()
                texts.append(new)
                chars.append(len(new) if removed else size.as_py() if size is not None else None)
                keep.append(not removed or bool(left))
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array(chars, columns[counted].type)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in columns], names=batch.schema.names)

    kept, own = found.mapInArrow(run, found.schema), {c: k for k, c in names.items()}
    text = F.when(~F.col(own[was_null]), F.col("text")).cast(docs.schema[text_col].dataType)
    return kept.select(*[(text if c == text_col else F.col(own[c])).alias(c) for c in docs.columns])
