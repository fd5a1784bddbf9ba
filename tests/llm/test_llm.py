import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from gleanwork.llm import attribution, classifier, components, fertility, fingerprints, licenses, mixing, near_dups, packing, substrings, textkit, vocabularies, warc  # noqa: E402

DATA = Path("/root/testdata/sf0.01")


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabularies.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# packing


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 10, 16, 30, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    runs, bins = packing.plan(Counter(lengths), capacity), defaultdict(list)
    for length, n in Counter(lengths).items():
        mine = [r for r in runs if r[0] == length]
        for rank in range(n):
            _, first, start, each, offset = max((r for r in mine if r[1] <= rank), key=lambda r: r[1])
            bins[start + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == sorted(brute.best_fit(lengths, capacity))


@pytest.mark.parametrize("capacity", [1024, 100, 7])
def test_packing_holds_every_token_once(docs, rows, exact, capacity):
    got = packing.pack_documents(docs, capacity).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = piece = 0
        while at < len(ids):
            n = (len(ids) - at) % capacity or capacity
            want[doc_id, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, piece = at + n, piece + 1
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(brute.best_fit([r["length"] for r in got], capacity))


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).collect() == []


# classifier


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_classifier_is_right_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    train = classifier.may_train(F.col("doc_id"))
    scores = classifier.score_documents(docs, labels, train)
    assert scores.count() == docs.count() and scores.filter("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    held = scores.join(labels, "doc_id").filter(~train).toPandas()
    assert (held["predicted"] == held["quality"]).mean() >= 0.93
    # labels of the held-out fold can't matter
    turned = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    again = classifier.score_documents(docs.select("doc_id", "text"), turned, train)
    assert bag(again.collect()) == bag(scores.collect())


def test_scores_against_plain_regression(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["word", "of", "###", "A1", "longerword", "is."], weights=[5, 3, 6 * (i % 3 == 0), 1, 2, 1], k=rng.randint(1, 60))) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0) if rng.random() < 0.9 else rng.randint(0, 1)) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in classifier.score_documents(docs, labels, F.col("doc_id") % 7 != 2).collect()}
    fold = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] % 7 != 2}
    data, offsets = near_dups.utf8(pa.array(texts))
    features = classifier.fourier(classifier.statistics(data, offsets).astype(np.float32).astype(float))
    fit, held = (np.array([i in known and (fold[i] > 0) == x for i in range(400)]) for x in (True, False))
    want = brute.ridge_scores(features, np.array([known.get(i, 0) for i in range(400)]), fit, held, classifier.RIDGE)
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=2e-3) and want.std() > 0.1  # sums are rounded to a grain


def test_classifier_on_odd_rows(spark, docs, none, rows):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.score_documents(docs, no_labels, F.lit(True)).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1), (7, None), (10**12, 1), (14, 1), (21, 0)], "doc_id long, quality int")
    assert classifier.score_documents(docs, odd, F.lit(True)).filter("score between 0 and 1").count() == len(rows)
    assert classifier.score_documents(none, odd, F.lit(True)).collect() == []


def test_isotonic_levels():
    levels = classifier.pool_adjacent(np.array([0, 1, 0, 2, 1, 3.0]), np.array([1, 1, 1, 2, 2, 3.0]))
    assert np.all(np.diff(levels) >= 0) and levels == pytest.approx([0, 0.5, 0.5, 0.75, 0.75, 1])


# licences


def test_licenses_against_plain_search(docs, rows):
    got = bag((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        n, found = brute.phrases(text, licenses.BASE_PHRASES)
        at = [i for i, _ in found]
        want[doc_id, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert got == want


def test_licenses_of_random_words():
    rng, automaton = random.Random(3), licenses.build_automaton()
    for _ in range(300):
        text = "".join(rng.choice(["cc", "by", "CC", "General", "public", "license", "all", "rights", "reserved", "ü", "9"]) + rng.choice([" ", "-", "\n", "  ", ""]) for _ in range(rng.randint(0, 30)))
        n, found = brute.phrases(text, licenses.BASE_PHRASES)
        at = [i for i, _ in found]
        assert licenses.scan(text, automaton)[:4] == (n, len(found), min(at, default=None), max(at, default=None)), text


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]), ("(MIT OR GPL-2.0) AND ISC", ["mit", "gpl-2.0", "or", "isc", "and"]),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]), ("MIT */ rest", ["mit"]), ("MIT OR", ["mit"]), ("OR MIT", []), ("(MIT", []), ("", []), ("MIT Apache", ["mit"]),
])
def test_expressions(text, postfix):
    assert licenses.parse_expression(text)[1] == postfix


def test_expression_values(none):
    value = lambda t: licenses.evaluate(licenses.parse_expression(t)[1])
    assert value("MIT OR GPL-2.0") == 1.0 and value("MIT AND GPL-2.0") == 0.5 and value("GPL-2.0 WITH GCC-exception-3.1") == pytest.approx(0.6) and value("GPL-2.0 WITH x") == 0.5
    assert licenses.scan_licenses(none).collect() == []


def test_labels_of_expressions():
    labels = lambda t: licenses.scan(t, licenses.build_automaton())[5:]
    tag = "SPDX-License-Identifier"
    assert labels(f"x\n// {tag}: GPL-2.0-only WITH Classpath-exception-2.0\ny") == ("gpl-2.0-only", "gpl-2.0-only classpath-exception-2.0 with", 0.6)
    assert labels(f"{tag}: NotALicense OR foo") == ("unknown:foo,unknown:notalicense", "notalicense foo or", 0.3)
    assert labels(f"{tag} MIT") == ("", "", 0.0) and labels(f"{tag}: MIT\nü {tag}:BSD-3-Clause AND Zlib")[:2] == ("bsd-3-clause,mit,zlib", "mit; bsd-3-clause zlib and")


def test_long_expressions_take_time_in_proportion():
    import time

    automaton = licenses.build_automaton()
    for text in (" OR ".join(["MIT"] * 100_000), "(" * 100_000 + "MIT" + ")" * 100_000, "SPDX-License-Identifier: MIT\n" * 20_000):
        began = time.process_time()
        found = licenses.scan(text if text.startswith("SPDX") else f"SPDX-License-Identifier: {text}", automaton)
        assert found[5] == "mit" and time.process_time() - began < 3


@pytest.mark.parametrize("text, label, score", [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.3), ("CC-BY-NC-ND", "cc-by-nc-nd", 0.1), ("cc by-sa 3.0", "cc-by-sa", 0.6), ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa", 0.2), ("CC BY 4.0", "cc-by", 0.9),
    ("under the GNU General Public License, version 3", "gpl-3.0", 0.5), ("GPLv2", "gpl-2.0", 0.5), ("LGPL v2.1", "lgpl-2.1", 0.6),
    ("Permission is hereby granted, free of charge, to any person", "mit", 1.0), ("Redistribution and use in source and binary forms, with", "bsd", 1.0),
])
def test_restricted_forms_and_grants(text, label, score):
    found = licenses.scan(text, licenses.build_automaton())
    assert label in found[5].split(",") and found[7] == score


# fingerprints


@pytest.mark.parametrize("bits, rows_per_range", [(64, 2048), (64, 3), (2, 10)])
def test_fingerprints_against_plain(docs, rows, bits, rows_per_range):
    distinct = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            distinct.setdefault(doc_id, text or "")
    plain = [(i, t) for i, t in distinct.items()]
    ordered = sorted(plain, reverse=True)
    table = docs.sparkSession.createDataFrame(plain, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.edit_probe(table, bits, rows_per_range).collect()}
    assert len(got) == len(plain)
    prints = {}
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(brute.canonical(text) == brute.canonical(edited)) and r["near_next"] == float(brute.canonical(text) == brute.canonical(after))
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(brute.canonical(t), f) == f
    if bits == 64:
        assert len(set(prints.values())) == len(prints)
    own = {brute.canonical(t): got[i]["fingerprint"] for i, t in plain}  # bytes are compared among the table's texts
    assert len(set(own.values())) == len(own)


@pytest.mark.parametrize("bits", [64, 2])
def test_fingerprint_groups(docs, none, rows, bits):
    got = fingerprints.fingerprint_groups(docs, bits).collect()
    sizes = Counter(brute.canonical(r[1]) for r in rows)
    assert Counter(r["group_size"] for r in got) == Counter(sizes[brute.canonical(r[1])] for r in rows)
    assert len({r["fingerprint"] for r in got}) == len(sizes)
    assert fingerprints.edit_probe(docs, bits, 5).count() == len(rows)
    assert fingerprints.edit_probe(none, bits).collect() == [] and fingerprints.fingerprint_groups(none).collect() == []


def test_fingerprints_run_no_python(docs):
    plan = fingerprints.edit_probe(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# substrings


@pytest.mark.parametrize("batches, max_runs", [(1, 4), (2, 4), (4, 1)])
def test_substrings_against_plain(docs, rows, batches, max_runs):
    got = bag(substrings.dedup_report(docs, batches=batches, max_runs=max_runs).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute.substrings([(r[0], r[1]) for r in rows]), strict=True))


def test_a_lasting_index_knows_what_an_earlier_session_added(spark, rows, tmp_path):
    folder, plain = str(tmp_path / "index"), [(r[0], r[1]) for r in rows if r[0] is not None]
    plain.sort()
    parts = [plain[:25], plain[25:40], plain[40:50], plain[50:]]
    got = Counter()
    for part in parts:  # another session each time, so runs are opened from the folder alone
        docs = spark.newSession().createDataFrame(part, "doc_id long, text string")
        got += bag(substrings.dedup_report(docs, folder=folder).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(plain, brute.substrings(plain), strict=True))
    state = substrings.FingerprintIndex(spark, folder)
    assert state.batches == 4 and [len(state.runs[k]) for k in ("keys", "windows", "copies", "texts")] == [2, 2, 2, 4]


def test_runs_are_merged_without_moving_them(spark, docs):
    index = substrings.FingerprintIndex(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("kid"), F.coalesce("text", F.lit("")).alias("text"))
    for part in (rows.filter("kid < 300"), rows.filter("kid >= 300")):
        index.add(part)
    new, old = (index.tables[index.runs["keys"][i]] for i in (1, 0))
    plan = index._meet("keys", new, [old], ["rid", "many"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    copy = np.concatenate([rng.integers(0, 1 << 60, 5, dtype=np.uint64), words[40:90]])
    assert np.array_equal(textkit.window_hashes(copy, 13)[5:], textkit.window_hashes(words, 13)[40:78])
    assert np.array_equal(substrings.window_anchors(copy)[5:], substrings.window_anchors(words)[40:78])
    shingles = textkit.window_hashes(words, 5)
    assert np.array_equal(substrings.window_anchors(words), [shingles[i : i + 9].min() for i in range(188)])


def test_remove_repeats(docs, none, rows):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    plain = brute.substrings([(r[0], r[1]) for r in rows])
    whole = sum(n > 0 and n == gone for n, gone, _ in plain)
    assert out.count() == len(rows) - whole
    assert out.filter("text is not null and doc_id is not null and n_chars <> char_length(text)").filter("KID is not null and not text like 'another%'").count() == 0
    assert substrings.remove_repeats(none).collect() == [] and substrings.dedup_report(none).collect() == []


# mixing


def test_raking_meets_targets():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, c, t, rng.integers(1, 1000)) for s in "abc" for c in "xy" for t in "pqr"], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.2, "q": 0.2, "r": 0.6}}
    cells["w"] = mixing.rake(cells, targets)
    for dim, target in targets.items():
        shares = cells.groupby(dim)["w"].sum() / cells["w"].sum()
        assert shares.to_dict() == pytest.approx(target, rel=1e-6)
    p = mixing.probabilities(cells["tokens"].to_numpy(float), cells["w"].to_numpy(), 0.3)
    assert (p * cells["tokens"]).sum() == pytest.approx(0.3 * cells["tokens"].sum()) and p.max() <= 1
    assert mixing.rake(cells.assign(tokens=0), targets).sum() == 0


def test_mixing_paths_agree(docs, none, rows):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["tokens"], r["topic"])
    here = sorted(mixing.mix_report(docs, rounds=3, keep_share=0.3).collect(), key=key)
    there = sorted(mixing.mix_report(docs, rounds=3, keep_share=0.3, max_cells=0).collect(), key=key)
    assert [key(r) for r in here] == [key(r) for r in there]
    assert [r["probability"] for r in there] == pytest.approx([r["probability"] for r in here], rel=1e-6)
    assert mixing.mix_report(docs).count() == len(rows)
    assert mixing.mix(docs).columns == docs.columns and 0 < mixing.mix(docs).count() < len(rows)
    assert mixing.mix(none).collect() == [] and mixing.mix_report(none).collect() == []


def skewed(spark):
    rng = random.Random(6)
    sources, langs = ["hot"] * 6 + ["a"] * 3 + ["b", "c", "d"], ["en"] * 7 + ["de", "fr", "es"]
    rows = [(i, " ".join(rng.choices("alpha bravo charlie delta echo foxtrot golf hotel".split(), k=rng.randint(20, 60))), rng.choice(sources), rng.choice(langs)) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("targets", [None, {"source": {"hot": 1, "a": 1, "b": 1, "c": 1, "d": 1}}, {"lang": {"en": 3, "de": 3, "fr": 2, "es": 2}, "source": {"hot": 2, "a": 3, "b": 1}}])
def test_expected_marginals_are_the_targets(spark, targets):
    docs = skewed(spark).cache()
    shares = mixing.mix_shares(docs, targets=targets).toPandas()
    assert shares["expected"].to_numpy() == pytest.approx(shares["target"].to_numpy(), abs=1e-3)
    if targets:
        wanted = {("source", f"={k}"): v / sum(targets["source"].values()) for k, v in targets["source"].items()}
        got = {(r.dim, r.category): r.target for r in shares.itertuples()}
        assert {k: got[k] for k in wanted} == pytest.approx(wanted)
    report = mixing.mix_report(docs, targets=targets).toPandas()
    assert report["probability"].max() <= 1
    weighted = (report["probability"] * report["tokens"]).groupby(report["source"]).sum()
    expected = shares[shares["dim"] == "source"].set_index("category")["expected"]
    assert (weighted / weighted.sum())[expected.index].to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-6)
    if targets and "lang" in targets:
        assert set(report[report["kept"]]["source"]) == {"=hot", "=a", "=b"}
    if targets is None:  # the clipped sample of the whole budget misses them
        cells = report.groupby(["source", "lang", "topic"], as_index=False).agg(tokens=("tokens", "sum"), factor=("factor", "first"))
        p = mixing.probabilities(cells["tokens"].to_numpy(float), (cells["tokens"] * cells["factor"]).to_numpy())
        clipped = (p * cells["tokens"]).groupby(cells["source"]).sum()
        assert np.abs((clipped / clipped.sum())[expected.index].to_numpy() - shares[shares["dim"] == "source"]["target"].to_numpy()).max() > 5e-3


@pytest.mark.parametrize("targets", [{}, {"source": {"hot": 1, "a": 1, "b": 1, "c": 1, "d": 1}}])
def test_probabilities_against_plain_raking(spark, targets):
    report = mixing.mix_report(skewed(spark), targets=targets, keep_share=0.5, count_words=True).toPandas()
    cells = report.groupby(["source", "lang", "topic"]).agg(tokens=("tokens", "sum"), probability=("probability", "first"), factor=("factor", "first"))
    tokens, total = cells["tokens"].to_dict(), report["tokens"].sum()
    wanted = []
    for dim in ("source", "lang", "topic"):
        own = report.groupby(dim)["tokens"].sum() / total
        wanted.append({f"={k}": v for k, v in targets[dim].items()} if dim in targets else (own ** mixing.EXPONENTS[dim]).to_dict())
    weight = brute.raked(tokens, wanted)
    assert [cells["factor"][c] * t for c, t in tokens.items()] == pytest.approx([weight[c] for c in tokens], rel=1e-6)
    kept = (cells["tokens"] * cells["probability"]).sum()
    assert kept <= 0.5 * total * (1 + 1e-9) and brute.is_calibrated(tokens, cells["probability"].to_dict(), wanted, kept)
    assert cells["probability"].max() <= 1 and abs(report[report["kept"]]["tokens"].sum() / kept - 1) < 0.1


def test_mixing_weighs_tokens(spark, docs, rows, exact):
    plain = docs.filter("text is null or not contains(text, '<|')")
    got = bag((r["doc_id"], r["tokens"]) for r in mixing.mix_report(plain).collect())
    assert got == Counter((r[0], len(exact.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows if "<|" not in (r[1] or ""))
    words = bag((r["doc_id"], r["tokens"]) for r in mixing.mix_report(docs, count_words=True).collect())
    assert words == Counter((r[0], brute.base_counts(r[1])[0]) for r in rows)
    counted = docs.withColumn("n", F.when(F.col("doc_id") > 9, F.lit(7)))
    assert {((r["doc_id"] or 0) > 9, r["tokens"]) for r in mixing.mix_report(counted, tokens_col="n").collect()} == {(True, 7), (False, 0)}
    long = spark.createDataFrame([(1, "日本語の文章です。" * 50, "a", "ja"), (2, "word", "a", "en")], "doc_id long, text string, source string, lang string")
    tokens = {r["doc_id"]: r["tokens"] for r in mixing.mix_report(long).collect()}
    assert tokens[1] > 100 * tokens[2]


def test_calibration_on_executors_is_the_same(spark):
    docs, targets = skewed(spark).limit(400).cache(), {"source": {"hot": 1, "a": 2, "b": 1, "c": 1, "d": 1}}
    here, there = (mixing.mix_report(docs, targets=targets, rounds=3, max_cells=n).toPandas().sort_values("doc_id") for n in (100_000, 0))
    assert there["probability"].to_numpy() == pytest.approx(here["probability"].to_numpy(), rel=1e-6)


# WARC


def make_pages(spark):
    rng = random.Random(2)
    big = "".join(rng.choices("abcdefgh<>\r\n é", k=90_000))
    bodies = [None, "", "same", "same", "same", big, big + "!", big, "ü" * 9000, "0\r\n\r\n", "short"]
    rows = [(i, f"http://h/{i}?a b\r\nX: y", body) for i, body in enumerate(bodies)] + [(None, None, "same"), (None, None, "only here"), (4, "http://h/4", "same")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


@pytest.mark.parametrize("limit, segment", [(0, 16 << 10), (5, 1000), (0, 10**9)])
def test_warc_round_trip(spark, tmp_path, limit, segment):
    rows, pages = make_pages(spark)
    archives = warc.write_archives(pages, min_payload=limit, segment_bytes=segment)
    largest = {}
    for i, _, body in rows:
        if i is not None:
            largest[body or ""] = max(i, largest.get(body or "", -1))
    want, payloads = Counter(), Counter()
    for i, _, body in rows:
        data = (body or "").encode()
        own = i == largest.get(body or "") or len(data) < limit
        want[i, len(data), warc.sha1_base32(data), "response" if own else "revisit", None if own else largest[body or ""], None] += 1
        payloads[data] += own
    warc.save_archives(archives, str(tmp_path / "out"))
    for source in (archives, warc.load_archives(spark, str(tmp_path / "out/*.warc.gz"))):
        got = warc.read_archives(source).collect()
        assert bag((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in got) == want
        assert Counter(bytes(r["payload"]) for r in got if r["payload"] is not None) == +payloads


def test_warc_finds_what_is_broken():
    payload = bytes(range(256)) * 40
    records = [next(warc.parse_archive(r)) for r in warc.page_records(1, "http://h", payload, None, "0.0", 1000)]
    segments = [{"segment": int(h["warc-segment-number"]), "record_type": h["warc-type"], "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "refers_to": None, "digest": h.get("warc-payload-digest", "")[5:] or None, "block": b} for h, b, _ in records]
    origin = records[0][0]["warc-record-id"]
    random.Random(1).shuffle(segments)
    assert warc.reassemble(origin, segments)[5:] == (None, payload) and warc.reassemble(origin, segments)[0] == 1
    ordered = sorted(segments, key=lambda s: s["segment"])
    assert warc.reassemble(origin, ordered[:3] + ordered[4:])[5] == "segment numbers have gaps or repeat"
    assert warc.reassemble(origin, ordered[:-1])[5] == "total length differs"
    assert warc.reassemble(origin, ordered[1:])[5] == "the first segment is missing"
    broken = [dict(ordered[0]), *ordered[1:]]
    broken[0]["block"] = broken[0]["block"][:-1] + b"\xff"
    assert warc.reassemble(origin, broken)[5] == "payload digest differs"
    for body in (b"", b"5\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.decode_chunked(body)
    assert warc.decode_chunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for body in (b"-5\r\nab", b"0x1\r\na\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.decode_chunked(body)


def test_damaged_archives_give_rows(spark):
    good = [b"".join(warc.page_records(i, None, b"payload %d" % i, None, "0.0")) for i in range(3)]
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:foreign>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n" % len(b"HTTP/1.1 200 OK\r\n\r\nhi")
    contents = {
        "no archive": b"no archive", "cut gzip": good[0] + good[1][:-20], "noise between": good[0] + b"\x1f\x8b\x08 noise" + good[1], "no length": plain.replace(b"Content-Length", b"Content-Size") + plain,
        "no id": plain.replace(b"WARC-Record-ID", b"X"), "foreign": plain, "twice": good[2], "empty": b"", "null": None, "cut record": plain[:-20],
    }
    for name, content in contents.items():
        got = warc.read_archives(spark.createDataFrame([(name, content)] * 2, "archive string, content binary")).collect()
        problems = [r for r in got if r["problem"]]
        assert all(r["record_type"] == "damaged" and r["payload"] is None for r in problems)
        assert len(problems) == (name in ("no archive", "cut gzip", "noise between", "no length", "no id", "cut record")), name
        assert sorted(r["page_id"] for r in got if r["page_id"] is not None) == {"cut gzip": [0], "noise between": [0, 1], "twice": [2]}.get(name, []), name
        assert [(r["record_id"], bytes(r["payload"])) for r in got if r["page_id"] is None and not r["problem"]] == [("<urn:uuid:foreign>", b"hi")] * (name in ("foreign", "no length")), name


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).collect() == []


# quality rules


def test_quality_counts_against_plain(docs, none, rows):
    got = fertility.quality_report(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert bag((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *brute.base_counts(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = fertility.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert fertility.quality_report(none).collect() == []
    assert fertility.quality_report(docs.drop("lang")).count() == len(rows)


def test_fertility_by_script():
    assert [fertility.script(t) for t in ("abc", "日本語 a", "Привет", "123", "")] == ["latin", "cjk", "cyrillic", "other", "other"]
    vocabulary = vocabularies.byte_vocabulary(vocabularies.vocabulary_path("byte_bpe_50k.json"), vocabularies.vocabulary_path("byte_bpe_50k.tiktoken"))
    pieces = vocabularies.piece_vocabulary(vocabularies.vocabulary_path("piece_bpe_32k.model"))
    n, chars, share, entropy = fertility.fertility("the the the the", vocabulary, pieces)
    assert n == 4 and chars == 15 / 4 and share == 0 and entropy < 0.5
    assert fertility.fertility("𒀀 𒀁", vocabulary, pieces)[2] == 1.0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_fertility_rejects_junk_that_the_base_rule_misses(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    passed = fertility.quality_report(docs).filter("not base_failed").join(labels, "doc_id").toPandas()
    kept = passed.groupby("quality")["kept"].mean()
    assert kept[0] <= 0.15 and kept[1] >= 0.98


def test_given_bands_replace_fitted_ones(spark):
    wide = (0.0, 100.0, 1.0, 0.0)
    docs = spark.createDataFrame([(1, "aichau### lichpf%%% zuung&&& keitenver*** erb$$$ einund### ägei%%% üschö&&& teau### tze%%% ungbe$$$", "de")], "doc_id long, text string, lang string")
    assert [r["kept"] for r in fertility.quality_report(docs).collect()] == [False]
    assert [r["kept"] for r in fertility.quality_report(docs, bands={"de": wide}).collect()] == [True]


def test_byte_fallback_is_what_the_model_does(rows):
    import sentencepiece

    path = vocabularies.vocabulary_path("piece_bpe_32k.model")
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), vocabularies.piece_vocabulary(path)
    for text in [r[1] or "" for r in rows] + ["𒀀 𒀁 a", "zażółć gęślą jaźń", "ẞẟ", "Ђ 中文 龘 ﷽"]:
        assert sum(model.IsByte(i) for w in text.split() for i in model.encode(w)) == pieces.fallback_bytes(text)


def test_plain_texts_encode_alike(exact, rows):
    vocabulary = vocabularies.byte_vocabulary(vocabularies.vocabulary_path("byte_bpe_50k.json"), vocabularies.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    alphabet = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC]))
    for text in [r[1] or "" for r in rows] + ["".join(rng.choices(alphabet, k=200)) for _ in range(300)]:
        assert vocabulary.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_queries_give_the_library_s_ids(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    from gleanwork.llm import queries

    library = Tokenizer.from_file(vocabularies.vocabulary_path("byte_bpe_50k.json"))
    more = [(10_000, "a <|endoftext|> b"), (10_001, "<|endoftext|><|endoftext|>\nx"), (10_002, "the end " * 60_000 + "<|endoftext|>"), (10_003, "日本<|endoftext|>\n語")]
    texts = [(r[0], r[1] or "") for r in rows] + more
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(i, t, None, None) for i, t in more], "doc_id long, text string, lang string, source string"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in texts]
    assert 50256 in ids[-4][1] and len(ids[-4][1]) == 4
    n = Counter((i, len(x)) for i, x in ids)
    counted = queries.op10_token_counts(spark, str(tmp_path)).collect()
    assert bag((r["doc_id"], r["n_tokens"]) for r in counted) == n and all(sum(r["section_tokens"]) == r["n_tokens"] for r in counted)
    assert {r["doc_id"]: r["section_tokens"] for r in counted}[10_001] == [3, 1]
    assert bag((r["doc_id"], r["n_tokens"]) for r in queries.op8_quality_rules(spark, str(tmp_path)).collect()) == n
    assert bag((r["doc_id"], r["tokens"]) for r in queries.op6_source_mixing(spark, str(tmp_path)).collect()) == n
    whole = Counter()
    for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect():
        whole[r["doc_id"]] += r["length"]
    sizes = Counter()
    for i, x in ids:
        sizes[i] += len(x) + 1
    assert whole == sizes


def test_long_texts_encode_alike_in_parts(exact, monkeypatch):
    vocabulary = vocabularies.byte_vocabulary(vocabularies.vocabulary_path("byte_bpe_50k.json"), vocabularies.vocabulary_path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(vocabularies, "_PART", 50)
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choices(["the", "Ü", " ", "  ", "\n", "'s", "ab cd", "1 2", "日本", ".", "。", "、", "한", "\x1c", "\u2028", "\u3000", "5", "?!", "\ta"], k=400))
        assert vocabulary.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_no_ranks_file_is_needed(spark, docs):
    path = vocabularies.vocabulary_path("byte_bpe_50k.json")
    alone, both = vocabularies.ByteVocabulary(path, None), vocabularies.ByteVocabulary(path, vocabularies.vocabulary_path("byte_bpe_50k.tiktoken"))
    assert alone.fast is None and both.fast and np.array_equal(alone.widths, both.widths)
    assert bag((r["doc_id"], r["n_tokens"], tuple(r["section_tokens"])) for r in attribution.count_tokens(docs, ranks_path="none").collect()) == bag((r["doc_id"], r["n_tokens"], tuple(r["section_tokens"])) for r in attribution.count_tokens(docs).collect())


# near duplicates


def test_near_duplicates_against_plain(docs, none, rows):
    got = near_dups.near_duplicates(docs).collect()
    want = brute.near_classes([(r[0], r[1]) for r in rows])
    assert bag(got) == Counter((rows[n][0], c) for n, c in want.items())
    assert near_dups.near_duplicates(none).collect() == []


def test_chains_of_near_copies_lose_no_link(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts, base = [], [word() for _ in range(80)]
    for _ in range(40):  # each a change of an earlier one: similarities from 0 to 1, linked in chains
        copy = list(rng.choice(texts)) if texts else list(base)
        for at in rng.sample(range(80), rng.randint(1, 3)):
            copy[at] = word()
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute.near_classes(rows)


def test_keep_first_keeps_one_of_each_class(docs, rows):
    out = near_dups.keep_first(docs)
    classes = near_dups.classify(docs).select("class_kid", "class_tid").distinct().count()
    assert out.columns == docs.columns and out.count() == classes


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(6)
    for _ in range(3):
        a = Counter({i: rng.randint(1, 9) for i in range(60)})
        b = Counter({i: max(1, a[i] + rng.randint(-3, 3)) if i < 45 else rng.randint(1, 9) for i in range(15, 75)})
        owner, hashes, weight = (np.array(x) for x in zip(*[(n, k, w) for n, x in enumerate((a, b)) for k, w in sorted(x.items())], strict=True))
        s = near_dups.signatures(owner, textkit.mix(hashes.astype(np.uint64)), weight, 2, 4000)
        assert (s[0] == s[1]).mean() == pytest.approx(brute.weighted_jaccard(a, b), abs=0.035)


def test_payload_overlap_is_multiset_overlap():
    a, b = Counter({1: 3, 2: 1, 3: 5}), Counter({1: 2, 3: 7, 4: 1})
    sets = [near_dups.elements(textkit.mix(np.array(sorted(x), np.uint64)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    assert [len(s) for s in sets] == [9, 10] and len(np.intersect1d(*sets)) == (a & b).total()


@pytest.mark.parametrize("common", [0, 30, 70])
def test_prefix_pairs_hold_every_pair_that_is_alike(spark, common):
    rng = np.random.default_rng(common)
    shared, sets = rng.integers(0, 1 << 63, common, dtype=np.uint64), []
    for _ in range(60):  # some with a common part, some made from others
        old = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.integers(0, 1 << 63, rng.integers(1, 40), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([shared, rng.choice(old, max(1, int(len(old) * rng.uniform(0.7, 1))), False), rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])))
    rows = spark.createDataFrame([(i, i % 7, x.tobytes()) for i, x in enumerate(sets)], "id long, comp long, payload binary")
    counts = near_dups.element_counts(rows)
    assert counts.sum() == sum(map(len, sets))
    got = {(r["a"], r["b"]) for r in near_dups.prefix_pairs(near_dups.prefixes(rows, counts, 0.8), 0.8).collect()}
    want = {(i, j) for j in range(60) for i in range(j) if i % 7 != j % 7 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert want <= got and (common == 0 or want)
    frequent = [(i, i, np.unique(np.concatenate([shared, np.arange(i * 100, i * 100 + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])).tobytes()) for i in range(1, 60)]
    many = spark.createDataFrame(frequent, "id long, comp long, payload binary")
    assert near_dups.prefix_pairs(near_dups.prefixes(many, near_dups.element_counts(many), 0.8), 0.8).count() == 0


def twins(n=1024):
    """Two words that every polynomial hash with an odd base modulo 2**64 takes for one."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_words_are_never_taken_for_one(spark):
    a, b = twins()
    lead = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{a} {b}\n{a}\n{b}"), (4, a), (5, b)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_report(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert {r["doc_id"]: r["n_dup_lines"] for r in fertility.quality_report(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    classes = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert classes[4] == 4 and classes[5] == 5
    whole = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13))], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.dedup_report(whole).collect()] == [0, 0]
    assert sorted(r["class_id"] for r in near_dups.near_duplicates(whole).collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: find(k) for k in root if k in got} and set(root) - set(got) <= loops
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# token counts


def test_attribution_against_plain(docs, none, rows, exact):
    got = bag((r["doc_id"], r["n_tokens"], r["n_sections"], tuple(r["section_tokens"])) for r in attribution.count_tokens(docs).collect())
    vocabulary = vocabularies.byte_vocabulary(vocabularies.vocabulary_path("byte_bpe_50k.json"), vocabularies.vocabulary_path("byte_bpe_50k.tiktoken"))
    want = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        sections, owner = [], []  # owner: for each byte its section, for each first byte of a code point too
        for line in text.split("\n") if text else []:
            sections.append(line + "\n")
        if text and not text.endswith("\n"):
            sections[-1] = sections[-1][:-1]
        elif text:
            sections.pop()
        for n, line in enumerate(sections):
            for c in line:
                owner += [(n, i == 0) for i in range(len(c.encode()))]
        counts, at = [0] * len(sections), 0
        ids = exact.encode(text, add_special_tokens=False).ids
        for i in ids:
            mine = owner[at : at + vocabulary.widths[i]]
            votes = Counter(n for n, lead in mine if lead)
            counts[min(votes, key=lambda n: (-votes[n], n)) if votes else mine[0][0]] += 1
            at += vocabulary.widths[i]
        assert at == len(owner)
        want[doc_id, len(ids), len(sections), tuple(counts)] += 1
    assert got == want
    assert attribution.count_tokens(none).collect() == []


# pipeline


def test_pipeline_over_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline

    for name, table in (("rows", docs), ("none", none)):
        (tmp_path / name).mkdir()
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns[:4] == ["doc_id", "piece", "start", "length"]
        assert (out.count() > 0) == (name == "rows")
    current = docs
    for stage, f in corpus_pipeline.STAGES[:-1]:
        current = f(spark, current, "")
        assert current.columns == docs.columns, stage


def test_stages_agree_with_their_operators(spark, docs, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    kept = fertility.quality_report(docs).filter("kept").select("doc_id")
    assert bag(stages["quality_rules"](spark, docs, "").select("doc_id").collect()) == bag(kept.collect())
    near = stages["near_duplicates"](spark, docs, "")
    assert near_dups.near_duplicates(near.filter("char_length(trim(text)) > 0")).filter("not doc_id <=> class_id").count() == 0
    mixed = stages["source_mixing"](spark, docs, "").select("doc_id")
    assert mixed.exceptAll(mixing.mix_report(docs).filter("kept").select("doc_id")).count() == 0


def test_record_batches_of_nothing():
    data, offsets = near_dups.utf8(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]
    assert textkit.split_words(data, np.zeros(4, np.int64))[2].tolist() == [0, 0, 0, 0]
