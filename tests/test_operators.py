import json
import random
import struct
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gleanwork.config import AuditThresholds, CurationConfig, load_config
from gleanwork.operators import audit, decide, discovery, images, ledger, reports, similarity
from gleanwork.plans.curate import curate, record
from gleanwork.runtime import global_rank
from gleanwork.schemas import HITS, LEDGER, PAYLOADS, VERDICTS
from gleanwork.sources import providers, tables

VALID = '{"label":"photo","confidence":0.8,"is_underage_or_ambiguous":false}'
CONFIG = CurationConfig(limit=2, max_urls_multiplier=10, min_bytes=1, max_bytes=100)


def inputs(spark, bodies, verdicts):
    hits = spark.createDataFrame([(0, "q", i, u) for i, u in enumerate(bodies)], HITS)
    payloads = spark.createDataFrame([(u, 200, "image/png", None, b) for u, b in bodies.items() if b is not None], PAYLOADS)
    hashed = payloads.select("url", F.sha2("content", 256).alias("sha256"))
    said = spark.createDataFrame(list(verdicts.items()) or [("", "")], "url string, response string")
    return hits, payloads, hashed.join(said, "url").select("sha256", "response", F.lit("m").alias("model_name"))


def test_decision_table(spark):
    bodies = {
        "http://h/old.jpg": b"1", "http://h/a.gif": b"2", "http://h/missing.jpg": None, "http://h/html.jpg": b"<p>", "http://h/past.jpg": b"past", "http://h/bad.jpg": b"3", "http://h/unsafe.jpg": b"4",
        "http://h/k1.jpg": b"5", "http://h/copy.jpg": b"5", "http://h/none.jpg": b"6", "http://h/k2.jpg": b"7", "http://h/k3.jpg": b"8", "http://h/copy-of-discarded.jpg": b"4",
    }
    ok = {u: VALID for u in ("http://h/k1.jpg", "http://h/k2.jpg", "http://h/k3.jpg", "http://h/past.jpg")}
    verdicts = ok | {"http://h/bad.jpg": "oops", "http://h/unsafe.jpg": VALID.replace("false", "true")}
    past = spark.createDataFrame([(1, "http://h/old.jpg", "x", None, None, "other", "t", "m", 1.0), (2, "http://h/p", __import__("hashlib").sha256(b"past").hexdigest(), None, None, "discard", "t", "m", 1.0)], LEDGER)
    run = curate(*inputs(spark, bodies, verdicts), past, CONFIG)
    got = {r["url"].rsplit("/", 1)[1]: (r["category"], r["model_name"], r["confidence"]) for r in run.decisions.collect()}
    assert got == {
        "past.jpg": ("discard", "dedupe", 1.0), "bad.jpg": ("discard", "classify_error", 0.0), "unsafe.jpg": ("discard", "m", 0.8), "k1.jpg": ("photo", "m", 0.8), "copy.jpg": ("discard", "dedupe", 1.0),
        "none.jpg": ("discard", "classify_error", 0.0), "k2.jpg": ("photo", "m", 0.8), "k3.jpg": ("discard", "limit_reached", 1.0), "copy-of-discarded.jpg": ("discard", "dedupe", 1.0),
    }
    assert run.counters.first().asDict() == {"urls_found": 11, "downloaded": 9, "classified": 4, "kept": 2, "discarded": 7}


def test_skip_classify_is_opt_in(spark):
    from dataclasses import replace

    hits, payloads, _ = inputs(spark, {"http://h/a.jpg": b"1"}, {})
    none = spark.createDataFrame([], LEDGER)
    assert curate(hits, payloads, None, none, replace(CONFIG, skip_classify=True)).decisions.first()["model_name"] == "unclassified"
    assert curate(hits, payloads, spark.createDataFrame([], VERDICTS), none, CONFIG).decisions.first()["category"] == "discard"


def test_rerun_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    args = inputs(spark, {"http://h/a.jpg": b"1", "http://h/b.png": b"2"}, {"http://h/a.jpg": VALID})
    for _ in range(2):
        record(curate(*args, ledger.read_ledger(spark, path), CONFIG), path, "2024-01-01T00:00:00+00:00", CONFIG)
    rows = ledger.in_order(ledger.read_ledger(spark, path)).collect()
    assert len(rows) == 2 and sum(r["filepath"] is not None for r in rows) == 1
    assert [r for r in rows if r["filepath"]][0]["filepath"].startswith("curated/photo/6b86b273ff34_a.png")
    assert ledger.write_manifest(ledger.read_ledger(spark, path), str(tmp_path / "m.json"), "now") == 2
    assert json.loads((tmp_path / "m.json").read_text())["count"] == 2


def test_stream_matches_batch(spark, tmp_path):
    from gleanwork.streaming.incremental import run_stream, stream_hits

    hits, payloads, verdicts = inputs(spark, {f"http://h/{i}.jpg": bytes([i]) for i in range(1, 5)}, {"http://h/1.jpg": VALID})
    hits.write.json(str(tmp_path / "hits"))
    path = str(tmp_path / "ledger")
    for _ in range(2):
        run_stream(stream_hits(spark, str(tmp_path / "hits")), lambda: payloads, lambda: verdicts, path, str(tmp_path / "ck"), CONFIG, lambda: "2024").awaitTermination()
    assert ledger.read_ledger(spark, path).count() == 4


def test_empty_everything(spark):
    none = spark.createDataFrame([], LEDGER)
    run = curate(spark.createDataFrame([], HITS), spark.createDataFrame([], PAYLOADS), spark.createDataFrame([], VERDICTS), none, CONFIG)
    assert run.decisions.count() == 0
    assert reports.stats_lines(none) == ["Total records: 0"]
    assert reports.success_rates(none).first()["kept_rate"] == "0.0%"
    assert "(none)" in reports.success_report(none, None, "today")


def test_expand_queries(spark):
    config = CurationConfig()
    base = spark.createDataFrame([(0, "a"), (1, "ü"), (2, "a fanart")], "base_rank int, query string")
    got = {r["query"]: (r["base_rank"], r["variant"]) for r in discovery.expand_queries(base, config.variant_suffixes, config.filetype_suffixes, ("a", "z")).collect()}
    assert len(got) == 13 + 1 + 13 - 1 + 1
    assert got["a"] == (0, 0) and got["a fanart"] == (0, 1) and got["z"] == (None, 1) and got["ü"] == (1, 0)


def test_global_rank_and_quota(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    ranked = global_rank(df, [F.col("k")], "r")
    assert ranked.filter("r <> k + 1").count() == 0
    assert global_rank(df.limit(0), [F.col("k")], "r").count() == 0
    quota = decide.keep_quota(df.withColumnRenamed("k", "discovery_rank"), 5, F.col("discovery_rank") % 2 == 0, ["discovery_rank"])
    assert sorted(r[0] for r in quota.filter("in_quota").select("discovery_rank").collect()) == [0, 2, 4, 6, 8]


def test_file_name_clash(spark):
    sha = lambda s: s.ljust(64, "0")
    rows = [("http://h/a.jpg", sha("a" * 12 + "1"), "image/png", "photo", 1), ("http://g/a.jpg", sha("a" * 12 + "2"), "image/png", "photo", 2), ("http://g/a", sha("b"), "image/png", "photo", 3)]
    got = [r["filepath"] for r in ledger.file_paths(spark.createDataFrame(rows, "url string, sha256 string, content_type string, category string, discovery_rank long"), F.lit("o")).orderBy("discovery_rank").collect()]
    assert got == ["o/photo/" + "a" * 12 + "_a.png", "o/photo/" + "a" * 12 + "2000_a.png", "o/photo/b00000000000_a.png"]
    taken = spark.createDataFrame([("o/photo/" + "a" * 12 + "_a.png",), ("o/photo/b00000000000_a.png",), ("o/photo/b000000000000000_a.png",)], "filepath string")
    got = [r["filepath"] for r in ledger.file_paths(spark.createDataFrame(rows, "url string, sha256 string, content_type string, category string, discovery_rank long"), F.lit("o"), taken).orderBy("discovery_rank").collect()]
    assert got == ["o/photo/" + "a" * 12 + "1000_a.png", "o/photo/" + "a" * 12 + "2000_a.png", "o/photo/b" + "0" * 19 + "_a.png"]


def test_one_payload_of_a_url_counts(spark):
    hits, payloads, verdicts = inputs(spark, {"http://h/a.jpg": b"1", "http://h/b.jpg": b"2"}, {"http://h/a.jpg": VALID, "http://h/b.jpg": VALID})
    more = spark.createDataFrame([("http://h/a.jpg", 200, "image/png", None, b"1"), ("http://h/a.jpg", 404, "image/png", None, b"x"), ("http://h/b.jpg", 200, "image/png", None, b"2")], PAYLOADS)
    none = spark.createDataFrame([], LEDGER)
    run = curate(hits, payloads.union(more).union(more), verdicts.distinct(), none, replace(CONFIG, limit=1))
    assert sorted((r["url"], r["model_name"], r["kept"]) for r in run.decisions.collect()) == [("http://h/a.jpg", "m", True), ("http://h/b.jpg", "limit_reached", False)]


def test_auditor_and_its_limit(spark):
    def auditor(content, mime):
        if content == b"bad":
            raise ValueError("no answer")
        return {"quality": "gray" if content == b"g" else "good", "is_gray": content == b"g", "reason": "r"}

    files = spark.createDataFrame([("a", b"g"), ("b", b"ok"), ("c", b"bad")], "filepath string, content binary")
    said = providers.audit(files, auditor, retries=0)
    assert {r["filepath"]: (r["llm"]["quality"], r["llm"]["is_gray"], r["llm"]["reason"]) for r in said.collect()} == {"a": ("gray", True, "r"), "b": ("good", False, "r"), "c": ("error", None, "no answer")}
    items = spark.createDataFrame([("a", False, []), ("b", True, ["x"]), ("c", True, [])], "filepath string, flagged boolean, flags array<string>")
    assert [r["filepath"] for r in audit.candidates(items, [F.col("filepath")], 1).collect()] == ["b"]
    assert [r["filepath"] for r in audit.candidates(items.filter("not flagged"), [F.col("filepath")], 5).collect()] == ["a"]
    waits = []
    assert providers.audit_one(auditor, b"bad", None, 2, waits.append)["quality"] == "error" and waits == [1.0, 2.1]


def test_gates_of_discovery(spark):
    hits = spark.createDataFrame([(0, "q", i, u) for i, u in enumerate(["http://h/thumb/a.jpg", "http://Bad.example/b.jpg", "http://h/c.jpg"])], HITS)
    none = spark.createDataFrame([], LEDGER)
    found = lambda c: [r["url"] for r in discovery.discover(hits, none, c).orderBy("discovery_rank").collect()]
    assert len(found(CONFIG)) == 3 and found(replace(CONFIG, reject_thumbnails=True, blocked_hosts=("bad.example",))) == ["http://h/c.jpg"]


def test_expansion_counts(spark):
    """14 queries, one not ASCII, with 4 extras of which 2 repeat: 174 spellings, 172 distinct. 4 queries: 44."""
    config, endings = CurationConfig(), ["one", "wallpaper 4k", "cosplay", "fanart", "2d art", "3d render", "key art", "screenshot", "official art", "wallpaper", "nsfw", "sfw", "remake"]
    base, extras = [f"Subject {x}" for x in endings] + ["主題"], ("Subject two remake", "Subject key art", "Subject portrait", "Subject 3d render")
    for queries, n in ((base, 172), ([*base[:3], base[-1]], 44)):
        rows = spark.createDataFrame(list(enumerate(queries)), "base_rank long, query string")
        assert discovery.expand_queries(rows, config.variant_suffixes, config.filetype_suffixes, extras).count() == n


def hamming(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_against_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = [rng.choice(centres) for _ in range(250)]
    for i in range(len(values)):
        for _ in range(rng.randint(0, 5)):
            values[i] ^= 1 << rng.randrange(64)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    items = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    got = {r["id"]: r["n_similar"] for r in similarity.similar_counts(items, 6).collect()}
    assert got == {i: sum(j != i and hamming(a, b) <= 6 for j, b in enumerate(signed)) for i, a in enumerate(signed)}
    kept = []
    for i, a in enumerate(signed):
        if not any(hamming(a, signed[j]) <= 6 for j in kept):
            kept.append(i)
    ranked = items.select(F.col("id").alias("rank"), "hash")
    assert sorted(r["rank"] for r in similarity.greedy_keep(ranked, 6).groupBy("hash").agg(F.min("rank").alias("rank")).collect()) == kept
    probe = similarity.similar_to_kept(items, items.filter("id < 10"), 6)
    assert {r["id"] for r in probe.collect()} == {i for i, a in enumerate(signed) if any(hamming(a, b) <= 6 for b in signed[:10])}


def test_plans_are_what_they_should_be(spark):
    docs = spark.range(100).withColumn("category", F.lit("a"))
    plan = reports.category_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    anti = discovery.not_recorded(spark.range(10).select(F.col("id").alias("url")), spark.range(5).select(F.col("id").alias("url")))
    assert "LeftAnti" in anti._jdf.queryExecution().executedPlan().toString()


def png(width, height, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_metrics(spark, tmp_path):
    pictures = {"flat": lambda x, y: (90, 90, 90), "ramp": lambda x, y: (4 * x, 4 * x, 4 * x), "check": lambda x, y: ((255, 0, 0) if (x // 8 + y // 8) % 2 else (0, 0, 255)), "block": lambda x, y: (200, 200, 200) if x < 20 and y < 30 else (10, 10, 10)}
    for name, pixel in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png(64, 64, pixel))
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = images.image_metrics(tables.read_images(spark, str(tmp_path)))
    got = {r["filepath"].rsplit("/", 1)[1]: r for r in audit.with_flags(found, AuditThresholds()).collect()}
    assert got["broken.png"]["width"] is None and got["broken.png"]["flags"] == ["metrics_missing"]
    assert got["flat.png"]["luma_stddev"] == 0 and got["flat.png"]["entropy"] == 0 and got["flat.png"]["flat_ratio"] == 1
    assert {"low_luma+low_sat_std", "flat_ratio", "low_entropy"} <= set(got["flat.png"]["flags"])
    assert got["ramp.png"]["entropy"] == pytest.approx(6.0) and got["check.png"]["colorfulness"] > 100
    assert got["block.png"]["phash"] != got["ramp.png"]["phash"] and len(got["ramp.png"]["phash"]) == 16
    gates = {r["filepath"].rsplit("/", 1)[1]: r["reason"] for r in images.size_gate(tables.read_images(spark, str(tmp_path)), 65).collect()}
    assert gates["broken.png"] == "decode_failed" and gates["flat.png"] == "too_small size=64x64"


def test_audit_report(spark):
    schema = "filepath string, luma_stddev double, sat_stddev double, sat_mean double, colorfulness double, flat_ratio double, laplacian_var double, edge_density double, entropy double, edge_mean double, brightness double"
    items = spark.createDataFrame([("a", 1.0, 1.0, 50.0, 50.0, 0.1, 99.0, 1.0, 7.0, 1.0, 1.0), ("b", 50.0, 50.0, 50.0, None, None, None, None, None, 1.0, 1.0)], schema)
    said = spark.createDataFrame([("b", ("Low", False, "dull"))], "filepath string, llm struct<quality:string,is_gray:boolean,reason:string>")
    out = audit.with_auditor(audit.with_flags(items, AuditThresholds()), said)
    flags = {r["filepath"]: r["flags"] for r in out.collect()}
    assert flags == {"a": ["low_luma+low_sat_std"], "b": ["llm_low"]}
    report = audit.quality_report(out, [F.col("filepath")])
    assert "Flagged as likely gray/low quality: 2 (100.0%)" in report and "- a | luma_std=1.00" in report
    files = audit.mark_missing(spark.createDataFrame([("a",), ("z",)], "filepath string"), items)
    assert {r["filepath"]: r["error"] for r in files.collect()} == {"a": None, "z": "missing_file"}


def test_logs(spark, tmp_path):
    lines = ["2024 | INFO | r | Download failed url=u error=Status 403", "2024 | INFO | r | download failed url=u error=status 403", "2024 | INFO | r | download failed error=", "  more text", "x status 429"]
    (tmp_path / "run_1.log").write_text("\n".join(lines))
    assert tables.latest_log(spark, str(tmp_path)).endswith("run_1.log")
    assert tables.latest_log(spark, str(tmp_path / "none")) is None
    log = tables.read_log(spark, str(tmp_path / "run_1.log"))
    assert reports.log_counters(log).first()["download_failed"] == 3
    assert [(r["reason"], r["n"]) for r in reports.failure_reasons(log).collect()] == [("Status 403", 2)]
    assert tables.parse_log(log).filter("level = 'INFO'").count() == 3


def test_providers():
    calls = []

    def flaky(content, model, with_schema):
        calls.append((model, with_schema))
        if model == "p":
            raise providers.NoVisionError("no images")
        if with_schema:
            raise providers.SchemaError("no schema")
        return "fine"

    assert providers.ask(flaky, b"", ("p", "f"), 2) == ("fine", "f", None)
    assert calls == [("p", True), ("f", True), ("f", False)]
    assert providers.ask(flaky, b"", ("p", "f"), 0)[0] is None
    policy = providers.RetryPolicy(3)
    assert policy.wait(404, 0) is None and policy.wait(429, 0, 7.0) == 7.0 and policy.wait(500, 2) is None


def test_search_source(spark):
    spark.dataSource.register(tables.search_source(lambda q, n: [f"http://{q}/{i}" for i in range(5)], 3))
    rows = spark.read.format("search").option("queries", "a\nb").load()
    assert rows.count() == 6 and rows.schema == HITS


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("limit: 3\nsearch_queries: [a, b]\naudit: {min_entropy: 1.5}\nother: 1\n")
    config = load_config(str(tmp_path / "c.yaml"), {"GLEANWORK_API_KEY": "k"})
    assert (config.limit, config.search_queries, config.audit.min_entropy, config.api_key, config.url_cap) == (3, ("a", "b"), 1.5, "k", 6)
    assert load_config(None, {}).limit == 20


def test_command_line(spark, tmp_path):
    from gleanwork.cli import main

    hits, payloads, verdicts = inputs(spark, {"http://h/a.jpg": b"1", "http://h/b.jpg": b"2"}, {"http://h/a.jpg": VALID})
    for name, df in (("hits.parquet", hits), ("payloads.parquet", payloads), ("verdicts.parquet", verdicts)):
        df.write.parquet(str(tmp_path / name))
    (tmp_path / "c.yaml").write_text(f"min_bytes: 1\nlog_dir: {tmp_path}/logs\n")
    base = ["--config", str(tmp_path / "c.yaml")]
    out = ["--out", str(tmp_path / "out")]
    run = [*base, "run", *out, "--hits", str(tmp_path / "hits.parquet"), "--payloads", str(tmp_path / "payloads.parquet"), "--verdicts", str(tmp_path / "verdicts.parquet"), "--limit", "1"]
    assert main(run, spark) == ["urls_found=2 downloaded=2 classified=1 kept=1 discarded=1"]
    assert main(run, spark) == ["urls_found=0 downloaded=0 classified=0 kept=0 discarded=0"]
    assert main([*base, "stats", *out], spark) == ["Total records: 2", "discard: 1", "photo: 1"]
    assert "- Kept: 1 (50.0%)" in main([*base, "report", *out], spark)
    assert json.loads((tmp_path / "out/manifest.json").read_text())["count"] == 2
    with pytest.raises(SystemExit):
        main([*base, "run", *out, "--hits", "x", "--payloads", "y"], spark)


def test_observed_counts(spark):
    from pyspark.sql import Observation

    from gleanwork.plans.curate import watched

    seen = Observation()
    watched(spark.createDataFrame([(True,), (False,), (True,)], "kept boolean"), seen).collect()
    assert seen.get == {"downloaded": 3, "kept": 2, "discarded": 1}


def test_gates(spark):
    schema = "luma_stddev double, sat_stddev double, sat_mean double, colorfulness double, flat_ratio double, laplacian_var double, edge_density double, entropy double, cut boolean"
    rows = [(1.0, 1.0, 90.0, 90.0, 0.0, 99.0, 1.0, 7.0, False), (9.0, 1.0, 1.0, 90.0, 0.0, 99.0, 1.0, 7.0, False), (9.0, 1.0, 90.0, 1.0, 0.0, 99.0, 1.0, 7.0, False), (9.0, 9.0, 9.0, 9.0, 0.9, 99.0, 1.0, 7.0, False), (9.0, 9.0, 9.0, 9.0, 0.0, 13.0, 1.0, 7.0, True), (9.0, 9.0, 9.0, 9.0, 0.0, 13.0, 1.0, 7.0, False)]
    got = spark.createDataFrame(rows, schema).select(audit.gate_reason(AuditThresholds(), F.col("cut")).alias("r")).collect()
    assert [r["r"] for r in got] == ["low_variance", "low_saturation", "low_color", "flat_ratio", "truncated_low_quality", None]
