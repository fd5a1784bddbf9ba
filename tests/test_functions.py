import hashlib

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import hashing, media, text, url, verdict

LABELS = ("photo", "other", "discard")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, ext", [
    ("http://h/b.JPG?x=1", ".jpg"), ("http://h/a.jpg;v=2", ".jpg"), ("http://h/.jpg", ""), ("http://h/a b.png", ".png"), ("http://h/a|b.png", ".png"), ("http://d.x/file", ""),
    ("http://h/a%2Ejpg", ""), ("http://h/a.tar.png#f", ".png"), ("http://h/dir.jpg/", ".jpg"), ("http://h.com", ""), ("", ""),
])
def test_url_ext(spark, given, ext):
    assert one(spark, url.url_ext(F.col("u")), u=given) == ext


@pytest.mark.parametrize("given, stem", [("http://h/p/b.JPG?x=1", "b"), ("http://h.com", "h.com"), ("http://h/.jpg", ".jpg"), ("", "image"), ("http://h/dir.x/", "dir")])
def test_url_stem(spark, given, stem):
    assert one(spark, url.url_stem(F.col("u")), u=given) == stem


@pytest.mark.parametrize("given, slug", [("Hello, World!", "hello-world"), ("--", "image"), ("", "image"), ("a" * 31 + " b", "a" * 31 + "-"), ("Ünï", "n")])
def test_slugify(spark, given, slug):
    assert one(spark, text.slugify(F.col("t")), t=given) == slug


@pytest.mark.parametrize("k, n, rate", [(0, 0, "0.0%"), (1, 3, "33.3%"), (2, 3, "66.7%"), (3, 3, "100.0%"), (0, 5, "0.0%"), (1, 80, "1.3%")])
def test_rate_text(spark, k, n, rate):
    assert one(spark, text.rate_text(F.col("k"), F.col("n")), k=k, n=n) == rate


def test_reason_flags_uri(spark):
    assert one(spark, text.error_reason(F.col("t")), t="x error=a error=b") == "a error=b"
    assert one(spark, text.error_reason(F.col("t")), t="x error=") == ""
    assert one(spark, text.join_flags(F.split("t", ",")), t="a,b") == "a,b"
    assert "\n" not in one(spark, text.data_uri(F.lit("image/png"), F.col("d")), d=bytes(200))


def test_hashes(spark):
    assert one(spark, hashing.sha256_hex(F.col("d")), d=b"abc") == hashlib.sha256(b"abc").hexdigest()
    bits = lambda c: hashing.hash_bits(F.col(c))
    assert one(spark, hashing.hamming(bits("a"), bits("b")), a="ffffffffffffffff", b="0000000000000000") == 64
    assert one(spark, hashing.hamming(bits("a"), bits("b")), a="8000000000000001", b="0000000000000000") == 2


def test_media(spark):
    for data, mime in ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n", "image/png"), (b"GIF89a", "image/gif"), (b"RIFF1234WEBPx", "image/webp"), (b"", "image/jpeg")):
        assert one(spark, media.sniff_mime(F.col("d")), d=data) == mime
    for given, ext in (("image/PNG; q=1", ".png"), ("application/octet-stream", ".bin"), ("image/pjpeg", ".jpg"), ("nonsense", ".jpg")):
        assert one(spark, media.mime_to_ext(F.col("t")), t=given) == ext
    assert one(spark, media.looks_like_html(F.col("d")), d=b" \t\n<html") is True
    assert one(spark, media.looks_like_html(F.col("d")), d=b"a<") is False


def test_html_after_long_white_space(spark):
    for n in (1023, 1024, 1025, 300_000):
        blanks = (b" \t\n\x0b\x0c\r" * n)[:n]
        for tail, is_html in ((b"<html", True), (b"a<", False), (b"", False), (b"\xff<", False), (b"\xe2", False)):
            assert one(spark, media.looks_like_html(F.col("d")), d=blanks + tail) is is_html, (n, tail)


def test_reject_reason(spark):
    rows = [
        (404, "", None, b"x" * 10, "status"), (200, "", "21", b"x" * 10, "too large (declared)"), (200, "", "4", b"x" * 10, "too small (declared)"), (200, "text/plain", None, b"x" * 10, "unsupported content-type"),
        (200, "", "11", b"x" * 10, "truncated"), (200, "", None, b"x" * 21, "too large"), (200, "", None, b"x" * 4, "too small"), (200, "", None, b" <body>", "html"),
        (200, "image/PNG; a", "10", b"x" * 10, None), (200, None, "abc", b"x" * 5, None), (200, "", None, b"x" * 20, None), (200, "", None, None, "status"), (None, "", None, b"x" * 10, "status"),
    ]
    df = spark.createDataFrame(rows, "status int, ct string, cl string, data binary, want string")
    got = df.select("want", media.reject_reason(F.col("status"), F.col("ct"), F.col("cl"), F.col("data"), 5, 20, ("image/png",)).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("body, label", [
    ('{"label":"photo","confidence":0.5,"is_underage_or_ambiguous":false}', "photo"), ('so {"label":"other","confidence":"0.9","reasons":["a"],"is_underage_or_ambiguous":"yes"} ok', "other"),
    ('["photo"]', None), ('{"label":"photo","confidence":0.5,"reasons":"x","is_underage_or_ambiguous":false}', None), ('{"label":"photo","confidence":0.5,"is_underage_or_ambiguous":false,"z":1}', None),
    ('{"label":"photo","confidence":1.5,"is_underage_or_ambiguous":false}', None), ('{"label":"photo","confidence":0.5}', None), ('{"label":"bad","confidence":0.5,"is_underage_or_ambiguous":false}', None),
    ("", None), ("{", None), ('"text"', None), ("3", None),
])
def test_verdicts(spark, body, label):
    got = one(spark, verdict.validate_verdict(verdict.extract_json(F.col("t")), LABELS), t=body)
    assert (got and got["label"]) == label


def test_responses_and_errors(spark):
    assert one(spark, verdict.response_text(F.col("t")), t='{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert one(spark, verdict.response_text(F.col("t")), t='{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}') == "ab"
    assert one(spark, verdict.candidate_text(F.col("t")), t='{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}') == "ab"
    assert one(spark, verdict.error_message(F.col("t")), t='{"error":{"message":"m"}}') == "m"
    assert one(spark, verdict.error_message(F.col("t")), t=" plain ") == "plain"
    for message, kind in (("Cannot decode image", "decode"), ("image not supported", "no_vision"), ("bad response_format", "schema_unsupported"), ("other", "other")):
        assert one(spark, verdict.error_class(F.col("t")), t=message) == kind
