"""Quality rules: counts over words and lines, then tokeniser fertility by language.

Null texts are empty (no words: base_failed, not kept). Each row is judged
alone, so repeated rows repeat results. Nothing of a text is left out. An empty
table gives no rows. A null or unknown language is judged by script. The report
ignores other columns; keep_good() returns them untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh
from .common import batch_of, slices, texts_of, utf8
from .textstats import base_counts
from .vocabularies import byte_vocabulary, piece_vocabulary, vocabulary_path

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Bands, by language and else by script: least and most characters per token of the
# byte-level vocabulary, most byte-fallback share of the piece vocabulary, and least
# share of the entropy that a text of so many tokens could have.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "en": (1.6, 8.0, 0.12, 0.35),
    "de": (1.5, 8.0, 0.12, 0.35),
    "fr": (1.4, 8.0, 0.12, 0.35),
    "es": (1.4, 8.0, 0.12, 0.35),
    "latin": (1.2, 9.0, 0.15, 0.30),
    "cyrillic": (0.5, 6.0, 0.20, 0.30),
    "cjk": (0.2, 3.0, 0.60, 0.30),
    "other": (0.2, 9.0, 0.95, 0.25),
}
# By language: the least characters per token of n tokens are chars - spread / sqrt(n), and
# the least entropy share is level + slope * log2(n), at most ENTROPY_CAP, as short texts vary
# more and long ones repeat more. Fitted on rows of sf0.1 labelled quality 1 that pass the base
# rule and whose labels may be learned (classifier.may_train): mean characters less 0.05, 2.5
# deviations, and the line of the entropy lowered to its 0.5% quantile. They narrow BANDS.
FITTED: dict[str, tuple[float, float, float, float]] = {
    "en": (2.613, 2.78, 1.1714, -0.0516),
    "de": (2.333, 2.68, 1.1868, -0.0545),
    "fr": (2.150, 2.77, 1.1713, -0.0541),
    "es": (2.042, 2.76, 1.1504, -0.0528),
}
ENTROPY_CAP = 0.8
_CYRILLIC, _CJK, _LATIN = (re.compile(x) for x in ("[Ѐ-ԯ]", "[぀-ヿ㐀-鿿가-힯]", "[A-Za-zÀ-ɏ]"))

STATS = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("band", pa.string()),
])
STATS_DDL = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,"
    "n_tokens:bigint,chars_per_token:double,fallback_share:double,token_entropy:double,band:string>"
)


def script(text: str) -> str:
    """The script of the most letters among three, else other."""
    if text.isascii():
        return "latin" if _LATIN.search(text) else "other"
    n = {"cyrillic": len(_CYRILLIC.findall(text)), "cjk": len(_CJK.findall(text)), "latin": len(_LATIN.findall(text))}
    best = max(n, key=n.get)
    return best if n[best] else "other"


def fertility(text: str, vocabulary, pieces) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share of the bytes, and entropy as a share of its most."""
    ids = vocabulary.ids(text)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(p * np.log2(p)).sum()) / np.log2(len(ids)) if len(ids) > 1 else 1.0
    of_bytes = pieces.fallback_bytes(text)
    share = of_bytes / len("".join(text.split()).encode()) if of_bytes else 0.0
    return len(ids), len(text) / len(ids), share, entropy


def within(band: str, bands: dict, fitted: dict, tokens: int, chars: float, fallback: float, entropy: float) -> bool:
    """Whether what fertility() gives lies in the band and, if one is fitted, above its bounds for so many tokens."""
    least, most, bytes_most, entropy_least = bands[band]
    if band in fitted and tokens:
        at, spread, level, slope = fitted[band]
        least = max(least, at - spread / tokens**0.5)
        entropy_least = max(entropy_least, min(ENTROPY_CAP, level + slope * float(np.log2(tokens))))
    return least <= chars <= most and fallback <= bytes_most and entropy >= entropy_least


def annotate(docs: DataFrame, into: str, text_col: str = "text", lang_col: str = "lang", byte_path: str | None = None, ranks_path: str | None = None, piece_path: str | None = None, bands: dict | None = None, added: bool = False) -> DataFrame:
    """All columns of docs, and a struct of the counts and the verdict named `into`.

    A band that is given replaces both the band and the fitted bounds of its language.
    """
    byte_path = byte_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
    piece_path = piece_path or vocabulary_path("piece_bpe_32k.model")
    fitted = {k: v for k, v in FITTED.items() if k not in (bands or {})}
    bands = {**BANDS, **(bands or {})}
    text_at = docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def judge(column: pa.Array, langs: list) -> pa.Array:
        vocabulary, pieces = byte_vocabulary(byte_path, ranks_path, added), piece_vocabulary(piece_path)
        data, offsets = utf8(column)
        counts: dict[str, list] = {f.name: [] for f in STATS}
        for lo, hi in slices(offsets):
            base = base_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = base["n_words"]
            failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                counts[k].append(base[k])
            counts["base_failed"].append(failed)
            rows = []
            for text, lang, bad in zip(texts_of(column.slice(lo, hi - lo)), langs[lo:hi], failed, strict=True):
                band = lang if lang in bands else script(text)
                tokens, chars, fallback, entropy = fertility(text, vocabulary, pieces)
                rows.append((not bad and within(band, bands, fitted, tokens, chars, fallback, entropy), tokens, chars, fallback, entropy, band))
            for k, values in zip(("kept", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "band"), zip(*rows, strict=True), strict=True):
                counts[k].append(np.array(values))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], f.type) for f, v in zip(STATS, counts.values(), strict=True)], fields=list(STATS))

    def run(batches):
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, judge(batch.column(text_at), langs)], names=[*batch.schema.names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DataType.fromDDL(STATS_DDL))])
    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per row of docs: the id and all counts."""
    langs = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), langs.alias("lang"))
    return annotate(rows, "stats", **options).select("doc_id", "stats.*")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with the columns of docs."""
    into = fresh(docs, "_quality")
    return annotate(docs, into, **options).filter(F.col(f"{into}.kept")).drop(into)
