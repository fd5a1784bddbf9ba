"""Token counts of a document's sections, from one encoding of the whole document.

Sections are a text's lines, each with its closing \\n. Every token is counted in
one section, so the counts of a document add up to its tokens. A token that
crosses a boundary goes to the section that holds most of its code points, the
earliest of several; a code point belongs to the token that holds its first byte.
A token without such a byte goes to the section of its own first byte.

Null texts are empty: no section, no token. Repeated rows repeat results. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, texts_of
from .vocabularies import byte_vocabulary, vocabulary_path

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.int64()))])


def spans(ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The n + 1 byte offsets of the tokens: each is the bytes that its entry holds."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(widths[ids])])


def attribute(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens crossed a boundary."""
    if not len(data):
        return np.zeros(0, np.int64), 0
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(data[:-1] == 10) + 1])
    first = np.searchsorted(starts, offsets[:-1], "right") - 1
    last = np.searchsorted(starts, offsets[1:] - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    leads = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    for token in crossing:
        edges = np.concatenate([[offsets[token]], starts[first[token] + 1 : last[token] + 1], [offsets[token + 1]]])
        first[token] += int(np.argmax(np.diff(leads[edges])))
    return np.bincount(first, minlength=len(starts)), len(crossing)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, added: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_sections, n_crossing, section_tokens."""
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocabulary = byte_vocabulary(json_path, ranks_path, added)
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                ids, data = vocabulary.ids(text), np.frombuffer(text.encode(), np.uint8)
                tokens, crossing = attribute(data, spans(ids, vocabulary.widths))
                rows.append((len(ids), len(tokens), crossing, tokens))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield batch_of(SCHEMA, doc_id=batch.column(0), **dict(zip(SCHEMA.names[1:], cols, strict=True)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
