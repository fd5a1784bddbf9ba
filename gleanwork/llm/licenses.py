"""Licence scans: phrases by Aho-Corasick, SPDX expressions by a shunting-yard parser.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z. Null
texts are empty. Every row is scanned alone, so repeated rows repeat results and ties
can't occur. A very long text is scanned whole, in time and memory in proportion to it.
An empty table gives no rows; other columns are ignored.

The automaton finds notice phrases and the tag of SPDX expressions; an expression is
parsed where a tag ends. Exceptions after `with` are no licences and give no label;
identifiers of no known licence are marked. Of the phrases the lists below are the
standard notices of common licences, not all that SPDX names.
"""

from __future__ import annotations

import bisect
import itertools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, texts_of

# Phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Phrases of the method's own, with a label, and how open the licence is.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "cc0": "cc0-1.0",
    "the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
    "do not distribute": "proprietary",
    "non commercial use only": "non-commercial",
    "noncommercial use only": "non-commercial",
    "mozilla public license version 2 0": "mpl-2.0",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
}
# Creative Commons forms, by code and in words.
for _code, _words in {
    "nc": ["noncommercial", "non commercial"], "nd": ["noderivatives", "no derivatives", "noderivs"], "sa": ["sharealike", "share alike"],
    "nc nd": [f"{a} {b}" for a in ("noncommercial", "non commercial") for b in ("noderivatives", "no derivatives", "noderivs")],
    "nc sa": [f"{a} {b}" for a in ("noncommercial", "non commercial") for b in ("sharealike", "share alike")],
}.items():
    PHRASES[f"cc by {_code}"] = f"cc-by-{_code.replace(' ', '-')}"
    PHRASES |= {f"creative commons attribution {x}": PHRASES[f"cc by {_code}"] for x in _words}
# Versions of the GNU licences, which fall under their family's openness.
for _family, _words in {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}.items():
    for _v in ("2", "2 1", "3"):
        _label = f"{_family}-{_v.replace(' ', '.')}{'' if ' ' in _v else '.0'}"
        PHRASES |= {x: _label for x in (f"{_words} version {_v}", f"{_words} v{_v}", f"{_family}v{_v}", f"{_family} v{_v}", f"{_family} version {_v}")}
TAG = "spdx license identifier"
_PLACED = {*BASE_PHRASES, TAG}
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "isc": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "public-domain": 1.0,
    "0bsd": 1.0, "afl": 1.0, "artistic": 0.8, "blueoak": 1.0, "bsl": 1.0, "cddl": 0.7, "cecill": 0.5, "epl": 0.7, "eupl": 0.6, "ncsa": 1.0, "ofl": 0.8, "openssl": 0.9, "postgresql": 1.0, "psf": 1.0, "python": 1.0, "unicode": 1.0, "wtfpl": 1.0, "x11": 1.0, "zlib": 1.0, "cc0": 1.0, "licenseref": 0.3, "busl": 0.1, "sspl": 0.1,
    "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nd": 0.3, "cc-by-nc": 0.3, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "non-commercial": 0.2, "mpl": 0.7, "lgpl": 0.6, "gpl": 0.5, "agpl": 0.4, "reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN = 0.3

_SEPARATORS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_REST = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Marks an identifier of no licence that is known here.
UNKNOWN_MARK = "unknown:"


def family(name: str) -> str | None:
    """The entry of OPENNESS for an identifier: its own, or that of the longest part before a version."""
    parts = name.rstrip("+").split("-")
    return next((x for n in range(len(parts), 0, -1) if (x := "-".join(parts[:n])) in OPENNESS), None)


def openness(name: str) -> float:
    return OPENNESS[known] if (known := family(name)) else UNKNOWN


def is_exception(name: str) -> bool:
    """Whether an identifier may follow `with`: exceptions say so in their names, but for one."""
    return "exception" in name or name == "linux-syscall-note"


def _well_formed(text: str) -> list[str]:
    """The tokens of the longest well-formed expression that text begins with."""
    tokens, end, depth, want, last, good = [], 0, 0, True, "", 0
    for m in _TOKEN.finditer(text):
        token = m[0].lower()
        if text[end : m.start()].strip():
            break  # something that no expression holds stands before this token
        if token == "(":
            if not want or last == "with":
                break
            depth += 1
        elif token == ")":
            if want or not depth:
                break
            depth -= 1
        elif token in _BINDS:
            if want or token == "with" and (last == ")" or is_exception(last)):
                break
            want = True
        else:
            if not want or is_exception(token) != (last == "with"):
                break
            want = False
        tokens.append(token)
        end, last = m.end(), token
        if not want and not depth:
            good = len(tokens)
    return tokens[:good]


def parse_expression(text: str) -> tuple[list[str], list[str]]:
    """Identifiers of licences, and the postfix form of the longest well-formed expression that text begins with."""
    out, stack = [], []
    for token in _well_formed(text):
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    out += reversed(stack)
    return [x for x in out if x not in _BINDS and not is_exception(x)], out


def evaluate(postfix: list[str]) -> float:
    """or: the more open choice; and: the stricter part; with: the licence, a little more open."""
    stack: list[float] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(openness(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(max(left, right) if token == "or" else min(left, right) if token == "and" else min(1.0, left + 0.1))
    return stack[0] if stack else 0.0


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *PHRASES, TAG}:
        automaton.add_word(_spread(phrase), phrase)
    automaton.make_automaton()
    return automaton


def scan(text: str, automaton: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, expression, score)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(_SEPARATORS).split()
    # each word is its own bytes as latin-1; doubled spaces let phrases share a boundary
    joined = f" {b'  '.join(words).decode('latin-1')} " if words else ""
    found = list(automaton.iter(joined))
    # where the space before each word stands: phrases begin there
    places = list(itertools.accumulate((len(w) + 2 for w in words), initial=0)) if any(x in _PLACED for _, x in found) else []
    n_base, first, last, base, labels, score, tagged = 0, None, None, set(), set(), 0.0, []
    for end, phrase in found:
        word = bisect.bisect_left(places, end - len(_spread(phrase)) + 1) if phrase in _PLACED else 0
        if phrase == TAG:
            tagged.append(word + TAG.count(" "))
            continue
        labels.add(label := BASE_PHRASES.get(phrase) or PHRASES[phrase])
        if phrase in BASE_PHRASES:
            n_base, base = n_base + 1, base | {label}
            first, last = min(word, word if first is None else first), max(word, word if last is None else last)
    expressions = []
    for line in _after(data, tagged):
        names, postfix = parse_expression(line)
        if names:
            labels.update(x if family(x) else UNKNOWN_MARK + x for x in names)
            expressions.append(" ".join(postfix))
            score = max(score, evaluate(postfix))
    if not expressions and labels:
        score = min(openness(x) for x in labels)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), "; ".join(expressions), score


def _after(data: bytes, words: list[int]):
    """What follows each of some words and a colon, to the end of its line."""
    if words:
        ends = [m.end() for m in re.finditer(rb"[^ ]+", data.translate(_SEPARATORS))]
        for word in words:
            if m := _REST.match(data, ends[word]):
                yield m[1].decode("utf-8", "surrogatepass")


def _spread(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expression", pa.string()), ("score", pa.float64())])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expression string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs; score: how open the licence is that the text names, 0 without one.

    An SPDX expression outweighs phrases; of several the most open counts. Of
    phrases alone the strictest counts. No phrase: empty label strings.
    """

    def run(batches):
        automaton = build_automaton()
        for batch in batches:
            rows = [scan(t, automaton) for t in texts_of(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield batch_of(SCHEMA, doc_id=batch.column(0), **dict(zip(SCHEMA.names[1:], cols, strict=True)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, DDL)
