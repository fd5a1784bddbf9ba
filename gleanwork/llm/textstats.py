"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from .textkit import covered, digests, inside, mix, split_words, sums, text_of_word, window_hashes

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SYMBOL = _table(SYMBOLS)
_UPPER, _DIGIT, _MARK = _table(bytes(range(0x41, 0x5B))), _table(b"0123456789"), _table(b".,;:?'\"()-")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(text: np.ndarray, halves: list[np.ndarray], every: bool) -> np.ndarray:
    """Flags of values that their text has twice or more: all of them, or all but the first.

    halves: both 64-bit halves of the values' digests.
    """
    order = np.argsort(halves[0] ^ mix(text.astype(np.uint64) + np.uint64(1)), kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (text, *halves)])
    out = np.zeros(len(order), bool)
    out[order] = (same[:-1] | same[1:]) if every else same[:-1]
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the quality rules and of the classifier, each an array over texts."""
    n = len(offsets) - 1
    starts, ends, first = split_words(data, offsets)
    text = text_of_word(first)
    points = (data & 0xC0) != 0x80
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(points)])
    size = at[ends] - at[starts] if len(data) else np.zeros(0, np.int64)
    words = digests(data, starts, ends)

    windows = inside(first, REPEAT_WINDOW)
    repeated = _repeats(text[windows], [window_hashes(x, REPEAT_WINDOW)[windows] for x in words], True) if len(windows) else np.zeros(0, bool)
    repeat_words = covered(len(starts), windows[repeated], REPEAT_WINDOW) if len(windows) else np.zeros(len(starts), bool)

    # lines with a word: from a text's start or a \n to the next \n or the text's end
    breaks = np.flatnonzero(data == 10) if len(data) else np.zeros(0, np.int64)
    line_from = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_from = line_from[line_from < len(data)]
    line_to = np.searchsorted(breaks, line_from)
    line_to = np.where(line_to < len(breaks), breaks[np.minimum(line_to, max(len(breaks) - 1, 0))], len(data)) if len(breaks) else np.full(len(line_from), len(data))
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    line_to = np.minimum(line_to, offsets[line_text + 1])
    line_words = np.searchsorted(starts, line_to) - np.searchsorted(starts, line_from)
    some = line_words > 0
    line_from, line_to, line_text = line_from[some], line_to[some], line_text[some]
    dup = _repeats(line_text, list(digests(data, line_from, line_to)), False) if len(line_from) else np.zeros(0, bool)
    last_byte = data[ends[np.searchsorted(starts, line_to) - 1] - 1] if len(line_from) else np.zeros(0, np.uint8)

    distinct = ~_repeats(text, list(words), False) if len(text) else np.zeros(0, bool)
    count = lambda flags, of: np.bincount(of[flags], minlength=n)
    return {
        "n_words": np.diff(first),
        "word_chars": sums(size, first),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": count(dup, line_text),
        "n_repeat_words": count(repeat_words, text),
        "n_lines": np.bincount(line_text, minlength=n),
        "n_distinct": count(distinct, text),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_digits": _per_text(_DIGIT[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
        "n_bangs": _per_text(data == 0x21, offsets),
        "n_bars": _per_text(data == 0x7C, offsets),
        "n_wide": _per_text(data >= 0xC0, offsets),
        "n_chars": _per_text(points, offsets),
        "n_short": count(size <= 3, text),
        "n_long": count(size >= 12, text),
        "n_closed": count((last_byte == 0x2E) | (last_byte == 0x21) | (last_byte == 0x3F), line_text) if len(line_from) else np.zeros(n, np.int64),
        "sum_square": sums(size * size, first),
    }
