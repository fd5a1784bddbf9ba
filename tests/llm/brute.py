"""Plain, slow versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_classes(rows, k=5, similarity=0.8):
    texts = defaultdict(list)
    for n, (_, text) in enumerate(rows):
        texts[tuple(words(text))].append(n)
    unique = [w for w in texts if w]
    bags = [Counter(w[i : i + k] for i in range(max(1, len(w) - k + 1))) for w in unique]
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(unique)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if shared >= similarity * (bags[i].total() + bags[j].total() - shared) - 1e-9:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, w in enumerate(unique):
        members[find(i)] += texts[w]
    key = lambda n: (rows[n][0] is None, rows[n][0])
    out = {n: rows[n][0] for n in texts.get((), [])}
    for group in members.values():
        least = min(group, key=key)
        out |= {n: rows[least][0] for n in group}
    return out


def weighted_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def substrings(rows, k=13):
    big = 1 << 63
    first = {}
    split = [(big if i is None else i, words(t)) for i, t in rows]
    for i, w in split:
        for n in range(len(w) - k + 1):
            key = tuple(w[n : n + k])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for n in range(len(w) - k + 1):
            if first[tuple(w[n : n + k])] < i:
                gone[n : n + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def phrases(text, table):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for phrase, label in table.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), found


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best] -= n
    return rooms


def raked(cells, targets, rounds=500):
    """{cell: weight} of {(category, ...): tokens}: every dimension in turn scaled to its target shares."""
    weight, total = dict(cells), sum(cells.values())
    for _ in range(rounds):
        for d, target in enumerate(targets):
            there = {c[d] for c, t in cells.items() if t}
            all_of = sum(target.get(k, 0) for k in there)
            for k in there:
                now = sum(w for c, w in weight.items() if c[d] == k)
                for c in weight:
                    if c[d] == k and now:
                        weight[c] *= target.get(k, 0) / all_of * total / now
    return weight


def is_calibrated(cells, probability, targets, budget):
    """Whether probabilities are min(1, product of a multiplier for each category) and meet targets and budget.

    Products have no interaction: over uncapped cells every cycle a, b / c, d of two dimensions multiplies out.
    """
    kept = sum(t * probability[c] for c, t in cells.items())
    if abs(kept - budget) > 1e-6 * budget:
        return False
    for d, target in enumerate(targets):
        there = {c[d] for c, t in cells.items() if t}
        for k in there:
            share = sum(t * probability[c] for c, t in cells.items() if c[d] == k) / kept
            if abs(share - target.get(k, 0) / sum(target.get(x, 0) for x in there)) > 1e-6:
                return False
    free = {c for c, t in cells.items() if t and 0 < probability[c] < 1}
    for a in free:
        for b in free:
            for d in range(len(targets)):
                c, e = a[:d] + (b[d],) + a[d + 1 :], b[:d] + (a[d],) + b[d + 1 :]
                if c in free and e in free and abs(probability[a] * probability[b] / (probability[c] * probability[e]) - 1) > 1e-6:
                    return False
    return True


def ridge_scores(features, labels, fit, calibrate, ridge):
    """Scores by ridge regression on the rows of fit, and the isotonic map of those of calibrate, by plain loops.

    The map: margins in 1,024 bins over -0.5 .. 1.5, means pooled until they don't fall, one
    knot for each level at its mean bin, straight lines between.
    """
    import numpy as np

    d = features.shape[1]
    zz, zy = np.zeros((d, d)), np.zeros(d)
    for i in np.flatnonzero(fit):
        zz += np.outer(features[i], features[i])
        zy += features[i] * labels[i]
    margin = features @ np.linalg.solve(zz + ridge * np.eye(d), zy)
    bins = defaultdict(lambda: [0.0, 0.0])
    for i in np.flatnonzero(calibrate):
        at = min(1023, max(0, int((margin[i] + 0.5) / 2 * 1024)))
        bins[at][0] += labels[i]
        bins[at][1] += 1
    levels = [[y, n, at * n] for at, (y, n) in sorted(bins.items())]
    i = 0
    while i + 1 < len(levels):
        if levels[i][0] / levels[i][1] >= levels[i + 1][0] / levels[i + 1][1]:
            levels[i : i + 2] = [[a + b for a, b in zip(levels[i], levels[i + 1], strict=True)]]
            i = max(0, i - 1)
        else:
            i += 1
    knots = [(at / n + 0.5) / 1024 * 2 - 0.5 for _, n, at in levels]
    return np.interp(margin, knots, np.maximum.accumulate([(y + 0.01) / (n + 0.02) for y, n, _ in levels]))
