import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KID string, stats string, _quality int, bands int, digest string"


def make_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "über", "naïve", "and", "x"] + ["".join(rng.choices("abcdefghijk", k=rng.randint(3, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = prose(60), prose(120).split(" ")
    texts = [prose(rng.randint(1, 150)) for _ in range(30)]
    texts += [f"{prose(20)}\n{passage}\n{prose(30)}" for _ in range(6)]
    for changes in (0, 0, 1, 2, 3, 6, 12, 20):
        copy = list(base)
        for at in rng.sample(range(len(copy)), changes):
            copy[at] = f"changed{rng.randint(0, 999)}"
        texts.append(" ".join(copy))
    texts += [
        None, "", "", "   \n\t", "one", "two words", "two words", "a b c d", "a  b\nc d", "same line\nsame line\nother\n\nsame line", "w " * 300, prose(3000), "日本語の文章です。" * 20, "emoji 😀 <|endoftext|> text",
        "ﬁ Straße  CAFÉ", "fi STRASSE café", "x" * 5000, "All Rights Reserved. CC-BY cc by 4.0 cc by cc by", "GNU General Public License\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause",
        "SPDX-License-Identifier: MIT */ rest", "a b\x1cc\x85d e", "a.\n\n\nb\r\n\r\nc\n\n", "\x00nul\x00 byte", "Ä" * 40 + "\n" + "ö" * 7,
    ]
    rows = []
    for i, text in enumerate(texts):
        rows.append((i * 7 % 997, text, rng.choice(["en", "de", None, "xx"]), rng.choice(["s0", "s0", "s1", None]), len(text or ""), "k", "s", 1, 2, "d"))
    rows.append(rows[3])  # a repeated row
    rows.append(rows[3])
    rows.append((rows[4][0], "another text under a known id " + prose(40), *rows[4][2:]))
    rows.append((None, passage, *rows[5][2:]))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(rows):
    from collections import Counter

    return Counter(tuple(r) for r in rows)
