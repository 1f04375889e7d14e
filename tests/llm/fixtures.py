"""Small tables with the awkward cases every operator must define: nulls, empties, long texts, ties, repeats, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stats string, score string, sequence_id string, g string"


def document_rows() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = prose(120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "One",
        "one two three",
        base,
        base,
        base.upper(),
        near,
        " ".join(words[:100] + prose(20).split()),
        " ".join(words[:40] + prose(300).split()),
        "a b c " * 40,
        "same line here\nother line\nsame line here\n\n\nsame line here\n" + prose(60),
        prose(9000),
        "*** $$$ " * 80 + prose(80),
        "Under the MIT\n License, or Apache License, Version 2.0; CC BY-NC. All rights reserved",
        "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\n" + prose(55),
        "tab\tand no-break \x1c odd  blanks\r\n'll it's 12345 日本語 🙂 é <|endoftext|>",
        "x" * 6000,
    ]
    texts += [prose(rng.randint(40, 400)) for _ in range(40)]
    rows = []
    for i, text in enumerate(texts):
        lang = None if i % 11 == 0 else "en" if i % 2 else "de"
        rows.append((i, text, lang, None if i % 7 == 0 else f"s{i % 2}", None, "x", "y", "z", "g"))
    rows.append(rows[9])  # a row repeated as a whole
    rows.append((None, base, "en", "s0", 1, "x", "y", "z", "g"))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


def documents(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(5)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
