import re

import pytest

from spendtrace.llm import licenses as L
from tests.llm.fixtures import document_rows, documents, no_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    places = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def test_base_matches_brute_force(spark):
    rows = document_rows()
    got = L.license_findings(documents(spark)).collect()
    want = sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[16].labels == ["apache-2", "cc-by-nc", "mit", "reserved"] and by_id[16].score == 0.0
    assert by_id[17].labels == ["apache-2", "gpl-3", "mit"] and by_id[17].score == 1.0
    assert by_id[6].score == L.NOTHING_SCORE
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in got)


def test_overlaps_and_long_texts():
    text = ("Under the MIT license; under the mit LICENSE under the mit licenses " + "é " * 50) * 500
    n_words, found, labels, _ = L.LicenseScanner().scan(text)
    assert (n_words, len(found), found[0].word, found[-1].word) == brute(text)[:4]
    assert labels == {"mit"}


@pytest.mark.parametrize(
    "expression, score",
    [
        ("MIT", 1.0),
        ("MIT OR GPL-3.0-only AND AGPL-3.0", 1.0),
        ("(MIT OR GPL-3.0-only) AND AGPL-3.0-or-later", 0.2),
        ("MIT AND GPL-2.0-only WITH Classpath-exception-2.0", 0.65),
        ("GPL-2.0+ OR LGPL-2.1 AND MIT", 0.5),
        ("Unheard-of-1.0", L.UNKNOWN_SCORE),
    ],
)
def test_expressions(expression, score):
    assert L.evaluate(expression)[1] == pytest.approx(score)


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL-2.0", "()", "MIT (GPL-2.0)", "MIT, GPL"])
def test_bad_expressions(expression):
    with pytest.raises(L.ExpressionError):
        L.evaluate(expression)
    assert L.LicenseScanner().scan("SPDX-License-Identifier: " + expression)[2:] == ({L.UNKNOWN_LABEL}, L.UNKNOWN_SCORE)


@pytest.mark.parametrize(
    "text, label",
    [
        ("/* SPDX-License-Identifier: MIT */", "mit"),
        ("/* SPDX-License-Identifier: MIT */ GPL-2.0", "mit"),
        ("<!-- SPDX-License-Identifier: Apache-2.0 -->", "apache-2"),
        ("<!--SPDX-License-Identifier: Apache-2.0-->", "apache-2"),
        ("(* SPDX-License-Identifier: BSD-3-Clause *)", "bsd"),
        ("SPDX-License-Identifier: MIT.", "mit"),
        ("SPDX-License-Identifier: GPL-2.0. More words", "gpl-2"),
        ("The file (SPDX-License-Identifier: MIT) is free", "mit"),
        ("SPDX-License-Identifier: MIT (see LICENSE)", "mit"),
        ("SPDX-License-Identifier: MIT, see the file LICENSE", "mit"),
        ('license = "SPDX-License-Identifier: MIT"', "mit"),
        ("SPDX-License-Identifier: MIT applies to all files", "mit"),
    ],
)
def test_tags_in_comments_and_prose(text, label):
    assert L.LicenseScanner().scan(text)[2:] == ({label}, L.SCORES[label])


def test_tag_with_an_expression_in_a_comment():
    assert L.LicenseScanner().scan("/* SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND MPL-2.0 */ x")[2:] == ({"mit", "gpl-3", "mpl-2"}, 0.6)


@pytest.mark.parametrize("rest", ["MIT OR */", "(MIT */", "*/", "MIT / GPL-2.0", "MIT (or GPL)", "MIT EUPL-1.2"])
def test_tags_that_cannot_be_read(rest):
    assert L.LicenseScanner().scan("/* SPDX-License-Identifier: " + rest)[2:] == ({L.UNKNOWN_LABEL}, L.UNKNOWN_SCORE)


def test_no_documents(spark):
    assert L.license_findings(no_documents(spark)).collect() == []
