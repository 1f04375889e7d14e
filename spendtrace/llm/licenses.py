"""License scans: an Aho-Corasick automaton finds phrases and identifier tags, a shunting-yard parser evaluates expressions.

A text is lower-cased (A-Z) and its words are the runs of digits, letters a-z and
non-ASCII characters. Phrases are found where their words stand one behind the
other, whatever separates them, in one pass of the automaton over the words
joined by spaces. Behind an ``SPDX-License-Identifier:`` tag, the rest of the
line starts with a licence expression (``MIT OR (Apache-2.0 AND BSD-3-Clause)``,
``GPL-2.0-only WITH Classpath-exception-2.0``), which the parser turns into postfix
form and evaluates: AND is as strict as its stricter side, OR as lenient as its
more lenient one, WITH lifts a licence halfway to 1. If the rest is not an expression
as a whole, its longest start that is one counts, up to the end of the comment, quotation
or sentence. What breaks off at an operator, or is followed by
another licence without one (``MIT, GPL``), can't be read.

The score is how freely a document may be used, by its strictest finding: 1 for
permissive licences, 0 for reserved rights, and ``UNKNOWN_SCORE`` for an
unknown identifier or an expression that can't be read. Without any finding it
is ``NOTHING_SCORE``.

Defined results: null and empty texts have no words and no finding. Places may
overlap, and each phrase is counted at each of its places. Repeated rows give
equal rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.llm.staging import bounded_batches

#: Base phrases and labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases.
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution 4 0": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "cc0",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How freely each label lets a text be used.
SCORES = {
    "mit": 1.0,
    "apache-2": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "cc0": 1.0,
    "cc-by": 0.9,
    "mpl-2": 0.6,
    "lgpl": 0.5,
    "gpl-2": 0.3,
    "gpl-3": 0.3,
    "agpl": 0.2,
    "cc-by-nc": 0.1,
    "reserved": 0.0,
}
#: Identifiers of tags by the label they start.
IDENTIFIERS = {
    "mit": "mit",
    "isc": "isc",
    "apache-2.0": "apache-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "cc0-1.0": "cc0",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc",
    "mpl-2.0": "mpl-2",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "agpl-3.0": "agpl",
}
UNKNOWN_SCORE = 0.25
NOTHING_SCORE = 0.5
UNKNOWN_LABEL = "unknown"

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier:([^\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


#: Ends of comments, quotations and markup, and of a sentence.
_CLOSING = re.compile(r"""\*+[/)]|-+!?>|--%>|-\}|[\]}"'`<>*#%?!\\]|[.](?=[\s)]|$)""")
_PART = re.compile(r"[()]|[a-z0-9.+-]+|[^\s()a-z0-9.+-]+")
_FAMILIES = {name.split("-")[0] for name in IDENTIFIERS}


class ExpressionError(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: ``with`` binds closest, then ``and``, then ``or``; equal ones from the left."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    tokens = _TOKEN.findall(expression.lower())
    if "".join(tokens) != "".join(expression.lower().split()):
        raise ExpressionError("unexpected characters")
    for token in tokens:
        if token in _STRENGTH:
            if operand_next:
                raise ExpressionError(f"{token} without a left side")
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ExpressionError("parenthesis behind an identifier")
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise ExpressionError("empty parenthesis or missing right side")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ExpressionError("unopened parenthesis")
            waiting.pop()
        else:
            if not operand_next:
                raise ExpressionError("two identifiers in a row")
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ExpressionError("incomplete expression")
    return out + waiting[::-1]


def label_of(identifier: str) -> str:
    name = identifier.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return IDENTIFIERS.get(name, UNKNOWN_LABEL)


def evaluate(expression: str) -> tuple[set[str], float]:
    """(labels, score) of a licence expression."""
    stack: list[tuple[set[str], float]] = []
    for token in to_postfix(expression):
        if token not in _STRENGTH:
            label = label_of(token)
            stack.append(({label}, SCORES.get(label, UNKNOWN_SCORE)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the right side names an exception, not a licence
            stack.append((left[0], (1 + left[1]) / 2))
        else:
            stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
    return stack[0]


def _names_licence(token: str) -> bool:
    return label_of(token) != UNKNOWN_LABEL or token in _FAMILIES or re.fullmatch(r"[a-z][a-z.+-]*-v?\d[a-z0-9.+-]*", token) is not None


def evaluate_start(rest: str, bracketed: bool = False) -> tuple[set[str], float]:
    """(labels, score) of the expression that a line's rest starts with; ``bracketed``: the tag stands in an open parenthesis."""
    try:
        return evaluate(re.sub(r"[.]\s*$", "", rest))
    except ExpressionError:
        pass
    rest = rest.lower().lstrip(" \t\"'`")
    closing = _CLOSING.search(rest)
    parts = _PART.findall(rest[: closing.start()] if closing else rest)
    whole, depth, operand_next = 0, 0, True
    for k, part in enumerate(parts):
        operand = _TOKEN.fullmatch(part) is not None and part not in _STRENGTH and part not in "()"
        if operand_next != (operand or part == "(") or (part == ")" and not depth) or not _TOKEN.fullmatch(part):
            break
        depth += (part == "(") - (part == ")")
        operand_next = part == "(" or part in _STRENGTH
        if not operand_next and not depth:
            whole = k + 1
    left = parts[whole:]
    if left and (left[0] in _STRENGTH or (left[0] == ")" and not bracketed)):
        raise ExpressionError("incomplete expression")
    following = next((p for p in left if _TOKEN.fullmatch(p) and p not in "()"), "") if left[:1] != [")"] else ""
    if following and (following in _STRENGTH or _names_licence(following.rstrip("."))):
        raise ExpressionError("another licence without an operator")
    return evaluate(" ".join(parts[:whole]))


@dataclass
class Finding:
    phrase: str
    label: str
    base: bool
    word: int


class LicenseScanner:
    def __init__(self, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES):
        self.machine = ahocorasick.Automaton()
        for phrases, is_base in ((notices, False), (base, True)):
            for phrase, label in phrases.items():
                self.machine.add_word(f" {phrase} ", (phrase, label, is_base))
        self.machine.add_word(f" {TAG} ", (TAG, None, False))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[Finding], set[str], float]:
        """(number of words, phrase places, labels, score)."""
        words = (text or "").encode().translate(_WORD_BYTES).split(b" ")
        joined = b" ".join(filter(None, words))
        n_words = joined.count(b" ") + 1 if joined else 0
        normal = f" {joined.decode()} "
        found: list[Finding] = []
        tagged = False
        seen, upto = 0, 0
        for end, (phrase, label, is_base) in self.machine.iter(normal):
            if label is None:
                tagged = True
                continue
            start = end - len(phrase) - 1  # of the space before the phrase
            seen += normal.count(" ", upto, start + 1) if start >= upto else -normal.count(" ", start + 1, upto)
            upto = start + 1
            found.append(Finding(phrase, label, is_base, seen - 1))
        labels = {f.label for f in found}
        scores = [SCORES[f.label] for f in found]
        if tagged:
            for tag in _TAG_LINE.finditer(text):
                before = text[text.rfind("\n", 0, tag.start()) + 1 : tag.start()]
                try:
                    names, score = evaluate_start(tag[1], before.count("(") > before.count(")"))
                except ExpressionError:
                    names, score = {UNKNOWN_LABEL}, UNKNOWN_SCORE
                labels |= names
                scores.append(score)
        return n_words, found, labels, min(scores, default=NOTHING_SCORE)


FINDINGS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("places", T.ArrayType(T.LongType())),
        T.StructField("phrases", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def license_findings(docs: DataFrame) -> DataFrame:
    """doc_id and the :data:`FINDINGS` of each row's whole text; places and phrases hold all findings, base or not."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(FINDINGS)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = LicenseScanner()
        rows = []
        for text in texts:
            n_words, found, labels, score = scanner.scan(text.as_py())
            at = [f.word for f in found if f.base]
            rows.append(
                {
                    "n_words": n_words,
                    "n_base": len(at),
                    "first_word": min(at, default=None),
                    "last_word": max(at, default=None),
                    "base_labels": sorted({f.label for f in found if f.base}),
                    "labels": sorted(labels),
                    "places": [f.word for f in found],
                    "phrases": [f.phrase for f in found],
                    "score": score,
                }
            )
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string()), pa.float64()]
        return pa.array(rows, pa.struct([pa.field(f.name, t) for f, t in zip(FINDINGS, kinds)]))

    rows = docs.select("doc_id", scan("text").alias("found"))
    return rows.select("doc_id", *[f"found.{f.name}" for f in FINDINGS])
