"""SQL-text cleaning and normalising, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that (?U)\\s matches, for trimming without a regular expression.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]))
_SPACES += "\u2028\u2029\u202f\u205f\u3000"

# A comment counts only with its newline; a block comment never spans lines.
_LINE_COMMENT = "--[^\\n]*\\n"
_BLOCK_COMMENT = "/\\*[^\\n]*?\\*/"


def _drop_comments(c: Column) -> Column:
    c = F.regexp_replace(c, _LINE_COMMENT, "\n")
    return F.regexp_replace(c, _BLOCK_COMMENT, " ")


def _strip(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_SPACES))


def _collapse(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+", " ")


def _drop_semicolons(c: Column) -> Column:
    return F.rtrim(c, F.lit(";"))


def clean_query_text(c: Column | str) -> Column:
    """Drop comments, collapse whitespace, trim: the text saved with query history."""
    return F.trim(F.regexp_replace(_drop_comments(_col(c)), "\\s+", " "))


def normalize_sql(c: Column | str, repairs: Sequence[tuple[str, str]] = ()) -> Column:
    """Matching key for cost attribution; NULL becomes ''.

    ``repairs`` are (regex, replacement) pairs applied first, for logs whose
    identifiers were damaged upstream. Comments are kept.
    """
    text = _strip(_col(c))
    for pattern, replacement in repairs:
        text = F.regexp_replace(text, pattern, replacement)
    return _drop_semicolons(_collapse(F.upper(text)))


def normalize_sql_latency(c: Column | str) -> Column:
    """Matching key for latency; comments go, and what they leave is not trimmed."""
    text = _drop_comments(_strip(_col(c)))
    return _drop_semicolons(_collapse(F.upper(text)))


def has_text(c: Column | str) -> Column:
    """Whether a text normalises to something: not just blanks around semicolons.

    Comments leave a blank or newline behind, so this holds for both ways of
    normalising, and it costs no regular expression.
    """
    return _drop_semicolons(_strip(_col(c))) != ""


def sql_fragment(c: Column | str, n: int | None) -> Column:
    """First ``n`` characters of a normalised text; the whole text for ``None``."""
    return _col(c) if n is None else F.substring(_col(c), 1, n)


def digest(c: Column | str) -> Column:
    """256-bit digest standing in for a text as a join key, so texts stay put."""
    return F.sha2(_col(c), 256)
