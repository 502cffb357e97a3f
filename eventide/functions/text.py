"""Word-list counting over whole texts with built-in string functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower-case tokens, each with its own blank on both sides, so that phrases can be counted."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def with_value(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def pattern(terms: list[str]) -> str:
    """One alternation for a word list; longer phrases first, so that they win over their prefixes."""
    spaced = sorted(("  ".join(re.findall(r"[^\W_]+", t.lower())) for t in terms), key=lambda t: (-len(t), t))
    return f" (?:{'|'.join(spaced)}) "


def hits(norm: Column, terms: list[str]) -> Column:
    return F.regexp_count(norm, F.lit(pattern(terms)))


def words(norm: Column) -> Column:
    return F.regexp_count(norm, F.lit(r"[\p{L}\p{N}]+"))


def per_thousand(norm: Column, terms: list[str]) -> Column:
    """Hits per 1000 words; 0 for a text without words."""
    return with_value(norm, lambda t: F.when(words(t) > 0, hits(t, terms) * 1000 / words(t)).otherwise(F.lit(0.0)))


def balance(norm: Column, positive: list[str], negative: list[str]) -> Column:
    """positive / (positive + negative) hits, 0.5 when there are none."""
    counts = with_value(norm, lambda t: F.struct(hits(t, positive).alias("p"), hits(t, negative).alias("n")))
    return with_value(counts, lambda c: F.when(c["p"] + c["n"] > 0, c["p"] / (c["p"] + c["n"])).otherwise(F.lit(0.5)))


def sections(text: Column, marker: str) -> tuple[Column, Column]:
    """Prepared remarks and Q&A: the text before, and from, the first marker."""
    at = F.instr(text, marker)
    return (F.when(at > 0, F.left(text, at - 1)).otherwise(text),
            F.when(at > 0, F.substr(text, at)).otherwise(F.lit("")))


def section_shift(text: Column, marker: str, terms: list[str], scale: float = 1000.0) -> Column:
    """Drop of a word list's density from the prepared remarks to the Q&A, clipped to [0, 1]."""
    prepared, qa = sections(text, marker)
    drop = (per_thousand(normalised(prepared), terms) - per_thousand(normalised(qa), terms)) / scale
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), drop))


def terms_present(norm: Column, terms: list[str]) -> Column:
    """The terms of a list that occur in the text; the text is normalised once for all of them."""
    literal = lambda t: pattern([t]).replace("(?:", "").replace(")", "")
    return with_value(norm, lambda text: F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(literal(t))), F.lit(t)) for t in terms])))


def specificity(text: Column) -> Column:
    """Numbers per 100 words."""
    n = words(normalised(text))
    return F.when(n > 0, F.regexp_count(text, F.lit(r"[0-9]+([.,][0-9]+)*")) * 100 / n).otherwise(F.lit(0.0))
