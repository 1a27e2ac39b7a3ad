"""Text expressions over columns; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_real_text(c: Column) -> Column:
    """Not null, not blank, and not the word ``nan``."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce((bare != "") & (bare != "nan"), F.lit(False))


def clean_text(c: Column) -> Column:
    """De-identification marks become ``[REDACTED]``, no white space before ``.,;:``, runs of lone periods collapse,
    white space becomes single spaces. Null, blank and ``nan`` become the empty string."""
    steps = (  # fixed patterns of the cleaning format, in order
        (r"(?iU)\bx{2,}\b", "[REDACTED]"),
        (r"(?U)\s+([.,;:])", "$1"),
        (r"(?U)(?:^|\.\s*)\.\s*(?=\.|$)", ". "),
        (r"(?U)\s+", " "),
    )
    t = c
    for pattern, put in steps:
        t = F.regexp_replace(t, pattern, put)
    return F.when(is_real_text(c), F.trim(t)).otherwise("")


def normalize_text(c: Column) -> Column:
    """Lower case; runs of x are gone; letters, digits and single spaces only. Null becomes empty."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+|x{2,}", " "), r" {2,}", " "))


def mentions(text: Column, term: str) -> Column:
    """Whole-word, case-insensitive mention of a term that is taken literally."""
    quoted = term.lower().replace("\\E", "\\E\\\\E\\Q")
    return F.coalesce(F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{quoted}\E(?![\p{{L}}\p{{N}}_])"), F.lit(False))


def mentioned_classes(text: Column, classes: list[str]) -> Column:
    """The classes that a text mentions, in the order given."""
    hits = F.array(*[F.when(mentions(text, c), F.lit(c)) for c in classes])
    return F.filter(hits, lambda x: x.isNotNull())
