"""Scalar expressions: wiki families, kinds, blank texts, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.plans.model import KINDS, WINDOW

# Families of single wikis, then of suffixes, in the order in which they are tried.
EXACT_FAMILIES = {"wikidatawiki": "wikidata", "commonswiki": "commons", "specieswiki": "wikispecies", "mediawikiwiki": "mediawiki"}
SUFFIX_FAMILIES = {
    "wiktionary": "wiktionary", "wikinews": "wikinews", "wikibooks": "wikibooks", "wikiquote": "wikiquote",
    "wikisource": "wikisource", "wikiversity": "wikiversity", "wikivoyage": "wikivoyage", "wiki": "wikipedia",
}


def family_for_wiki(wiki: Column) -> Column:
    """The project family of a wiki's database name; ``other`` where no rule fits, null for null."""
    rules = [(wiki == name, family) for name, family in EXACT_FAMILIES.items()]
    rules += [(wiki.endswith(suffix), family) for suffix, family in SUFFIX_FAMILIES.items()]
    chain = reduce(lambda c, rule: c.when(rule[0], F.lit(rule[1])), rules, F.when(wiki.isNull(), F.lit(None).cast("string")))
    return chain.otherwise(F.lit("other"))


def is_kind(kind: Column) -> Column:
    """Is this one of the event kinds? Case counts."""
    return F.coalesce(kind.isin(*KINDS), F.lit(False))


def is_blank(text: Column) -> Column:
    """Is nothing left without white space of any script?"""
    return F.regexp_replace(text, r"(?U)\s", "") == ""


def window_start(ts: Column, size: str = WINDOW) -> Column:
    """Start of the tumbling window; ``week``, ``month``, ``quarter`` and ``year`` go by the calendar."""
    if size in ("week", "month", "quarter", "year"):
        return F.date_trunc(size, ts).cast("timestamp_ntz") if size != "week" else F.date_trunc("week", ts)
    return F.window(ts, size)["start"]


def window_end(start: Column, size: str = WINDOW) -> Column:
    """End of a window of fixed size."""
    return start + F.expr(f"INTERVAL {size}")


def kpartition(user: Column, partitions: int = 12) -> Column:
    """The partition of a user: a function of the user alone, so that partial distinct counts may be added."""
    return F.pmod(F.crc32(F.coalesce(user, F.lit("")).cast("binary")), F.lit(partitions)).cast("int")


def saturating_minus(a: Column, b: Column) -> Column:
    """a - b, at least 0."""
    return F.greatest(F.lit(0), a - b)
