"""Column functions for names, dates and scores."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Without ASCII punctuation, in lower case; spaces stay, null stays null."""
    return F.lower(F.translate(c, string.punctuation, ""))


def floor4(c: Column) -> Column:
    return F.floor(c * 10000) / 10000.0


def birth_year(c: Column) -> Column:
    return F.substring(c, 1, 4).cast("int")


def decade(c: Column) -> Column:
    return F.concat((F.floor(birth_year(c) / 10) * 10).cast("string"), F.lit("s"))


def email_domain(c: Column) -> Column:
    return F.split(c, "@")[1]


def display_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(first, F.lit("Unknown")), F.coalesce(last, F.lit("Unknown")))


#: Titles, suffixes and particles that are no part of a name.
NAME_TERMS = (
    "dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "lord", "lady", "hon", "rev", "reverend", "father", "fr", "sister", "brother",
    "captain", "capt", "major", "colonel", "general", "admiral", "sergeant", "lieutenant", "md", "dvm", "phd", "dds", "do", "jd", "esq", "cpa",
    "rn", "pharmd", "dpt", "edd", "psyd", "dnp", "crna", "pa", "np", "jr", "sr", "ii", "iii", "iv", "v", "vi", "1st", "2nd", "3rd", "4th", "5th",
    "the", "von", "van", "de", "del", "da", "di", "du",
)


def clean_name_part(c: Column, blocked: tuple[str, ...] = NAME_TERMS) -> Column:
    """Null where the part, without dots and commas around it, is one of ``blocked``."""
    bare = F.trim(F.lower(c), F.lit(".,"))
    return F.when(~bare.isin(*blocked), c)


def first_and_last(name: Column) -> tuple[Column, Column]:
    """The first and last part of a full name that :func:`clean_name_part` keeps; null for a name of fewer than two."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda x: clean_name_part(x).isNotNull())
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)), F.when(F.size(parts) > 1, F.element_at(parts, -1))
