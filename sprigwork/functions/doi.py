"""DOI normal form, once as a Catalyst expression and once in Python (both must agree)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of a DOI inside free text.
DOI_PATTERN = r"10\.\d{4,9}/[^\s<>\"']+"
#: Fixed value: characters that end a sentence or a bracket, not a DOI.
TRAILING = ".,;:!?)]}>"

_DOI = re.compile(DOI_PATTERN)


def bare_doi(col: Column) -> Column:
    """Lower-case DOI without label, link or trailing punctuation; '' where there is none, null for null."""
    text = F.lower(F.regexp_replace(col, "%2[fF]", "/"))
    return F.rtrim(F.regexp_extract(text, f"({DOI_PATTERN})", 1), F.lit(TRAILING))


def bare_doi_py(text: str | None) -> str | None:
    if text is None:
        return None
    found = _DOI.search(text.replace("%2F", "/").replace("%2f", "/").lower())
    return found.group(0).rstrip(TRAILING) if found else ""


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(F.regexp_replace(col, r"[\s ​]+", "")) == 0, F.lit(True))


def doi_slug(col: Column) -> Column:
    """File-name form of a DOI: runs of other characters become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))
