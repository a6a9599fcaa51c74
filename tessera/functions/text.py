"""Name normalisation as Column expressions (SCL10-SCL14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns the reference matches names with.
SERUM_PREFIX = r"(?i)^SERUM_ABS_"
TRAILING_INDEX = r"_\d+$"
NON_ALNUM = r"[^0-9a-z]+"
QUERY_UNSAFE = r"[^0-9a-zA-Z -]+"


def canon(s: Column) -> Column:
    """lower, each run of non [0-9a-z] -> one space, trim."""
    return F.trim(F.regexp_replace(F.lower(s), NON_ALNUM, " "))


def clean_metabolome_name(s: Column) -> Column:
    """Strip the SERUM_ABS_ prefix (any case), then a trailing _<digits>."""
    return F.regexp_replace(F.regexp_replace(s, SERUM_PREFIX, ""), TRAILING_INDEX, "")


def query_string(s: Column) -> Column:
    """Keyword query: unsafe runs -> space, tokens joined by '+'; '' when empty."""
    toks = F.split(F.trim(F.regexp_replace(s, QUERY_UNSAFE, " ")), r"\s+")
    return F.array_join(F.filter(toks, lambda t: t != ""), "+")


def strip_prefix(s: Column, prefix: str) -> Column:
    """Remove every occurrence of a literal prefix token (``ko:``, ``ec:``, ``cpd:``)."""
    return F.replace(s, F.lit(prefix), F.lit(""))


def composite_label(*cols: str) -> Column:
    """'a_b' with nulls rendered as 'nan' (as the reference's string cast)."""
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
