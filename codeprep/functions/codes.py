"""Expressions over lists of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeprep.config import DEFAULT_MAX_CODES, NO_DESCRIPTION
from codeprep.functions.lookup import constant_lookup
from codeprep.functions.text import strip
from codeprep.schemas import CODES


def no_codes() -> Column:
    return F.array().cast(CODES)


def or_empty(codes: Column) -> Column:
    """A missing list becomes an empty one."""
    return F.coalesce(codes, no_codes())


def all_codes(diagnoses: Column, procedures: Column) -> Column:
    """Diagnoses then procedures; a missing side counts as empty."""
    return F.concat(or_empty(diagnoses), or_empty(procedures))


def joined(codes: Column) -> Column:
    return F.array_join(codes, ",")


def with_system(codes: Column, system: str) -> Column:
    """Put the code system in front of each code, as in ``ICD-9:0389``."""
    return F.transform(codes, lambda c: F.concat(F.lit(f"{system}:"), c))


def extract_codes(response: Column) -> Column:
    """Comma-separated entries, stripped, empty ones dropped."""
    entries = F.transform(F.split(response, F.lit(",")), strip)
    return F.filter(entries, lambda c: c != "")


def plausible_codes(codes: Column) -> Column:
    """Entries with a colon or a hyphen."""
    return F.filter(codes, lambda c: c.contains(":") | c.contains("-"))


def parse_codes(response: Column) -> Column:
    return plausible_codes(extract_codes(response))


def cap_codes(codes: Column, max_codes: int = DEFAULT_MAX_CODES) -> Column:
    """The first ``max_codes`` entries."""
    if max_codes < 0:
        raise ValueError("max_codes must not be negative")
    return F.slice(codes, 1, max_codes)


def described(codes: Column, descriptions: dict[str, str]) -> Column:
    """``{code, description}`` per entry from a configured dictionary, without a join."""
    find = constant_lookup(descriptions, "string")
    told = lambda c: F.coalesce(find(c), F.lit(NO_DESCRIPTION))
    return F.transform(codes, lambda c: F.struct(c.alias("code"), told(c).alias("description")))


def undescribed(codes: Column) -> Column:
    """``{code, description}`` per entry with the description left out."""
    return F.transform(
        codes,
        lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("description")),
    )
