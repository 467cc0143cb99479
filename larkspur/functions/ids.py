"""Product identifiers: GTINs, fingerprints and offer ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import text_of


def gtin_valid(c: Column) -> Column:
    """Whether 8, 12, 13 or 14 digits end in their check digit; false for anything else."""
    d = text_of(c)
    body = F.transform(F.split(F.reverse(d), ""), lambda x: x.try_cast("int"))
    total = F.aggregate(F.transform(F.slice(body, 2, 13), lambda x, i: x * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(d.rlike(r"^(?:\d{8}|\d{12,14})$") & ((10 - total % 10) % 10 == F.get(body, F.lit(0))), F.lit(False))


def normalize_gtin(c: Column) -> Column:
    """A valid code as 14 digits; null otherwise, so also for 11 digits."""
    d = F.regexp_replace(text_of(c), r"\D", "")
    return F.when(gtin_valid(d), F.lpad(d, 14, "0"))


def gtins_in_text(c: Column) -> Column:
    """Distinct valid codes among numbers of 12 to 14 digits that stand alone, sorted."""
    runs = F.regexp_extract_all(text_of(c), F.lit(r"(?<!\d)(\d{12,14})(?!\d)"), 1)
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(runs, normalize_gtin))))


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the parts set apart by bars; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[text_of(p.cast("string")) for p in parts]).cast("binary")), 1, 12)


def upc(c: Column) -> Column:
    """Leading zeros dropped, then filled up to 12 digits; longer codes stay."""
    d = F.ltrim(text_of(c), F.lit("0"))
    return F.when(F.length(d) < 12, F.lpad(d, 12, "0")).otherwise(d)
