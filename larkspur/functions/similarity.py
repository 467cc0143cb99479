"""Sequence similarity, for which Spark has no expression, and bounds on it, which are expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters that are counted one by one for a bound; all others count together.
_COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts, 1 for equal ones; nulls count as empty."""
    from difflib import SequenceMatcher

    return pd.Series([1.0 if (x or "") == (y or "") else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts passes this: twice the characters that both have, as often as the one with fewer has them, by all characters; 1 for two empty texts."""
    pair = F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    return F.get(F.transform(F.array(pair), lambda p: _bound(p["a"], p["b"])), F.lit(0))


def _bound(a: Column, b: Column) -> Column:
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    rest = lambda t: F.length(F.regexp_replace(t, f"[{_COUNTED}]", ""))
    common = F.aggregate(F.array(*map(F.lit, _COUNTED)), F.least(rest(a), rest(b)), lambda n, c: n + F.least(count(a, c), count(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def is_similar(a: Column, b: Column, least: float, asked: Column | None = None) -> Column:
    """Whether the ratio of two texts is `least` or more; null where it isn't asked for.

    Equal texts, and pairs whose lengths or characters rule it out, are decided
    by expressions; Python gets only the texts of the others.
    """

    def judged(p: Column) -> Column:
        near = 2.0 * F.least(F.length(p["a"]), F.length(p["b"])) >= least * (F.length(p["a"]) + F.length(p["b"]))
        verdict = F.when(p["a"] == p["b"], "yes").when(~near, "no").when(_bound(p["a"], p["b"]) < least, "no").otherwise("open")
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), verdict.alias("verdict"))

    pair = F.array(F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
    q = F.get(F.transform(pair if asked is None else F.when(asked, pair), judged), F.lit(0))  # both texts are made once, inside
    open_ = q["verdict"] == "open"
    return F.when(open_, sequence_ratio(F.when(open_, q["a"]), F.when(open_, q["b"])) >= least).otherwise(q["verdict"] == "yes")
