"""Predicates on pairs of cases, as Columns (q: the query's column prefix, c: the candidate's)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; two empty ones are equal."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def flags_equal(q: str, c: str) -> Column:
    return (F.col(f"{q}_death") == F.col(f"{c}_death")) & (F.col(f"{q}_life") == F.col(f"{c}_life"))


def within_tolerance(q: str, c: str) -> Column:
    """Flags equal, and months within max(6, 20 % of the query's) unless a flag is set."""
    qm, cm = F.col(f"{q}_months"), F.col(f"{c}_months")
    return flags_equal(q, c) & (F.col(f"{q}_death") | F.col(f"{q}_life") | (F.abs(qm - cm) <= F.greatest(F.lit(6.0), qm * F.lit(0.2))))


def months_ratio(q: str, c: str) -> Column:
    return F.abs(F.col(f"{q}_months") - F.col(f"{c}_months")) / F.greatest(F.col(f"{q}_months"), F.lit(1))


def comparable(q: str, c: str) -> Column:
    """The hard filter: flags equal, labels equal or both lists overlap, months within 30 %."""
    acc, art = (F.col(f"{q}_accusation"), F.col(f"{c}_accusation")), (F.col(f"{q}_articles"), F.col(f"{c}_articles"))
    labels = same_set(*acc) | (overlap(*acc) & overlap(*art))
    return flags_equal(q, c) & labels & (F.col(f"{q}_death") | F.col(f"{q}_life") | (months_ratio(q, c) <= 0.3))


def similarity_level(q: str, c: str) -> Column:
    """1 (closest) to 5, or 0 for none."""
    acc, art = (F.col(f"{q}_accusation"), F.col(f"{c}_accusation")), (F.col(f"{q}_articles"), F.col(f"{c}_articles"))
    ratio, same = months_ratio(q, c), same_set(*acc)
    return (
        F.when(~flags_equal(q, c), 0)
        .when(same & same_set(*art) & (F.col(f"{q}_months") == F.col(f"{c}_months")), 1)
        .when(same & same_set(*art) & (ratio <= 0.1), 2)
        .when(same & same_set(*art) & (ratio <= 0.3), 3)
        .when(same & overlap(*art) & (ratio <= 0.3), 4)
        .when(overlap(*acc) & overlap(*art) & (ratio <= 0.3), 5)
        .otherwise(0)
    )
