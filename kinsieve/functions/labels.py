"""Clone types and action tiers of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ADVISORY, AUTO_REFACTOR, REVIEW_FIRST, TYPE_1, TYPE_2, TYPE_3

AUTO_REFACTOR_FLOOR = 0.95
REVIEW_FIRST_FLOOR = 0.85
EPSILON = 2.220446049250313e-16


def classify(score: Column, same_idents: Column) -> Column:
    """type_3 for scores other than 1, else type_1 where identifiers agree, else type_2."""
    return F.when(F.abs(score - 1.0) > EPSILON, TYPE_3).when(same_idents, TYPE_1).otherwise(TYPE_2)


def tier_for(score: Column) -> Column:
    return F.when(score >= AUTO_REFACTOR_FLOOR, AUTO_REFACTOR).when(score >= REVIEW_FIRST_FLOOR, REVIEW_FIRST).otherwise(ADVISORY)


def type_rank(clone_type: Column) -> Column:
    """Order of findings that tie otherwise."""
    return F.when(clone_type == TYPE_1, 1).when(clone_type == TYPE_2, 2).otherwise(3)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == AUTO_REFACTOR, 1).when(tier == REVIEW_FIRST, 2).otherwise(3)
