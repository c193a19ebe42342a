"""Rule conditions as columns over binary text. Comparisons are bytewise; lengths count bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcesieve.plans.program import Check, RulePlan, Value


def text_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def compare(left: Column, operator: str, right: Column) -> Column:
    match operator:
        case "==":
            return left == right
        case "!=":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
        case ">=":
            return left >= right
    return F.startswith(left, right)


def value_column(value: Value, paths: tuple[tuple[str, ...], ...]) -> Column:
    """The value of text, length or blankLines; what a missing path leads to is empty."""
    if value.subject == "gap":
        text = F.col("gap")
        if value.prop == "blankLines":
            return F.col("gap_blank_lines")
    else:
        side = "left_" if value.subject == "left" else ""
        text = F.get(F.col(f"{side}path_texts"), F.lit(paths.index(value.path))) if value.path else F.col(f"{side}text")
    return text_length(text) if value.prop == "length" else F.coalesce(text, F.lit(bytearray()))


def check_column(check: Check | None, paths: tuple[tuple[str, ...], ...]) -> Column:
    if check is None:
        return F.lit(True)
    right = check.right
    other = value_column(right, paths) if isinstance(right, Value) else F.lit(bytearray(right)) if isinstance(right, bytes) else F.lit(right).cast("long")
    return compare(value_column(check.left, paths), check.operator, other)


def relation_column(rule: RulePlan) -> Column:
    """Whether the row stands where the rule wants it."""
    match rule.scope:
        case "inside":
            return F.array_contains("ancestor_kinds", rule.scope_kind)
        case "outside":
            return ~F.array_contains("ancestor_kinds", rule.scope_kind)
        case "parent":
            return F.col("parent_kind").eqNullSafe(F.lit(rule.scope_kind))
        case "notparent":
            return ~F.col("parent_kind").eqNullSafe(F.lit(rule.scope_kind))
    return F.col("left_kind").eqNullSafe(F.lit(rule.left)) if rule.left >= 0 else F.lit(True)
