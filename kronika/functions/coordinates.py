"""Entity and scope strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 1024


def in_namespace(entity: Column, prefix: str) -> Column:
    """``prefix`` itself or what lies below it: ``alice`` does not hold ``alice2``."""
    return (entity == prefix) | F.startswith(entity, F.lit(prefix + ":"))


def problem(part: Column, name: str) -> Column:
    """The first rule that a component breaks, or null."""
    rules = (
        ("empty", part.isNull() | (part == "")),
        ("too_long", F.octet_length(part) > MAX_BYTES),
        ("nul", F.contains(part, F.lit("\x00"))),
        ("control", part.rlike(r"[\x01-\x1F\x7F]")),
        ("path", F.contains(part, F.lit("/")) | F.contains(part, F.lit(".."))),
        ("separator", part.rlike(r"[|=]")),
    )
    return F.coalesce(*(F.when(broken, F.lit(f"{name}_{label}")) for label, broken in rules))


def coordinate_problem(entity: Column, scope: Column) -> Column:
    """Entity is judged before scope."""
    return F.coalesce(problem(entity, "entity"), problem(scope, "scope"))


def shown(entity: Column, scope: Column) -> Column:
    return F.concat(entity, F.lit("@"), scope)


def first_of(*cases: tuple[str, Column]) -> Column:
    """Label of the first case that holds; a null condition does not hold."""
    return F.coalesce(*(F.when(holds, F.lit(label)) for label, holds in cases))


def all_of(*cases: tuple[str, Column]) -> Column:
    """Labels of all cases that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(label)) for label, holds in cases)))


def any_true(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
