"""The one predicate of queries, cursors and subscriptions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coordinates import in_namespace


@dataclass(frozen=True)
class Region:
    """A conjunction; what is None does not restrict.

    ``kind`` is an exact kind, ``category`` a category, ``any_kind`` says "any" outright, which selects the same rows as
    nothing but has another identity.  ``clock`` is inclusive and holds in batch queries only.
    """

    entity: str | None = None
    scope: str | None = None
    kind: int | None = None
    category: int | None = None
    any_kind: bool = False
    clock: tuple[int, int] | None = None
    lane: int | None = None

    def __post_init__(self) -> None:
        if self.clock and self.clock[0] > self.clock[1]:
            raise ValueError("a clock range must not end before it starts")
        if self.category is not None and not 0 <= self.category < 16:
            raise ValueError("a category has 4 bits")
        if (self.kind is not None) + (self.category is not None) + self.any_kind > 1:
            raise ValueError("kind, category and any_kind exclude each other")

    def predicate(self, live: bool = False) -> Column:
        """``live`` leaves the clock range out, as pushed rows are not checked against it."""
        parts = [F.lit(True)]
        if self.entity is not None:
            parts.append(in_namespace(F.col("entity"), self.entity))
        if self.scope is not None:
            parts.append(F.col("scope") == self.scope)
        if self.kind is not None:
            parts.append(F.col("kind") == self.kind)
        if self.category is not None:
            first = self.category << 12  # a range of kinds, which a stored journal's scan can be asked for
            parts.append(F.col("kind").between(first, first | 0x0FFF))
        if self.clock is not None and not live:
            parts.append(F.col("clock").between(*self.clock))
        if self.lane is not None:
            parts.append(F.col("dag_lane") == self.lane)
        out = parts[0] if len(parts) == 1 else parts[1]
        for part in parts[2:]:
            out = out & part
        return out

    def identity(self) -> str:
        """A string that differs for different regions; strings are length-delimited."""

        def text(value: str | None) -> str:
            return "-" if value is None else f"{len(value)}:{value}"

        fact = f"kind:{self.kind}" if self.kind is not None else f"category:{self.category}" if self.category is not None else "any" if self.any_kind else "-"
        clock = "-" if self.clock is None else f"{self.clock[0]}..{self.clock[1]}"
        lane = "" if self.lane is None else f"|lane={self.lane}"
        return f"entity={text(self.entity)}|scope={text(self.scope)}|fact={fact}|clock={clock}{lane}"

    def on_lane(self, lane: int) -> "Region":
        return replace(self, lane=lane)
