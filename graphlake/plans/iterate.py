"""Loops over DataFrames that end with an empty frontier.

The state of every round is a staged table: a loop's plan stays one round long, a lost executor costs no earlier round, and whether
there is another round is read from the table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame

from graphlake.plans.staging import stage


def grow(step: Callable[[DataFrame, DataFrame, int], DataFrame], first: DataFrame, most: int | None = None, label: str = "frontier") -> DataFrame:
    """The union of ``first`` and all frontiers; ``step`` gets (frontier, all so far, round). The loop ends with an empty
    frontier, or where the caller bounds the depth after ``most`` rounds."""
    frontier = stage(first, label)
    parts = [frontier]
    for i in count(1):
        if most is not None and i > most:
            break
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        frontier = stage(step(frontier, seen, i), label)
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 16:  # many small tables become one
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            parts = [stage(merged, label)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
