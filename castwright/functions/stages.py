"""Value rules in stages.

A value rule often needs an intermediate result several times.  Written as one
expression, the intermediate is repeated in the generated code; written as
successive projections, Catalyst computes it once (it does not merge projections
whose non-trivial outputs are used more than once).  A rule is therefore a list
of column dictionaries, and rules of many columns advance side by side, so the
plan depth does not grow with the number of columns.

Rules are SQL text over column names: Spark parses a whole expression in one call,
where a chain of ``Column`` calls would make a round trip per operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

Stages = list[dict[str, Column]]


def raw(pattern: str) -> str:
    """A pattern as a SQL literal without escape processing."""
    return f"r'{pattern}'"


def apply_stages(frame: DataFrame, rules: list[Stages]) -> DataFrame:
    """Run the first stage of every rule, then every second stage, and so on."""
    for depth in range(max((len(rule) for rule in rules), default=0)):
        frame = frame.withColumns(
            {name: column for rule in rules if depth < len(rule) for name, column in rule[depth].items()}
        )
    return frame
