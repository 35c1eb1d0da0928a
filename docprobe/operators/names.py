"""Columns that an operator needs for itself, under names that its caller's table does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with as many underscores behind them as it takes to be free (column names differ by more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def refuse(df: DataFrame, *names: str) -> None:
    """An error if the table has a column of a name under which the operator returns something of its own."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"the table has columns that this operator adds: {sorted(clash)}")
