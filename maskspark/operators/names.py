"""Names of columns that operators add for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Each of `names` with as many underscores before it as no column of df has; one name gives one string."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out[0] if len(out) == 1 else out


def fields(df: DataFrame, but: tuple[str, ...] = ()) -> str:
    """The columns of df as a schema, whatever their names."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in but)
