"""Key merges for tables without row updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, key: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """target with updates merged in by key.

    Columns that updates has replace those of a row that is there; others keep their values, and in new rows
    get their default, or null. An empty updates changes nothing. Both sides hold a key once at most.
    """
    fresh = updates.select(*key, *(F.col(c).alias(f"new_{c}") for c in updates.columns if c not in key), F.lit(True).alias("in_updates"))
    joined = target.join(fresh, key, "full_outer")
    out = list(map(F.col, key))
    for field in target.schema.fields:
        if field.name in key:
            continue
        if field.name in updates.columns:
            value = F.when(F.col("in_updates"), F.col(f"new_{field.name}")).otherwise(F.col(field.name))
        else:
            value = F.col(field.name)
            if (defaults or {}).get(field.name) is not None:
                value = F.coalesce(value, F.lit(defaults[field.name]))
        out.append(value.cast(field.dataType).alias(field.name))
    return joined.select(*out).select(*target.columns)


def append_new(known: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The distinct rows whose key known doesn't hold."""
    return rows.select(*key).distinct().join(known.select(*key), key, "left_anti")
