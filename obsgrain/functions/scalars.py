"""Column functions: missing values, states, transforms, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Missing values are NULL from here on: NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def state_code(x: Column, mode: str = "finite") -> Column:
    """1 positive, 2 zero, 3 missing. In mode "reference" negative values count as missing, in mode "finite" as measured (1)."""
    x = finite(x)
    kept = (x > 0) if mode == "reference" else (x != 0)
    return F.when(kept, 1).when(x == 0, 2).otherwise(3)


def transform(x: Column, kind: str = "identity") -> Column:
    """identity, log (of positive values, else NULL) or log_nonzero (the same, zeros counted apart by the caller)."""
    x = finite(x)
    return x if kind == "identity" else F.when(x > 0, F.ln(x))


def semitones(x: Column) -> Column:
    return 12 * F.log2(x)


def category(label: Column, table: dict[str, list[str]], default: str) -> Column:
    """Trimmed, lower-case label looked up in lists of synonyms."""
    said, out = F.lower(F.trim(label)), None
    for name, synonyms in table.items():
        out = (F if out is None else out).when(said.isin(*synonyms), name)
    return F.lit(default) if out is None else F.coalesce(out.otherwise(default), F.lit(default))


def base_phone(label: Column) -> Column:
    """Lower case, stress digits at the end removed."""
    return F.regexp_replace(F.lower(F.trim(label)), "[0-9]+$", "")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def natural_key(name: Column) -> list[Column]:
    """Sort keys of names like ab12_3: prefix, then numbers as numbers."""
    return [F.regexp_extract(name, r"^([^0-9]*)", 1), F.coalesce(F.regexp_extract(name, r"([0-9]+)", 1).try_cast("long"), F.lit(-1)), F.coalesce(F.regexp_extract(name, r"[0-9]+[^0-9]+([0-9]+)", 1).try_cast("long"), F.lit(-1)), name]


def hash_order(*parts: Column) -> Column:
    """An order that depends on its parts alone, the same in any engine; NULL if a part is."""
    first, *rest = (p.cast("string") for p in parts)
    return F.md5(F.concat(first, *[c for p in rest for c in (F.lit(":"), p)]))


def ascending(*columns: Column | str) -> list[Column]:
    """Ascending sort keys, NULLs last (Spark's own default is first)."""
    return [F.asc_nulls_last(c) for c in columns]


def rescale_seconds(df: DataFrame, column: str) -> DataFrame:
    """Milliseconds become seconds if the largest value exceeds 1000. One row is broadcast."""
    top = df.agg(F.max(column).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("__top") > 1000, F.col(column) / 1000).otherwise(F.col(column))).drop("__top")
