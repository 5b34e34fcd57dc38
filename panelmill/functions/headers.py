"""Column-name operators: they work on the driver-side schema and never touch rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake_name(name: str) -> str:
    """Ascii snake_case form of a header."""
    plain = unicodedata.normalize("NFKD", str(name).strip().lower()).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def loose_name(name: str) -> str:
    """Header form that keeps accents: lower case, spaces to underscores, symbols dropped."""
    return re.sub(r"[^\w]", "", spaced_name(name))


def spaced_name(name: str) -> str:
    """Header form that only lowers, trims and replaces spaces."""
    return str(name).strip().lower().replace(" ", "_")


HEADER_MODES = {
    "snake": snake_name,
    "loose": loose_name,
    "spaced": spaced_name,
    "dotless": lambda name: spaced_name(name).replace(".", ""),
    "strip": lambda name: str(name).strip(),
}


def normalise_headers(df: DataFrame, mode: str = "snake") -> DataFrame:
    rename = HEADER_MODES[mode]
    return df.toDF(*[rename(c) for c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().startswith("unnamed")])


def rename_headers(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def require_columns(df: DataFrame, required: Iterable[str], label: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks required columns: {', '.join(missing)}")
    return df


def find_column(df: DataFrame, fragment: str) -> str:
    """First column whose name contains `fragment`."""
    for name in df.columns:
        if fragment in name:
            return name
    raise ValueError(f"no column contains {fragment!r}")


def first_present(df: DataFrame, *candidates: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} is a column")


def value_series(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Two-column monthly series: date and one renamed value."""
    return df.select("fecha", F.col(value).alias(alias))


def has_table_shape(df: DataFrame) -> bool:
    """False for inputs with no rows or fewer than two columns."""
    return len(df.columns) >= 2 and not df.isEmpty()


def non_numeric(df: DataFrame, columns: Iterable[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if not isinstance(types[c], T.NumericType)]
