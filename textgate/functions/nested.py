"""Nested JSON values: all their strings, and keys that must not occur."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which a record would carry text.
TEXT_FIELDS = frozenset({"text", "message", "prompt", "conversation", "transcript"})


def walked(value: str | None) -> dict:
    """strings: all string values in order; keys: the text fields among all keys, sorted. Any depth."""
    strings, keys, open_ = [], set(), []
    try:
        open_.append(json.loads(value) if value else None)
    except ValueError:
        return {"strings": None, "keys": None}
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            strings.append(x)
        elif isinstance(x, dict):
            keys.update(k for k in x if k.casefold() in TEXT_FIELDS)
            open_.extend(reversed(x.values()))
        elif isinstance(x, list):
            open_.extend(reversed(x))
    return {"strings": strings, "keys": sorted(keys)}


def walk(value: Column) -> Column:
    """A struct of ``walked``; both parts are null where the text is no JSON."""

    @F.pandas_udf("struct<strings:array<string>,keys:array<string>>")
    def found(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walked(v) for v in values], columns=["strings", "keys"])

    return found(value)
