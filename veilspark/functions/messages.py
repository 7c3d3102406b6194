"""Depth-first search for a path in JSON messages, for shapes that no fixed key tells."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PATH_KEYS


def path_in(value: object) -> object:
    """The first plausible path: of an object its fields by priority, then its values in order; of a list its items; of a text itself if it holds a slash or a dot."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, str):
            if "/" in v or "." in v:
                return v
        elif isinstance(v, dict):
            known = [v[k] for k in PATH_KEYS if v.get(k)]
            if known:
                return known[0]
            waiting += reversed(list(v.values()))
        elif isinstance(v, list):
            waiting += reversed(v)
    return None


def _loaded(message: str | None) -> object:
    try:
        return json.loads(message) if message else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def deep_path(messages: pd.Series) -> pd.Series:
    """path_in() of JSON texts; null for broken ones and for paths that are no text."""
    found = [path_in(_loaded(m)) for m in messages]
    return pd.Series([p if isinstance(p, str) else None for p in found], dtype="object")
