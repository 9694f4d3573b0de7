"""Canonical JSON text, and reading and writing at dotted paths of it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(value):
    """Whole doubles print without a fraction, as in canonical text."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def dumps(value) -> str:
    """Keys in order, no spaces, nulls kept, text as it is."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    return None if text is None else dumps(json.loads(text))


def read_path(value, path: str):
    """The value at a dotted path; None where the path leaves the objects."""
    for part in path.split("."):
        if not isinstance(value, dict) or part not in value:
            return None
        value = value[part]
    return value


def write_path(value, path: str, new):
    """A copy with ``new`` at a dotted path; what is in the way and no object is replaced."""
    first, _, rest = path.partition(".")
    out = dict(value) if isinstance(value, dict) else {}
    out[first] = write_path(out.get(first), rest, new) if rest else new
    return out


def touches(path: str, protected: str) -> bool:
    """Whether writing at ``path`` changes ``protected``: equal, above, or below it."""
    return path == protected or path.startswith(f"{protected}.") or protected.startswith(f"{path}.")


def camel(key: str) -> str:
    """snake_case to camelCase, with the two acronyms that stay upper case."""
    out = re.sub(r"_+([a-zA-Z0-9])", lambda m: m[1].upper(), key)
    return out.replace("Uuid", "UUID").replace("Uri", "URI")


def camel_keys(value):
    """All keys of nested objects in camelCase, nulls left out."""
    if isinstance(value, dict):
        return {camel(k): camel_keys(v) for k, v in value.items() if v is not None}
    return [camel_keys(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(canonical_text, na_action="ignore")


@F.pandas_udf(StringType())
def camel_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: dumps(camel_keys(json.loads(t))), na_action="ignore")


@F.pandas_udf(StringType())
def _set(texts: pd.Series, changes: pd.Series) -> pd.Series:
    def one(text, change):
        value = json.loads(text) if text else {}
        for path, new in sorted((change or {}).items() if isinstance(change, dict) else change or ()):
            value = write_path(value, path, new)
        return dumps(value)

    return pd.Series([one(t, c) for t, c in zip(texts, changes, strict=True)])


def set_paths(props: str | Column, changes: str | Column) -> Column:
    """Props with the texts of a map column written at their dotted paths."""
    return _set(F.col(props) if isinstance(props, str) else props, F.col(changes) if isinstance(changes, str) else changes)
