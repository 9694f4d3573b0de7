"""Text functions of the engine, on the JVM where it has the means."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKS = re.compile("[̀-ͯ]")


def without_accents(text: str | None) -> str | None:
    """Decomposed, without the combining marks U+0300 to U+036F, in lower case."""
    return None if text is None else _MARKS.sub("", unicodedata.normalize("NFD", text)).lower()


@F.pandas_udf(StringType())
def no_accents(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(without_accents, na_action="ignore")


def slug(text: Column) -> Column:
    """Words of letters and digits joined by dashes, without accents."""
    return F.regexp_replace(F.regexp_replace(F.trim(no_accents(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("bigint")


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last of a longer text an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def node_label(text: Column) -> Column:
    return F.when(F.length(text) > 84, F.concat(F.substring(text, 1, 82), F.lit("…"))).otherwise(text)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def natural_key(text: Column) -> Column:
    """A key under which digits in a text sort by their value: each run is padded to twenty places."""
    padded = F.regexp_replace(text, r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0+(\d{20})(?!\d)", "$1")


def namespace(workspace: Column, grade: Column, subject: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("/", workspace, grade, subject))


def namespace_parts(name: Column, reserved: tuple[str, ...] = ("_catalog", "_glossary")) -> Column:
    """(workspace, grade, subject) of a namespace; null for another number of parts or a reserved grade."""
    parts = F.split(name, "/")
    good = (F.size(parts) == 3) & ~F.get(parts, 1).isin(*reserved)
    return F.when(good, F.struct(parts[0].alias("workspace"), parts[1].alias("grade"), parts[2].alias("subject")))


def namespace_slug(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def namespace_of_slug(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))


def iso_minutes(minutes: Column) -> Column:
    """A duration of whole minutes in ISO form; null if the text has no number at its start."""
    n = F.nullif(F.regexp_extract(minutes.cast("string"), r"^\s*(\d+)", 1), F.lit(""))
    return F.concat(F.lit("PT"), n.cast("bigint").cast("string"), F.lit("M"))


def text_window(text: Column, offset: int = 0, most: int = 20_000) -> Column:
    """(text, next_offset) of a slice in code points; the next offset is null at the end."""
    offset, most = max(0, offset), min(max(1, most), 50_000)
    end = F.lit(offset + most)
    return F.struct(F.substring(text, offset + 1, most).alias("text"), F.when(F.length(text) > end, end).alias("next_offset"))


def normal_renderings(renderings: Column) -> Column:
    """Language to text without blanks, trimmed, keys in lower case; a later key wins."""
    kept = F.filter(F.map_entries(renderings), lambda e: F.length(F.trim(e["value"])) > 0)
    items = F.transform(kept, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    fold = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
    return F.aggregate(items, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), fold)


def primary_rendering(renderings: Column) -> Column:
    return F.coalesce(F.try_element_at(renderings, F.lit("fr")), F.get(F.map_values(renderings), 0))


# Subjects with a name of their own, in two languages.
SUBJECTS = {"maths": ("Mathématiques", "Mathematics"), "reading": ("Lecture", "Reading")}


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def namespace_label(grade: Column, subject: Column) -> Column:
    """(fr, en) of a grade and subject."""
    named = lambda i: F.concat(F.coalesce(*(F.when(subject == k, v[i]) for k, v in SUBJECTS.items()), capitalised(subject)), F.lit(" — "), F.upper(grade))
    return F.struct(named(0).alias("fr"), named(1).alias("en"))


def text_of(value: Column) -> Column:
    """A value as text, nothing as the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def stored_apart(canonical: Column, least: int) -> Column:
    """Whether arguments, as canonical JSON, are long enough to be kept aside instead of being sent again."""
    return F.length(canonical) >= least


# What a message says when the store is to blame.
_STORE_SIGNS = (
    r"(?i)\b(ECONNRESET|ETIMEDOUT|ENOTFOUND|ECONNREFUSED|EAI_AGAIN)\b|socket hang up|network error|Could not (load|refresh) default credentials|credential"
    r"|GaxiosError|firebase|storage bucket|\bbucket\b|Quota exceeded|rate limit|DEADLINE_EXCEEDED|UNAVAILABLE"
)


def error_code(message: Column) -> Column:
    """STORE_UNAVAILABLE if the message has a sign of it, else INTERNAL_ERROR."""
    return F.when(message.rlike(_STORE_SIGNS), "STORE_UNAVAILABLE").otherwise("INTERNAL_ERROR")
