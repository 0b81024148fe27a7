"""JSON objects as documents: setting and deleting keys, and caps of stored texts; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.functions.text import col

#: How many characters of each text are stored.
CAPS = {"abstract": 1024, "question": 10_240, "answer": 40_960, "title": 255, "content": 102_400, "problem": 255}


def capped(text: Column | str, kind: str) -> Column:
    return F.substring(col(text), 1, CAPS[kind])


def _entries(document: Column | str) -> Column:
    return F.from_json(col(document), "map<string, variant>")


def json_set(document: Column | str, **values: Column) -> Column:
    """A JSON object with keys set to values, JSON texts each; other keys keep their values. What is no object, null too,
    counts as an empty one; a null value sets JSON null."""
    kept = F.coalesce(F.map_filter(_entries(document), lambda k, _: ~k.isin(*values)), F.from_json(F.lit("{}"), "map<string, variant>"))
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.parse_json(F.coalesce(v, F.lit("null"))))])
    return F.to_json(F.map_concat(kept, new))


def json_without(document: Column | str, *keys: str) -> Column:
    """A JSON object without keys; null stays null, as does what is no object."""
    return F.to_json(F.map_filter(_entries(document), lambda k, _: ~k.isin(*keys)))
