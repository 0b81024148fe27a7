"""Predicates of workflow conditions over columns of any type, and the choice of a branch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    """As printed: null prints as None, booleans as True and False."""
    s = c.cast("string")
    return F.coalesce(F.when(F.typeof(c) == "boolean", F.initcap(s)).otherwise(s), F.lit("None"))


def _number(op: Callable[[Column, Column], Column]) -> Callable[[Column, object], Column]:
    return lambda c, v: F.coalesce(op(c.cast("string").try_cast("double"), F.lit(str(v)).try_cast("double")), F.lit(False))


def _length(op: Callable[[Column, Column], Column]) -> Callable[[Column, object], Column]:
    return lambda c, v: F.coalesce(op(F.length(c.cast("string")), F.lit(str(v)).try_cast("int")), F.lit(False))


def _list_length(op: Callable[[Column, Column], Column]) -> Callable[[Column, object], Column]:
    return lambda c, v: F.coalesce(op(F.array_size(c), F.lit(str(v)).try_cast("int")), F.lit(False))


_ORDER = {"ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b}

#: name -> (column, value) -> boolean column; text operands. Nothing here is null.
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: _text(c) == F.lit("None" if v is None else str(v)),
    "contain": lambda c, v: F.coalesce(c.cast("string").contains(str(v)), F.lit(False)),
    "not_contain": lambda c, v: ~F.coalesce(c.cast("string").contains(str(v)), F.lit(False)),
    **{k: _number(op) for k, op in _ORDER.items() if k != "eq"},
    **{f"len_{k}": _length(op) for k, op in _ORDER.items()},
    "is_null": lambda c, v: c.isNull() | (F.length(c.cast("string")) == 0),
    "is_not_null": lambda c, v: c.isNotNull() & (F.length(c.cast("string")) > 0),
    # only booleans are: the text 'true' is neither
    "is_true": lambda c, v: (F.typeof(c) == "boolean") & c.cast("string").eqNullSafe("true"),
    "is_not_true": lambda c, v: (F.typeof(c) == "boolean") & c.cast("string").eqNullSafe("false"),
}
#: The same for list operands.
COMPARE_LIST: dict[str, Callable[[Column, object], Column]] = {
    "contain": lambda c, v: F.coalesce(F.exists(c, lambda x: x.cast("string") == str(v)), F.lit(False)),
    "not_contain": lambda c, v: ~F.coalesce(F.exists(c, lambda x: x.cast("string") == str(v)), F.lit(False)),
    **{f"len_{k}": _list_length(op) for k, op in _ORDER.items()},
    "is_null": lambda c, v: c.isNull() | (F.array_size(c) == 0),
    "is_not_null": lambda c, v: c.isNotNull() & (F.array_size(c) > 0),
}


def compare(name: str, c: Column, value: object = None, is_list: bool = False) -> Column:
    table = COMPARE_LIST if is_list and name in COMPARE_LIST else COMPARE
    if name not in table:
        raise ValueError(f"no such comparison: {name}")
    return table[name](c, value)


def combine(parts: list[Column], how: str) -> Column:
    """All ('and') or any ('or') of the parts; of no parts, all hold and none does."""
    if how == "and":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def branch(branches: list[dict], otherwise: str | None = None) -> Column:
    """Id of the first branch that holds. branches: {id, condition: and|or, conditions: [(column,
    comparison, value, is_list)]}, the last one of which may be left out."""
    out = None
    for b in branches:
        test = combine([compare(op, F.col(c) if isinstance(c, str) else c, v, *is_list) for c, op, v, *is_list in b["conditions"]], b.get("condition", "and"))
        out = F.when(test, b["id"]) if out is None else out.when(test, b["id"])
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def one_of_or_null(c: Column, values: list[str], null_name: str = "NOT_AUTH") -> Column:
    """In a list in which one name stands for null."""
    hit = c.isin(*[v for v in values if v != null_name]) if any(v != null_name for v in values) else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | (c.isNull() if null_name in values else F.lit(False))


def days_between(c: Column, first: str, last: str) -> Column:
    """From the start of the first day to the last microsecond of the last one; null times are outside."""
    return F.coalesce((c >= F.lit(first).cast("timestamp")) & (c < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")), F.lit(False))


def contains(c: Column, part: str) -> Column:
    """Containment in which case counts; null contains nothing."""
    return F.coalesce(c.contains(part), F.lit(False))


def any_of(c: Column, values: list[str]) -> Column:
    """Whether an array and a list of values share one; null and empty ones don't."""
    return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]).cast("array<string>")), F.lit(False)) if values else F.lit(False)


def all_of(c: Column, values: list[str]) -> Column:
    """Whether an array holds each of the values; an empty list is held by every array but null."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.array_contains(c, v) for v in values], c.isNotNull()), F.lit(False))


def not_deleted(c: Column | str = "is_deleted") -> Column:
    """Rows without a mark of deletion; null is none."""
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def named_or_described(part: str, *also: Column, name: str = "name", description: str = "description") -> Column:
    """The part in the name or the description, in any case; and all further conditions."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(x).contains(part.lower()), F.lit(False)) for x in (name, description)])
    return reduce(lambda a, b: a & b, also, hit if part else F.lit(True))
