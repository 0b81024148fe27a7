"""Full-text queries over token arrays: phrases, OR, NOT, and cover-density ranks.

A query is words that all must occur; "quoted words" must stand side by side; `or` takes either side; a leading - forbids.
Ranks follow Clarke, Cormack and Tudhope (2000): each shortest span that holds all terms counts 1 / its number of extra
places, and the sum r is scaled to r / (r + 1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
#: Weight of a token without a label.
WEIGHT = 0.1


def words(text: str) -> list[str]:
    out = []
    for run in re.findall(r"[぀-ヿ㐀-鿿]+|[^\W_぀-ヿ㐀-鿿]+", text.lower()):
        out += list(run) if "぀" <= run[0] <= "鿿" else [run]
    return out


def parse(query: str) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """Alternatives, each a list of (wanted, phrase)."""
    out: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for minus, quoted, word in _PART.findall(query):
        if word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        if word:
            minus, body = ("-", word[1:]) if word.startswith("-") and len(word) > 1 else ("", word)
        else:
            body = quoted
        phrase = tuple(words(body))
        if phrase:
            out[-1].append((not minus, phrase))
    return [a for a in out if any(w for w, _ in a)]


def _places(tokens: list[str], phrase: tuple[str, ...]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(tokens) - n + 1) if tuple(tokens[i : i + n]) == phrase]


def cover_rank(tokens: list[str] | None, query: list[list[tuple[bool, tuple[str, ...]]]]) -> float:
    """0 if the tokens don't match the query."""
    if tokens is None or not len(tokens):
        return 0.0
    tokens = list(tokens)
    best = 0.0
    for alternative in query:
        if any(not wanted and _places(tokens, p) for wanted, p in alternative):
            continue
        places = [_places(tokens, p) for wanted, p in alternative if wanted]
        if not places or not all(places):
            continue
        length = [len(p) for wanted, p in alternative if wanted]
        marks = sorted((i, k) for k, at in enumerate(places) for i in at)
        last, rank, before = {}, 0.0, -1
        for i, k in marks:
            last[k] = i
            if len(last) == len(places):
                start = min(last.values())
                if start > before:
                    end = max(last[j] + length[j] - 1 for j in last)
                    rank += WEIGHT * sum(length) / max(end - start + 1, 1)
                    before = start
        best = max(best, rank)
    return best / (best + 1)


def rank_udf(query: str):
    """Arrow UDF: token array -> rank of one query."""
    parsed = parse(query)

    @F.pandas_udf(T.DoubleType())
    def rank(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in col:
            yield s.map(lambda t: cover_rank(t, parsed)).astype("float64")

    return rank


def may_match(tokens: Column, query: str) -> Column:
    """A cheap necessary condition, inside the JVM: some alternative has all its wanted words."""
    tests = []
    for alternative in parse(query):
        need = sorted({w for wanted, p in alternative if wanted for w in p})
        tests.append(F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in need]))) == len(need))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
