"""Problem 7: the ids of every text by a public byte-level BPE tokenizer.

Method: each partition cuts its texts into words, and DuckDB contracts the words' byte rows by a recursive query: rows
(word and position, token) are joined with the merge table on the pair of neighbours, each round merges every word's
leftmost pair of least rank, until no pair of a word is in the table. An ordered aggregation turns the last rows of a
word into its ids, and the words' ids, in order of place, make the text's ids. decode() is the way back, an ordered
aggregation of the tokens' bytes.

A word is contracted once per partition and batch, not once per occurrence; a worker keeps the ids of words it met in a
cache that is emptied when it holds CACHE_WORDS, so memory is bounded and results don't depend on it.

Defined results: null and empty text give the empty list; text that looks like a special token is ordinary text; lone
surrogates can't occur in Spark strings; other columns of the input are passed on by id only, so their names don't clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.session import spread

#: Folder of the vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pattern that cuts text into words before the merges of this vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pieces of one recursive query, by their bytes; a longer one is a query of its own.
QUERY_BYTES = 200_000
CACHE_WORDS = 300_000
#: Bytes by which pieces of long words follow each other, and by which each reaches into the next.
PIECE, OVERLAP = 48, 24

#: Rows are (round, key, token), where the key is a word's number and a position in it, so that one sorted column orders them.
_CONTRACT = """
with recursive step(n, k, id) as (
    select 0, k, id from word_rows
    union all
    (with pairs as (
        select n, k, id, lead(k) over g as next_k, lead(id) over g as next_id, lag(k) over g as before
        from step window g as (order by k)
    ), least as (
        select k >> 32 as w, min(((rank_id >> 20) << 46) | ((k & 67108863) << 20) | (rank_id & 1048575)) as pick
        from pairs join merges on merges.pair = ((pairs.id::bigint << 20) | pairs.next_id)
        where next_k >> 32 = k >> 32
        group by 1
    )
    select n + 1, p.k, case when (p.k & 67108863) = ((pick >> 20) & 67108863) then (pick & 1048575)::int else p.id end
    from pairs p join least on least.w = p.k >> 32
    where p.before is null or p.before <> (((p.k >> 32) << 32) | ((pick >> 20) & 67108863)))
), done as (select k >> 32 as w, max(n) as n from step group by 1)
select step.k >> 32 as w, list(id order by k) as ids from step join done on done.w = step.k >> 32 and done.n = step.n group by 1 order by 1
"""


def byte_letters() -> list[str]:
    """The letter by which this kind of vocabulary writes each byte: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Words to ids by the recursive query; one per worker process."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, folder: str, name: str) -> Encoder:
        path = os.path.join(folder, f"{name}.json")
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_id = np.array([vocab[x] for x in byte_letters()], dtype=np.int32)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.merges = pa.table({"pair": (left << 20) | right, "rank_id": (np.arange(len(pairs), dtype=np.int64) << 20) | merged})
        letters = {x: b for b, x in enumerate(byte_letters())}
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.token_len = {i: len(b) for i, b in self.token_bytes.items()}
        self.words = regex.compile(WORD_PATTERN)
        self.db = duckdb.connect(":memory:")
        self.db.execute("set threads = 1")
        self.db.execute("set memory_limit = '300MB'")
        self.db.register("merge_rows", self.merges)
        self.db.execute("create table merges as select * from merge_rows")
        self.cache: dict[str, tuple[int, ...]] = {}

    def contract(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each of the distinct words."""
        raw = [w.encode("utf-8") for w in words]
        long = [i for i, x in enumerate(raw) if len(x) > PIECE + OVERLAP]
        out = self._contract([x if len(x) <= PIECE + OVERLAP else b"" for x in raw])
        for i, ids in zip(long, self._joined([raw[i] for i in long]), strict=True):
            out[i] = ids
        return out

    def _contract(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of byte strings, by the recursive query."""
        out: list[tuple[int, ...]] = [()] * len(raw)
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= QUERY_BYTES):
                size += len(raw[end])
                end += 1
            lens = np.fromiter((len(x) for x in raw[at:end]), dtype=np.int64, count=end - at)
            word = np.repeat(np.arange(end - at, dtype=np.int64), lens)
            pos = np.arange(size, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
            ids = self.byte_id[np.frombuffer(b"".join(raw[at:end]), dtype=np.uint8)]
            self.db.register("word_rows", pa.table({"k": (word << 32) | pos, "id": ids}))
            got = self.db.execute(_CONTRACT).fetchnumpy()
            for w, x in zip(got["w"].tolist(), got["ids"], strict=True):
                out[at + w] = tuple(x.tolist())
            self.db.unregister("word_rows")
            at = end
        return out

    def _joined(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of long byte strings, from those of overlapping pieces."""
        spans = [[(s, min(s + PIECE + OVERLAP, len(x))) for s in range(0, len(x) - OVERLAP, PIECE)] for x in words]
        done: dict[bytes, list[int]] = {}
        while True:
            new = list({x[a:b]: None for x, of in zip(words, spans, strict=True) for a, b in of if x[a:b] not in done})
            done.update(zip(new, self._contract(new), strict=True))
            out, apart = [], False
            for i, (x, of) in enumerate(zip(words, spans, strict=True)):
                ids, again = self._join(x, of, done)
                apart |= bool(again)
                out.append(ids)
                if again:
                    spans[i] = again
            if not apart:
                return out

    def _join(self, word: bytes, spans: list[tuple[int, int]], done: dict[bytes, list[int]]) -> tuple[tuple[int, ...], list[tuple[int, int]]]:
        """The word's ids; or, where neighbouring pieces agree on no token, the pieces to be contracted instead."""
        out: list[int] = []
        merged: list[tuple[int, int]] = []
        held: list[tuple[int, int, int]] = []  # tokens not yet given: start, end, id
        for k, (a, b) in enumerate(spans):
            tokens, at = [], a
            for t in done[word[a:b]]:
                tokens.append((at, at + self.token_len[t], t))
                at = tokens[-1][1]
            if k == 0:
                held = tokens
                merged.append((a, b))
                continue
            before = {s: (e, n) for n, (s, e, _) in enumerate(held) if s >= a}
            found = next(((n, before[s][1]) for n, (s, e, _) in enumerate(tokens) if s in before and before[s][0] == e), None)
            if found is None:
                merged[-1] = (merged[-1][0], b)
                held = tokens
                continue
            merged.append((a, b))
            out += [t for _, _, t in held[: found[1]]]
            held = tokens[found[0] :]
        out += [t for _, _, t in held]
        return tuple(out), (merged if len(merged) < len(spans) else [])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(dict.fromkeys(w for ws in cut for w in ws))
        self.cache.update(zip(new, self.contract(new), strict=True))
        lists = [np.fromiter(chain.from_iterable(self.cache[w] for w in ws), dtype=np.int32) for ws in cut]
        for w in new:
            if len(w) > PIECE:  # the cache is bounded by its number of short words
                del self.cache[w]
        return lists

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists: the tokens' bytes are joined in order of position."""
        self.db.register("token_bytes", pa.table({"id": list(self.token_bytes), "hex": [b.hex() for b in self.token_bytes.values()]}))
        lens = [len(x) for x in ids]
        self.db.register("id_rows", pa.table({"d": np.repeat(np.arange(len(ids)), lens), "pos": np.concatenate([np.arange(n) for n in lens] or [np.zeros(0, int)]), "id": np.concatenate([np.asarray(x, dtype=np.int64) for x in ids] or [np.zeros(0, np.int64)])}))
        rows = self.db.execute("select d, string_agg(hex, '' order by pos) from id_rows join token_bytes using (id) group by d").fetchall()
        found = {int(d): bytes.fromhex(x).decode("utf-8") for d, x in rows}
        return [found.get(i, "") for i in range(len(ids))]


def _batches(batch: pa.RecordBatch, text_at: int, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about limit characters at most, or one row."""
    start, size = 0, 0
    for i, x in enumerate(batch.column(text_at)):
        n = len(x.as_py() or "") if x.is_valid else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Columns id_col and ids of every row; one pass over the texts; they are shuffled only if they come in fewer partitions than there are cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer_dir, tokenizer)
        for batch in batches:
            for a, b in _batches(batch, 1):
                part = batch.slice(a, b - a)
                lists = coder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=[id_col, "ids"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(source).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[str], text_col: str, tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Columns keep and n_tokens; only the counts leave the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer_dir, tokenizer)
        for batch in batches:
            for a, b in _batches(batch, len(keep)):
                part = batch.slice(a, b - a)
                sizes = [len(x) for x in coder.encode(part.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int32())], names=[*keep, "n_tokens"])

    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType())])
    return spread(source).mapInArrow(run, schema)
