"""Retrieval over embedding rows: vector, keyword and blended top-k, hit tests, reranking and context assembly.

Candidates are filtered before anything is scored; best row per paragraph is a two-phase max_by, so a shuffle moves one
row per paragraph and task; ties go to the smaller paragraph id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import fulltext
from lorespan.functions import vector as V

MODES = ("embedding", "keywords", "blend")


def candidates(rows: DataFrame, knowledge_ids: list[str] | None = None, exclude_documents: list[str] | None = None, exclude_paragraphs: DataFrame | list[str] | None = None, active: bool = True) -> DataFrame:
    """An empty list of knowledge bases gives no rows; None means all."""
    out = rows.where(F.col("is_active") == active)
    if knowledge_ids is not None:
        out = out.where(F.col("knowledge_id").isin(*knowledge_ids)) if knowledge_ids else out.where(F.lit(False))
    if exclude_documents:
        out = out.where(~F.coalesce(F.col("document_id").isin(*exclude_documents), F.lit(False)))
    if isinstance(exclude_paragraphs, DataFrame):
        out = out.join(exclude_paragraphs.select("paragraph_id"), "paragraph_id", "left_anti")
    elif exclude_paragraphs:
        out = out.where(~F.coalesce(F.col("paragraph_id").isin(*exclude_paragraphs), F.lit(False)))
    return out


def best_per_paragraph(scored: DataFrame, score: str = "score", key: str = "paragraph_id", tie: str = "id") -> DataFrame:
    """paragraph_id, score, and the row that has it; of equal rows the one with the smaller id."""
    best = scored.where(F.col(score).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(score).alias(score), F.min_by(tie, F.struct(-F.col(score), F.col(tie))).alias("best_id"))
    return best.select(key, score, "best_id")


def top(scored: DataFrame, threshold: float, k: int, score: str = "score", key: str = "paragraph_id") -> DataFrame:
    """Strictly above the threshold, best first, k of them."""
    return scored.where(F.col(score) > threshold).orderBy(F.desc(score), F.asc(key)).limit(k)


def search(rows: DataFrame, mode: str, query_vector: list[float] | None = None, query_text: str | None = None, threshold: float = 0.6, top_n: int = 3, tokens: str = "tokens") -> DataFrame:
    """paragraph_id, score, best_id. rows: candidates with id, paragraph_id, embedding and a token array."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    score = F.lit(0.0)
    if mode in ("embedding", "blend"):
        score = score + V.cosine(F.col("embedding"), V.literal(query_vector or []))
    if mode != "embedding":
        # ranks are computed in Python, so only rows that can match go there
        matches = fulltext.may_match(F.col(tokens), query_text or "")
        ranked = rows.where(matches).select("id", "paragraph_id", (score + F.coalesce(fulltext.rank_udf(query_text or "")(F.col(tokens)), F.lit(0.0))).alias("score"))
        if mode == "blend":
            ranked = ranked.unionByName(rows.where(~F.coalesce(matches, F.lit(False))).select("id", "paragraph_id", score.alias("score")))
    else:
        ranked = rows.select("id", "paragraph_id", score.alias("score"))
    return top(best_per_paragraph(ranked), threshold, top_n)


#: Query vectors that are searched, and broadcast, at once.
MOST_QUERIES = 10_000


def search_many(rows: DataFrame, queries: DataFrame, threshold: float, top_n: int) -> DataFrame:
    """query_id, paragraph_id, score, rank of any number of query vectors (query_id, query_vector) against all rows.

    Queries are searched in blocks of about MOST_QUERIES. A task compares a batch of rows with a block and keeps, for each
    query, the best row of each paragraph and the top_n of these; what is shuffled doesn't grow with the rows compared.
    Vectors of another length, null and zero ones score nothing."""
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // MOST_QUERIES))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks)) == block).select("query_id", "query_vector").toPandas()
        shared = spark.sparkContext.broadcast(part)
        out = rows.select("paragraph_id", "embedding").mapInPandas(_best_of_batches(shared, threshold, top_n), f"query_id {queries.schema['query_id'].dataType.simpleString()}, paragraph_id string, score double")
        found = out if found is None else found.unionByName(out)
    best = found.groupBy("query_id", "paragraph_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "paragraph_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def _best_of_batches(shared, threshold: float, top_n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(v) for v in q["query_vector"] if v is not None}:
            at = [i for i, v in enumerate(q["query_vector"]) if v is not None and len(v) == size]
            m = np.array([q["query_vector"].iloc[i] for i in at], dtype=np.float64)
            norm = np.sqrt((m * m).sum(1))
            by_size[size] = ([q["query_id"].iloc[i] for i, x in zip(at, norm, strict=True) if x > 0], m[norm > 0] / norm[norm > 0][:, None])
        for f in frames:
            f = f[f["embedding"].notna() & f["paragraph_id"].notna()]
            sizes = f["embedding"].map(len)
            out = []
            for size, (ids, m) in by_size.items():
                of = f[sizes == size]
                if not len(of) or not len(ids):
                    continue
                v = np.array(of["embedding"].tolist(), dtype=np.float64)
                norm = np.sqrt((v * v).sum(1))
                paragraphs = of["paragraph_id"].to_numpy()
                for begin in range(0, len(ids), 256):
                    with np.errstate(all="ignore"):
                        scores = (m[begin : begin + 256] @ v.T) / norm
                    for q_id, s in zip(ids[begin : begin + 256], scores, strict=True):
                        best: dict[str, float] = {}
                        for i in np.flatnonzero(s > threshold):
                            best[paragraphs[i]] = max(best.get(paragraphs[i], -2.0), float(s[i]))
                        out += [(q_id, p, x) for x, p in heapq.nsmallest(top_n, ((-x, p) for p, x in best.items()))]
            yield pd.DataFrame([(i, p, -x) for i, p, x in out], columns=["query_id", "paragraph_id", "score"])

    return run


def hit_test(rows: DataFrame, paragraphs: DataFrame, documents: DataFrame, **query: object) -> DataFrame:
    """Hits with their paragraphs; inactive documents are left out. rows may hold repeated rows, as the best one of a
    paragraph counts."""
    inactive = documents.where(~F.col("is_active")).select(F.col("id").alias("document_id"))
    hits = search(rows.join(inactive, "document_id", "left_anti"), **query)  # type: ignore[arg-type]
    return hits.join(paragraphs.withColumnRenamed("id", "paragraph_id"), "paragraph_id").orderBy(F.desc("score"), "paragraph_id")


def direct_return(hits: DataFrame, method: str = "hit_handling_method", limit: str = "directly_return_similarity", strict: bool = False) -> DataFrame:
    """The single best hit that its document returns directly, or all hits if there's none. The threshold is reached at
    equality, or only beyond it with strict."""
    over = F.col("score") > F.col(limit) if strict else F.col("score") >= F.col(limit)
    direct = F.coalesce((F.col(method) == "directly_return") & over, F.lit(False))
    best = hits.where(direct).orderBy(F.desc("score"), "paragraph_id").limit(1).withColumn("direct", F.lit(True))
    # all of them only if there's no such row: an anti join with that one row
    every = hits.withColumn("direct", direct).join(F.broadcast(best.select(F.lit(True).alias("__one"))), F.col("__one"), "left_anti")
    return best.unionByName(every)


def context_workflow(hits: DataFrame, most_chars: int = 5000, group: str | None = None) -> DataFrame:
    """'#### title' and content of all hits, best first, joined by line ends and cut."""
    part = F.concat_ws("\n", F.concat(F.lit("#### "), F.coalesce("title", F.lit(""))), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "paragraph_id", part.alias("part"))))
    agg = F.substring(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n"), 1, most_chars).alias("context")
    return hits.groupBy(group).agg(agg) if group else hits.agg(agg)


def context_pipeline(hits: DataFrame, most_chars: int = 5000, group: str | None = None) -> DataFrame:
    """'title:content' in data tags, best first, until the budget is used; the last one is cut."""
    part = F.concat(F.coalesce("title", F.lit("")), F.lit(":"), F.coalesce("content", F.lit("")))
    keys = [group] if group else []
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "paragraph_id")
    w = order.rowsBetween(W.unboundedPreceding, -1)
    # each part has a character at least, so no more of them than characters can count; ranks are limited before the shuffle
    few = hits.select(*keys, "score", "paragraph_id", part.alias("part")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most_chars).drop("__n")
    used = few.withColumn("used", F.coalesce(F.sum(F.length("part")).over(w), F.lit(0)))
    kept = used.where(F.col("used") < most_chars).withColumn("part", F.expr(f"substring(part, 1, {most_chars} - cast(used as int))"))
    tagged = F.concat(F.lit("<data>"), F.col("part"), F.lit("</data>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", (-F.col("score")).alias("d"), "paragraph_id", tagged.alias("t")))), lambda x: x["t"]), "\n").alias("context")
    return kept.groupBy(*keys).agg(joined) if group else kept.agg(joined)


def reranked(documents: DataFrame, scorer: Callable[[Column, Column], Column], query: Column) -> DataFrame:
    """Non-empty documents by falling score of a scorer (any column function, e.g. an Arrow UDF around a model)."""
    kept = documents.where(F.length(F.coalesce("content", F.lit(""))) > 0)
    return kept.withColumn("score", scorer(query, F.col("content")))


def budget_cut(documents: DataFrame, most_chars: int, top_n: int, threshold: float, group: str | None = None, tie: str = "paragraph_id") -> DataFrame:
    """The prefix by falling score: it ends before the first row at which the budget is used, top_n are taken, or the
    score is below the threshold; the last content is cut to what is left. A later row never comes back in."""
    keys = [group] if group else []
    order = W.partitionBy(*keys).orderBy(F.desc("score"), tie)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    # ranks are limited before the shuffle: no row beyond top_n comes back in
    n = documents.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).withColumn("used", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)))
    ok = n.withColumn("ok", F.min((F.col("used") < most_chars) & (F.col("score") >= threshold)).over(so_far))
    return ok.where("ok").withColumn("content", F.expr(f"substring(content, 1, cast({most_chars} - used as int))")).drop("ok", "used")


def reattached(scored: DataFrame, originals: DataFrame, text: str = "content") -> DataFrame:
    """Rerank results with their originals' columns, by text; equal texts are paired in order, each used once."""
    numbered = lambda d, o: d.withColumn("__k", F.row_number().over(W.partitionBy(text).orderBy(*o)))
    return numbered(scored, [F.desc("score")]).join(numbered(originals, [F.col("paragraph_id")]), [text, "__k"]).drop("__k")


def single_model(knowledge: DataFrame, knowledge_ids: list[str]) -> str | None:
    """The embedding model of these knowledge bases; more than one is an error."""
    models = knowledge.where(F.col("id").isin(*knowledge_ids)).select("embedding_model_id").distinct().limit(2).collect()
    if len(models) > 1:
        raise ValueError("the knowledge bases use different embedding models")
    return models[0][0] if models else None


def shown_before(records: DataFrame, question: str) -> DataFrame:
    """Paragraphs that earlier records of the same question already showed. details: JSON with search_step.paragraph_list."""
    ids = F.from_json(F.get_json_object("details", "$.search_step.paragraph_list"), "array<struct<id: string>>")
    return records.where(F.col("message") == question).select(F.explode(ids).alias("p")).select(F.col("p.id").alias("paragraph_id")).distinct()


def embedding_texts(paragraphs: DataFrame) -> DataFrame:
    """What is embedded: each problem (source_type 0) and each title with content (1); nulls are skipped."""
    problems = paragraphs.select("knowledge_id", "document_id", F.col("id").alias("paragraph_id"), "is_active", F.explode("problem_list").alias("p"))
    a = problems.select(F.col("p.id").alias("source_id"), "document_id", "paragraph_id", "knowledge_id", F.lit(0).alias("source_type"), F.col("p.content").alias("text"), "is_active")
    b = paragraphs.select(F.col("id").alias("source_id"), "document_id", F.col("id").alias("paragraph_id"), "knowledge_id", F.lit(1).alias("source_type"), F.concat_ws("\n", "title", "content").alias("text"), "is_active")
    return a.unionByName(b).distinct()


def chunked(texts: DataFrame) -> DataFrame:
    """Paragraph texts as chunks, problems whole."""
    from lorespan.functions.text import mark_chunks

    pieces = F.when(F.col("source_type") == 1, mark_chunks("text")).otherwise(F.array("text"))
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(pieces).alias("chunk_no", "text"))


def hashing_embedder(size: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: signed counts of hashed tokens, scaled to length 1, inside the JVM."""
    from lorespan.functions.text import tokens

    def bound(c: Column, f: Callable[[Column], Column]) -> Column:
        """f(c), with c computed once."""
        return F.element_at(F.transform(F.array(c), f), 1)

    def counts(hashes: Column) -> Column:
        of = lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), of)

    def scaled(raw: Column) -> Column:
        return bound(V.norm(raw), lambda n: F.when(n > 0, F.transform(raw, lambda x: (x / n).cast("float"))))

    def embed(text: Column) -> Column:
        hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
        return F.when(text.isNotNull(), bound(hashes, lambda h: bound(counts(h), scaled)))

    return embed
