"""Problems of paragraphs as tables of their own: a problem once per knowledge base and content, and its mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """problem (id, knowledge_id, content) and mapping (problem_id, paragraph_id, document_id, knowledge_id) of paragraphs'
    problem lists. A content's id is the least of those it comes with; null contents are none."""
    every = paragraphs.select("knowledge_id", "document_id", F.col("id").alias("paragraph_id"), F.explode("problem_list").alias("q"))
    every = every.select("knowledge_id", "document_id", "paragraph_id", F.col("q.id").alias("own_id"), F.col("q.content").alias("content")).where(F.col("content").isNotNull())
    problem = every.groupBy("knowledge_id", "content").agg(F.min("own_id").alias("id")).select("id", "knowledge_id", "content")
    mapping = every.join(problem, ["knowledge_id", "content"]).select(F.col("id").alias("problem_id"), "paragraph_id", "document_id", "knowledge_id").distinct()
    return problem, mapping


def with_mappings(problems: DataFrame, mappings: DataFrame) -> DataFrame:
    """Problems with the paragraphs they are mapped to; those without one stay."""
    m = mappings.select("problem_id", "paragraph_id", "document_id")
    return problems.join(m, problems.id == m.problem_id, "left").select("id", "knowledge_id", "content", "paragraph_id", "document_id")


def with_paragraphs(problems: DataFrame, mappings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The same with the paragraph's title and whether it is active, as texts are embedded by it."""
    p = paragraphs.select(F.col("id").alias("paragraph_id"), "title", "is_active")
    return with_mappings(problems, mappings).join(p, "paragraph_id", "left").select("id", "knowledge_id", "content", "paragraph_id", "document_id", "title", "is_active")


def listing(problems: DataFrame, mappings: DataFrame) -> DataFrame:
    """Problems with the number of their paragraphs."""
    n = mappings.groupBy("problem_id").agg(F.count("*").alias("n"))
    return problems.join(n, problems.id == n.problem_id, "left").select("id", "knowledge_id", "content", F.coalesce("n", F.lit(0)).alias("paragraph_count"))


def of_paragraphs(paragraphs: DataFrame, problems: DataFrame, mappings: DataFrame) -> DataFrame:
    """paragraph_id and the contents of its problems, in order of content, as an array; none: empty."""
    texts = mappings.join(problems.select(F.col("id").alias("problem_id"), "content"), "problem_id")
    lists = texts.groupBy("paragraph_id").agg(F.array_sort(F.collect_set("content")).alias("problems"))
    return paragraphs.select(F.col("id").alias("paragraph_id")).join(lists, "paragraph_id", "left").select("paragraph_id", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def left_over(problems: DataFrame, mappings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays when paragraphs (paragraph_id) go: their mappings go with them, and problems that then have none."""
    kept = mappings.join(gone.select("paragraph_id"), "paragraph_id", "left_anti")
    touched = mappings.join(gone.select("paragraph_id"), "paragraph_id", "left_semi").select("problem_id").distinct()
    orphans = touched.join(kept.select("problem_id"), "problem_id", "left_anti")
    return problems.join(orphans.withColumnRenamed("problem_id", "id"), "id", "left_anti"), kept


def remapped(problems: DataFrame, mappings: DataFrame, moves: DataFrame) -> DataFrame:
    """Mappings of moved paragraphs (paragraph_id, target_id: a knowledge base, target_document_id) with the problem of the
    same content in the target: the one that is there, or a new one (created), whose id is the old one with the target's."""
    old = problems.select(F.col("id").alias("problem_id"), "content")
    moved = mappings.join(moves, "paragraph_id").join(old, "problem_id")
    there = problems.select(F.col("id").alias("known_id"), F.col("knowledge_id").alias("target_id"), "content")
    found = moved.join(there, ["target_id", "content"], "left")
    new_id = F.concat_ws(":", "target_id", F.md5("content"))
    return found.select("paragraph_id", F.col("target_id").alias("knowledge_id"), F.col("target_document_id").alias("document_id"), F.coalesce("known_id", new_id).alias("problem_id"), "content", F.col("known_id").isNull().alias("created"))
