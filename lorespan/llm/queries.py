"""The pN_ queries over the tables of a data directory, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm import encode, garble, knn, language, mainbody, neardup, pack, pairs, split
from lorespan.session import scratch_dir
from lorespan.sources.tables import table

NEAR_DUPLICATE = {"threshold": 0.7, "least_chars": 300, "most_chars": 3000}

#: Files that p6_file_pieces writes, each of a share of all texts.
FILES = 3
#: Documents count as copies of each other, for p8, from this similarity on; texts of fewer characters have no substrings.
COPIES = {"threshold": 0.8, "least_chars": neardup.CHARS}


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = garble.fields({t: table(spark, sf_dir, t) for t in ("paragraph", "document", "document_import")})
    return garble.restore(rows, garble.fit_rows(rows))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("item_table", "item_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(pairs.pairs_of(table(spark, sf_dir, "application_chat_record"), table(spark, sf_dir, "paragraph")))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = mainbody.web_pages(table(spark, sf_dir, "paragraph"), table(spark, sf_dir, "document"))
    return mainbody.main_lines(pages, mainbody.fit_pages(pages))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_lines(spark, sf_dir).select("paragraph_id", "line_no")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_pairs(*neardup.near_duplicates(table(spark, sf_dir, "paragraph"), "id", "content", **NEAR_DUPLICATE))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(table(spark, sf_dir, "paragraph"), "id", "content", **NEAR_DUPLICATE))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(neardup.near_duplicates(table(spark, sf_dir, "paragraph"), "id", "content", **NEAR_DUPLICATE)[0])


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_links(*neardup.near_duplicates(table(spark, sf_dir, "paragraph"), "id", "content", **NEAR_DUPLICATE))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.pairs(knn.neighbours(table(spark, sf_dir, "embedding")))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    limits = split.settings(spark, table(spark, sf_dir, "split_setting"))
    tables = {t: table(spark, sf_dir, t) for t in ("paragraph", "document_import")}
    return split.split_items(split.items_of(spark, tables, limits))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = _split(spark, sf_dir)
    return pieces.where("section = 0 and piece_in_section = 0").select(*split.key_parts())


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.emit_pieces(*_split(spark, sf_dir)).select(*split.key_parts(), "piece_no", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "text")


def p6_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents, written as FILES text files in order of id, and split by byte ranges."""
    folder = f"{scratch_dir(spark)}/split-files-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    in_files = texts.repartition(FILES, F.pmod("doc_id", F.lit(FILES))).sortWithinPartitions("doc_id").select("text")
    in_files.write.text(folder)
    paths = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect())
    limit = split.settings(spark, table(spark, sf_dir, "split_setting")).get(("paragraph", "content"), (2000, 120))
    pieces = split.split_files(spark, paths, *limit)
    number = F.regexp_extract("item_key", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no")
    return pieces.select(number, "piece_no", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "token_container").limit(101).collect()
    if len(rows) > 100:
        raise ValueError("token_container is a table of parameters; it has over 100 rows")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = encode.token_counts(docs, ["doc_id", "source"], "text").select(F.col("doc_id").alias("item_id"), "n_tokens", "source")
    folded = docs.select("doc_id", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("folded"))
    alike = neardup.groups(*neardup.alike(folded, "doc_id", "folded", **COPIES))
    clusters = alike.join(alike.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "group_id").select(F.col("id").alias("item_id"), F.col("group_id").alias("cluster"))
    sized = sized.join(clusters, "item_id", "left")
    packed = pack.pack(sized, [(r.container_name, r.capacity_tokens) for r in rows])
    return packed.select("container_name", "container_id", F.col("item_id").alias("doc_id"), "part_no", F.col("start").alias("first_token"), "n_tokens")


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    docs, codes = table(spark, sf_dir, "documents"), language.codes_of(table(spark, sf_dir, "language_code"))
    return language.judge(docs, language.fit_on(docs, codes)), codes


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(*_judged(spark, sf_dir))


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[0].select("doc_id", "lang", "language", F.round("confidence", 6).alias("confidence"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _judged(spark, sf_dir)[0].where(F.size("languages") > 1)
    return mixed.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.language").alias("language"), F.round("s.confidence", 6).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_restored": p1_restored,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_lines": p3_lines,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p4_classes": p4_classes,
        "p4_links": p4_links,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p6_file_pieces": p6_file_pieces,
        "p7_ids": p7_ids,
        "p8_packed": p8_packed,
        "p9_found": p9_found,
        "p9_languages": p9_languages,
        "p9_segments": p9_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_classes": """
            select distinct p.id, min(p.id) over (partition by p.content) as class_id
            from paragraph p where p.id is not null and length(p.content) between 300 and 3000""",
        "p6_found": """
            with item as (
                select 'paragraph' as item_table, id as item_id, 0 as item_no, title, content from paragraph
                union all
                select 'document_import', id, (n - 1)::int, paragraphs[n].title, paragraphs[n].content
                from (select id, paragraphs, unnest(range(1, len(paragraphs) + 1)) as n from document_import)
            ), part as (
                select item_table, item_id, item_no, 'content' as field, content as text from item
                union all select item_table, item_id, item_no, 'title', title from item
            )
            select distinct p.item_table, p.item_id, p.item_no, p.field
            from part p join split_setting s on s.item_table = p.item_table and s.field = p.field
            where length(p.text) > s.max_chars""",
    }
