"""Queries over the tables of a data directory, one per operator or family, with the SQL that gives the same rows.

Records delivered again count once: both sides keep the newest row of an id. Doubles are rounded, counts are bigint.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.functions import fulltext, predicates, status, text, vector
from lorespan.operators import maintain, problems, relational, reports, search
from lorespan.session import scratch_dir
from lorespan.plans.flow import Edge, Flow, Node
from lorespan.sources.split import split_documents
from lorespan.sources.tables import table
from lorespan.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The newest row of each id, as common table expressions.
_CURRENT = {
    t: f"select * exclude (rn) from (select *, row_number() over (partition by id order by update_time desc nulls last, create_time desc nulls last) as rn from {t}) where rn = 1"
    for t in ("document", "paragraph", "application_chat", "application_chat_record")
} | {"embedding": "select distinct * from embedding"}
_CTE = {"document": "doc", "paragraph": "par", "application_chat": "chat", "application_chat_record": "rec", "embedding": "emb"}


def _with(*tables: str, more: str = "") -> str:
    return "with " + ", ".join(f"{_CTE[t]} as ({_CURRENT[t]})" for t in tables) + more + " "


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _docs(s: SparkSession, d: str) -> DataFrame:
    return relational.current(table(s, d, "document"))


def _pars(s: SparkSession, d: str) -> DataFrame:
    return relational.current(table(s, d, "paragraph"))


def _chats(s: SparkSession, d: str) -> DataFrame:
    return relational.current(table(s, d, "application_chat"))


def _recs(s: SparkSession, d: str) -> DataFrame:
    return relational.current(table(s, d, "application_chat_record"))


def _embs(s: SparkSession, d: str) -> DataFrame:
    """Rows as they come: a row delivered again scores the same, and the best row of a paragraph counts, so searches filter
    on the scan and never rank all vectors by id."""
    return table(s, d, "embedding")


def _emb_keys(s: SparkSession, d: str) -> DataFrame:
    """Embedding rows, each once, without vectors and tokens."""
    return table(s, d, "embedding").drop("embedding", "tokens").distinct()


#: A query vector for reports: fixed, so that both sides have it.
PROBE = [round(((i * 37) % 64 - 31.5) / 100, 3) for i in range(64)]
_PROBE_SQL = "[" + ", ".join(str(x) for x in PROBE) + "]::double[]"


# --- retrieval ---


@query(f"""with best as (
        select label, max(list_cosine_similarity(embedding::double[], {_PROBE_SQL})) as score from embeddings group by label
    ) select label::bigint as label, round(score, 5) as score from best where score > 0.1 order by score desc, label limit 5""")
def vector_topk_labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("paragraph_id"), vector.cosine("embedding", vector.literal(PROBE)).alias("score"))
    return search.top(search.best_per_paragraph(rows), 0.1, 5).select(F.col("paragraph_id").alias("label"), F.round("score", 5).alias("score"))


_SCORED = f"""scored as (
    select id, paragraph_id, list_cosine_similarity(embedding::double[], {_PROBE_SQL}) as score from emb
    where is_active and len(embedding) = 64 and list_inner_product(embedding::double[], embedding::double[]) > 0)"""


@query(_with("embedding", more=", " + _SCORED) + "select paragraph_id, round(max(score), 5) as score from scored where paragraph_id is not null group by paragraph_id having max(score) > 0.25 order by max(score) desc, paragraph_id limit 10")
def vector_search(s: SparkSession, d: str) -> DataFrame:
    rows = search.candidates(_embs(s, d)).where(vector.dims("embedding") == 64)
    return search.search(rows, "embedding", PROBE, threshold=0.25, top_n=10).select("paragraph_id", F.round("score", 5).alias("score"))


@query(_with("embedding", "document", more=", " + _SCORED.replace("from emb\n", "from emb anti join (select id as document_id from doc where not is_active) using (document_id)\n")) + """, kb as (select knowledge_id from paragraph group by knowledge_id order by count(distinct id) desc, knowledge_id limit 2)
    select s.paragraph_id, round(max(s.score), 5) as score from scored s join emb using (id) where emb.knowledge_id in (select knowledge_id from kb) group by s.paragraph_id order by max(s.score) desc, s.paragraph_id limit 20""")
def search_prefiltered(s: SparkSession, d: str) -> DataFrame:
    """Two knowledge bases, without inactive documents."""
    pars = table(s, d, "paragraph").groupBy("knowledge_id").agg(F.countDistinct("id").alias("n"))
    kb = [r[0] for r in pars.orderBy(F.desc("n"), "knowledge_id").limit(2).collect()]
    inactive = _docs(s, d).where(~F.col("is_active")).select(F.col("id").alias("document_id"))
    rows = search.candidates(_embs(s, d), kb).where(vector.dims("embedding") == 64).join(inactive, "document_id", "left_anti")
    return search.search(rows, "embedding", PROBE, threshold=-2, top_n=20).select("paragraph_id", F.round("score", 5).alias("score"))


#: Cover-density ranks of "draft policy or 冷却": spans between neighbouring places of two words, and places of a phrase.
_RANKS_SQL = """, t as (select row_number() over () as r, * from (select distinct id, paragraph_id, tokens, embedding from emb where is_active)),
    u as (select r, unnest(tokens) as tok, generate_subscripts(tokens, 1) as i from t),
    m as (select r, tok, i, lag(tok) over (partition by r order by i) as before, lag(i) over (partition by r order by i) as j from u where tok in ('draft', 'policy')),
    one as (select r, sum(0.2 / (i - j + 1)) as x from m where before <> tok group by r),
    two as (select r, count(*) * 0.1 as x from (select r, tok, lead(tok) over (partition by r order by i) as after from u) where tok = '冷' and after = '却' group by r),
    ranks as (select r, max(x) / (max(x) + 1) as rank from (select * from one union all select * from two) group by r)"""


@query(_with("embedding", more=_RANKS_SQL) + "select paragraph_id, round(max(rank), 6) as score from t join ranks using (r) where paragraph_id is not null group by 1 having max(rank) > 0 order by max(rank) desc, paragraph_id limit 50")
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    rows = search.candidates(_embs(s, d))
    return search.search(rows, "keywords", query_text="draft policy or 冷却", threshold=0.0, top_n=50).select("paragraph_id", F.round("score", 6).alias("score"))


@query(_with("embedding", more=_RANKS_SQL) + f""", mixed as (select paragraph_id, list_cosine_similarity(embedding::double[], {_PROBE_SQL}) + coalesce(rank, 0) as score from t left join ranks using (r)
    where paragraph_id is not null and len(embedding) = 64 and list_inner_product(embedding::double[], embedding::double[]) > 0)
    select paragraph_id, round(max(score), 5) as score from mixed group by 1 having max(score) > 0.2 order by max(score) desc, paragraph_id limit 50""")
def blend_search(s: SparkSession, d: str) -> DataFrame:
    rows = search.candidates(_embs(s, d)).where(vector.dims("embedding") == 64)
    return search.search(rows, "blend", PROBE, "draft policy or 冷却", threshold=0.2, top_n=50).select("paragraph_id", F.round("score", 5).alias("score"))


@query(_with("embedding", "paragraph", "document", more=", " + _SCORED.replace("from emb\n", "from emb anti join (select id as document_id from doc where not is_active) using (document_id)\n")) + """, best as (select paragraph_id, max(score) as score from scored group by paragraph_id having max(score) > 0.25 order by max(score) desc, paragraph_id limit 10)
    select b.paragraph_id, round(b.score, 5) as score, p.title, p.content, p.document_id from best b join par p on p.id = b.paragraph_id""")
def hit_test(s: SparkSession, d: str) -> DataFrame:
    rows = search.candidates(_embs(s, d)).where(vector.dims("embedding") == 64)
    hits = search.hit_test(rows, _pars(s, d), _docs(s, d), mode="embedding", query_vector=PROBE, threshold=0.25, top_n=10)
    return hits.select("paragraph_id", F.round("score", 5).alias("score"), "title", "content", "document_id")


@query(_with("embedding", more=""", q as (select id, any_value(embedding::double[]) as v from emb where is_active and len(embedding) = 64 and list_inner_product(embedding::double[], embedding::double[]) > 0 and paragraph_id is not null group by id)
    """) + """select 'q' || n as query_id, paragraph_id, round(score, 5) as score, rank::bigint as rank from (
        select n, paragraph_id, score, row_number() over (partition by n order by score desc, paragraph_id) as rank from (
            select n, e.paragraph_id, max(list_cosine_similarity(q.v, list_transform(range(64), lambda i: ((i * (37 + n)) % 64 - 31.5) / 100)::double[])) as score
            from q join (select distinct id, paragraph_id from emb) e using (id), range(6) as r(n) group by n, e.paragraph_id) where score > 0.2) where rank <= 4""")
def search_batch(s: SparkSession, d: str) -> DataFrame:
    """Several query vectors at once."""
    rows = search.candidates(_embs(s, d)).where(vector.dims("embedding") == 64)
    queries = s.createDataFrame([(f"q{n}", [((i * (37 + n)) % 64 - 31.5) / 100 for i in range(64)]) for n in range(6)], "query_id string, query_vector array<double>")
    return search.search_many(rows, queries, 0.2, 4).select("query_id", "paragraph_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    """All paragraphs with a score that SQL can reproduce, by knowledge base."""
    score = F.round(F.length("content") % 97 / F.lit(97.0), 4)
    return _pars(s, d).where(F.length("content") > 0).select("knowledge_id", F.col("id").alias("paragraph_id"), F.coalesce("title", F.lit("")).alias("title"), "content", score.alias("score"))


_HITS_SQL = _with("paragraph", more=", hits as (select knowledge_id, id as paragraph_id, coalesce(title, '') as title, content, round(length(content) % 97 / 97.0, 4) as score from par where length(content) > 0)")


@query(_HITS_SQL + """, w as (select *, row_number() over (partition by knowledge_id order by score desc, paragraph_id) as rank,
        coalesce(sum(length(content)) over (partition by knowledge_id order by score desc, paragraph_id rows between unbounded preceding and 1 preceding), 0) as used from hits),
    k as (select *, min((used < 5000 and rank <= 8 and score >= 0.6)::int) over (partition by knowledge_id order by score desc, paragraph_id rows between unbounded preceding and current row) as ok from w)
    select knowledge_id, paragraph_id, rank::bigint as rank, substring(content, 1, (5000 - used)::int) as content from k where ok = 1""")
def rerank_budget_cut(s: SparkSession, d: str) -> DataFrame:
    return search.budget_cut(_hits(s, d), 5000, 8, 0.6, "knowledge_id").select("knowledge_id", "paragraph_id", F.col("rank").cast("long").alias("rank"), "content")


@query(_HITS_SQL + """, top as (select *, row_number() over (partition by knowledge_id order by score desc, paragraph_id) as r from hits)
    select knowledge_id, substring(string_agg('#### ' || title || chr(10) || content, chr(10) order by score desc, paragraph_id), 1, 5000) as context from top where r <= 5 group by knowledge_id""")
def context_workflow(s: SparkSession, d: str) -> DataFrame:
    w = F.row_number().over(search.W.partitionBy("knowledge_id").orderBy(F.desc("score"), "paragraph_id"))
    return search.context_workflow(_hits(s, d).withColumn("r", w).where("r <= 5"), 5000, "knowledge_id")


@query(_HITS_SQL + """, w as (select *, coalesce(sum(length(title) + 1 + length(content)) over (partition by knowledge_id order by score desc, paragraph_id rows between unbounded preceding and 1 preceding), 0) as used from hits)
    select knowledge_id, string_agg('<data>' || substring(title || ':' || content, 1, (3000 - used)::int) || '</data>', chr(10) order by used, score desc, paragraph_id) as context from w where used < 3000 group by knowledge_id""")
def context_pipeline(s: SparkSession, d: str) -> DataFrame:
    return search.context_pipeline(_hits(s, d), 3000, "knowledge_id")


_DIRECT_SQL = _with("paragraph", "document", more=", h as (select p.id as paragraph_id, round(length(p.content) % 97 / 97.0, 4) as score, x.hit_handling_method, x.directly_return_similarity from par p join doc x on x.id = p.document_id where length(p.content) > 0), f as (select *, coalesce(hit_handling_method = 'directly_return' and score {op} directly_return_similarity, false) as direct from h)")


def _direct_hits(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select(F.col("id").alias("document_id"), "hit_handling_method", "directly_return_similarity")
    score = F.round(F.length("content") % 97 / F.lit(97.0), 4)
    return _pars(s, d).where(F.length("content") > 0).select("document_id", F.col("id").alias("paragraph_id"), score.alias("score")).join(docs, "document_id")


@query(_DIRECT_SQL.replace("{op}", ">=") + "select paragraph_id, score from f where direct order by score desc, paragraph_id limit 1")
def direct_return_pick(s: SparkSession, d: str) -> DataFrame:
    return search.direct_return(_direct_hits(s, d)).select("paragraph_id", "score")


@query(_DIRECT_SQL.replace("{op}", ">") + "select paragraph_id, score from f where direct order by score desc, paragraph_id limit 1")
def direct_return_strict(s: SparkSession, d: str) -> DataFrame:
    return search.direct_return(_direct_hits(s, d), strict=True).select("paragraph_id", "score")


@query(_DIRECT_SQL.replace("{op}", ">") + "select paragraph_id, score from f")
def direct_return_none(s: SparkSession, d: str) -> DataFrame:
    """No hit can reach its limit, so all come back."""
    return search.direct_return(_direct_hits(s, d).withColumn("directly_return_similarity", F.lit(2.0))).select("paragraph_id", "score")


@query(_with("paragraph", "application_chat_record") + """, w as (select content, round(length(content) % 97 / 97.0, 4) as score, id from par where length(content) > 0),
    a as (select *, row_number() over (partition by content order by id) as k from w), b as (select content, score, row_number() over (partition by content order by score desc) as k from w)
    select a.id as paragraph_id, b.score from a join b using (content, k)""")
def rerank_reattached(s: SparkSession, d: str) -> DataFrame:
    """Texts scored alone get their paragraphs back; equal texts are paired in order."""
    docs = _pars(s, d).where(F.length("content") > 0).select(F.col("id").alias("paragraph_id"), "content")
    scored = search.reranked(docs.select("content"), lambda q, c: F.round(F.length(c) % 97 / F.lit(97.0), 4), F.lit("q"))
    return search.reattached(scored, docs).select("paragraph_id", "score")


@query("select embedding_model_id as model, count(*) as bases from knowledge group by 1")
def single_model_guard(s: SparkSession, d: str) -> DataFrame:
    """Each model's knowledge bases pass the guard together."""
    k = table(s, d, "knowledge")
    models = [r[0] for r in k.select("embedding_model_id").distinct().collect()]
    rows = []
    for m in models:
        of = F.col("embedding_model_id").eqNullSafe(m)
        ids = [r[0] for r in k.where(of).select("id").collect()]
        rows.append((search.single_model(k, ids), len(ids)))
    return s.createDataFrame(rows, "model string, bases long")


@query(_with("application_chat_record") + """select id, message, answer_text, coalesce(list_contains(['-1'], vote_status), false) as open from rec where message = (select min(message) from rec where length(message) > 20)""")
def same_question_records(s: SparkSession, d: str) -> DataFrame:
    recs = _recs(s, d)
    first = recs.where(F.length("message") > 20).agg(F.min("message")).first()[0]
    return recs.where(F.col("message") == first).select("id", "message", "answer_text", predicates.one_of_or_null(F.col("vote_status"), ["-1"]).alias("open"))


@query(_with("paragraph") + """select p.document_id, p.id as paragraph_id, p.knowledge_id, 0 as source_type, q.id as source_id, q.content as text, p.is_active from par p, unnest(p.problem_list) as u(q)
    union select document_id, id, knowledge_id, 1, id, concat_ws(chr(10), title, content), is_active from par""")
def embedding_text_union(s: SparkSession, d: str) -> DataFrame:
    return search.embedding_texts(_pars(s, d)).select("document_id", "paragraph_id", "knowledge_id", "source_type", "source_id", "text", "is_active")


_CHUNK_MARK = "(?s).{1,256}[。 |\\\\.！;；!\\n]"


@query(_with("paragraph") + f""", x as (select p.id as paragraph_id, 0 as source_type, q.id as source_id, q.content as text from par p, unnest(p.problem_list) as u(q) union select id, 1, id, concat_ws(chr(10), title, content) from par),
    r as (select paragraph_id, source_type, source_id, text, regexp_extract_all(text, '{_CHUNK_MARK}') as runs, regexp_split_to_array(text, '{_CHUNK_MARK}') as rests from x where source_type = 1 and text is not null),
    rest as (select * exclude (rests, runs), unnest(rests) as y from r), a as (select * exclude (rests, runs), unnest(runs) as c from r union all select * exclude (y), unnest(regexp_extract_all(y, '(?s).{{1,256}}')) from rest),
    b as (select paragraph_id, source_type, source_id, regexp_replace(c, '^[\\s\\v\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\v\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g') as text from a)
    select * from b where length(text) > 0 union all select paragraph_id, source_type, source_id, text from x where source_type = 0""")
def chunked_texts(s: SparkSession, d: str) -> DataFrame:
    return search.chunked(search.embedding_texts(_pars(s, d))).select("paragraph_id", "source_type", "source_id", "text")


@query(_with("embedding", "paragraph") + "select distinct e.id from emb e anti join (select * from par where is_active) p on p.id = e.paragraph_id")
def stale_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Embeddings whose paragraph is gone; a paragraph that was switched off counts as gone here."""
    return relational.without(_emb_keys(s, d), _pars(s, d).where("is_active").select(F.col("id").alias("paragraph_id")), "paragraph_id").select("id")


# --- reports ---


@query(_with("application_chat_record", "application_chat") + """select r.create_time::date::varchar as day, sum(case when vote_status = '0' then 1 else 0 end)::bigint as star_num, sum(case when vote_status = '1' then 1 else 0 end)::bigint as trample_num,
    sum(message_tokens + answer_tokens)::bigint as tokens_num, count(r.id) as chat_record_count, count(distinct c.chat_user_id) as customer_num from rec r left join chat c on c.id = r.chat_id group by 1""")
def daily_trend(s: SparkSession, d: str) -> DataFrame:
    return reports.daily_trend(_recs(s, d), _chats(s, d)).withColumn("day", F.col("day").cast("string"))


@query("""with first as (select chat_user_id, min(create_time) as t from application_chat where chat_user_id is not null group by 1) select t::date::varchar as day, count(*) as customer_added_count from first group by 1""")
def new_users_daily(s: SparkSession, d: str) -> DataFrame:
    return reports.new_users(_chats(s, d)).withColumn("day", F.col("day").cast("string"))


@query("""with day as (select ts::date as day, count(*) as n, count(distinct user_id) as users from events group by 1), days as (select unnest(generate_series((select min(day) from day)::timestamp, (select max(day) from day)::timestamp + interval 7 day, interval 1 day))::date as day)
    select days.day::varchar as day, coalesce(n, 0) as n, coalesce(users, 0) as users from days left join day using (day)""")
def trend_gap_filled(s: SparkSession, d: str) -> DataFrame:
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    lo, hi = table(s, d, "events").agg(F.to_date(F.min("ts")), F.date_add(F.to_date(F.max("ts")), 7)).first()
    return reports.gap_filled(daily, F.lit(lo), F.lit(hi), ["n", "users"]).withColumn("day", F.col("day").cast("string"))


@query(_with("application_chat_record") + """select chat_id, count(id) as chat_record_count, sum(case when vote_status = '0' then 1 else 0 end)::bigint as star_num, sum(case when vote_status = '1' then 1 else 0 end)::bigint as trample_num,
    sum(coalesce(len(improve_paragraph_id_list), 0))::bigint as mark_sum from rec group by chat_id""")
def chat_counters(s: SparkSession, d: str) -> DataFrame:
    return reports.chat_counters(_recs(s, d))


@query(_with("application_chat_record", "application_chat") + """, real as (select chat_id, count(id) as n, sum(case when vote_status = '0' then 1 else 0 end) as a, sum(case when vote_status = '1' then 1 else 0 end) as b, sum(coalesce(len(improve_paragraph_id_list), 0)) as m from rec group by chat_id)
    select c.id, coalesce(n, 0)::bigint as chat_record_count, coalesce(a, 0)::bigint as star_num, coalesce(b, 0)::bigint as trample_num, coalesce(m, 0)::bigint as mark_sum from chat c left join real r on r.chat_id = c.id
    where c.chat_record_count is distinct from coalesce(n, 0) or c.star_num is distinct from coalesce(a, 0) or c.trample_num is distinct from coalesce(b, 0) or c.mark_sum is distinct from coalesce(m, 0)""")
def counter_drift(s: SparkSession, d: str) -> DataFrame:
    return reports.counter_drift(_chats(s, d), _recs(s, d))


@query(_with("document") + """, t as (select knowledge_id, count(id) as document_count, sum(char_length)::bigint as char_length from doc group by 1)
    select k.id, k.name, k.workspace_id, k.knowledge_type, coalesce(document_count, 0) as document_count, coalesce(char_length, 0) as char_length from knowledge k left join t on t.knowledge_id = k.id""")
def knowledge_listing(s: SparkSession, d: str) -> DataFrame:
    return reports.knowledge_listing(table(s, d, "knowledge"), _docs(s, d))


@query("select id, name, 'knowledge' as resource_type, description from knowledge union select distinct folder_id, folder_id, 'folder', null from knowledge where folder_id is not null")
def resource_folder_union(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge")
    folders = k.where(F.col("folder_id").isNotNull()).select(F.col("folder_id").alias("id"), F.col("folder_id").alias("name"), F.lit("folder").alias("resource_type"))
    return relational.union_distinct(k.select("id", "name", F.lit("knowledge").alias("resource_type"), "description"), folders)


@query(_with("document", "paragraph") + """, n as (select document_id, status, count(id) as n from par group by 1, 2), j as (select document_id, '[' || string_agg('{"status":"' || status || '","count":' || n || '}', ',' order by status) || ']' as aggs from n group by 1)
    select doc.id as document_id, coalesce(aggs, '[]') as aggs from doc left join j on j.document_id = doc.id""")
def status_rollup_json(s: SparkSession, d: str) -> DataFrame:
    return reports.status_rollup(_docs(s, d), _pars(s, d))


@query(_with("document", "paragraph") + "select doc.id as document_id, coalesce(sum(length(content)), 0)::bigint as char_length from doc left join par on par.document_id = doc.id group by 1")
def document_char_length(s: SparkSession, d: str) -> DataFrame:
    return reports.char_lengths(_docs(s, d), _pars(s, d))


@query(_with("document", "paragraph") + "select doc.id, (select count(*) from par where par.document_id = doc.id) as paragraph_count, k.name as knowledge_name from doc left join knowledge k on k.id = doc.knowledge_id")
def document_listing(s: SparkSession, d: str) -> DataFrame:
    n = _pars(s, d).groupBy("document_id").agg(F.count("*").alias("n"))
    k = table(s, d, "knowledge").select(F.col("id").alias("knowledge_id"), F.col("name").alias("knowledge_name"))
    return _docs(s, d).join(n, F.col("id") == F.col("document_id"), "left").join(k, "knowledge_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("paragraph_count"), "knowledge_name")


@query(_with("paragraph", "document") + "select p.id, p.title, x.name as document_name, k.name as knowledge_name from par p left join knowledge k on k.id = p.knowledge_id left join doc x on x.id = p.document_id where p.hit_num > 5")
def paragraph_enrich(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge").select(F.col("id").alias("knowledge_id"), F.col("name").alias("knowledge_name"))
    x = _docs(s, d).select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    return _pars(s, d).where("hit_num > 5").join(k, "knowledge_id", "left").join(x, "document_id", "left").select("id", "title", "document_name", "knowledge_name")


@query(_with("application_chat", "application_chat_record", "paragraph") + """, res as (select r.id as record_id, count(p.id) as improved, md5(string_agg(p.id || chr(31) || coalesce(p.title, '') || chr(31) || coalesce(p.content, ''), chr(30) order by p.id)) as digest from (select id, unnest(improve_paragraph_id_list) as pid from rec) r join par p on p.id = r.pid group by 1)
    select c.id as chat_id, c.abstract, r.id as record_id, r.record_index, r.message, r.answer_text, r.vote_status, coalesce(res.improved, 0) as improved, res.digest from chat c left join rec r on r.chat_id = c.id left join res on res.record_id = r.id""")
def chat_export(s: SparkSession, d: str) -> DataFrame:
    out = reports.chat_export(_chats(s, d), _recs(s, d), _pars(s, d))
    found = F.from_json("improve_paragraph_list", "array<struct<paragraph_id: string, title: string, content: string>>")
    text_of = F.array_join(F.transform(found, lambda p: F.concat_ws("\x1f", p["paragraph_id"], F.coalesce(p["title"], F.lit("")), F.coalesce(p["content"], F.lit("")))), "\x1e")
    n = F.coalesce(F.size(found), F.lit(0)).cast("long")
    return out.select("chat_id", "abstract", "record_id", "record_index", "message", "answer_text", "vote_status", n.alias("improved"), F.when(n > 0, F.md5(text_of)).alias("digest"))


@query(_with("document", "paragraph") + """, sheet as (select id, name || case when n > 0 then '-' || n else '' end as sheet from (select id, name, row_number() over (partition by name order by id) - 1 as n from doc)),
    q as (select p.id, string_agg(t.q.content, chr(10) order by t.k) as problems from par p, (select unnest(p.problem_list) as q, generate_subscripts(p.problem_list, 1) as k) as t group by 1)
    select s.sheet, p.sort_position, p.id as paragraph_id, """ + ", ".join(f"case when regexp_matches({c}, '^[=+\\-@]') then chr(65279) || {c} else {c} end as {n}" for c, n in (("p.title", "title"), ("p.content", "content"), ("coalesce(q.problems, '')", "problems"))) + " from par p join sheet s on s.id = p.document_id left join q on q.id = p.id")
def document_export(s: SparkSession, d: str) -> DataFrame:
    return reports.document_export(_docs(s, d), _pars(s, d))


def _grants(s: SparkSession, d: str) -> DataFrame:
    """Grants on knowledge bases by a rule over the table, as there's none of grants."""
    n = F.pmod(F.length("name") * 7 + F.length("workspace_id"), F.lit(5))
    kind = F.when(n < 2, "ROLE").otherwise("RESOURCE_PERMISSION_GROUP")
    permits = F.when(n == 0, F.array(F.lit("ROLE"))).when(n == 2, F.array(F.lit("VIEW"), F.lit("MANAGE"))).when(n == 3, F.array(F.lit("VIEW")))
    return table(s, d, "knowledge").where(n < 4).select(F.col("id").alias("target"), "user_id", "workspace_id", kind.alias("auth_type"), permits.alias("permission_list"))


_GRANTS_SQL = """with g as (select id as target, user_id, workspace_id, (length(name) * 7 + length(workspace_id)) % 5 as n from knowledge),
    grants as (select target, user_id, workspace_id, case when n < 2 then 'ROLE' else 'RESOURCE_PERMISSION_GROUP' end as auth_type, case n when 0 then ['ROLE'] when 2 then ['VIEW', 'MANAGE'] when 3 then ['VIEW'] end as permission_list from g where n < 4) """


@query(_GRANTS_SQL + """select k.id, k.name, coalesce(case when auth_type = 'ROLE' and list_contains(permission_list, 'ROLE') then 'ROLE' when auth_type = 'RESOURCE_PERMISSION_GROUP' and list_contains(permission_list, 'MANAGE') then 'MANAGE'
    when auth_type = 'RESOURCE_PERMISSION_GROUP' and list_contains(permission_list, 'VIEW') then 'VIEW' end, 'NOT_AUTH') as permission from knowledge k left join grants on target = k.id""")
def acl_effective_permission(s: SparkSession, d: str) -> DataFrame:
    return reports.effective_permission(table(s, d, "knowledge").select("id", "name"), _grants(s, d))


@query(_GRANTS_SQL + "select id, name from knowledge where id in (select target from grants where (auth_type = 'ROLE' and list_contains(permission_list, 'ROLE') and user_id is not null and length(user_id) % 2 = 0) or (auth_type <> 'ROLE' and list_contains(permission_list, 'VIEW')))")
def acl_visible(s: SparkSession, d: str) -> DataFrame:
    users = table(s, d, "knowledge").where(F.col("user_id").isNotNull()).select("user_id", "workspace_id", F.when(F.length("user_id") % 2 == 0, "READER").otherwise("GUEST").alias("role_id")).distinct()
    roles = s.createDataFrame([("READER", "APPLICATION:READ"), ("GUEST", "OTHER")], "role_id string, permission_id string")
    return reports.visible(table(s, d, "knowledge").select("id", "name"), _grants(s, d), roles, users)


@query("""with w as (select unnest(['missing-1', 'missing-2', (select min(id) from knowledge)]) as target_id, 'KNOWLEDGE' as auth_target_type union all select (select min(id) from knowledge), 'TOOL' union all select '3', 'TOOL' union all select '9', 'MODEL')
    select * from w where not exists (select * from (select id, 'KNOWLEDGE' as t from knowledge union all select id, 'APPLICATION' from document union all select n_nationkey::varchar, 'TOOL' from nation union all select r_regionkey::varchar, 'MODEL' from region) k where k.id = target_id and k.t = auth_target_type)""")
def acl_missing_targets(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "knowledge").agg(F.min("id")).first()[0]
    asked = [("missing-1", "KNOWLEDGE"), ("missing-2", "KNOWLEDGE"), (known, "KNOWLEDGE"), (known, "TOOL"), ("3", "TOOL"), ("9", "MODEL")]
    rows = ", ".join(f'{{"target_id": "{t}", "auth_target_type": "{k}"}}' for t, k in asked)
    wanted = relational.json_rows(s, f"[{rows}]", "target_id: string, auth_target_type: string")
    keys = lambda t, c: table(s, d, t).select(F.col(c).cast("string").alias("id"))
    return reports.missing_targets(wanted, ("KNOWLEDGE", keys("knowledge", "id")), ("APPLICATION", _docs(s, d)), ("TOOL", keys("nation", "n_nationkey")), ("MODEL", keys("region", "r_regionkey")))


@query(_with("document") + "select id, name, create_time from doc order by create_time desc nulls first, id limit 20 offset 40")
def document_page(s: SparkSession, d: str) -> DataFrame:
    rows, _ = relational.page(_docs(s, d).select("id", "name", "create_time"), 3, 20, relational.ordered(_docs(s, d)))
    return rows


@query(_with("document") + "select count(*) as total, 3 as current, 20 as size from doc")
def document_page_total(s: SparkSession, d: str) -> DataFrame:
    return relational.page(_docs(s, d), 3, 20, [F.col("id")])[1]


# --- predicates and text ---


@query(_with("document") + "select id, name from doc where contains(lower(name), 'the ') and not is_active is null")
def icontains_filter(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where(text.icontains("name", "The ") & F.col("is_active").isNotNull()).select("id", "name")


@query(_with("paragraph") + """, p as (select id, status, case when length(coalesce(status, '')) < 3 then lpad(coalesce(status, ''), 3, 'n') else status end as full_status from par)
    select id, substring(reverse(full_status), 1, 1) as embedding_state, substring(reverse(full_status), 2, 1) as generate_state, regexp_matches(full_status, '^[2n]*$') as done, translate(full_status, '014', '333') as recovered,
        substring(full_status, 1, length(full_status) - 2) || '4' || substring(full_status, length(full_status), 1) as spliced from p""")
def status_slots(s: SparkSession, d: str) -> DataFrame:
    return _pars(s, d).select("id", status.state("status", status.EMBEDDING).alias("embedding_state"), status.state("status", status.GENERATE_PROBLEM).alias("generate_state"), status.all_done("status").alias("done"), status.recovered("status").alias("recovered"), status.with_state("status", status.GENERATE_PROBLEM, status.REVOKE).alias("spliced"))


@query(_with("paragraph") + """select id, case when hit_num >= 10 and title like '%e%' then 'hot' when title is null or title = '' or length(title) > 40 then 'untitled' when is_active then 'plain' else 'off' end as branch_id from par""")
def branch_conditions(s: SparkSession, d: str) -> DataFrame:
    branches = [
        {"id": "hot", "condition": "and", "conditions": [("hit_num", "ge", "10"), ("title", "contain", "e")]},
        {"id": "untitled", "condition": "or", "conditions": [("title", "is_null", None), ("title", "len_gt", "40")]},
        {"id": "plain", "condition": "and", "conditions": [("is_active", "is_true", None)]},
    ]
    return _pars(s, d).select("id", predicates.branch(branches, "off").alias("branch_id"))


@query("""with r as (select doc_id, regexp_extract_all(text, '(?s).{1,256}[。 |\\\\.！;；!\\n]') as runs, regexp_split_to_array(text, '(?s).{1,256}[。 |\\\\.！;；!\\n]') as rests from documents where text is not null),
    rest as (select doc_id, unnest(rests) as x from r), cut as (select doc_id, unnest(regexp_extract_all(x, '(?s).{1,256}')) as c from rest), a as (select doc_id, unnest(runs) as c from r union all select * from cut),
    b as (select doc_id, regexp_replace(c, '^[\\s\\v\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+|[\\s\\v\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+$', '', 'g') as c from a)
    select doc_id, count(*) as chunks, sum(length(c))::bigint as chars, md5(string_agg(c, chr(31) order by c)) as digest from b where length(c) > 0 group by doc_id""")
def chunk_counts(s: SparkSession, d: str) -> DataFrame:
    """Numbers and lengths of chunks, and a digest of all of them in order of text."""
    chunks = table(s, d, "documents").select("doc_id", text.mark_chunks("text").alias("c")).where(F.size("c") > 0)
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return chunks.select("doc_id", F.size("c").cast("long").alias("chunks"), chars.alias("chars"), F.md5(F.array_join(F.array_sort("c"), "\x1f")).alias("digest"))


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), ' +', ' ', 'g'), '#+', '', 'g'), '\\t+', '', 'g') as cleaned from documents")
def clean_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.clean("text").alias("cleaned"))


def _plain_sql(column: str) -> str:
    """The passes in RE2's words: its dot takes all but a line feed, and its white space is ASCII without the vertical tab."""
    any_, space, wide = r"[^\n\r\x{85}\x{2028}\x{2029}]", r"[\s\v]", r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]"
    out = f"array_to_string(list_filter(string_split({column}, chr(10)), lambda x: length(regexp_replace(x, '{wide}+', '', 'g')) > 0), chr(10))"
    passes = [(rf"!\[{any_}*?\]\({any_}*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (rf"(?m)^#{{1,6}}{space}+", ""), (rf"\*\*({any_}*?)\*\*", r"\1"), (rf"__({any_}*?)__", r"\1"), (rf"\*({any_}*?)\*", r"\1"), (rf"_({any_}*?)_", r"\1"), (rf"`({any_}*?)`", r"\1"), (r"(?s)```.*?```", ""), (r"\n{2,}", "\n"), (r"<[^>]+>", ""), (f"{wide}+", " ")]
    for pattern, new in passes:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"regexp_replace({out}, '^{wide}+|{wide}+$', '', 'g')"


@query(f"select doc_id, {_plain_sql('text')} as plain from documents")
def markdown_plain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.speakable("text").alias("plain"))


@query("""select id, case when floor(length(name) / 5 * 2) > 8 then substring(name, 1, 8) when floor(length(name) / 5 * 2) <= 0 then substring(name, 1, 1) else substring(name, 1, floor(length(name) / 5 * 2)::int) end || '***************' ||
    case when floor(length(name) / 5 * 2) < 4 then case when floor(length(name) / 5) = 0 then '' else right(name, floor(length(name) / 5)::int) end else right(name, 4) end as masked from knowledge""")
def mask_secret(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge").select("id", text.mask_secret("name").alias("masked"))


@query("select doc_id, md5(text) as md5, sha256(text) as sha256, length(text)::bigint as n from documents where text is not null")
def text_hashes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.md5_hex("text").alias("md5"), text.sha256_hex("text").alias("sha256"), F.length("text").cast("long").alias("n"))


@query("select doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|[vV]?\\d+(?:\\.\\d+)+'), '|') as words from documents where regexp_matches(text, '\\d\\.\\d')")
def protected_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(F.col("text").rlike(r"\d\.\d")).select("doc_id", F.array_join(text.protected_words("text"), "|").alias("words"))


@query()
def heading_split(s: SparkSession, d: str) -> DataFrame:
    return split_documents(table(s, d, "documents"), "doc_id", "text")


@query("""with p as (select doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+)', ' \\1 ', 'g'), '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+|[\\p{L}\\p{N}]+')) as w from documents where text is not null),
    t as (select doc_id, w from p where not regexp_matches(w, '^[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]') union all select doc_id, substring(w, i::int, n::int) from (select *, unnest(range(1, length(w) + 1)) as i from p where regexp_matches(w, '^[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]')), range(1, 3) as r(n) where i + n <= length(w) + 1),
    k as (select distinct doc_id, w from t where w not in ('the', 'a', 'of', 'and'))
    select d.doc_id, case when d.text is not null then coalesce(string_agg(k.w, ' ' order by encode(k.w)), '') end as words from documents d left join k using (doc_id) group by d.doc_id, d.text""")
def token_keywords(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(text.keywords("text", ["the", "a", "of", "and"])), " ").alias("words"))


@query("""with u as (select distinct source_url from knowledge_web_request) select source_url, regexp_replace(regexp_replace(source_url, '#.*$', ''), '/$', '') as key from u""")
def web_page_keys(s: SparkSession, d: str) -> DataFrame:
    from lorespan.sources.web import page_key

    return table(s, d, "knowledge_web_request").select("source_url").distinct().withColumn("key", page_key("source_url"))


@query("select id, json_extract_string(meta, '$.source_url') as source_url, json_extract_string(meta, '$.selector') as selector from (" + _CURRENT["document"] + ") where doc_type = 1")
def json_path_filter(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("doc_type = 1").select("id", F.get_json_object("meta", "$.source_url").alias("source_url"), F.get_json_object("meta", "$.selector").alias("selector"))


# --- windows and maintenance ---


@query(_with("application_chat_record") + "select chat_id, id from (select chat_id, id, row_number() over (partition by chat_id order by create_time desc nulls last, id desc) as n from rec) where n <= 3")
def history_last_n(s: SparkSession, d: str) -> DataFrame:
    return relational.last_n(_recs(s, d), "chat_id", "create_time", 3, tie="id").select("chat_id", "id")


@query(_with("document") + "select knowledge_id, max_by(id, (create_time, id)) as id from doc group by knowledge_id")
def latest_version(s: SparkSession, d: str) -> DataFrame:
    return relational.latest_per(_docs(s, d), "knowledge_id", [F.desc("create_time"), F.desc("id")]).select("knowledge_id", "id")


@query(_with("paragraph") + "select id, row_number() over (partition by document_id order by sort_position, create_time, id)::int - 1 as sort_position from par")
def position_renumber(s: SparkSession, d: str) -> DataFrame:
    return relational.renumbered(_pars(s, d), "document_id", "sort_position", ["sort_position", "create_time", "id"]).select("id", "sort_position")


@query(_with("paragraph") + ", p as (select id, row_number() over (partition by document_id order by sort_position, create_time, id)::int - 1 as p from par) select id, case when p = 0 then 2 when p <= 2 then p - 1 else p end as sort_position from p")
def position_shift(s: SparkSession, d: str) -> DataFrame:
    numbered = relational.renumbered(_pars(s, d), "document_id", "sort_position", ["sort_position", "create_time", "id"])
    return relational.moved(numbered, "document_id", "sort_position", F.lit(0), F.lit(2)).select("id", "sort_position")


@query(_with("paragraph") + """, q as (select p.knowledge_id, t.q.content as content, t.q.id as id, p.is_active from par p, unnest(p.problem_list) as t(q)), known as (select knowledge_id, content, min(id) as known_id from q where is_active group by 1, 2), w as (select distinct knowledge_id, content from q where content is not null)
    select w.knowledge_id, w.content, k.known_id is null as created from w left join known k on k.knowledge_id = w.knowledge_id and k.content = w.content""")
def upsert_get_or_create(s: SparkSession, d: str) -> DataFrame:
    q = _pars(s, d).select("knowledge_id", "is_active", F.explode("problem_list").alias("q")).select("knowledge_id", "is_active", F.col("q.content").alias("content"), F.col("q.id").alias("id"))
    out = relational.get_or_create(q.where("is_active"), q.where("content is not null").select("knowledge_id", "content"), ["knowledge_id", "content"], F.expr("uuid()"))
    return out.select("knowledge_id", "content", "created")


@query(_with("application_chat_record", "application_chat") + """, lim as (select application_id, 30 + length(application_id) % 7 as days from chat group by 1), now as (select max(create_time) as t from rec)
    select r.id from rec r join chat c on c.id = r.chat_id join lim using (application_id), now where r.create_time < now.t - to_days(lim.days::int)""")
def retention_cutoff(s: SparkSession, d: str) -> DataFrame:
    chats, recs = _chats(s, d), _recs(s, d)
    keep = chats.select("application_id", (F.lit(30) + F.length("application_id") % 7).alias("clean_time")).distinct()
    now = recs.agg(F.max("create_time")).first()[0]
    return maintain.expired_records(recs, chats, keep, F.lit(now)).select("id")


@query(_with("embedding", "paragraph") + "select e.id, coalesce(p.is_active, e.is_active) as is_active from emb e left join par p on p.id = e.paragraph_id")
def propagated_active(s: SparkSession, d: str) -> DataFrame:
    return maintain.propagated_active(_emb_keys(s, d), _pars(s, d)).select("id", "is_active")


@query(_with("paragraph", "document") + "select id from par where document_id not in (select id from doc where is_active) and document_id is not null")
def orphan_cleanup(s: SparkSession, d: str) -> DataFrame:
    return relational.without(_pars(s, d), _docs(s, d).where("is_active").select(F.col("id").alias("document_id")), "document_id").where("document_id is not null").select("id")


@query("""select r_name as root, n_name as id, 1 as depth from nation join region on n_regionkey = r_regionkey union all select r_name, r_name, 0 from region union all select n_name, n_name, 0 from nation
    union all select n_name, s_name, 1 from supplier join nation on s_nationkey = n_nationkey union all select r_name, s_name, 2 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def folder_descendants(s: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (table(s, d, t) for t in ("region", "nation", "supplier"))
    a = region.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    b = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"))
    c = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("id"), F.col("n_name").alias("parent_id"))
    return relational.descendants(a.unionByName(b).unionByName(c), a.unionByName(b))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as s, event_id from events),
    g as (select user_id, ts, sum(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as n from e)
    select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as records from g group by user_id, n""")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(s, d, "events"), key="user_id", time="ts")


@query("select user_id, ts::date::varchar as day, count(*) as used, count(*) >= 3 as exhausted from events group by 1, 2")
def quota_daily(s: SparkSession, d: str) -> DataFrame:
    return streams.daily_quota(table(s, d, "events"), 3, key="user_id", time="ts").withColumn("day", F.col("day").cast("string"))


@query(_with("application_chat_record") + """select id, case when length(coalesce(message, '')) = 0 then 'ask' when length(message) >= 60 then 'long' else 'short' end as way, case when length(coalesce(message, '')) = 0 then 'Please ask.' when length(message) >= 60 then 'L:' || message else 'S:' || message end as answer from rec""")
def flow_batch(s: SparkSession, d: str) -> DataFrame:
    """A flow of conditions and replies over all chat records at once."""
    branches = [{"id": "ask", "conditions": [{"field": ["start", "question"], "compare": "is_null"}]}, {"id": "long", "conditions": [{"field": ["start", "question"], "compare": "len_ge", "value": "60"}]}, {"id": "short", "conditions": []}]
    nodes = [Node("start", "start-node", {"question": "message"}), Node("c", "condition-node", {"branch": branches})]
    nodes += [Node(n, "reply-node", {"value": v}) for n, v in (("ra", "Please ask."), ("rl", "L:{{start.question}}"), ("rs", "S:{{start.question}}"))]
    edges = [Edge("start", "c")] + [Edge("c", t, f"c_{b}_right") for t, b in (("ra", "ask"), ("rl", "long"), ("rs", "short"))]
    out = Flow(nodes, edges).run(_recs(s, d).select("id", "message"))
    return out.select("id", F.col("c__branch_id").alias("way"), F.coalesce("ra__answer", "rl__answer", "rs__answer").alias("answer"))


@query(ORACLES["chat_counters"])
def stream_counters(s: SparkSession, d: str) -> DataFrame:
    """Counters of the whole record table, read as a stream until it ends; each record as it came last."""
    name = f"{scratch_dir(s)}/counters-{uuid.uuid4().hex}"
    path = f"{d}/application_chat_record.parquet"
    folder = path if os.path.isdir(path) else f"{d}/application_chat_record*.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(folder)
    streams.newest_to(stream, f"{name}/rows", f"{name}/checkpoint").awaitTermination()
    return streams.chat_counters(streams.latest_of(s, f"{name}/rows"))


def queries() -> dict[str, Query]:
    from lorespan import queries_more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
