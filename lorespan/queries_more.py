"""More queries and their SQL: predicates, joins, problems, text, maintenance, sources, dataflows and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import documents, predicates, registered, status, text
from lorespan.operators import maintain, problems, relational, reports, search, sinks
from lorespan.plans.flow import Edge, Flow, Node
from lorespan.queries import _GRANTS_SQL, _HITS_SQL, ORACLES, _chats, _docs, _emb_keys, _grants, _hits, _pars, _recs, _with, query
from lorespan.session import scratch_dir
from lorespan.sources import files, web
from lorespan.sources.split import cut_at_periods
from lorespan.sources.tables import table
from lorespan.streaming import streams

# --- predicates ---


@query(_with("application_chat_record") + "select id from rec where create_time >= timestamp '2025-02-01' and create_time < timestamp '2025-04-16'")
def date_range_filter(s: SparkSession, d: str) -> DataFrame:
    return _recs(s, d).where(predicates.days_between(F.col("create_time"), "2025-02-01", "2025-04-15")).select("id")


@query(_with("document") + "select id, name from doc where contains(name, 'The') or contains(name, 'des')")
def contains_filter(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where(predicates.combine([predicates.contains(F.col("name"), p) for p in ("The", "des")], "or")).select("id", "name")


@query(_GRANTS_SQL + "select target from grants where permission_list && ['MANAGE', 'ROLE']")
def array_overlap_filter(s: SparkSession, d: str) -> DataFrame:
    return _grants(s, d).where(predicates.any_of(F.col("permission_list"), ["MANAGE", "ROLE"])).select("target")


@query(_GRANTS_SQL + "select target, coalesce(permission_list @> ['VIEW', 'MANAGE'], false) as all_of, not coalesce(permission_list @> ['MANAGE'], false) as no_manage from grants")
def array_contains_all(s: SparkSession, d: str) -> DataFrame:
    p = F.col("permission_list")
    return _grants(s, d).select("target", predicates.all_of(p, ["VIEW", "MANAGE"]).alias("all_of"), (~predicates.all_of(p, ["MANAGE"])).alias("no_manage"))


@query(_with("application_chat") + "select id from chat where not coalesce(is_deleted, false)")
def soft_delete_filter(s: SparkSession, d: str) -> DataFrame:
    return _chats(s, d).where(predicates.not_deleted()).select("id")


@query("select id, name from knowledge where (contains(lower(name), 'the') or contains(lower(coalesce(description, '')), 'the')) and scope = 'SHARED'")
def name_or_description(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge").where(predicates.named_or_described("The", F.col("scope") == "SHARED")).select("id", "name")


@query(_with("paragraph") + """select id, coalesce(title, 'None') = 'x' as eq, coalesce(not contains(title, 'e'), true) as not_contain, coalesce(hit_num > 3, false) as gt, coalesce(hit_num < 3, false) as lt, coalesce(hit_num <= 3, false) as le,
    coalesce(length(title) = 5, false) as len_eq, coalesce(length(title) >= 5, false) as len_ge, coalesce(length(title) < 9, false) as len_lt, coalesce(length(title) <= 9, false) as len_le, coalesce(length(title) > 0, false) as is_not_null,
    coalesce(not is_active, false) as is_not_true, false as text_is_true, coalesce(len(problem_list) >= 2, false) as list_len_ge, coalesce(len(problem_list) = 0, true) as list_is_null,
    coalesce(list_contains(list_transform(problem_list, lambda q: q.id), (select min(q.id) from par p, unnest(p.problem_list) as u(q))), false) as list_contain from par""")
def comparisons(s: SparkSession, d: str) -> DataFrame:
    """Workflow comparisons over texts, numbers, booleans and lists."""
    pars = _pars(s, d)
    least = pars.select(F.explode("problem_list").alias("q")).agg(F.min("q.id")).first()[0]
    c, ids = predicates.compare, F.transform("problem_list", lambda q: q["id"])
    title, hits = F.col("title"), F.col("hit_num")
    return pars.select(
        "id", c("eq", title, "x").alias("eq"), c("not_contain", title, "e").alias("not_contain"), c("gt", hits, "3").alias("gt"), c("lt", hits, "3").alias("lt"), c("le", hits, "3").alias("le"),
        c("len_eq", title, "5").alias("len_eq"), c("len_ge", title, "5").alias("len_ge"), c("len_lt", title, "9").alias("len_lt"), c("len_le", title, "9").alias("len_le"), c("is_not_null", title).alias("is_not_null"),
        c("is_not_true", F.col("is_active")).alias("is_not_true"), c("is_true", F.lit("true")).alias("text_is_true"), c("len_ge", ids, "2", True).alias("list_len_ge"), c("is_null", ids, None, True).alias("list_is_null"), c("contain", ids, least, True).alias("list_contain"),
    )


# --- problems of paragraphs ---

_PROBLEMS_SQL = _with("paragraph", more=""", q as (select p.knowledge_id, p.document_id, p.id as paragraph_id, t.q.id as own_id, t.q.content as content from par p, unnest(p.problem_list) as t(q) where t.q.content is not null),
    problem as (select min(own_id) as id, knowledge_id, content from q group by 2, 3), mapping as (select distinct b.id as problem_id, q.paragraph_id, q.document_id, q.knowledge_id from q join problem b using (knowledge_id, content))""")


@query(_PROBLEMS_SQL + "select b.id, b.knowledge_id, b.content, (select count(*) from mapping m where m.problem_id = b.id) as paragraph_count from problem b")
def problem_listing(s: SparkSession, d: str) -> DataFrame:
    return problems.listing(*problems.normalised(_pars(s, d)))


@query(_PROBLEMS_SQL + "select b.id, b.knowledge_id, b.content, m.paragraph_id, m.document_id from problem b left join mapping m on m.problem_id = b.id")
def problem_mappings(s: SparkSession, d: str) -> DataFrame:
    return problems.with_mappings(*problems.normalised(_pars(s, d)))


@query(_PROBLEMS_SQL + "select b.id, b.knowledge_id, b.content, m.paragraph_id, m.document_id, p.title, p.is_active from problem b left join mapping m on m.problem_id = b.id left join par p on p.id = m.paragraph_id")
def problem_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return problems.with_paragraphs(*problems.normalised(_pars(s, d)), _pars(s, d))


@query(_PROBLEMS_SQL + "select p.id as paragraph_id, coalesce(string_agg(distinct b.content, '|' order by b.content), '') as problems from par p left join mapping m on m.paragraph_id = p.id left join problem b on b.id = m.problem_id group by 1")
def paragraph_problems(s: SparkSession, d: str) -> DataFrame:
    out = problems.of_paragraphs(_pars(s, d), *problems.normalised(_pars(s, d)))
    return out.select("paragraph_id", F.array_join("problems", "|").alias("problems"))


@query(_PROBLEMS_SQL + ", gone as (select id from par where not is_active), kept as (select * from mapping where paragraph_id not in (select id from gone)) select id from problem where id in (select problem_id from kept) or id not in (select problem_id from mapping)")
def problems_left_over(s: SparkSession, d: str) -> DataFrame:
    """Problems that stay when inactive paragraphs go."""
    gone = _pars(s, d).where("not is_active").select(F.col("id").alias("paragraph_id"))
    return problems.left_over(*problems.normalised(_pars(s, d)), gone)[0].select("id")


@query(_PROBLEMS_SQL + """, kb as (select min(knowledge_id) as target from par), moved as (select m.*, b.content from mapping m join problem b on b.id = m.problem_id join par p on p.id = m.paragraph_id where p.hit_num > 5)
    select m.paragraph_id, kb.target as knowledge_id, m.document_id, coalesce(t.id, kb.target || ':' || md5(m.content)) as problem_id, m.content, t.id is null as created from moved m, kb left join problem t on t.knowledge_id = kb.target and t.content = m.content""".replace("from moved m, kb left join", "from (select * from moved, kb) m cross join kb left join"))
def problems_remapped(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs with many hits move to the first knowledge base; their problems are found or created there."""
    pars = _pars(s, d)
    target = pars.agg(F.min("knowledge_id")).first()[0]
    moves = pars.where("hit_num > 5").select(F.col("id").alias("paragraph_id"), F.lit(target).alias("target_id"), F.col("document_id").alias("target_document_id"))
    return problems.remapped(*problems.normalised(pars), moves)


# --- joins, permissions, aggregates ---


@query("""with u as (select distinct user_id as id, 'u-' || substring(user_id, 1, 8) as nick_name from knowledge where length(coalesce(description, '')) % 2 = 0 and user_id is not null) select k.id, k.name, u.nick_name from knowledge k left join u on u.id = k.user_id""")
def owner_names(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge")
    users = k.where((F.length(F.coalesce("description", F.lit(""))) % 2 == 0) & F.col("user_id").isNotNull()).select(F.col("user_id").alias("id"), F.concat(F.lit("u-"), F.substring("user_id", 1, 8)).alias("nick_name")).distinct()
    return reports.with_owner(k, users).select("id", "name", "nick_name")


@query(_with("application_chat") + "select c.id, c.chat_user_id, u.c_name as chat_user_name from (select id, (length(abstract) % 200)::varchar as chat_user_id from chat) c left join customer u on u.c_custkey::varchar = c.chat_user_id")
def chat_user_names(s: SparkSession, d: str) -> DataFrame:
    chats = _chats(s, d).select("id", (F.length("abstract") % 200).cast("string").alias("chat_user_id"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reports.with_chat_user(chats, users).select("id", "chat_user_id", "chat_user_name")


_LINKS_SQL = "links as (select distinct c.application_id, k.id as knowledge_id from application_chat c join knowledge k on k.scope = 'SHARED' and length(c.abstract) % 40 = length(k.name) % 40)"


def _links(s: SparkSession, d: str) -> DataFrame:
    """Which application uses which knowledge base, by a rule, as there's no such table."""
    k = table(s, d, "knowledge").where("scope = 'SHARED'").select(F.col("id").alias("knowledge_id"), (F.length("name") % 40).alias("m"))
    return table(s, d, "application_chat").select("application_id", (F.length("abstract") % 40).alias("m")).distinct().join(k, "m").select("application_id", "knowledge_id").distinct()


@query(f"with {_LINKS_SQL} select k.id, count(distinct l.application_id) as application_count from knowledge k left join links l on l.knowledge_id = k.id group by 1")
def applications_per_knowledge(s: SparkSession, d: str) -> DataFrame:
    return reports.applications_per_knowledge(table(s, d, "knowledge"), _links(s, d))


@query(f"with {_LINKS_SQL} select id, name from knowledge where user_id = (select min(user_id) from knowledge) union select k.id, k.name from knowledge k where k.id in (select knowledge_id from links where application_id = (select min(application_id) from links))")
def own_and_shared(s: SparkSession, d: str) -> DataFrame:
    k, links = table(s, d, "knowledge"), _links(s, d)
    user, app = k.agg(F.min("user_id")).first()[0], links.agg(F.min("application_id")).first()[0]
    return reports.own_and_shared(k.select("id", "name", "user_id"), links.where(F.col("application_id") == app).select(F.col("knowledge_id").alias("id")), user).select("id", "name")


@query(_with("application_chat_record") + "select chat_id, max(create_time) as last_time from rec group by 1")
def chat_last_activity(s: SparkSession, d: str) -> DataFrame:
    return reports.last_activity(_recs(s, d))


@query(_with("application_chat_record") + "select id, coalesce(message_tokens, 0)::bigint + 7 as message_tokens, coalesce(answer_tokens, 0)::bigint as answer_tokens from rec")
def runtime_token_sums(s: SparkSession, d: str) -> DataFrame:
    """Tokens summed over the nodes of run details, here of two nodes."""
    node = lambda m, a: F.struct(m.cast("long").alias("message_tokens"), a.cast("long").alias("answer_tokens"))
    details = F.to_json(F.create_map(F.lit("n1"), node(F.col("message_tokens"), F.col("answer_tokens")), F.lit("n2"), node(F.lit(7), F.lit(None))))
    return _recs(s, d).select("id", reports.tokens_of_details(details).alias("t")).select("id", "t.*")


@query(_with("application_chat_record") + """, w as (select *, case when row_number() over w = 1 or vote_status is distinct from lag(vote_status) over w then 1 else 0 end as b from rec window w as (partition by chat_id order by create_time, id)),
    g as (select *, sum(b) over (partition by chat_id order by create_time, id)::int as run from w) select chat_id, run, vote_status, string_agg(coalesce(message, ''), '|' order by create_time, id) as message, count(*) as n_parts from g group by 1, 2, 3""")
def answer_runs(s: SparkSession, d: str) -> DataFrame:
    """Records of one vote state in a row are one."""
    return relational.runs(_recs(s, d), "chat_id", ["create_time", "id"], "vote_status", "message", "|")


@query(_GRANTS_SQL + """, one as (select * from grants where target in (select min(target) from grants group by user_id)) select u.id, coalesce(case when auth_type = 'ROLE' and list_contains(permission_list, 'ROLE') then 'ROLE' when auth_type = 'RESOURCE_PERMISSION_GROUP' and list_contains(permission_list, 'MANAGE') then 'MANAGE'
    when auth_type = 'RESOURCE_PERMISSION_GROUP' and list_contains(permission_list, 'VIEW') then 'VIEW' end, 'NOT_AUTH') as permission from (select distinct user_id as id from knowledge where user_id is not null) u left join one on one.user_id = u.id""")
def user_permission_detail(s: SparkSession, d: str) -> DataFrame:
    g = _grants(s, d)
    one = g.join(g.groupBy("user_id").agg(F.min("target").alias("target")).select("target"), "target", "left_semi")
    users = table(s, d, "knowledge").where("user_id is not null").select(F.col("user_id").alias("id")).distinct()
    return reports.user_permissions(users, one)


@query(_GRANTS_SQL + _with("document").replace("with ", ", ", 1) + """, r as (select id, name, 'KNOWLEDGE' as auth_target_type, user_id, workspace_id, knowledge_type::varchar as icon, folder_id from knowledge union select id, name, 'APPLICATION', null, knowledge_id, doc_type::varchar, 'default' from doc
    union select n_nationkey::varchar, n_name, 'TOOL', null, 'default', null, 'default' from nation union select r_regionkey::varchar, r_name, 'MODEL', null, 'default', 'local', 'default' from region)
    select r.*, array_to_string(coalesce(g.permission_list, []), ',') as permissions, coalesce(g.auth_type, 'ROLE') as auth_type from r left join grants g on g.target = r.id""")
def all_resource_permissions(s: SparkSession, d: str) -> DataFrame:
    """Resources of four kinds; documents, nations and regions stand for applications, tools and models."""
    of = lambda t, i, n, user, ws, icon, folder: t.select(F.col(i).cast("string").alias("id"), F.col(n).alias("name"), user.alias("user_id"), ws.alias("workspace_id"), icon.alias("icon"), folder.alias("folder_id"))
    none, default = F.lit(None).cast("string"), F.lit("default")
    k = of(table(s, d, "knowledge"), "id", "name", F.col("user_id"), F.col("workspace_id"), F.col("knowledge_type"), F.col("folder_id"))
    a = of(_docs(s, d), "id", "name", none, F.col("knowledge_id"), F.col("doc_type"), default)
    t = of(table(s, d, "nation"), "n_nationkey", "n_name", none, default, none, default)
    m = of(table(s, d, "region"), "r_regionkey", "r_name", none, default, F.lit("local"), default)
    out = reports.all_resource_permissions(_grants(s, d), KNOWLEDGE=k, APPLICATION=a, TOOL=t, MODEL=m)
    return out.withColumn("permissions", F.array_join("permission_list", ",")).drop("permission_list")


@query("select r_name, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey = r_regionkey) as members from region")
def grouped_into_map(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = relational.grouped_map(rows, "r_name", "n_name")
    return groups.select(F.explode("groups").alias("r_name", "v")).select("r_name", F.array_join("v", ",").alias("members"))


@query(_with("document", "paragraph") + """, top as (select document_id, max(sort_position) as m from par group by 1) select p.id || '-new' as id, p.document_id, (coalesce(top.m, 0) + row_number() over (partition by p.document_id order by p.id))::int as sort_position from par p left join top using (document_id) where p.hit_num > 5""")
def appended_positions(s: SparkSession, d: str) -> DataFrame:
    """Copies of paragraphs with many hits go to the end of their documents."""
    new = _pars(s, d).where("hit_num > 5").select(F.concat("id", F.lit("-new")).alias("id"), "document_id")
    return relational.appended_positions(_pars(s, d).select("document_id", "sort_position"), new, "document_id", "sort_position", ["id"]).withColumn("sort_position", F.col("sort_position").cast("int")).select("id", "document_id", "sort_position")


# --- text ---


@query("select doc_id, replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '') as normal from documents")
def normalized_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.normalize("text").alias("normal"))


@query("select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\\s\\v\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+', '', 'g')) > 0), chr(10)) as kept from documents where text is not null")
def blank_lines_dropped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.drop_blank_lines("text").alias("kept"))


@query("select doc_id, array_to_string(regexp_extract_all('![a](/oss/image/' || doc_id || ') ' || coalesce(text, '') || ' ![b](x.png)', '!\\[.*?\\]\\(.*?\\)'), ' ') as links, doc_id::varchar as file_id from documents")
def image_links(s: SparkSession, d: str) -> DataFrame:
    """Image links of texts, each of which gets two."""
    with_links = F.concat(F.lit("![a](/oss/image/"), F.col("doc_id").cast("string"), F.lit(") "), F.coalesce("text", F.lit("")), F.lit(" ![b](x.png)"))
    return table(s, d, "documents").select("doc_id", F.array_join(text.image_links(with_links), " ").alias("links"), F.array_join(text.stored_file_ids(with_links), ",").alias("file_id"))


@query(_with("application_chat_record") + "select id, coalesce(message, '') as reasoning, coalesce(answer_text, '') as answer, coalesce(nullif(message, ''), '<data></data>') as tagged from rec")
def reasoning_split(s: SparkSession, d: str) -> DataFrame:
    """Answers after their reasoning, and what a tag holds."""
    rows = _recs(s, d).select("id", F.coalesce("message", F.lit("")).alias("m"), F.coalesce("answer_text", F.lit("")).alias("a"))
    parts = text.split_reasoning(F.concat(F.lit("<think>"), "m", F.lit("</think>"), "a"))
    return rows.select("id", parts["reasoning"].alias("reasoning"), parts["answer"].alias("answer"), text.data_tag(F.concat(F.lit("<data>"), "m", F.lit("</data>"))).alias("tagged"))


@query("select id, case length(name) % 4 when 0 then name when 1 then name when 2 then name else '第' || name end as title from knowledge")
def chapter_titles(s: SparkSession, d: str) -> DataFrame:
    kind = F.length("name") % 4
    marked = F.when(kind == 0, F.concat(F.lit("第一章 "), "name")).when(kind == 1, F.concat(F.lit("二、"), "name")).when(kind == 2, F.concat(F.lit("（三）"), "name")).otherwise(F.concat(F.lit("第"), "name"))
    return table(s, d, "knowledge").select("id", text.chapter_title(marked).alias("title"))


@query("select unnest(['#', '##', '###', '####', '#####', '######', '-', 'space', 'semicolon', 'comma', 'period', 'enter', 'blank line']) as name")
def split_pattern_catalogue(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(list(text.SPLIT_PATTERNS.items()), "name string, pattern string").select("name")


@query()
def period_pieces(s: SparkSession, d: str) -> DataFrame:
    """Texts cut at full stops within 500 characters."""
    pieces = F.udf(lambda t: cut_at_periods(t, 500), "array<string>", useArrow=True)
    return table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(pieces("text")).alias("piece_no", "text"))


@query("select doc_id, substring(text, 1, 255) as title, substring(text, 1, 1024) as abstract, substring(text, 1, 10240) as question, substring(text, 1, 40960) as answer, substring(text, 1, 102400) as content from documents")
def capped_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", *[documents.capped("text", k).alias(k) for k in ("title", "abstract", "question", "answer", "content")])


@query(_with("document") + "select id, json_extract_string(m, '$.state') as state, json_extract_string(m, '$.n') as n, json_extract_string(m, '$.source_url') as source_url, null::varchar as gone from (select id, json_merge_patch(coalesce(meta, '{}'), json_object('state', status, 'n', length(name))) as m from doc)")
def json_keys_set(s: SparkSession, d: str) -> DataFrame:
    """Two keys set, one of them deleted again from a copy."""
    changed = documents.json_set("meta", state=F.to_json(F.struct(F.col("status").alias("s"))), n=F.length("name").cast("string"))
    rows = _docs(s, d).select("id", changed.alias("m"))
    return rows.select("id", F.get_json_object("m", "$.state.s").alias("state"), F.get_json_object("m", "$.n").alias("n"), F.get_json_object("m", "$.source_url").alias("source_url"), F.get_json_object(documents.json_without("m", "n", "state"), "$.n").alias("gone"))


@query()
def split_in_sql(s: SparkSession, d: str) -> DataFrame:
    """The table function and a tool under their SQL names."""
    registered.register(s, {"shouted": (lambda t: t.str.upper(), "string")})
    table(s, d, "documents").createOrReplaceTempView("documents_to_split")
    return s.sql("select d.doc_id, p.ordinal, shouted(p.title) as title, p.content from documents_to_split d, lateral split_text(d.text) p")


# --- maintenance ---

_FAILED_SQL = "f as (select document_id, bool_or(substring(reverse(coalesce(status, '')), 1, 1) = '3') as failed from par group by 1), d as (select *, case when length(coalesce(status, '')) < 3 then lpad(coalesce(status, ''), 3, 'n') else status end as st from doc)"


@query(_with("document", "paragraph", more=", " + _FAILED_SQL) + "select d.id, substring(st, 1, length(st) - 1) || case when right(st, 1) = '4' then '5' when coalesce(f.failed, false) then '3' else '2' end as status from d left join f on f.document_id = d.id")
def task_finalised(s: SparkSession, d: str) -> DataFrame:
    """The embedding task's last state of each document, by its paragraphs' states."""
    failed = _pars(s, d).groupBy("document_id").agg(F.max(status.state("status", status.EMBEDDING) == status.FAILURE).alias("failed"))
    rows = _docs(s, d).join(failed.withColumnRenamed("document_id", "id"), "id", "left")
    return rows.select("id", status.finalized("status", status.EMBEDDING, F.coalesce("failed", F.lit(False))).alias("status"))


@query(_with("paragraph") + "select id, translate(case when length(coalesce(status, '')) < 3 then lpad(coalesce(status, ''), 3, 'n') else status end, '014', '333') as status from par")
def status_finalised(s: SparkSession, d: str) -> DataFrame:
    return _pars(s, d).select("id", status.recovered("status").alias("status"))


@query(_with("application_chat_record") + "select id, case when vote_status = '-1' and record_index % 3 in (0, 1) then (record_index % 3)::varchar when vote_status <> '-1' and record_index % 3 = 2 then '-1' else vote_status end as vote_status from rec")
def votes_applied(s: SparkSession, d: str) -> DataFrame:
    """A wish by the record's number: up, down or withdrawn."""
    wish = F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("-1")), (F.col("record_index") % 3 + 1).cast("int"))
    return _recs(s, d).select("id", maintain.voted(F.col("vote_status"), wish).alias("vote_status"))


@query(ORACLES.get("votes_applied") or _with("application_chat_record") + "select id, case when vote_status = '-1' and record_index % 3 in (0, 1) then (record_index % 3)::varchar when vote_status <> '-1' and record_index % 3 = 2 then '-1' else vote_status end as vote_status from rec")
def stream_votes(s: SparkSession, d: str) -> DataFrame:
    """The same as a stream of two events a record: its state so far, then the wish."""
    recs = _recs(s, d)
    wish = F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("-1")), (F.col("record_index") % 3 + 1).cast("int"))
    events = recs.select(F.col("id").alias("record_id"), F.explode(F.array(F.struct(F.col("vote_status").alias("wish"), F.lit(0).alias("at")), F.struct(wish.alias("wish"), F.lit(1).alias("at")))).alias("e")).select("record_id", "e.*")
    folder = f"{scratch_dir(s)}/votes-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{folder}/out")

    stream = streams.votes(streams.read_tables(s, f"{folder}/in", 1000))
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").groupBy(F.col("record_id").alias("id")).agg(F.max_by("vote_status", "n").alias("vote_status"))


@query(_with("paragraph", "application_chat_record") + """, a as (select r.id, d.document_id, row_number() over (partition by d.document_id order by r.message, r.answer_text) - 1 as p from rec r join (select record_index % 2 as k, id from rec) x using (id) join (select 0 as k, min(document_id) as document_id from par union all select 1, max(document_id) from par) d on d.k = x.k where r.vote_status = '1'),
    n as (select document_id, count(*) as n from a group by 1) select 'new-' || id as id, document_id, p::int as sort_position from a union all select par.id, par.document_id, (par.sort_position + coalesce(n.n, 0))::int from par left join n using (document_id)""")
def improved_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Answers voted down become first paragraphs of one of two documents."""
    pars = _pars(s, d)
    lo, hi = pars.agg(F.min("document_id"), F.max("document_id")).first()
    answers = _recs(s, d).where("vote_status = '1'").select(F.when(F.col("record_index") % 2 == 0, lo).otherwise(hi).alias("document_id"), F.lit(None).cast("string").alias("knowledge_id"), F.col("message").alias("title"), F.col("answer_text").alias("content"), "id")
    return maintain.improved(pars, answers, F.concat(F.lit("new-"), F.col("id"))).select("id", "document_id", "sort_position")


@query(_with("document") + """, f as (select id, create_time, ['TEMPORARY_30_MINUTE', 'TEMPORARY_120_MINUTE', 'TEMPORARY_1_DAY', 'DOCUMENT'][length(name) % 4 + 1] as source_type from doc), now as (select max(create_time) as t from f)
    select id from f, now where source_type = 'DOCUMENT' or create_time >= t - case source_type when 'TEMPORARY_30_MINUTE' then interval 30 minute when 'TEMPORARY_120_MINUTE' then interval 120 minute else interval 1440 minute end""")
def live_files(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("TEMPORARY_30_MINUTE", "TEMPORARY_120_MINUTE", "TEMPORARY_1_DAY", "DOCUMENT")])
    rows = _docs(s, d).select("id", "create_time", F.element_at(kinds, (F.length("name") % 4 + 1).cast("int")).alias("source_type"))
    return maintain.live_files(rows, F.lit(rows.agg(F.max("create_time")).first()[0])).select("id")


@query(_with("application_chat_record", "application_chat") + """, lim as (select application_id, 30 + length(application_id) % 7 as days from chat group by 1), now as (select max(create_time) as t from rec), gone as (select r.id from rec r join chat c on c.id = r.chat_id join lim using (application_id), now where r.create_time < now.t - to_days(lim.days::int))
    select id from chat where id not in (select chat_id from rec where chat_id is not null) or id in (select chat_id from rec where id not in (select id from gone) and chat_id is not null)""")
def retained_chats(s: SparkSession, d: str) -> DataFrame:
    chats, recs = _chats(s, d), _recs(s, d)
    keep = chats.select("application_id", (F.lit(30) + F.length("application_id") % 7).alias("clean_time")).distinct()
    return maintain.retained(recs, chats, keep, F.lit(recs.agg(F.max("create_time")).first()[0]))[1].select("id")


@query(_with("paragraph", "document") + ", gone as (select id from doc where doc_type = 1) select id from par where document_id is null or document_id not in (select id from gone)")
def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs that stay when web documents go."""
    return relational.without(_pars(s, d), _docs(s, d).where("doc_type = 1").select(F.col("id").alias("document_id")), "document_id").select("id")


@query(_with("document", "paragraph") + """, kb as (select min(id) as target from knowledge), mv as (select id as document_id from doc where doc_type = 1) select p.id, case when mv.document_id is not null then kb.target else p.knowledge_id end as knowledge_id, mv.document_id is not null and length(p.document_id) % 2 = 1 as re_embed from par p left join mv using (document_id), kb""")
def migrated_paragraphs(s: SparkSession, d: str) -> DataFrame:
    target = table(s, d, "knowledge").agg(F.min("id")).first()[0]
    moves = _docs(s, d).where("doc_type = 1").select(F.col("id").alias("document_id"), F.lit(target).alias("target_id"), (F.length("id") % 2 == 0).alias("same_model"))
    return maintain.migrated(_pars(s, d), moves).select("id", "knowledge_id", "re_embed")


@query(_with("document") + """, w as (select id, json_extract_string(meta, '$.source_url') as source_url from doc where doc_type = 1), f as (select 'new-' || min(id) as id, source_url from w where length(source_url) % 3 = 0 group by source_url union all select 'add-' || id, source_url || '#new' from w where length(source_url) % 3 = 1)
    select id, source_url from w where source_url not in (select source_url from f) union all select * from f""")
def web_sync_replace(s: SparkSession, d: str) -> DataFrame:
    return maintain.synced(*_web(s, d), replace=True).select("id", "source_url")


@query(_with("document") + """, w as (select id, json_extract_string(meta, '$.source_url') as source_url from doc where doc_type = 1), f as (select 'new-' || min(id) as id, source_url from w where length(source_url) % 3 = 0 group by source_url union all select 'add-' || id, source_url || '#new' from w where length(source_url) % 3 = 1)
    select id, source_url from w union all select * from f where source_url not in (select source_url from w)""")
def web_sync_add(s: SparkSession, d: str) -> DataFrame:
    return maintain.synced(*_web(s, d), replace=False).select("id", "source_url")


def _web(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = _docs(s, d).where("doc_type = 1").select("id", F.get_json_object("meta", "$.source_url").alias("source_url"))
    again = w.where(F.length("source_url") % 3 == 0).groupBy("source_url").agg(F.concat(F.lit("new-"), F.min("id")).alias("id"))
    new = w.where(F.length("source_url") % 3 == 1).select(F.concat(F.lit("add-"), "id").alias("id"), F.concat("source_url", F.lit("#new")).alias("source_url"))
    return w, again.unionByName(new)


@query(_with("paragraph") + "select id as paragraph_id, substring(x, 1, 255) as problem from (select id, unnest(string_split(content, chr(10))) as x from par) where length(trim(x, ' ')) > 0")
def generated_problems(s: SparkSession, d: str) -> DataFrame:
    """Lines of contents as a model's answers."""
    return maintain.generated_problems(_pars(s, d), "content")


@query("select md5(v) as digest, count(*) as n from (select distinct text as v from documents where text is not null) group by 1")
def stored_once(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return maintain.stored_once(rows).groupBy(F.md5("content").alias("digest")).agg(F.count("*").alias("n"))


@query("select id, 0 as intraday_access_num from application_chat group by id")
def quota_reset(s: SparkSession, d: str) -> DataFrame:
    return maintain.reset_daily(_chats(s, d).select("id", F.col("star_num").alias("intraday_access_num")))


@query("select doc_id, substring(hex(text), 3, 8) as part from documents where text is not null")
def byte_ranges(s: SparkSession, d: str) -> DataFrame:
    """The second to fifth byte of texts."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.hex(sinks.byte_range(F.col("text").cast("binary"), 1, 4)).alias("part"))


# --- sources ---


def _csv(rows: DataFrame, key: str, header: str, line, order: str) -> DataFrame:
    """A CSV file in memory for each key."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(key).agg(body.alias("b")).select(F.concat(key, F.lit(".csv")).alias("path"), F.concat(F.lit(header + "\n"), "b").cast("binary").alias("content"))


@query("select r_name || '.csv' as path, (row_number() over (partition by r_name order by n_name) - 1)::int as ordinal, 'key:' || n_nationkey || '; name:' || n_name as content from nation join region on n_regionkey = r_regionkey")
def table_import(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return files.table_rows_of(_csv(rows, "r_name", "key,name", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name"), "n_name"))


@query("select c_mktsegment || '.csv' as path, (row_number() over (partition by c_mktsegment order by c_name) - 1)::int as ordinal, 'T' || c_name as title, 'C ' || c_custkey as content, 'q' || c_custkey || '|what?' as problems from customer")
def qa_import(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("T"), "c_name", F.lit(",C "), F.col("c_custkey").cast("string"), F.lit(',"q'), F.col("c_custkey").cast("string"), F.lit('\n\nwhat?"'))
    got = files.qa_of(_csv(table(s, d, "customer"), "c_mktsegment", "title,content,problem_list", line, "c_name"))
    return got.select("path", "ordinal", "title", "content", F.array_join("problems", "|").alias("problems"))


@query("""with f as (select r_name || '.csv' as path, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' order by n_name) as content from nation join region on n_regionkey = r_regionkey group by r_name)
    select path, path as name, 0 as ordinal, '' as title, content, null::varchar as error from f""")
def csv_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return files.paragraphs_of(_csv(rows, "r_name", "key,name", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name"), "n_name"))


@query("""select r_name || case r_regionkey % 3 when 0 then '.md' when 1 then '.txt' else '.html' end as path, (row_number() over (partition by r_name order by n_name) - 1)::int as ordinal, ' ' || n_name as title, 'Nation ' || n_nationkey || '.' as content from nation join region on n_regionkey = r_regionkey""")
def text_import(s: SparkSession, d: str) -> DataFrame:
    """A Markdown, text or HTML file for each region, with a heading and a paragraph for each nation."""
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("r_regionkey") % 3
    number = F.col("n_nationkey").cast("string")
    part = F.when(kind == 2, F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>Nation "), number, F.lit(".</p>"))).otherwise(F.concat(F.lit("# "), "n_name", F.lit("\nNation "), number, F.lit(".\n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", part.alias("p")))), lambda x: x["p"]), "")
    made = rows.groupBy("r_name", "r_regionkey").agg(body.alias("b")).select(F.concat("r_name", F.when(kind == 0, ".md").when(kind == 1, ".txt").otherwise(".html")).alias("path"), F.col("b").cast("binary").alias("content"))
    return files.paragraphs_of(made).select("path", "ordinal", "title", text.strip("content").alias("content"))


@query("select n_name as archive, n_name || '.txt' as name, 'Nation ' || n_nationkey as content from nation union all select n_name, 'broken.docx', null from nation")
def archive_import(s: SparkSession, d: str) -> DataFrame:
    """Archives of a text and a broken file: packed by the sink, read by the source; what is broken gives an error."""
    n = table(s, d, "nation")
    one = n.select(F.col("n_name").alias("document_id"), F.concat("n_name", F.lit(".txt")).alias("name"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).cast("binary").alias("content"))
    bad = n.select(F.col("n_name").alias("document_id"), F.lit("broken.docx").alias("name"), F.lit("x").cast("binary").alias("content"))
    packed = sinks.packed_exports(one.unionByName(bad)).select(F.concat("document_id", F.lit(".zip")).alias("path"), F.col("archive").alias("content"))
    return files.paragraphs_of(packed).select(F.regexp_replace("path", r"\.zip$", "").alias("archive"), "name", "content")


@query("select md5(text) as digest, min(doc_id) as doc_id, min(strlen(text)) as n_bytes from documents where text is not null group by text")
def file_store(s: SparkSession, d: str) -> DataFrame:
    """Contents stored once, as ZIP, and read again."""
    rows = table(s, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("text").cast("binary").alias("content"))
    stored = maintain.stored_once(rows).select("doc_id", sinks.compressed("content").alias("stored"))
    return stored.select("doc_id", sinks.uncompressed("stored").alias("c")).select(F.md5("c").alias("digest"), "doc_id", F.length("c").cast("long").alias("n_bytes"))


@query("select r_name as book, n_name as sheet, (row_number() over (partition by n_name order by s_name))::int as row_no, s_name as title, chr(10) || '<' || s_suppkey || ' & co>' as content from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def workbook_export(s: SparkSession, d: str) -> DataFrame:
    """A workbook for each region with a sheet for each nation: written, and read by the source."""
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    content = F.concat(F.lit("\n<"), F.col("s_suppkey").cast("string"), F.lit(" & co>"))
    books = sinks.workbooks(rows.select(F.col("r_name").alias("book"), F.col("n_name").alias("sheet"), F.col("s_name").alias("place"), F.col("s_name").alias("title"), content.alias("content")), "book", ["title", "content"])

    def read(frames):
        for f in frames:
            out = [(b, name, i, *r) for b, raw in f.itertuples(index=False) for name, lines, _ in files.sheets(bytes(raw)) for i, r in enumerate(lines) if i]
            yield pd.DataFrame(out, columns=["book", "sheet", "row_no", "title", "content"])

    return books.mapInPandas(read, "book string, sheet string, row_no int, title string, content string")


@query("select n_name, '# ' || n_name || chr(10) || chr(10) || 'Nation **' || n_nationkey || '**' as content, 'https://h.example/a/n' || n_nationkey as links from nation")
def web_parse(s: SparkSession, d: str) -> DataFrame:
    """Pages of which a selector keeps the main part; links count below the page's address."""
    number = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit('<nav><a href="/b">menu</a></nav><div class="main"><h1>'), "n_name", F.lit("</h1><p>Nation <b>"), number, F.lit('</b></p></div><script>x</script>'))
    pages = table(s, d, "nation").select(F.concat(F.lit("https://h.example/a#"), "n_name").alias("url"), html.alias("html"))
    got = web.parse_pages(pages, [".main"]).select(F.regexp_extract("url", "#(.*)$", 1).alias("n_name"), "content")
    linked = table(s, d, "nation").select(F.lit("https://h.example/a").alias("url"), F.concat(F.lit('<div class="main"><a href="/a/n'), number, F.lit('#x">l</a><a href="/b/n">o</a><a href="mailto:x">m</a></div>')).alias("html"), "n_name")
    links = web.parse_pages(linked.select(F.concat("url", F.lit("#"), "n_name").alias("url"), "html"), [".main"]).select(F.regexp_extract("url", "#(.*)$", 1).alias("n_name"), F.array_join("links", " ").alias("links"))
    return got.join(links, "n_name")


@query("""select 'https://h.example/a' as url, 0 as level union all select 'https://h.example/a/r' || r_regionkey, 1 from region union all select 'https://h.example/a/r' || n_regionkey || '/n' || n_nationkey, 2 from nation""")
def web_crawl(s: SparkSession, d: str) -> DataFrame:
    """A site of a root, pages of regions and, below them, of nations, each of which links back and to one more level."""
    region, nation = table(s, d, "region"), table(s, d, "nation")
    link = lambda *to: F.concat(F.lit('<a href="'), *to, F.lit('">x</a>'))
    r, n = F.concat(F.lit("/a/r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("/a/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    host = F.lit("https://h.example")
    root = region.agg(F.array_join(F.collect_list(link(r, F.lit("/"))), "").alias("html")).select(F.concat(host, F.lit("/a")).alias("url"), "html")
    mid = nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(link(n, F.lit("#top"))), "").alias("html")).select(F.concat(host, F.lit("/a/r"), F.col("n_regionkey").cast("string")).alias("url"), "html")
    leaf = nation.select(F.concat(host, n).alias("url"), F.concat(link(F.lit("/a")), link(n, F.lit("/deeper"))).alias("html"))
    below = nation.select(F.concat(host, n, F.lit("/deeper")).alias("url"), F.lit("").alias("html"))
    start = s.createDataFrame([("https://h.example/a/",)], "url string")
    return web.crawl(root.unionByName(mid).unionByName(leaf).unionByName(below), start, 2).select("url", "level")


# --- messages and batches ---


@query(_with("application_chat_record") + "select id, 'data: ' || m || chr(10) || chr(10) as event, json_extract_string(m, '$.chat_id') as chat_id, coalesce(message_tokens, 0) + coalesce(answer_tokens, 0) as total_tokens from (select *, '{\"chat_id\":\"' || chat_id || '\",\"chat_record_id\":\"' || id || '\",\"operate\":true,\"content\":\"x\",\"is_end\":true}' as m from rec)")
def answer_messages(s: SparkSession, d: str) -> DataFrame:
    """Server-sent events and completions of chat records."""
    event = sinks.stream_message(F.col("chat_id"), F.col("id"), F.lit("x"), F.lit(True))
    done = sinks.completion_message(F.col("id"), F.col("answer_text"), F.coalesce("message_tokens", F.lit(0)), F.coalesce("answer_tokens", F.lit(0)))
    return _recs(s, d).select("id", event.alias("event"), F.get_json_object(F.regexp_replace(event, "^data: ", ""), "$.chat_id").alias("chat_id"), F.get_json_object(done, "$.usage.total_tokens").cast("int").alias("total_tokens"))


@query("select doc_id, coalesce(length(text), -1) as first, text is null as empty from documents")
def embedded_batches(s: SparkSession, d: str) -> DataFrame:
    """Texts with vectors of a model that takes lists of ten; here one of lengths."""
    got = sinks.embed_batches(table(s, d, "documents").select("doc_id", "text"), lambda texts: [[float(len(t)), 1.0] for t in texts])
    return got.select("doc_id", F.coalesce(F.col("embedding")[0].cast("long"), F.lit(-1)).alias("first"), F.col("embedding").isNull().alias("empty"))


@query(_with("application_chat_record") + " select distinct unnest(improve_paragraph_id_list) as paragraph_id from rec")
def shown_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs that earlier answers to a question showed; here all records ask the same, and show what they improve."""
    shown = F.to_json(F.struct(F.struct(F.transform("improve_paragraph_id_list", lambda i: F.struct(i.alias("id"))).alias("paragraph_list")).alias("search_step")))
    return search.shown_before(_recs(s, d).select(F.lit("same").alias("message"), shown.alias("details")), "same")


@query("select doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (('0x' || substring(h, 17, 1))::int % 4 + 1)::int, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as id from (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) as h from documents where text is not null)")
def name_based_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.uuid5("text").alias("id"))


# --- dataflows ---


@query(_HITS_SQL + """, b as (select knowledge_id, content, score, row_number() over (partition by knowledge_id order by score desc, paragraph_id) as r from hits) select knowledge_id, case when score > 0.98 then 'direct' else 'context' end as way, case when score > 0.98 then content else 'CTX ' || content end as answer from b where r = 1""")
def flow_rerank(s: SparkSession, d: str) -> DataFrame:
    """A reranker node over each knowledge base's paragraphs, a condition on its result's score, and replies."""
    docs = _hits(s, d).groupBy("knowledge_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "title", "content"))).alias("src__list"))
    score = lambda q, c: F.round(F.length(c) % 97 / F.lit(97.0), 4)
    branches = [{"id": "direct", "conditions": [{"field": ["top", "score"], "compare": "gt", "value": "0.98"}]}, {"id": "context", "conditions": []}]
    nodes = [Node("start", "start-node", {"question": "question"}), Node("rr", "reranker-node", {"key": "knowledge_id", "references": [["src", "list"]], "question": ["start", "question"], "scorer": score, "top_n": 1, "max_paragraph_char": 1_000_000})]
    nodes += [Node("top", "tool-node", {"inputs": {"x": {"source": "reference", "reference": ["rr", "result"], "as": "string"}}, "function": lambda x: F.length(x)}), Node("c", "condition-node", {"branch": branches}), Node("a", "reply-node", {"source": "reference", "reference": ["rr", "result"]}), Node("b", "reply-node", {"value": "CTX {{rr.result}}"})]
    edges = [Edge("start", "rr"), Edge("rr", "top"), Edge("top", "c"), Edge("c", "a", "c_direct_right"), Edge("c", "b", "c_context_right")]
    kinds = {"tool-node": lambda df, node: df.withColumn("top__score", F.element_at("rr__result_list", 1)["score"])}
    out = Flow(nodes, edges).run(docs.withColumn("question", F.lit("q")), kinds)
    return out.select("knowledge_id", F.col("c__branch_id").alias("way"), F.coalesce("a__answer", "b__answer").alias("answer"))


@query(_with("application_chat_record") + "select id, case when record_index % 2 = 0 then 'got ' || record_index else null end as answer, record_index % 2 = 0 as is_submit from rec")
def flow_form(s: SparkSession, d: str) -> DataFrame:
    """A form that half of the requests have sent in; the others wait before the reply."""
    data = F.when(F.col("record_index") % 2 == 0, F.to_json(F.struct(F.col("record_index").alias("n"))))
    nodes = [Node("start", "start-node", {"question": "message"}), Node("f", "form-node", {"data": "sent", "fields": ["n"]}), Node("r", "reply-node", {"value": "got {{f.n}}"})]
    out = Flow(nodes, [Edge("start", "f"), Edge("f", "r")]).run(_recs(s, d).select("id", "message", data.alias("sent")))
    return out.select("id", F.col("r__answer").alias("answer"), F.col("f__is_submit").alias("is_submit"))


@query(_with("application_chat_record") + "select id, 'inner: ' || coalesce(message, '') as answer, try_cast(message as double) is null as no_number from rec")
def flow_application(s: SparkSession, d: str) -> DataFrame:
    """A flow within a flow, and a tool with an input that is coerced to a number."""
    inner = Flow([Node("s", "start-node"), Node("r", "reply-node", {"value": "inner: {{s.question}}"})], [Edge("s", "r")])
    nodes = [Node("start", "start-node", {"question": "message"}), Node("app", "application-node", {"key": "id", "flow": inner, "question": ["start", "question"], "answers": [["r", "answer"]]})]
    nodes += [Node("t", "tool-node", {"inputs": {"x": {"source": "reference", "reference": ["start", "question"], "as": "float"}}, "function": lambda x: x.isNull()})]
    out = Flow(nodes, [Edge("start", "app"), Edge("app", "t")]).run(_recs(s, d).select("id", "message"))
    return out.select("id", F.col("app__answer").alias("answer"), F.col("t__result").alias("no_number"))


@query("select n_name, '### ' || n_name || '.txt' || chr(10) || 'Nation ' || n_nationkey || chr(10) || '`-----------------------------------`' || chr(10) || '### b.csv' || chr(10) || '| k |' || chr(10) || '| --- |' || chr(10) || '| 1 |' || chr(10) as content from nation")
def flow_extract(s: SparkSession, d: str) -> DataFrame:
    """Texts of two files a request."""
    made = F.array(
        F.struct(F.concat("n_name", F.lit(".txt")).alias("name"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).cast("binary").alias("content")),
        F.struct(F.lit("b.csv").alias("name"), F.lit("k\n1\n").cast("binary").alias("content")),
        F.struct(F.lit("broken.docx").alias("name"), F.lit("x").cast("binary").alias("content")),
    )
    rows = table(s, d, "nation").select("n_name", F.col("n_name").alias("question"), made.alias("up__files"))
    nodes = [Node("start", "start-node"), Node("x", "document-extract-node", {"files": ["up", "files"]}), Node("r", "reply-node", {"source": "reference", "reference": ["x", "content"]})]
    return Flow(nodes, [Edge("start", "x"), Edge("x", "r")]).run(rows).select("n_name", F.col("r__answer").alias("content"))


@query()
def flow_search(s: SparkSession, d: str) -> DataFrame:
    """Retrieval for all chat records that ask something: contexts of their three best paragraphs by the hashing embedder."""
    embed = search.hashing_embedder(32)
    pars = _pars(s, d).where(F.length("content") > 0).select(F.col("id").alias("paragraph_id"), "title", "content")
    rows = pars.select(F.col("paragraph_id").alias("id"), "paragraph_id", embed(F.concat_ws(" ", "title", "content")).alias("embedding"))
    nodes = [Node("start", "start-node", {"question": "message"}), Node("k", "search-knowledge-node", {"key": "id", "rows": rows, "paragraphs": pars, "embed": embed, "question": ["start", "question"], "similarity": 0.3, "top_n": 3}), Node("r", "reply-node", {"source": "reference", "reference": ["k", "data"]})]
    out = Flow(nodes, [Edge("start", "k"), Edge("k", "r")]).run(_recs(s, d).where(F.length("message") > 0).select("id", "message"))
    return out.select("id", F.size("k__paragraph_list").alias("n_hits"), F.col("r__answer").alias("context"))
