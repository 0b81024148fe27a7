"""Reports of a retrieval service: trends, counters, listings, roll-ups, permissions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import formula_safe


def daily_trend(records: DataFrame, chats: DataFrame) -> DataFrame:
    """Per day: votes up ('0') and down ('1'), tokens, records and distinct users."""
    users = chats.select(F.col("id").alias("chat_id"), "chat_user_id")
    joined = records.select("id", "chat_id", "vote_status", "message_tokens", "answer_tokens", F.to_date("create_time").alias("day")).join(users, "chat_id", "left")
    return joined.groupBy("day").agg(
        F.sum(F.when(F.col("vote_status") == "0", 1).otherwise(0)).alias("star_num"),
        F.sum(F.when(F.col("vote_status") == "1", 1).otherwise(0)).alias("trample_num"),
        F.sum(F.col("message_tokens") + F.col("answer_tokens")).alias("tokens_num"),
        F.count("id").alias("chat_record_count"),
        F.countDistinct("chat_user_id").alias("customer_num"),
    )


def new_users(chats: DataFrame) -> DataFrame:
    """Users by the day of their first chat."""
    first = chats.where(F.col("chat_user_id").isNotNull()).groupBy("chat_user_id").agg(F.min("create_time").alias("t"))
    return first.groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("customer_added_count"))


def gap_filled(trend: DataFrame, start: Column, end: Column, counts: list[str], day: str = "day") -> DataFrame:
    """Every day from start to end; days without data have zeros."""
    spark = trend.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias(day))
    return days.join(trend, day, "left").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def chat_counters(records: DataFrame) -> DataFrame:
    """Per chat: records, votes, and marks (paragraphs that answers went into)."""
    return records.groupBy("chat_id").agg(
        F.count("id").alias("chat_record_count"),
        F.sum(F.when(F.col("vote_status") == "0", 1).otherwise(0)).alias("star_num"),
        F.sum(F.when(F.col("vote_status") == "1", 1).otherwise(0)).alias("trample_num"),
        F.sum(F.coalesce(F.array_size("improve_paragraph_id_list"), F.lit(0))).alias("mark_sum"),
    )


def counter_drift(chats: DataFrame, records: DataFrame) -> DataFrame:
    """Chats whose stored counters differ from their records."""
    real = chat_counters(records).withColumnsRenamed({c: f"real_{c}" for c in ("chat_record_count", "star_num", "trample_num", "mark_sum")})
    joined = chats.join(real, chats.id == real.chat_id, "left")
    names = ("chat_record_count", "star_num", "trample_num", "mark_sum")
    differ = [~F.col(n).eqNullSafe(F.coalesce(F.col(f"real_{n}"), F.lit(0)).cast("int")) for n in names]
    return joined.where(differ[0] | differ[1] | differ[2] | differ[3]).select("id", *[F.coalesce(F.col(f"real_{n}"), F.lit(0)).alias(n) for n in names])


def knowledge_listing(knowledge: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases with document counts and sizes, aggregated before the join."""
    totals = documents.groupBy("knowledge_id").agg(F.count("id").alias("document_count"), F.sum("char_length").alias("char_length"))
    out = knowledge.join(totals, knowledge.id == totals.knowledge_id, "left")
    return out.select("id", "name", "workspace_id", "knowledge_type", F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("char_length", F.lit(0)).alias("char_length"))


def status_rollup(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Per document the counts of its paragraphs by status, as a JSON array sorted by status; none: '[]'."""
    counts = paragraphs.groupBy("document_id", "status").agg(F.count("id").alias("count"))
    aggs = counts.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("aggs"))
    return documents.select(F.col("id").alias("document_id")).join(aggs, "document_id", "left").select("document_id", F.coalesce("aggs", F.lit("[]")).alias("aggs"))


def char_lengths(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    sums = paragraphs.groupBy("document_id").agg(F.sum(F.length("content")).alias("n"))
    return documents.select(F.col("id").alias("document_id")).join(sums, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("char_length"))


def effective_permission(resources: DataFrame, grants: DataFrame) -> DataFrame:
    """Resources with the caller's permission: ROLE, MANAGE or VIEW by the kind of grant, NOT_AUTH without one."""
    return resources.join(grants.select("target", _granted().alias("permission")), resources.id == F.col("target"), "left").select(*resources.columns, F.coalesce("permission", F.lit("NOT_AUTH")).alias("permission"))


def visible(resources: DataFrame, grants: DataFrame, role_permissions: DataFrame | None = None, user_roles: DataFrame | None = None, needed: str = "APPLICATION:READ", user_role: str = "USER") -> DataFrame:
    """Resources a grant shows: VIEW in its list, or, for grants by role, a role of the user that has the permission."""
    by_list = grants.where((F.col("auth_type") != "ROLE") & F.array_contains("permission_list", "VIEW")).select("target")
    shown = by_list
    if role_permissions is not None and user_roles is not None:
        held = role_permissions.join(user_roles, "role_id", "right").select("user_id", "workspace_id", F.when(F.col("role_id") == user_role, needed).otherwise(F.col("permission_id")).alias("p")).where(F.col("p") == needed).select("user_id", "workspace_id").distinct()
        by_role = grants.where((F.col("auth_type") == "ROLE") & F.array_contains("permission_list", "ROLE")).join(held, ["user_id", "workspace_id"], "left_semi").select("target")
        shown = shown.unionByName(by_role)
    return resources.join(shown.withColumnRenamed("target", "id"), "id", "left_semi")


def missing_targets(wanted: DataFrame, *resources: tuple[str, DataFrame]) -> DataFrame:
    """Of (target_id, auth_target_type) those that no resource of that type has."""
    known = None
    for kind, df in resources:
        part = df.select(F.col("id").alias("target_id"), F.lit(kind).alias("auth_target_type"))
        known = part if known is None else known.unionByName(part)
    return wanted.join(known, ["target_id", "auth_target_type"], "left_anti")


def chat_export(chats: DataFrame, records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Records of chats with the improved paragraphs resolved; chats without records stay."""
    ids = records.select(F.col("id").alias("record_id"), F.explode("improve_paragraph_id_list").alias("paragraph_id"))
    texts = paragraphs.select(F.col("id").alias("paragraph_id"), "title", "content")
    found = ids.join(texts, "paragraph_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "title", "content"))).alias("improved"))
    full = records.withColumnRenamed("id", "record_id").join(found, "record_id", "left").select("chat_id", "record_id", "record_index", "message", "answer_text", "message_tokens", "answer_tokens", "run_time", "vote_status", "create_time", F.coalesce(F.to_json("improved"), F.lit("[]")).alias("improve_paragraph_list"))
    return chats.select(F.col("id").alias("chat_id"), "abstract").join(full, "chat_id", "left")


def document_export(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Sheet rows: sheet name (repeated names get a number), title, content, problems by line; safe against formulas."""
    sheet = documents.withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy("id")) - 1)
    sheet = sheet.select(F.col("id").alias("document_id"), F.concat(F.col("name"), F.when(F.col("__n") > 0, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise("")).alias("sheet"))
    problems = F.array_join(F.transform("problem_list", lambda p: p["content"]), "\n")
    rows = paragraphs.select("document_id", "sort_position", F.col("id").alias("paragraph_id"), formula_safe("title").alias("title"), formula_safe("content").alias("content"), formula_safe(F.coalesce(problems, F.lit(""))).alias("problems"))
    return rows.join(sheet, "document_id").select("sheet", "sort_position", "paragraph_id", "title", "content", "problems")


def with_owner(resources: DataFrame, users: DataFrame, owner: str = "user_id") -> DataFrame:
    """Resources with the nick name of who owns them (users: id, nick_name); unknown owners have none."""
    return resources.join(users.select(F.col("id").alias(owner), "nick_name"), owner, "left")


def with_chat_user(chats: DataFrame, users: DataFrame, key: str = "chat_user_id") -> DataFrame:
    """Chats with their user's name. users: id of any type, compared as text, and name."""
    names = users.select(F.col("id").cast("string").alias(key), F.col("name").alias("chat_user_name"))
    return chats.join(names, key, "left")


def applications_per_knowledge(knowledge: DataFrame, links: DataFrame) -> DataFrame:
    """id, application_count: distinct applications (links: application_id, knowledge_id) that use each knowledge base."""
    n = links.groupBy("knowledge_id").agg(F.countDistinct("application_id").alias("n"))
    return knowledge.join(n, knowledge.id == n.knowledge_id, "left").select("id", F.coalesce("n", F.lit(0)).alias("application_count"))


def last_activity(records: DataFrame) -> DataFrame:
    """Per chat the time of its last record."""
    return records.groupBy("chat_id").agg(F.max("create_time").alias("last_time"))


def tokens_of_details(details: Column) -> Column:
    """struct(message_tokens, answer_tokens): sums over the nodes of a JSON of run details; no or broken details: 0."""
    nodes = F.map_values(F.from_json(details, "map<string, struct<message_tokens: bigint, answer_tokens: bigint>>"))
    total = lambda f: F.coalesce(F.aggregate(nodes, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x[f], F.lit(0))), F.lit(0))
    return F.struct(total("message_tokens").alias("message_tokens"), total("answer_tokens").alias("answer_tokens"))


def _granted() -> Column:
    has = lambda p: F.array_contains("permission_list", p)
    group = F.col("auth_type") == "RESOURCE_PERMISSION_GROUP"
    return F.when((F.col("auth_type") == "ROLE") & has("ROLE"), "ROLE").when(group & has("MANAGE"), "MANAGE").when(group & has("VIEW"), "VIEW")


def user_permissions(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Users with their permission on one resource (its grants): as effective_permission() gives resources."""
    return users.join(grants.select(F.col("user_id").alias("id"), _granted().alias("permission")), "id", "left").select(*users.columns, F.coalesce("permission", F.lit("NOT_AUTH")).alias("permission"))


def all_resource_permissions(grants: DataFrame, **resources: DataFrame) -> DataFrame:
    """The resources of all kinds (by keyword: id, name, user_id, workspace_id, icon, folder_id) with the list and kind of a
    grant on them; without one, an empty list by role."""
    parts = [df.select("id", "name", F.lit(kind).alias("auth_target_type"), "user_id", "workspace_id", F.col("icon").cast("string").alias("icon"), "folder_id") for kind, df in resources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    g = grants.select(F.col("target").alias("id"), "permission_list", "auth_type")
    return every.distinct().join(g, "id", "left").select(*parts[0].columns, F.coalesce("permission_list", F.array().cast("array<string>")).alias("permission_list"), F.coalesce("auth_type", F.lit("ROLE")).alias("auth_type"))


def own_and_shared(resources: DataFrame, shared_ids: DataFrame, user: str, owner: str = "user_id") -> DataFrame:
    """Resources of a user and those shared with them, each once."""
    return resources.where(F.col(owner) == user).unionByName(resources.join(shared_ids.select("id"), "id", "left_semi")).distinct()
