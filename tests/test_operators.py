"""Relational, retrieval, reporting and maintenance operators, flows and streams on small tables."""

import datetime as dt
import os
import subprocess
import sys

import pytest

from lorespan import session
from lorespan.functions import documents, predicates
from lorespan.operators import maintain, problems, relational, reports, search, sinks
from lorespan.plans.flow import Edge, Flow, Node
from lorespan.sources import files
from lorespan.streaming import streams
from pyspark.sql import functions as F

T0 = dt.datetime(2025, 1, 1)


def rows(df, *order):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def emb(spark):
    data = [("e1", "p1", "k1", "d1", True, [1.0, 0.0], ["draft", "policy"]), ("e2", "p1", "k1", "d1", True, [0.8, 0.6], None), ("e3", "p2", "k1", "d2", True, [0.6, 0.8], ["draft", "x", "policy"]), ("e4", "p3", "k2", "d3", True, [1.0, 0.0], []), ("e5", "p4", "k1", "d1", False, [1.0, 0.0], ["draft"]), ("e6", "p5", "k1", "d1", True, None, ["draft"]), ("e7", "p6", "k1", "d1", True, [0.0, 0.0], ["policy", "draft"])]
    return spark.createDataFrame(data, "id string, paragraph_id string, knowledge_id string, document_id string, is_active boolean, embedding array<float>, tokens array<string>")


def test_vector_search(spark, emb):
    got = search.search(search.candidates(emb, ["k1"]), "embedding", [1.0, 0.0], threshold=0.6, top_n=9)
    assert [(r.paragraph_id, round(r.score, 4)) for r in got.collect()] == [("p1", 1.0), ("p2", 0.6)] or [r.paragraph_id for r in got.collect()] == ["p1"]
    tie = search.search(search.candidates(emb), "embedding", [1.0, 0.0], threshold=0.0, top_n=2)
    assert [(r.paragraph_id, r.best_id) for r in tie.collect()] == [("p1", "e1"), ("p3", "e4")]
    assert search.candidates(emb, []).count() == 0
    assert {r.id for r in search.candidates(emb, exclude_documents=["d1"], exclude_paragraphs=["p2"]).collect()} == {"e4"}
    with pytest.raises(ValueError):
        search.search(emb, "other")


def test_keyword_and_blend(emb):
    rows_ = search.candidates(emb)
    words = [r.paragraph_id for r in search.search(rows_, "keywords", query_text="draft policy", threshold=0.0, top_n=9).collect()]
    assert words[0] in ("p1", "p6") and set(words) == {"p1", "p2", "p6"}
    blend = {r.paragraph_id: r.score for r in search.search(rows_, "blend", [1.0, 0.0], "draft policy", threshold=0.0, top_n=9).collect()}
    assert blend["p1"] > 1.0 and "p6" not in blend


def test_budget_cut_is_a_prefix(spark):
    d = spark.createDataFrame([("a", 0.9, "x" * 40), ("b", 0.8, "y" * 40), ("c", 0.7, "z" * 40), ("d", 0.1, "w"), ("e", 0.05, "v")], "paragraph_id string, score double, content string")
    assert [(r.paragraph_id, len(r.content)) for r in search.budget_cut(d, 60, 5, 0.0).orderBy("rank").collect()] == [("a", 40), ("b", 20)]
    assert search.budget_cut(d, 1000, 5, 0.5).count() == 3 and search.budget_cut(d, 1000, 2, 0.0).count() == 2


def test_direct_return(spark):
    d = spark.createDataFrame([("a", 0.9, "optimization", 0.5), ("b", 0.8, "directly_return", 0.8), ("c", 0.7, "directly_return", 0.1)], "paragraph_id string, score double, hit_handling_method string, directly_return_similarity double")
    assert [r.paragraph_id for r in search.direct_return(d).collect()] == ["b"]
    assert [r.paragraph_id for r in search.direct_return(d, strict=True).collect()] == ["c"]
    assert search.direct_return(d.where("paragraph_id = 'a'")).count() == 1


def test_contexts_rerank_and_models(spark):
    d = spark.createDataFrame([("b", 0.5, "T2", "two"), ("a", 0.9, None, "one")], "paragraph_id string, score double, title string, content string")
    assert search.context_workflow(d).first().context == "#### \none\n#### T2\ntwo"
    assert search.context_pipeline(d, 6).first().context == "<data>:one</data>\n<data>T2</data>"
    twice = spark.createDataFrame([("x", "same"), ("y", "same")], "paragraph_id string, content string")
    scored = spark.createDataFrame([("same", 0.9), ("same", 0.2)], "content string, score double")
    assert rows(search.reattached(scored, twice).select("paragraph_id", "score")) == [("x", 0.9), ("y", 0.2)]
    k = spark.createDataFrame([("k1", "m1"), ("k2", "m1"), ("k3", "m2")], "id string, embedding_model_id string")
    assert search.single_model(k, ["k1", "k2"]) == "m1"
    with pytest.raises(ValueError):
        search.single_model(k, ["k1", "k3"])
    e = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(search.hashing_embedder(8)(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in e[0].v) - 1) < 1e-6 and e[1].v is None and e[2].v is None
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    v = spark.createDataFrame([("e", "p", [1.0, 0.0])], "id string, paragraph_id string, embedding array<float>")
    assert rows(search.search_many(v, q, 0.5, 3)) == [("q", "p", 1.0, 1)]


def test_many_queries_in_blocks(spark, emb, monkeypatch):
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    q = spark.createDataFrame([(f"q{i}", [1.0, i / 4]) for i in range(9)] + [("zero", [0.0, 0.0]), ("long", [1.0] * 3), ("none", None)], "query_id string, query_vector array<double>")
    got = rows(search.search_many(emb, q, 0.5, 2).select("query_id", "paragraph_id", "rank", F.round("score", 6)))
    want = []
    for i in range(9):
        one = search.search(emb, "embedding", [1.0, i / 4], threshold=0.5, top_n=2).collect()
        want += [(f"q{i}", r.paragraph_id, n + 1, round(r.score, 6)) for n, r in enumerate(one)]
    assert got == sorted(want, key=str) and len(want) > 9
    assert search.search_many(emb.limit(0), q, 0.5, 2).count() == 0 and search.search_many(emb, q.limit(0), 0.5, 2).count() == 0


def test_problems(spark):
    q = "array<struct<id: string, content: string>>"
    par = spark.createDataFrame([("p1", "k1", "d1", [("q2", "same"), ("q3", "own")]), ("p2", "k1", "d1", [("q1", "same"), ("q9", None)]), ("p3", "k2", "d2", [("q4", "own")]), ("p4", "k2", "d2", None)], f"id string, knowledge_id string, document_id string, problem_list {q}")
    problem, mapping = problems.normalised(par)
    assert rows(problem) == [("q1", "k1", "same"), ("q3", "k1", "own"), ("q4", "k2", "own")]
    assert rows(mapping.select("problem_id", "paragraph_id")) == [("q1", "p1"), ("q1", "p2"), ("q3", "p1"), ("q4", "p3")]
    left, kept = problems.left_over(problem, mapping, spark.createDataFrame([("p1",)], "paragraph_id string"))
    assert rows(left.select("id")) == [("q1",), ("q4",)] and kept.count() == 2
    moves = spark.createDataFrame([("p1", "k2", "d9")], "paragraph_id string, target_id string, target_document_id string")
    assert {(r.content, r.problem_id if not r.created else "new", r.knowledge_id) for r in problems.remapped(problem, mapping, moves).collect()} == {("same", "new", "k2"), ("own", "q4", "k2")}
    assert problems.of_paragraphs(par, problem, mapping).where("size(problems) = 0").count() == 1


def test_predicates_of_arrays_names_and_days(spark):
    d = spark.createDataFrame([(["a", "b"], T0, "The X", None, False), ([], T0 + dt.timedelta(hours=47, minutes=59), "y", "the", None), (None, None, None, None, True)], "l array<string>, t timestamp, name string, description string, is_deleted boolean")
    got = d.select(predicates.any_of(F.col("l"), ["b", "c"]), predicates.all_of(F.col("l"), ["a", "b"]), predicates.all_of(F.col("l"), []), predicates.days_between(F.col("t"), "2025-01-01", "2025-01-02"), predicates.named_or_described("THE"), predicates.not_deleted(), predicates.contains(F.col("name"), "The")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True, True, True, True), (False, False, True, True, True, True, False), (False, False, False, False, False, False, False)]
    b = spark.createDataFrame([(True,), (False,), (None,)], "x boolean").select(predicates.compare("is_true", F.col("x")), predicates.compare("is_not_true", F.col("x")), predicates.compare("is_true", F.lit("true")))
    assert [tuple(r) for r in b.collect()] == [(True, False, False), (False, True, False), (False, False, False)]


def test_runs_and_maps(spark):
    d = spark.createDataFrame([("c", 1, "a", "x"), ("c", 2, "a", None), ("c", 3, None, "y"), ("c", 4, None, "z"), ("c", 5, "a", "w")], "chat string, at int, kind string, t string")
    assert rows(relational.runs(d, "chat", ["at"], "kind", "t", "+")) == [("c", 1, "a", "x+", 2), ("c", 2, None, "y+z", 2), ("c", 3, "a", "w", 1)]
    m = spark.range(1).select(relational.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"), relational.flattened(F.array(F.array(F.lit(1)), F.lit(None), F.array(F.lit(2), F.lit(3)))).alias("f")).first()
    assert m.m == {"a": 1, "b": 3} and m.f == [1, 2, 3]
    assert spark.createDataFrame([("{}",), (None,), ("x",), ('{"n": {"message_tokens": 2}, "m": {"message_tokens": 3, "answer_tokens": 4}}',)], "d string").select(reports.tokens_of_details(F.col("d")).alias("t")).select("t.*").collect() == [(0, 0), (0, 0), (0, 0), (5, 4)]


def test_scratch_is_refused_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda k, d=None: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.scratch_dir(Session())


def test_relational(spark):
    d = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + dt.timedelta(1)), ("b", 3, None)], "id string, n int, update_time timestamp")
    assert rows(relational.current(d).select("id", "n")) == [("a", 2), ("b", 3)]
    p = spark.createDataFrame([("d", i, f"x{i}") for i in range(4)], "document_id string, pos int, id string")
    assert [r.id for r in relational.moved(p, "document_id", "pos", F.lit(0), F.lit(2)).orderBy("pos").collect()] == ["x1", "x2", "x0", "x3"]
    assert [r.id for r in relational.moved(p, "document_id", "pos", F.lit(3), F.lit(1)).orderBy("pos").collect()] == ["x0", "x3", "x1", "x2"]
    new = spark.createDataFrame([("d", "n"), ("e", "m")], "document_id string, id string")
    assert rows(relational.appended_positions(p, new, "document_id", "pos", ["id"]).select("id", "pos")) == [("m", 1), ("n", 4)]
    known = spark.createDataFrame([("i1", "q1")], "id string, content string")
    want = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "content string")
    assert rows(relational.get_or_create(known, want, ["content"], F.lit("new"))) == [("q1", "i1", False), ("q2", "new", True)]
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "c")], "id string, parent_id string")
    assert rows(relational.descendants(tree, tree.where("id = 'r'"))) == [("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("r", "r", 0)]


def test_reports(spark):
    rec = spark.createDataFrame([("r1", "c1", "0", 1, 2, T0 + dt.timedelta(hours=23, minutes=59), ["p"]), ("r2", "c1", "1", 3, None, T0, None), ("r3", "c9", "-1", 0, 0, T0 + dt.timedelta(2), [])], "id string, chat_id string, vote_status string, message_tokens int, answer_tokens int, create_time timestamp, improve_paragraph_id_list array<string>")
    chats = spark.createDataFrame([("c1", "u1", 2, 1, 1, 1), ("c2", None, 5, 0, 0, 0)], "id string, chat_user_id string, chat_record_count int, star_num int, trample_num int, mark_sum int")
    trend = reports.daily_trend(rec, chats)
    assert rows(trend) == [(dt.date(2025, 1, 1), 1, 1, 3, 2, 1), (dt.date(2025, 1, 3), 0, 0, 0, 1, 0)]
    filled = reports.gap_filled(trend, F.lit(dt.date(2025, 1, 1)), F.lit(dt.date(2025, 1, 3)), ["chat_record_count"])
    assert [r[1] for r in filled.orderBy("day").collect()] == [2, 0, 1]
    assert rows(reports.counter_drift(chats, rec)) == [("c2", 0, 0, 0, 0)]
    res = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    grants = spark.createDataFrame([("a", "ROLE", ["ROLE"]), ("b", "RESOURCE_PERMISSION_GROUP", ["VIEW", "MANAGE"]), ("c", "RESOURCE_PERMISSION_GROUP", None)], "target string, auth_type string, permission_list array<string>")
    assert rows(reports.effective_permission(res, grants)) == [("a", "ROLE"), ("b", "MANAGE"), ("c", "NOT_AUTH"), ("d", "NOT_AUTH")]


def test_maintenance(spark):
    one = spark.createDataFrame([("-1", "0"), ("0", "1"), ("0", "-1"), ("-1", "-1")], "a string, b string")
    assert [r[0] for r in one.select(maintain.voted(F.col("a"), F.col("b"))).collect()] == ["0", "0", "-1", "-1"]
    rec = spark.createDataFrame([("r1", "c1", T0), ("r2", "c2", T0), ("r3", "c2", T0 + dt.timedelta(20))], "id string, chat_id string, create_time timestamp")
    chats = spark.createDataFrame([("c1", "a"), ("c2", "a"), ("c3", "b")], "id string, application_id string")
    keep = spark.createDataFrame([("a", 10)], "application_id string, clean_time int")
    left, stay = maintain.retained(rec, chats, keep, F.lit(T0 + dt.timedelta(21)))
    assert rows(left.select("id")) == [("r3",)] and rows(stay.select("id")) == [("c2",), ("c3",)]
    assert maintain.expired_records(rec, chats, keep.limit(0), F.lit(T0 + dt.timedelta(99))).count() == 0
    f = spark.createDataFrame([("a", "TEMPORARY_30_MINUTE", T0), ("b", "TEMPORARY_1_DAY", T0), ("c", "KNOWLEDGE", T0)], "id string, source_type string, create_time timestamp")
    assert rows(maintain.live_files(f, F.lit(T0 + dt.timedelta(hours=1))).select("id")) == [("b",), ("c",)]
    web = spark.createDataFrame([("u1", "old"), ("u2", "old")], "source_url string, v string")
    new = spark.createDataFrame([("u2", "new"), ("u3", "new")], "source_url string, v string")
    assert rows(maintain.synced(web, new, True)) == [("u1", "old"), ("u2", "new"), ("u3", "new")] and rows(maintain.synced(web, new, False)) == [("u1", "old"), ("u2", "old"), ("u3", "new")]


def test_sinks(spark):
    t = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, text string")
    sizes = [r.embedding for r in sinks.embed_batches(t, lambda xs: [[float(len(xs))] for _ in xs], 1).orderBy("id").collect()]
    assert sizes == [[1.0], None, [1.0]]
    b = spark.createDataFrame([(bytearray(b"abcdef"),)], "c binary").select(sinks.byte_range(F.col("c"), 1, 3).alias("x"), sinks.byte_range(F.col("c"), 4).alias("y")).first()
    assert (bytes(b.x), bytes(b.y)) == (b"bcd", b"ef")
    m = spark.range(1).select(sinks.stream_message(F.lit("c"), F.lit("r"), F.lit("hi"), F.lit(True)).alias("m")).first().m
    assert m.startswith("data: {") and m.endswith("\n\n") and '"content":"hi"' in m
    files = spark.createDataFrame([("d", "a.txt", bytearray(b"x"))], "document_id string, name string, content binary")
    assert bytes(sinks.packed_exports(files).first().archive)[:2] == b"PK"


def _flow(wait_any=False):
    branches = [{"id": "yes", "conditions": [{"field": ["start", "question"], "compare": "contain", "value": "a"}]}, {"id": "no", "conditions": []}]
    nodes = [Node("start", "start-node"), Node("c", "condition-node", {"branch": branches}), Node("v", "variable-assign-node", {"variables": [{"name": "x", "value": "<{{start.question}}>"}]}), Node("r", "reply-node", {"source": "reference", "reference": ["v", "x"]}), Node("n", "reply-node", {"value": "no {{global.missing}}"}), Node("e", "ai-chat-node", {"prompt": "{{r.answer}}{{n.answer}}"}, wait_any=wait_any)]
    edges = [Edge("start", "c"), Edge("c", "v", "c_yes_right"), Edge("v", "r"), Edge("c", "n", "c_no_right"), Edge("r", "e"), Edge("n", "e")]
    return nodes, edges


def test_flow(spark):
    df = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, None)], "id int, question string")
    out = Flow(*_flow()).run(df).orderBy("id").collect()
    assert [r.e__answer for r in out] == ["<cat>", "no ", "no "] and [r.n__reached for r in out] == [False, True, True]
    nodes, edges = _flow()
    for bad in ([*edges, Edge("e", "c")], [e for e in edges if e.anchor != "c_no_right"]):
        with pytest.raises(ValueError):
            Flow(nodes, bad).check()
    with pytest.raises(ValueError):
        Flow(nodes[1:], [e for e in edges if e.source != "start"]).check()


def test_streams_equal_batches(spark, tmp_path):
    data = [(f"r{i}", f"c{i % 3}", str(i % 2), T0 + dt.timedelta(minutes=(i * 37) % 300), ["p"] * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(data, "id string, chat_id string, vote_status string, create_time timestamp, improve_paragraph_id_list array<string>")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streams.read_tables(spark, str(tmp_path / "in"))
    got = streams.drained(streams.chat_counters(stream), "t_counters", str(tmp_path / "c1"))
    assert rows(got) == rows(streams.chat_counters(df))
    assert {r.chat_id: r.used for r in streams.daily_quota(df, 5).collect()} == {"c0": 20, "c1": 20, "c2": 20}
    assert sum(r.records for r in streams.sessions(df, "5 minutes").collect()) == 60
    events = spark.createDataFrame([("r", "0", 1), ("r", "1", 2), ("r", "-1", 3), ("s", "1", 1)], "record_id string, wish string, at int")
    events.write.parquet(str(tmp_path / "ev"))
    out = streams.drained(streams.votes(streams.read_tables(spark, str(tmp_path / "ev"), 100)), "t_votes", str(tmp_path / "c2"), "update")
    assert rows(out) == [("r", "-1"), ("s", "1")]
    streams.ingest(streams.read_tables(spark, str(tmp_path / "in")), lambda b: b.select("id"), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_retrieval_nodes(spark, emb):
    pars = spark.createDataFrame([("p1", "T1", "one two", "directly_return", 0.9), ("p2", None, "three", "optimization", 0.9)], "paragraph_id string, title string, content string, hit_handling_method string, directly_return_similarity double")
    req = spark.createDataFrame([(1, "a", None), (2, "b", '{"n": 5}'), (3, None, None)], "id int, question string, sent string")
    embed = lambda c: F.when(c == "a", F.array(F.lit(1.0), F.lit(0.0))).when(c == "b", F.array(F.lit(-1.0), F.lit(0.0)))
    nodes = [Node("start", "start-node"), Node("k", "search-knowledge-node", {"key": "id", "rows": search.candidates(emb), "paragraphs": pars, "embed": embed, "question": ["start", "question"], "similarity": 0.5})]
    nodes += [Node("r", "reranker-node", {"key": "id", "references": [["k", "paragraph_list"]], "question": ["start", "question"], "scorer": lambda q, c: F.length(c).cast("double"), "top_n": 1, "max_paragraph_char": 4}), Node("f", "form-node", {"data": "sent", "fields": ["n"]}), Node("e", "reply-node", {"value": "{{f.n}}"})]
    out = Flow(nodes, [Edge("start", "k"), Edge("k", "r"), Edge("r", "f"), Edge("f", "e")]).run(req).orderBy("id").collect()
    assert [p.paragraph_id for p in out[0].k__paragraph_list] == ["p1", "p2"] and out[0].k__data == "#### T1\none two\n#### \nthree" and out[0].k__directly_return == "one two"
    assert out[0].r__result == "one " and out[1].k__paragraph_list == [] and out[1].r__result == "" and out[2].k__data == ""
    assert [r.e__answer for r in out] == [None, "5", None]


def test_expiry_stream(spark, tmp_path):
    data = [("a", T0, 30), ("a", T0 + dt.timedelta(minutes=20), 30), ("b", T0, 600), ("c", T0 + dt.timedelta(hours=3), 1)]
    df = spark.createDataFrame(data, "id string, create_time timestamp, life int")
    for i, part in enumerate([df.where("id <> 'c'"), df.where("id = 'c'")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.read_tables(spark, str(tmp_path / "in"), 10)
        q = streams.live(streams.read_tables(spark, str(tmp_path / "in"), 10), "life").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.id: r.expired_at for r in spark.read.schema("id string, expired_at timestamp").parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": T0 + dt.timedelta(minutes=50)}


def test_reasoning_of_chunks(spark, tmp_path):
    texts = {"a": "x<think>why</think>so", "b": "no tags < here", "c": "<think>open", "d": "<think>1</think>2<think>3</think>"}
    for n in (1, 3, 100):
        data = [(k, i, t[i * n : i * n + n], (i + 1) * n >= len(t)) for k, t in texts.items() for i in range(-(-len(t) // n))]
        spark.createDataFrame(data, "record_id string, seq int, text string, is_end boolean").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        out = streams.reasoning(streams.read_tables(spark, str(tmp_path / f"in{n}"), 100))
        got = streams.drained(out, f"t_reasoning_{n}", str(tmp_path / f"c{n}"), "append").orderBy("record_id", "seq").collect()
        whole = {k: ("".join(r.reasoning for r in got if r.record_id == k), "".join(r.answer for r in got if r.record_id == k)) for k in texts}
        assert whole == {"a": ("why", "xso"), "b": ("", "no tags < here"), "c": ("open", ""), "d": ("1", "2<think>3</think>")}


def test_files_workbooks_and_documents(spark):
    f = spark.createDataFrame([(bytearray(b"abc"),), (None,), (bytearray(b""),)], "c binary")
    got = f.select(sinks.uncompressed(sinks.compressed("c")).alias("a"), sinks.uncompressed("c").alias("b")).collect()
    assert [(r.a and bytes(r.a), r.b and bytes(r.b)) for r in got] == [(b"abc", b"abc"), (None, None), (b"", b"")] or [bytes(r.a) if r.a is not None else None for r in got] == [b"abc", None, b""]
    raw = sinks.workbook([("A & B", [["h", None], ["x\r\n\x01", "=1"]]), ("C", [])])
    assert [(n, [list(r) for r in rows_]) for n, rows_, _ in files.sheets(raw)] == [("A & B", [["h", None], ["x\r\n", "=1"]]), ("C", [])]
    d = spark.createDataFrame([('{"a": 1, "b": {"x": [null]}}',), (None,), ("bad",)], "j string")
    got = d.select(documents.json_set("j", a=F.lit('"z"'), c=F.lit(None)).alias("s"), documents.json_without("j", "a").alias("w")).collect()
    assert [(r.s, r.w) for r in got] == [('{"b":{"x":[null]},"a":"z","c":null}', '{"b":{"x":[null]}}'), ('{"a":"z","c":null}', None), ('{"a":"z","c":null}', None)]


def test_newest_of_a_stream(spark, tmp_path):
    for n, rows_ in enumerate([[("r", 1, T0), ("s", 1, T0)], [("r", 2, T0 + dt.timedelta(1))], [("s", 0, T0 - dt.timedelta(1))]]):
        spark.createDataFrame(rows_, "id string, n int, update_time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.newest_to(streams.read_tables(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert rows(streams.latest_of(spark, str(tmp_path / "out")).select("id", "n")) == [("r", 2), ("s", 1)]


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lorespan.llm'] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert q and not any(k.startswith('p4') for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
