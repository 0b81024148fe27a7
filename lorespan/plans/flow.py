"""A dataflow of typed nodes over a batch of requests: one row per request, variables as columns, branches as filters.

The graph is small and read on the driver; the rows never leave Spark. Nodes run in topological order. A node that waits
for all its upstream nodes (the default) runs for requests that every live upstream node reached; one that waits for any
runs for requests that some upstream node reached. A node adds columns named <node>__<field>.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.functions.predicates import branch
from lorespan.operators.search import budget_cut, reranked, search_many
from lorespan.sources.files import file_text

START, CONDITION, FORM = "start-node", "condition-node", "form-node"
#: Nodes at which a flow may end.
END_TYPES = ("ai-chat-node", "reply-node", "tool-node", "tool-lib-node", "application-node", "image-understand-node", "image-generate-node", "text-to-speech-node", "speech-to-text-node", "mcp-node")


@dataclass
class Node:
    id: str
    type: str
    config: dict = field(default_factory=dict)
    y: float = 0.0
    wait_any: bool = False


@dataclass
class Edge:
    source: str
    target: str
    anchor: str | None = None  # '<node>_<branch>_right' for conditions


class Flow:
    def __init__(self, nodes: list[Node], edges: list[Edge]) -> None:
        self.nodes = {n.id: n for n in nodes}
        self.edges = edges
        self.up: dict[str, list[Edge]] = {n.id: [] for n in nodes}
        self.down: dict[str, list[Edge]] = {n.id: [] for n in nodes}
        for e in edges:
            self.up[e.target].append(e)
            self.down[e.source].append(e)

    def check(self) -> None:
        """One start node, all branches connected, ends only where a flow may end, no cycle."""
        if sum(n.type == START for n in self.nodes.values()) != 1:
            raise ValueError("a flow has exactly one start node")
        for n in self.nodes.values():
            if n.type == CONDITION:
                anchors = {e.anchor for e in self.down[n.id]}
                for b in n.config.get("branch", []):
                    if f"{n.id}_{b['id']}_right" not in anchors:
                        raise ValueError(f"branch {b['id']} of {n.id} leads nowhere")
            elif not self.down[n.id] and n.type not in END_TYPES:
                raise ValueError(f"{n.id} can't be the last node")
        self.order()

    def order(self) -> list[Node]:
        """Topological; nodes that may run at once are ordered by their place on the canvas."""
        left = {k: len(v) for k, v in self.up.items()}
        ready = sorted((n for n in self.nodes.values() if not left[n.id]), key=lambda n: (n.y, n.id))
        out = []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for e in self.down[n.id]:
                left[e.target] -= 1
                if not left[e.target]:
                    ready.append(self.nodes[e.target])
            ready.sort(key=lambda x: (x.y, x.id))
        if len(out) < len(self.nodes):
            raise ValueError("a flow has no cycles")
        return out

    def run(self, requests: DataFrame, custom: dict[str, Callable[[DataFrame, Node], DataFrame]] | None = None) -> DataFrame:
        """Requests with the columns of all nodes; <node>__reached tells whether a node ran. Inner columns of nodes that
        didn't run are null."""
        self.check()
        kinds = NODES | (custom or {})
        df = requests
        for node in self.order():
            reached = self._reached(node)
            df = df.withColumn(f"{node.id}__reached", reached)
            if node.type not in kinds:
                raise ValueError(f"no such node type: {node.type}")
            before = set(df.columns)
            df = kinds[node.type](df, node)
            for c in [c for c in df.columns if c not in before]:
                df = df.withColumn(c, F.when(F.col(f"{node.id}__reached"), F.col(c)))
        return df

    def _reached(self, node: Node) -> Column:
        ways = []
        for e in self.up[node.id]:
            way = F.col(f"{e.source}__reached")
            if self.nodes[e.source].type == FORM:
                way = way & F.col(f"{e.source}__is_submit")
            if self.nodes[e.source].type == CONDITION:
                m = re.fullmatch(rf"{re.escape(e.source)}_(.+)_right", e.anchor or "")
                way = way & F.coalesce(F.col(f"{e.source}__branch_id") == (m[1] if m else ""), F.lit(False))
            ways.append(way)
        if not ways:
            return F.lit(True)
        out = ways[0]
        for w in ways[1:]:
            out = (out | w) if node.wait_any or self._exclusive(node) else (out & w)
        return out

    def _exclusive(self, node: Node) -> bool:
        """Whether some ways in come from branches of one condition: then only one of them can be alive."""
        seen: dict[str, set[str | None]] = {}

        def climb(n: str, via: str | None) -> None:
            for e in self.up[n]:
                if self.nodes[e.source].type == CONDITION:
                    seen.setdefault(e.source, set()).add(e.anchor)
                climb(e.source, via)

        climb(node.id, None)
        return any(len(a) > 1 for a in seen.values())


def reference(path: list[str]) -> Column:
    """[node, field, key ...]: a column of a node, or a path into it; null where anything is missing."""
    c = F.col(f"{path[0]}__{path[1]}") if path[0] != "global" else F.col(path[1])
    for key in path[2:]:
        c = F.get_json_object(c, f"$.{key}")
    return c


def template(text: str, columns: list[str]) -> Column:
    """{{a.b}} replaced by columns a__b (or global b); unknown names and nulls by nothing."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*([\w-]+)\.([\w-]+)\s*\}\}", text):
        name = m[2] if m[1] == "global" else f"{m[1]}__{m[2]}"
        parts.append(F.lit(text[at : m.start()]))
        parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit(""))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def _value(spec: dict, df: DataFrame) -> Column:
    if spec.get("source") == "reference":
        return reference(spec["reference"]).cast("string")
    if spec.get("type") == "json":
        return F.lit(spec["value"])
    return template(str(spec.get("value", "")), df.columns)


def _start(df: DataFrame, node: Node) -> DataFrame:
    return df.withColumn(f"{node.id}__question", F.col(node.config.get("question", "question")))


def _condition(df: DataFrame, node: Node) -> DataFrame:
    def test(c: dict) -> tuple:
        operand = reference(c["field"])
        is_list = isinstance(df.select(operand.alias("x")).schema["x"].dataType, T.ArrayType)
        return operand, c["compare"], c.get("value"), is_list

    branches = [{"id": b["id"], "condition": b.get("condition", "and"), "conditions": [test(c) for c in b.get("conditions", [])]} for b in node.config["branch"]]
    return df.withColumn(f"{node.id}__branch_id", branch(branches))


def _assign(df: DataFrame, node: Node) -> DataFrame:
    for v in node.config["variables"]:
        df = df.withColumn(f"{node.id}__{v['name']}", _value(v, df))
    return df


def _reply(df: DataFrame, node: Node) -> DataFrame:
    return df.withColumn(f"{node.id}__answer", _value(node.config, df))


def _prompt(df: DataFrame, node: Node) -> DataFrame:
    """Prompt assembly of a model call; the call itself is the caller's function of the prompt, an echo by default."""
    prompt = template(node.config.get("prompt", ""), df.columns)
    model: Callable[[Column], Column] = node.config.get("model") or (lambda p: p)
    return df.withColumn(f"{node.id}__prompt", prompt).withColumn(f"{node.id}__answer", model(F.col(f"{node.id}__prompt")))


def _tool(df: DataFrame, node: Node) -> DataFrame:
    """A registered column function over named inputs, each coerced to the type its "as" names; what is no such value is null."""
    args = {k: COERCIONS[v.get("as", "string")](_value(v, df)) for k, v in node.config.get("inputs", {}).items()}
    return df.withColumn(f"{node.id}__result", node.config["function"](**args))


def _search(df: DataFrame, node: Node) -> DataFrame:
    """Retrieval for all requests at once. config: key (a column that tells requests apart), rows (candidates: id,
    paragraph_id, embedding), paragraphs (paragraph_id, title, content, and hit_handling_method and
    directly_return_similarity where documents are returned directly), embed (column of text to column of vectors),
    question (a path), top_n, similarity, most_chars.

    Gives paragraph_list, is_hit_handling_method_list (those returned directly), data (the context, cut) and
    directly_return; requests without a hit have empty ones."""
    c, key = node.config, node.config["key"]
    queries = df.where(F.col(f"{node.id}__reached")).select(F.col(key).cast("string").alias("query_id"), c["embed"](reference(c["question"])).alias("query_vector"))
    hits = search_many(c["rows"], queries, c.get("similarity", 0.6), c.get("top_n", 3)).join(c["paragraphs"], "paragraph_id")
    hits = hits.select("query_id", "paragraph_id", "score", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        *[(F.col(n) if n in hits.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (("hit_handling_method", "string"), ("directly_return_similarity", "double"))])
    direct = F.coalesce((F.col("hit_handling_method") == "directly_return") & (F.col("score") > F.col("directly_return_similarity")), F.lit(False))
    shown = F.struct("paragraph_id", "title", "content", "score")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "paragraph_id", direct.alias("direct"), shown.alias("p"))))
    per = hits.groupBy("query_id").agg(ordered.alias("h"))
    part = lambda p: F.concat(F.lit("#### "), p["title"], F.lit("\n"), p["content"])
    own = per.select(
        "query_id",
        F.transform("h", lambda x: x["p"]).alias("l"),
        F.transform(F.filter("h", lambda x: x["direct"]), lambda x: x["p"]).alias("r"),
    )
    new = own.select(
        F.col("query_id").alias("__key"),
        F.col("l").alias(f"{node.id}__paragraph_list"),
        F.col("r").alias(f"{node.id}__is_hit_handling_method_list"),
        F.substring(F.array_join(F.transform("l", part), "\n"), 1, c.get("most_chars", 5000)).alias(f"{node.id}__data"),
        F.array_join(F.transform("r", lambda p: p["content"]), "\n").alias(f"{node.id}__directly_return"),
    )
    return _joined(df, new, key, node)


def _joined(df: DataFrame, new: DataFrame, key: str, node: Node) -> DataFrame:
    """Columns of a node by request; requests without a row have empty lists and texts."""
    out = df.join(new, df[key].cast("string") == new["__key"], "left").drop("__key")
    for f in new.schema.fields:
        if f.name != "__key":
            out = out.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit("")))
    return out


def _rerank(df: DataFrame, node: Node) -> DataFrame:
    """Documents of earlier nodes (references to paragraph lists) by falling score of config's scorer (query, content),
    cut to top_n, similarity and max_paragraph_char. Gives document_list, result_list and result."""
    c, key = node.config, node.config["key"]
    lists = [F.coalesce(F.transform(reference(r), lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), p["title"].alias("title"), p["content"].alias("content"))), F.array()) for r in c["references"]]
    kind = "array<struct<paragraph_id: string, title: string, content: string>>"
    df = df.withColumn(f"{node.id}__document_list", F.concat(*[x.cast(kind) for x in lists]))
    asked = df.where(F.col(f"{node.id}__reached")).select(F.col(key).cast("string").alias("__key"), reference(c["question"]).alias("q"), F.posexplode(f"{node.id}__document_list").alias("place", "p"))
    docs = asked.select("__key", "q", "place", "p.*")
    cut = budget_cut(reranked(docs, c["scorer"], F.col("q")), c.get("max_paragraph_char", 5000), c.get("top_n", 3), c.get("similarity", 0.0), "__key", "place")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct("paragraph_id", "title", "content", "score").alias("p"))))
    new = cut.groupBy("__key").agg(F.transform(ordered, lambda x: x["p"]).alias(f"{node.id}__result_list"))
    new = new.withColumn(f"{node.id}__result", F.array_join(F.transform(f"{node.id}__result_list", lambda p: p["content"]), "\n"))
    return _joined(df, new, key, node)


#: Fixed value: what stands between the texts of several files.
FILE_RULE = "\n`-----------------------------------`\n"


def _extract(df: DataFrame, node: Node) -> DataFrame:
    """Texts of files (a reference to an array of name and content), each under its name; unreadable files are left out."""

    @F.pandas_udf("string")
    def texts(lists: pd.Series) -> pd.Series:
        return lists.map(lambda files: FILE_RULE.join(f"### {f['name']}\n{text}" for f in (files if files is not None else []) if (text := file_text(f["name"], f["content"])) is not None))

    return df.withColumn(f"{node.id}__content", texts(reference(node.config["files"])))


def _form(df: DataFrame, node: Node) -> DataFrame:
    """A form: what was submitted, JSON in the column that config's data names, or null while it waits. Nodes after it are
    reached once it is submitted; a later run of the same requests with data goes on from there."""
    data = F.col(node.config["data"])
    out = df.withColumn(f"{node.id}__is_submit", data.isNotNull()).withColumn(f"{node.id}__form_data", data)
    for name in node.config.get("fields", []):
        out = out.withColumn(f"{node.id}__{name}", F.get_json_object(data, f"$.{name}"))
    return out


def _application(df: DataFrame, node: Node) -> DataFrame:
    """Another flow, with a question of this one; its answer is the first one that its answer nodes (paths) give."""
    c = node.config
    inner = c["flow"].run(df.select("*", reference(c["question"]).alias("__question")).drop("question").withColumnRenamed("__question", "question"), c.get("custom"))
    # the inner flow's nodes may be named like this one's
    answer = F.coalesce(*[reference(a) for a in c["answers"]])
    kept = inner.select(F.col(c["key"]).cast("string").alias("__key"), answer.alias(f"{node.id}__answer"))
    return _joined(df, kept, c["key"], node)


#: Node type -> (rows, node) -> rows with the node's columns.
NODES: dict[str, Callable[[DataFrame, Node], DataFrame]] = {
    START: _start,
    CONDITION: _condition,
    "variable-assign-node": _assign,
    "reply-node": _reply,
    "ai-chat-node": _prompt,
    "question-node": _prompt,
    "tool-node": _tool,
    "tool-lib-node": _tool,
    "search-knowledge-node": _search,
    "reranker-node": _rerank,
    "document-extract-node": _extract,
    FORM: _form,
    "application-node": _application,
}
#: Results of typed inputs: what is no such value is null.
COERCIONS: dict[str, Callable[[Column], Column]] = {
    "string": lambda c: c.cast("string"),
    "int": lambda c: c.cast("string").try_cast("bigint"),
    "float": lambda c: c.cast("string").try_cast("double"),
    "array": lambda c: F.from_json(c.cast("string"), "array<string>"),
    "dict": lambda c: F.from_json(c.cast("string"), "map<string,string>"),
}
