"""Text, status, vector, predicate and full-text functions against plain Python."""

import hashlib
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.functions import fulltext, predicates, status, text, vector
from pyspark.sql import functions as F

TEXTS = [None, "", "   \n ", "a" * 600, "a" * 300 + ". b", "Hello world. How are you? 会议。结束！ok", "　x　\n\n\ty", "x;y；z|w\\v.u!", ("word " * 100).strip()]


def plain_chunks(t):
    ends = r".{1,256}[。 |\\.！;；!\n]"
    runs = re.findall(ends, t, flags=re.S)
    rests = [p for r in re.split(ends, t, flags=re.S) for p in re.findall(r".{1,256}", r, flags=re.S)]
    return [c.strip() for c in runs + rests if c.strip()]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_chunks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string").select("i", text.mark_chunks("x").alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert got[0] is None and [got[i] for i in range(1, len(TEXTS))] == [plain_chunks(t) for t in TEXTS[1:]]
    assert list(map(len, got[3])) == [256, 256, 88] and list(map(len, got[4])) == [257, 44, 1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .;\n会。", max_size=700), min_size=1, max_size=8))
def test_chunks_keep_all_visible_characters(texts):
    from lorespan.session import local_session

    spark = local_session("4", "4g", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", text.mark_chunks("x").alias("c"))
    for r in df.collect():
        assert r.c == plain_chunks(texts[r.i]) and all(0 < len(c) <= 257 for c in r.c)
        assert sorted("".join(r.c).replace(" ", "").replace("\n", "")) == sorted(texts[r.i].replace(" ", "").replace("\n", ""))


def test_text_passes(spark):
    assert one(spark, "# T\r\nx\0y\rz", text.normalize) == "# T\nxy\nz"
    assert one(spark, "a\n\n\nb  c##\t", text.clean) == "a\nb c"
    assert one(spark, "# Title\n\n**b** _i_ `c` [l](u) ![i](u) <p>x</p>", text.markdown_to_plain) == "Title b i c l x"
    assert one(spark, "a\n \n\nb", text.drop_blank_lines) == "a\nb"
    assert one(spark, "![a](x) and ![b](/oss/image/1-2) /oss/file/ab", text.image_links) == ["![a](x)", "![b](/oss/image/1-2)"]
    assert one(spark, "![b](/oss/image/1-2) /oss/file/ab", text.stored_file_ids) == ["1-2", "ab"]
    assert one(spark, "<data>q</data> rest", text.data_tag) == "q" and one(spark, "none", text.data_tag) == "none"
    assert tuple(one(spark, "a<think>r</think>b", text.split_reasoning)) == ("r", "ab")
    assert tuple(one(spark, "a<think>r", text.split_reasoning)) == ("r", "a") and tuple(one(spark, "ab", text.split_reasoning)) == ("", "ab")
    assert one(spark, "第三章 概述", text.chapter_title) == "概述"
    assert one(spark, "v1.2.3 of a@b.com", text.protected_words) == ["v1.2.3", "a@b.com"]
    assert one(spark, "Hello 会议 x1", text.tokens) == ["hello", "会", "会议", "议", "x1"]
    assert one(spark, "=1+1", text.formula_safe) == "﻿=1+1"


@pytest.mark.parametrize("s", ["", "a", "abcd", "1234567890", "x" * 40])
def test_secrets_and_hashes(spark, s):
    two, fifth = int(len(s) / 5 * 2), int(len(s) / 5)
    head = s[: 8 if two > 8 else 1 if two <= 0 else two]
    tail = s[len(s) - (fifth if two < 4 else 4) :] if (fifth if two < 4 else 4) else ""
    assert one(spark, s, text.mask_secret) == head + "*" * 15 + tail
    assert one(spark, s, text.sha256_hex) == hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, s, text.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))


def test_status(spark):
    assert one(spark, "2", lambda c: status.padded(c)) == "nn2" and one(spark, None, lambda c: status.padded(c)) == "nnn"
    assert one(spark, "n32", lambda c: status.state(c, 2)) == "3"
    for slot, want in ((1, "n34"), (2, "n42"), (3, "432")):
        assert one(spark, "n32", lambda c, k=slot: status.with_state(c, k, "4")) == want
    assert one(spark, "n22", status.all_done) and not one(spark, "n32", status.all_done)
    assert one(spark, "014", status.recovered) == "333"
    assert one(spark, "nn4", lambda c: status.finalized(c, 1, F.lit(True))) == "nn5"
    assert one(spark, "nn1", lambda c: status.finalized(c, 1, F.lit(True))) == "nn3" and one(spark, "nn1", lambda c: status.finalized(c, 1, F.lit(False))) == "nn2"


def test_cosine(spark):
    for v, want in (([1.0, 0.0], 0.6), ([0.0, 0.0], None), ([1.0], None), (None, None)):
        got = one(spark, v, lambda c: vector.cosine(c, vector.literal([3.0, 4.0])), "array<float>")
        assert got is None if want is None else abs(got - want) < 1e-9


@pytest.mark.parametrize(
    ("op", "x", "value", "want"),
    [
        ("eq", "a", "a", True), ("eq", None, "None", True), ("contain", "abc", "b", True), ("contain", None, "b", False), ("not_contain", None, "b", True),
        ("ge", "10", "9", True), ("gt", "abc", "1", False), ("lt", None, "1", False), ("le", "1.5", "1.5", True), ("len_eq", "abc", "3", True), ("len_gt", "abc", "x", False), ("len_le", "abc", "3", True),
        ("is_null", "", None, True), ("is_null", None, None, True), ("is_not_null", "a", None, True), ("is_true", "true", None, False), ("is_true", None, None, False), ("is_not_true", "false", None, False), ("is_not_true", None, None, False),
    ],
)
def test_comparisons(spark, op, x, value, want):
    assert one(spark, x, lambda c: predicates.compare(op, c, value)) is want


def test_list_comparisons_and_branches(spark):
    assert one(spark, ["a", "b"], lambda c: predicates.compare("contain", c, "b", True), "array<string>")
    assert one(spark, [], lambda c: predicates.compare("is_null", c, None, True), "array<string>")
    assert one(spark, ["a"], lambda c: predicates.compare("len_eq", c, "1", True), "array<string>")
    b = [{"id": "x", "condition": "or", "conditions": [("x", "eq", "1"), ("x", "eq", "2")]}, {"id": "y", "conditions": [("x", "len_ge", "2")]}]
    assert [one(spark, v, lambda c: predicates.branch(b, "z")) for v in ("2", "33", "4")] == ["x", "y", "z"]
    assert [one(spark, v, lambda c: predicates.one_of_or_null(c, ["VIEW", "NOT_AUTH"])) for v in ("VIEW", None, "X")] == [True, True, False]
    with pytest.raises(ValueError):
        predicates.compare("nope", F.lit(1))


def test_fulltext():
    q = fulltext.parse('draft "policy paper" -old or 会议')
    t = lambda s: fulltext.words(s)
    assert fulltext.cover_rank(t("a draft of the policy paper"), q) > 0
    assert fulltext.cover_rank(t("a draft of the policy old paper"), q) == 0
    assert fulltext.cover_rank(t("draft policy paper old"), q) == 0
    assert fulltext.cover_rank(t("会议 纪要"), q) > 0
    near, far = (fulltext.cover_rank(t(s), fulltext.parse("draft policy")) for s in ("draft policy", "draft x x x x policy"))
    assert near > far > 0 and near < 1
    assert fulltext.cover_rank(None, q) == fulltext.cover_rank([], q) == 0 == fulltext.cover_rank(t("draft"), fulltext.parse("-draft"))
