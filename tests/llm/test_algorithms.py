"""Near duplicates, neighbours, splitting, encoding and packing."""

import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorespan.llm import encode, knn, neardup, pack, split

TOKENIZER_FILE = f"{encode.TOKENIZER_DIR}/{encode.TOKENIZER}.json"
TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", "naïve café – 21 °C", "会议助手恢复每日报表", "aaaa" * 40, "\n\n  \t x", "don't you'll we've", "🙂👩‍🔧", "0123456789" * 5]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(TOKENIZER_FILE):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(TOKENIZER_FILE)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library_and_decode(spark, library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abc éß會議\n .,'st", k=60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", encode.F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode.encode(docs, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    coder = encode.Encoder(TOKENIZER_FILE)
    assert coder.decode([got[i] for i in range(len(texts))]) == [t or "" for t in texts]
    assert encode.encode(docs.limit(0), "doc_id", "text").count() == 0


def test_long_words_and_small_batches(library, monkeypatch):
    monkeypatch.setattr(encode, "QUERY_BYTES", 30)
    monkeypatch.setattr(encode, "CACHE_WORDS", 5)
    coder = encode.Encoder(TOKENIZER_FILE)
    texts = [t for t in TEXTS if t]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [10_000, 100_000, 2_000_000])
def test_words_of_any_length_by_the_recursive_query(library, size):
    rng = random.Random(7)
    coder = encode.Encoder(TOKENIZER_FILE)
    words = ["supercalifragilistic" * (size // 20), "a" * size]
    if size <= 100_000:
        words += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(size // 3)), "".join(rng.choices("etaoinshrdlucm", k=size))]
    began = time.time()
    got = [x.tolist() for x in coder.encode(words)]
    assert time.time() - began < 60
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_pieces_that_agree_on_no_token_are_contracted_as_one(library, monkeypatch):
    monkeypatch.setattr(encode, "PIECE", 3)
    monkeypatch.setattr(encode, "OVERLAP", 2)
    coder = encode.Encoder(TOKENIZER_FILE)
    rng = random.Random(8)
    words = ["internationalisation", "会议助手恢复每日报表", *("".join(rng.choices("abcdeéß会議", k=rng.randint(1, 40))) for _ in range(300))]
    for w in words:
        assert coder.encode([w])[0].tolist() == library.encode(w, add_special_tokens=False).ids


def _bins(placed):
    out = defaultdict(int)
    for r in placed:
        if r.container_id is not None:
            out[r.container_id] += r.n_tokens
    return out


def test_packing_is_whole_within_capacity_and_tight(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 100, 512, 513, 1500, rng.randint(1, 511)]) for _ in range(600)]
    rows = [(i, n, None if i % 11 == 0 else f"s{i % 57}", 7 if i % 23 == 0 else i) for i, n in enumerate(sizes)]
    sized = spark.createDataFrame(rows + [(10_000, None, None, None)], "item_id long, n_tokens int, source string, cluster long")
    placed = pack.pack(sized, [("c", 512)], shard_items=100).collect()
    got = defaultdict(list)
    for r in placed:
        got[r.item_id].append((r.part_no, r.start, r.n_tokens))
    for i, n in enumerate(sizes):
        parts = sorted(got[i])
        assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(len(parts)))
        assert len(parts) == 1 or (n > 512 and all(p[2] == 512 for p in parts[:-1]))
    fill = _bins(placed)
    assert max(fill.values()) <= 512 and len(fill) <= sum(sizes) / 512 * 1.05 + 1
    assert sorted(got) == [*range(600), 10_000]
    assert _conflicts(placed, {r[0]: r for r in rows}) == 0
    assert pack.pack(sized.limit(0), [("c", 512)]).count() == 0


def _conflicts(placed, rows):
    """Pairs of texts of one source or one cluster in one container."""
    held = defaultdict(Counter)
    for r in placed:
        if r.container_id is not None:
            for key in (("source", rows[r.item_id][2]), ("cluster", rows[r.item_id][3])):
                if key[1] is not None:
                    held[r.container_id][key] += 1
    return sum(n - 1 for c in held.values() for n in c.values())


def test_packing_of_a_hot_source_and_a_hot_cluster(spark):
    rows = [(i, 40 + i % 90, "hot" if i % 3 == 0 else f"s{i}", 7 if i % 3 == 1 else i) for i in range(900)]
    sized = spark.createDataFrame(rows, "item_id long, n_tokens int, source string, cluster long")
    placed = pack.pack(sized, [("c", 512)], shard_items=120).collect()
    assert len(placed) == 900 and _conflicts(placed, {r[0]: r for r in rows}) == 0
    assert 300 <= len(_bins(placed)) <= 330


def test_best_fit_takes_the_tightest_compatible_bin_or_a_new_one():
    assert pack.best_fit([6, 5, 4], [None] * 3, [None] * 3, 10) == [0, 1, 0]
    assert pack.best_fit([6, 5, 4], ["a", "b", "a"], [None] * 3, 10) == [0, 1, 1]
    assert pack.best_fit([6, 5, 4], ["a", "b", "a"], [1, 2, 2], 10) == [0, 1, 2]
    assert len(set(pack.best_fit([1] * 100, ["s"] * 100, [1] * 100, 10))) == 100
    assert pack.best_fit([1, 1], [None] * 2, [None] * 2, 1 << 20) == [0, 0]


def test_best_fit_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        n, capacity = rng.randint(1, 40), 30
        sizes, sources, clusters = [rng.randint(1, 30) for _ in range(n)], [rng.choice("abcdef") for _ in range(n)], [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        bins = []
        crowd = [max(sources.count(s), clusters.count(c) if c else 0) for s, c in zip(sources, clusters, strict=True)]
        for i in sorted(range(n), key=lambda i: (crowd[i] <= max(pack.CROWDED * sum(sizes) / capacity, 1), -sizes[i], i)):
            fits = [b for b in bins if sum(sizes[j] for j in b) + sizes[i] <= capacity and not any(sources[j] == sources[i] or (clusters[i] and clusters[j] == clusters[i]) for j in b)]
            best = max(fits, key=lambda b: sum(sizes[j] for j in b), default=None)
            if best is None:
                bins.append(best := [])
            best.append(i)
        got = pack.best_fit(sizes, sources, clusters, capacity)
        room = lambda of: sorted(capacity - sum(sizes[i] for i in b) for b in of)
        held = [[i for i in range(n) if got[i] == b] for b in range(max(got) + 1)]
        assert len(held) <= len(bins) + 1 and min(room(held)) >= 0
        assert not any(sources[i] == sources[j] or (clusters[i] and clusters[i] == clusters[j]) for b in held for i in b for j in b if i < j)


def _check_pieces(text, rows, most, overlap):
    rows = sorted(rows)
    assert rows[0][1] == 0 and rows[-1][2] == len(text)
    for _, a, b, t in rows:
        assert t == text[a:b] and 0 < len(t) <= most
    for (_, a, b, _), (_, c, _, _) in zip(rows, rows[1:], strict=False):
        assert a < c <= b and b - c >= min(overlap, b - a - 1)


def test_pieces_cover_within_limits_and_equal_over_ranges(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["word " * 700, "x" * 5000, "。".join("会议助手恢复每日报表" for _ in range(300)), "\n\n".join("Line one. Line two; three, four" for _ in range(120)), "".join(rng.choices("ab .\n", k=4000))]
    items = spark.createDataFrame([(f"k{i}", t, 500, 40) for i, t in enumerate(texts)] + [("s", "short", 500, 40), ("n", None, 500, 40)], "item_key string, text string, max_chars int, overlap_chars int")
    results = []
    for size in (split.RANGE_CHARS, 97):
        cut = split.ranges(items.where("length(text) > max_chars"), size=size)
        pieces = split.plan_pieces(split.boundary_table(cut))
        got = defaultdict(list)
        for r in split.emit_pieces(pieces, cut, size).collect():
            got[r.item_key].append((r.piece_no, r.start, r.end, r.text))
        assert sorted(got) == [f"k{i}" for i in range(len(texts))]
        for i, t in enumerate(texts):
            _check_pieces(t, got[f"k{i}"], 500, 40)
        results.append({k: sorted(v) for k, v in got.items()})
    assert results[0] == results[1]
    assert all(t.endswith("\n\n") for _, _, e, t in results[0]["k3"] if e < len(texts[3]))


@pytest.mark.parametrize(("section", "group"), [(2, 1), (3, 7), (256, 1024)])
def test_sections_and_groups_cover_the_item(spark, monkeypatch, section, group):
    monkeypatch.setattr(split, "SECTION", section)
    monkeypatch.setattr(split, "GROUP", group)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc  .,\n", k=n)) for n in (4000, 501, 999)] + ["x" * 3000]
    items = spark.createDataFrame([(f"k{i}", t, 200, 30) for i, t in enumerate(texts)], "item_key string, text string, max_chars int, overlap_chars int")
    cut = split.ranges(items, size=61)
    got = defaultdict(list)
    for r in split.emit_pieces(split.plan_pieces(split.boundary_table(cut)), cut, 61).collect():
        got[r.item_key].append((r.piece_no, r.start, r.end, r.text))
    for i, t in enumerate(texts):
        assert [r[0] for r in sorted(got[f"k{i}"])] == list(range(len(got[f"k{i}"])))
        _check_pieces(t, got[f"k{i}"], 200, 30)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_giant_files_by_byte_ranges(spark, tmp_path, scheme):
    text = "".join(f"Satz {i} über die Größe. 会议{i}。\n" for i in range(4000))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    rows = [(r.piece_no, r.start, r.end, r.text) for r in split.split_files(spark, [scheme + str(path)], 3000, 100, size=4099).collect()]
    _check_pieces(text, rows, 3000, 100)


def test_split_tables_with_nulls_and_repeats(spark):
    par = spark.createDataFrame([("p1", "t", "y" * 3000), ("p1", "t", "y" * 3000), ("p2", None, None), ("p3", "z" * 300, "")], "id string, title string, content string")
    imp = spark.createDataFrame([("d1", [("a", "b" * 1501), None]), ("d2", None), ("d3", [])], "id string, paragraphs array<struct<title string, content string>>")
    limits = {("paragraph", "content"): (2000, 120), ("paragraph", "title"): (255, 0), ("document_import", "content"): (1500, 80)}
    pieces, _ = split.split_items(split.items_of(spark, {"paragraph": par, "document_import": imp}, limits))
    got = pieces.where("section = 0 and piece_in_section = 0").select(*split.key_parts()).collect()
    assert sorted(map(tuple, got)) == [("document_import", "d1", 0, "content"), ("paragraph", "p1", 0, "content"), ("paragraph", "p3", 0, "title")]


def _edited(rng, base):
    chars = list(base)
    for _ in range(rng.randint(0, 14)):
        chars[rng.randrange(len(chars))] = rng.choice("abcdefgh ")
    return "".join(chars)


@pytest.mark.parametrize("small_bucket", [neardup.SMALL_BUCKET, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(neardup, "CHUNK", 5)
    rng = random.Random(4)
    bases = ["".join(rng.choices("abcdefghij klm", k=400)) for _ in range(12)]
    texts = [_edited(rng, b) for b in bases for _ in range(8)] + [bases[0]] * 9
    rows = [(f"i{n:03}", t, n) for n, t in enumerate(texts)] + [("i000", texts[0], 99), (None, texts[0], 1), ("nul", None, 1), ("tiny", "abc", 1)]
    df = spark.createDataFrame(rows, "id string, content string, rid int")
    members, links = neardup.near_duplicates(df, "id", "content", 0.7, 300, 3000)
    want = {(f"i{a:03}", f"i{b:03}") for a in range(len(texts)) for b in range(a + 1, len(texts)) if neardup.jaccard(texts[a], texts[b]) >= 0.7}
    got = [tuple(r) for r in neardup.all_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and len(want - set(got)) <= 0.01 * len(want) and not set(got) - want
    stands = {r.id: r.class_id for r in neardup.classes(members).collect()}
    assert stands == {f"i{n:03}": min(f"i{m:03}" for m, o in enumerate(texts) if o == t) for n, t in enumerate(texts)}
    assert {(r.class_a, r.class_b) for r in neardup.class_links(members, links).collect()} == {tuple(sorted((stands[a], stands[b]))) for a, b in got if stands[a] != stands[b]}
    root = {r.id: r.group_id for r in neardup.groups(members, links).collect()}
    assert sorted(root) == [f"i{n:03}" for n in range(len(texts))] and all(root[a] == root[b] for a, b in got)
    same, like = neardup.alike(df, "id", "content", 0.7, 300)
    text_of = {r.rid: texts[int(r.id[1:])] for r in same.collect()}
    like = [tuple(r) for r in like.collect()]
    assert like and all(neardup.jaccard(text_of[a], text_of[b]) > 0.55 for a, b in like)
    empty = neardup.near_duplicates(df.limit(0), "id", "content", 0.7, 300, 3000)
    assert neardup.all_pairs(*empty).count() == 0 and neardup.groups(*empty).count() == 0


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_buckets_over_batches(monkeypatch, batch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    rng = random.Random(9)
    sizes = [1, 2, 4, 5, 9, 1, 12, 4, 3]
    h = np.array([k for k, n in enumerate(sizes) for _ in range(n)], dtype=np.int64)
    r = np.array(rng.sample(range(1000), len(h)), dtype=np.int64)
    buckets, pairs, large = neardup.Buckets(), set(), []
    parts = [(h[i : i + batch], r[i : i + batch], False) for i in range(0, len(h), batch)] + [(h[:0], r[:0], True)]
    for part in parts:
        for f in buckets.feed(*part):
            if f["b"].isna().all():
                large += list(zip(f["h"], f["a"], f["chunk"], strict=True))
            else:
                assert not (set(zip(f["a"], f["b"], strict=True)) & pairs)
                pairs |= set(zip(f["a"], f["b"], strict=True))
    rows = {k: [x for y, x in zip(h, r, strict=True) if y == k] for k in range(len(sizes))}
    assert pairs == {(min(a, b), max(a, b)) for k, v in rows.items() if len(v) <= 4 for i, a in enumerate(v) for b in v[:i]}
    assert sorted(large) == sorted((k, x, i // 3) for k, v in rows.items() if len(v) > 4 for i, x in enumerate(v))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 31)} == {0} and {got[k] for k in range(101, 140)} == {100} and got[201] == 200


def _brute(rows, k=5):
    """rows: id, source, vector; neighbours of other sources by cosine, ties by id."""
    ids = sorted(range(len(rows)), key=lambda i: rows[i][0])
    v = np.array([rows[i][2] for i in ids], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = (v @ v.T).round(9)
    out = {}
    for a, i in enumerate(ids):
        order = [b for b in np.argsort(-s[a], kind="stable") if b != a and (rows[i][1] is None or rows[ids[b]][1] != rows[i][1])]
        out[rows[i][0]] = [rows[ids[b]][0] for b in order[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    vectors = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.25, size=(1200, 64))
    rows = [(f"v{i:04}", None if i % 50 == 0 else f"s{i // 2}", vectors[i].astype(np.float32).tolist()) for i in range(1200)]
    bad = [("x1", "a", None, True), ("x2", "a", [0.0] * 64, True), ("x3", "a", [1.0] * 8, True), ("x4", "a", [1.0] * 64, False), ("x5", "a", [float("nan")] * 64, True)]
    data = [(i, s, v, True) for i, s, v in rows] + [(rows[0][0], rows[0][1], rows[0][2], True)] + bad
    df = spark.createDataFrame(data, "id string, source_id string, embedding array<float>, is_active boolean").withColumn("source", knn.F.lit("clash"))
    want = _brute(rows)
    for block_rows in (25_000, 150):
        got = defaultdict(dict)
        for r in knn.neighbours(df, block_rows=block_rows).collect():
            got[r.id][r.rank] = r.neighbour
        assert sorted(got) == sorted(want)
        hit = sum(len(set(want[i]) & set(got[i].values())) for i in want)
        assert hit / (5 * len(want)) >= 0.97
        assert all(len(x) == 5 for x in got.values())
    assert knn.neighbours(df.limit(0)).count() == 0


def test_blocks_lose_no_neighbour_of_the_traversal(spark):
    vectors = np.random.default_rng(3).normal(size=(600, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03}", f"s{i}", v.tolist(), True) for i, v in enumerate(vectors)], "id string, source_id string, embedding array<float>, is_active boolean")
    # 16-bit requests may change places of neighbours that are equally near
    one, many = ({(r.id, r.neighbour) for r in knn.neighbours(df, candidates=1000, block_rows=n, slack=1).collect()} for n in (25_000, 100))
    assert len(one) == len(many) == 3000 and len(one & many) >= 2997


def test_slack_loses_next_to_nothing(spark):
    rng = np.random.default_rng(4)
    vectors = (np.repeat(rng.normal(size=(40, 64)), 30, axis=0) + rng.normal(scale=0.4, size=(1200, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04}", f"s{i}", v.tolist(), True) for i, v in enumerate(vectors)], "id string, source_id string, embedding array<float>, is_active boolean")
    whole, as_shipped = ({(r.id, r.neighbour) for r in knn.neighbours(df, block_rows=100, slack=s).collect()} for s in (1, None))
    assert len(whole) == 6000 and len(whole & as_shipped) >= 0.999 * len(whole)


def test_hot_equal_vectors_are_exact(spark):
    one, other = [1.0] + [0.0] * 63, [0.9, 0.1] + [0.0] * 62
    rows = [(f"h{i:03}", f"s{i % 40}", one) for i in range(300)] + [(f"o{i}", "o", other) for i in range(3)]
    df = spark.createDataFrame([(i, s, v, True) for i, s, v in rows], "id string, source_id string, embedding array<float>, is_active boolean")
    got = defaultdict(list)
    for r in knn.neighbours(df).orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    assert got == _brute(rows)


def test_hot_equal_vectors_of_few_sources_are_exact(spark):
    one, two, other = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62, [0.9, 0.1] + [0.0] * 62
    rows = [(f"h{i:02}", "a", one) for i in range(30)] + [(f"g{i:02}", "b" if i < 20 else "c", two) for i in range(23)] + [(f"o{i}", f"o{i}", other) for i in range(3)]
    df = spark.createDataFrame([(i, s, v, True) for i, s, v in rows], "id string, source_id string, embedding array<float>, is_active boolean")
    for block_rows in (25_000, 1):
        got = defaultdict(list)
        for r in knn.neighbours(df, block_rows=block_rows).orderBy("id", "rank").collect():
            got[r.id].append(r.neighbour)
        assert got == _brute(rows)


def test_shingles_are_of_code_points():
    assert len(set(neardup.shingle_hashes("🙂🙂🙂🙂🙂a"))) == 2 and len(neardup.shingle_hashes("abcd")) == 0
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab会", k=rng.randint(0, 40))) for _ in range(2))
        assert neardup.overlap(*(np.unique(neardup.shingle_hashes(t)) for t in (a, b))) == neardup.jaccard(a, b)
    assert neardup.jaccard("abcdef", "abcdef") == 1 and neardup.jaccard("", "") == 0
    assert Counter(len(neardup.signature("x" * n, *neardup._functions())) for n in (5, 5000)) == {neardup.HASHES: 2}
