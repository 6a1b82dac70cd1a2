import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.functions import chunking, embedders
from vectrail.functions import text as X
from vectrail.functions import vectors as V
from vectrail.schemas import Collection, Metric
from vectrail.sources import graph_files, segment_files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_measures_of_basis_vectors(spark):
    u, v, w, z = (V.literal(x) for x in ((1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 0)))
    r = one(spark, a=V.cosine(u, v), b=V.cosine(u, w), c=V.l2(u, v), d=V.l2(u, w), e=V.dot(u, v), f=V.dot(u, w), g=V.manhattan(u, v), h=V.manhattan(u, w), i=V.cosine(u, z), j=V.cosine_distance(u, z), k=V.normalised(V.literal((3, 4))), m=V.normalised(z))
    assert [r[x] for x in "abcdefgh"] == [0, 1, pytest.approx(math.sqrt(2)), 0, 0, 1, 2, 0]
    assert (r["i"], r["j"]) == (0, 1) and r["k"] == [0.6, 0.8] and r["m"] == [0, 0, 0]


def test_metrics_by_name():
    assert Metric.of("EUCLIDEAN") is Metric.L2 is Metric.of("l2") and Metric.of("DotProduct") is Metric.DOT and Metric.of("Cosine").descending
    with pytest.raises(ValueError):
        Metric.of("hamming")
    with pytest.raises(ValueError):
        Collection("c", 0)


def test_wrong_length_is_an_error(spark):
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, v=V.checked(V.literal((1, 2)), 3))


def chunks(spark, chunker, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r["chunk"] for r in chunker.chunk(df, "text").orderBy("chunk_index").collect()]


def test_fixed_and_sliding(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    assert chunks(spark, chunking.Fixed(10), alphabet) == ["abcdefghij", "klmnopqrst", "uvwxyz"]
    assert chunks(spark, chunking.Sliding(10, 4), "abcdefghijkl") == ["abcdefghij", "ghijkl"]
    assert chunks(spark, chunking.Fixed(2), "é😀x") == ["é😀", "x"] and chunks(spark, chunking.Fixed(10), "") == []
    assert chunks(spark, chunking.Sliding(10, 4), "abc") == ["abc"]
    with pytest.raises(ValueError):
        chunking.Sliding(10, 10)


def test_recursive(spark):
    out = chunks(spark, chunking.Recursive(15, 5, ["\n", " "]), "hello world\nthis is a test\nof recursive chunking")
    assert out and all(len(c) <= 15 for c in out)
    assert chunks(spark, chunking.Recursive(), "") == [""] and chunks(spark, chunking.Recursive(), None) == []
    # Parts are carried over whatever the length becomes.
    assert chunking.pack("aaaaaaaaaa bbbb ccccccccccccccc", 15, 5, [" "])[1] == "bbbb ccccccccccccccc"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(1, 12), st.integers(0, 6))
def test_recursive_bounds(text, size, overlap):
    separators = ["\n\n", "\n", " ", ""]
    out = chunking.pack(text, size, overlap, separators)
    assert all(len(c) <= size + overlap + 2 for c in out)
    assert {c for c in "".join(out) if c not in " \n"} == {c for c in text if c not in " \n"}
    if overlap == 0 and text.strip():
        assert "".join("".join(out).split()) == "".join(text.split())


def test_semantic(spark):
    text = "red apples taste sweet. red apples taste sweet! database systems write logs."
    out = chunks(spark, chunking.Semantic(embedders.FeatureHash(256), 0.5), text)
    assert out == ["red apples taste sweet. red apples taste sweet!", "database systems write logs."]


def test_gaussian_embedder(spark):
    e = embedders.Gaussian(128)
    a, b, c = e.one("apples are red"), e.one("red are Apples!"), e.one("databases")
    assert a == b and a != c and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not any(e.one(" ... "))
    df = spark.createDataFrame([(1, "apples are red"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in e.embed(df, "text", ["id"]).collect()}
    assert got[1] == pytest.approx(a) and not any(got[2])


def plain_gaussian(text, dimension):
    v = np.sum([embedders.gaussian_word(w, dimension) for w in (text or "").split()] or [np.zeros(dimension)], axis=0)
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)


def test_gaussian_vectors_equal_single_generators(monkeypatch):
    seeds = np.array([0, 1, 7, 2**31, 2**32 - 1])
    assert embedders.seeds_of(seeds).tolist() == [np.random.SeedSequence(int(n)).generate_state(4, np.uint64).tolist() for n in seeds]
    r = np.random.default_rng(3)
    texts = [" ".join(f"W{x}{'.' * (x % 3)}" for x in r.integers(0, 500, n)) for n in (900, 1, 40, 333)] + [None, "", " ... ", "\u00c9t\u00e9 stra\u00dfe"]
    monkeypatch.setattr(embedders, "BLOCK", 100)
    monkeypatch.setattr(embedders, "_kept", {16: embedders.Words(16, 120)})  # words are dropped and made again
    assert np.array_equal(embedders.gaussian_vectors(texts, 16), [plain_gaussian(t, 16) for t in texts])
    assert len(embedders._kept[16].at) <= 120


def test_new_words_cost_no_generator_each(monkeypatch):
    monkeypatch.setattr(embedders, "_kept", {})
    monkeypatch.setattr(np.random, "default_rng", lambda *a: 1 / 0)
    assert embedders.gaussian_vectors([" ".join(f"w{i}" for i in range(2000))], 8).any()


def test_feature_hash(spark):
    df = spark.createDataFrame([(1, "Red, apples"), (2, "apples red"), (3, ""), (4, None)], "id long, text string")
    got = {r["id"]: r["v"] for r in embedders.FeatureHash(64).embed(df, "text", ["id"], "v").collect()}
    assert got[1] == got[2] and np.linalg.norm(got[1]) == pytest.approx(1) and not any(got[3]) and not any(got[4])


def test_remote_embedder_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    e = embedders.Remote(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, batch=2)
    assert sorted((r["id"], r["embedding"][0]) for r in e.embed(df, "text", ["id"]).collect()) == [(i, float(i)) for i in range(5)]


def test_text_functions(spark):
    r = one(spark, s=X.sentences(F.lit("One. Two?  Three! ")), n=X.token_count(F.lit("  a b\tc\n")), k=X.keyword_score(F.lit("Sweet red FRUIT"), X.query_words("fruit is red red")), z=X.keyword_score(F.lit("x"), []), w=X.clean_word(F.lit("Éa-1!")))
    assert (r["s"], r["n"], r["w"]) == (["One.", "Two?", "Three!"], 3, "éa1") and r["k"] == 1.0 and r["z"] == 0


def test_json_equality(spark):
    r = one(spark, a=X.json_equal(F.lit('{"b":1,"a":1.0}'), '{"a": 1, "b": 1}'), b=X.json_equal(F.lit('"1"'), "1"), c=X.json_equal(F.lit("true"), "1"), d=X.json_equal(F.lit("[1,2]"), "[2,1]"))
    assert (r["a"], r["b"], r["c"], r["d"]) == (True, False, False, False)


def records(n, dim=3):
    return [segment_files.Record(uuid.UUID(int=i + 1), [float(i), 0.5, -1.0][:dim], segment_files.payload(i=i, t="é"), 2 if i == 1 else 1) for i in range(n)]


def test_segment_file_round_trip():
    seg = uuid.UUID(int=9)
    data = segment_files.encode(seg, records(3), 3)
    assert segment_files.decode(data, 3) == (seg, records(3)) and segment_files.decode(segment_files.encode(seg, [], 3), 3) == (seg, [])
    for broken in (b"x" * 10, b"NOPE" + data[4:], data[:-1] + b"!"):
        with pytest.raises(ValueError):
            segment_files.decode(broken, 3)
    with pytest.raises(ValueError):
        segment_files.encode(seg, records(2), 4)


def test_segment_files_in_spark(spark, tmp_path):
    a, b = str(uuid.UUID(int=7)), str(uuid.UUID(int=8))
    rows = spark.createDataFrame([(a, 0, str(uuid.UUID(int=1)), [1.0, 2.0], "{}", 1), (a, 1, str(uuid.UUID(int=2)), [3.0, 4.0], None, 2), (b, 0, str(uuid.UUID(int=3)), [5.0, 6.0], '{"k":1}', 1)], segment_files.SCHEMA)
    assert {(r["segment_id"], r["records"]) for r in segment_files.write_segments(rows, str(tmp_path), 2).collect()} == {(a, 2), (b, 1)}
    want = {(r["segment_id"], r["vector_idx"], r["id"], tuple(r["vector"]), r["payload"] or "{}", r["status"]) for r in rows.collect()}
    got = segment_files.read_segments(spark, str(tmp_path), 2)
    assert {(r["segment_id"], r["vector_idx"], r["id"], tuple(r["vector"]), r["payload"], r["status"]) for r in got.collect()} == want
    spark.dataSource.register(segment_files.SegmentSource)
    assert spark.read.format("vseg").option("dimension", 2).load(str(tmp_path)).count() == 3


def test_graph_file_round_trip():
    ids = [uuid.UUID(int=i) for i in range(1, 4)]
    nodes = [graph_files.Node(ids[0], ids[2], 0, [[ids[1], ids[2]], [ids[1]]]), graph_files.Node(ids[1], ids[2], 1, [[ids[0]], [ids[0]]]), graph_files.Node(ids[2], ids[2], 2, [[]])]
    data = graph_files.encode(nodes, ids[0])
    assert graph_files.decode(data) == (nodes, ids[0]) and graph_files.header(data)["max_level"] == 1
    assert graph_files.decode(graph_files.encode([], None)) == ([], None)
    for broken in (b"", b"X" * 64, data[:-3]):
        with pytest.raises(ValueError):
            graph_files.decode(broken)


def plain_pack(text, size, overlap, separators):
    """The published packing, in plain steps: split at the first separator, pack greedily, carry parts over."""
    if len(text) <= size:
        return [text]
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(separators[0]) if separators[0] else list(text)
    groups, group = [], []
    joined = lambda g: separators[0].join(g)
    for part in parts:
        if len(part) > size:
            if group:
                groups.append(joined(group))
            group = []
            groups += plain_pack(part, size, overlap, separators[1:])
        elif group and len(joined([*group, part])) > size:
            groups.append(joined(group))
            carried = []
            while len(carried) < len(group) and sum(len(x) + len(separators[0]) for x in carried) + len(group[-1 - len(carried)]) <= overlap:
                carried = group[len(group) - len(carried) - 1 :]
            group = [*carried, part]
        else:
            group.append(part)
    return [*groups, joined(group)] if group else groups


def test_recursive_chunks_against_plain_packing(spark):
    import random

    r = random.Random(8)
    texts = ["".join(r.choices(["a", "bb ", "ccc", " ", "\n", "\n\n", "dddddd"], k=r.randint(0, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    got = {}
    for x in chunking.Recursive(20, 7).chunk(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(x["doc_id"], []).append(x["chunk"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_pack(t, 20, 7, ("\n\n", "\n", " ", "")), t
    assert 999 not in got


def test_semantic_chunks_of_rows_that_share_an_id(spark):
    text = "Red apples grow. Red apples fall. Blue whales swim."
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, k string")
    got = sorted((r["k"], r["chunk_index"], r["chunk"]) for r in chunking.Semantic(embedders.FeatureHash(256), 0.4).chunk(docs).collect())
    assert got == [(k, i, c) for k in "xy" for i, c in enumerate(["Red apples grow. Red apples fall.", "Blue whales swim."])]


def test_gaussian_vectors_in_plain_steps(spark):
    import hashlib

    import numpy as np

    texts = ["Alpha beta, alpha!", "", None, "!!", "beta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in embedders.Gaussian(16).embed(rows, "text", ["doc_id"]).collect():
        total = np.zeros(16)
        for w in (texts[r["doc_id"]] or "").split():
            clean = "".join(c for c in w.lower() if c.isalnum())
            if clean:
                total += np.random.default_rng(int(hashlib.sha256(clean.encode()).hexdigest()[:8], 16)).standard_normal(16)
        n = np.sqrt((total**2).sum())
        assert r["embedding"] == pytest.approx((total / n if n else total).tolist(), abs=1e-6)
