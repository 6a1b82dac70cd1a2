import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import embedders
from vectrail.operators import cache, exact, filters, hnsw, hybrid, ingest, segments
from vectrail.schemas import Collection, Metric


def vectors(spark, x, status=None):
    return spark.createDataFrame([(i, v.tolist(), 1 if status is None else status[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, status int")


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(101).standard_normal((200, 64)).astype(np.float32)


@pytest.mark.parametrize("metric", list(Metric))
def test_exact_against_numpy(spark, data, metric):
    q = data[3].tolist()
    want = exact.scores(metric, data.astype(float), np.array(q, dtype=float)).round(6)
    order = np.lexsort((np.arange(200), -want if metric.descending else want))[:7]
    for search in (exact.exact_topk, exact.blocked_topk):
        got = search(vectors(spark, data), q, 7, metric).collect()
        assert [r["vec_id"] for r in got] == order.tolist()
        assert [r["score"] for r in got] == pytest.approx(want[order].tolist(), abs=2e-6)


def test_filters_come_before_the_top_k(spark, data):
    rows, ids = vectors(spark, data), spark.createDataFrame([(150,), (151,), (152,)], "vec_id long")
    assert {r["vec_id"] for r in exact.exact_topk(rows, data[0].tolist(), 3, ids=ids).collect()} == {150, 151, 152}
    assert exact.exact_topk(rows, data[0].tolist(), 3, ids=ids.limit(0)).count() == 0
    assert exact.exact_topk(vectors(spark, data, [2] * 200), data[0].tolist()).count() == 0


def test_plans(spark, data):
    plan = exact.exact_topk(vectors(spark, data), data[0].tolist(), 3, ids=spark.createDataFrame([(1,)], "vec_id long"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan


def metadata(spark):
    return spark.createDataFrame([(1, "category", '"db"'), (2, "category", '"web"'), (3, "category", '"db"'), (3, "priority", "1")], "chunk_id long, key string, value string")


def test_filter_resolution(spark):
    m = metadata(spark)
    ids = lambda f: {r[0] for r in filters.resolve(m, f, "chunk_id").collect()}
    assert ids({"category": "db"}) == {1, 3} and ids({"category": "db", "priority": 1}) == {3} and ids({"category": "x"}) == set() == ids({})
    assert ids({"priority": "1"}) == set() and ids({"priority": 1.0}) == {3}


def test_selectivity(spark):
    rows = [(i, "cat", '"A"' if i < 6 else '"B"') for i in range(10)] + [(i, "pri", "1" if i < 4 else "2") for i in range(10)]
    m = spark.createDataFrame(rows, "id long, key string, value string")
    share = lambda f, keys=10: filters.selectivity(m, f, spark.range(keys), "id").first()[0]
    assert [share({"cat": "A"}), share({"cat": "B"}), share({"pri": 1}), share({"cat": "A", "pri": 1}), share({"cat": "A", "pri": 2}), share({"cat": "C"}), share({}), share({"cat": "A"}, 0)] == [0.6, 0.4, 0.4, 0.4, 0.2, 0.001, 1.0, 1.0]


def test_segments(spark):
    rows = spark.createDataFrame([(i * 3, 2 if i == 2 else 1) for i in range(4)], "vec_id long, status int")
    placed = segments.assign(rows, "vec_id", 3)
    assert [(r["segment_id"], r["vector_idx"]) for r in placed.orderBy("vec_id").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    s = {r["segment_id"]: r for r in segments.stats(placed, 3).collect()}
    assert (s[0]["state"], s[0]["deleted"], s[1]["state"]) == ("sealed", 1, "growing")
    done = segments.compact(placed, 100).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["segment_id"], r["vector_idx"]) for r in done] == [(0, 0, 0), (3, 0, 1), (9, 0, 2)]
    assert segments.lookup(placed, 0, 1).first()["vec_id"] == 3 and segments.lookup(placed, 0, 3).count() == 0


def test_ordinals_over_many_ranges(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7 % 1009).alias("k"))
    got = [r["ordinal"] for r in segments.ordinals(rows, "k", per_range=90, start=5).orderBy("k").collect()]
    assert got == list(range(5, 1005))


def test_thousands_of_ranges(spark):
    rows = spark.range(0, 20_000).select((F.col("id") * 7919 % 20_011).alias("k"))
    got = [r["ordinal"] for r in segments.ordinals(rows, "k", per_range=4).orderBy("k").collect()]  # 5000 ranges
    assert got == list(range(20_000))
    cuts = list(range(0, 50_000, 10))
    places = spark.createDataFrame([(x,) for x in (-1, 0, 1, 10, 11, 49_990, 49_991)], "x long").select(segments.range_of(F.col("x"), cuts, "bigint").alias("n"))
    assert [r["n"] for r in places.collect()] == [0, 0, 1, 1, 2, 4999, 5000]
    halves = spark.createDataFrame([(i / 2,) for i in range(300)], "k double")
    assert [r["ordinal"] for r in segments.ordinals(halves, "k", per_range=20).orderBy("k").collect()] == list(range(300))


@pytest.mark.parametrize("metric", list(Metric))
def test_vectors_that_are_no_neighbours(spark, data, metric):
    """Null, short, empty vectors, and those with a null or NaN within, in rows and in queries."""
    good = [(i, data[i].tolist(), 1) for i in range(30)]
    hole = [float(x) for x in data[0]]
    bad = [(100, None, 1), (101, hole[:63], 1), (102, [], 1), (103, [None, *hole[1:]], 1), (104, [float("nan"), *hole[1:]], 1)]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, status int")
    q = data[3].tolist()
    want = [(r["vec_id"], r["score"]) for r in exact.exact_topk(rows.where("vec_id < 100"), q, 50, metric).collect()]
    assert len(want) == 30
    for search in (exact.exact_topk, exact.blocked_topk):
        assert [(r["vec_id"], pytest.approx(r["score"], abs=2e-6)) for r in search(rows, q, 50, metric).collect()] == want
    queries = spark.createDataFrame([(1, q), (2, None), (3, q[:63]), (4, [None, *q[1:]])], "query_id long, query_vector array<float>")
    got = exact.batch_knn(rows, queries, 50, metric).collect()
    assert sorted({r["query_id"] for r in got}) == [1, 3] and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1] == [k for k, _ in want]
    assert {r["vec_id"] for r in got if r["query_id"] == 3} == {101}
    texts = spark.createDataFrame([(r[0], "alpha") for r in good + bad], "vec_id long, text string")
    assert {r["vec_id"] for r in hybrid.hybrid_topk(rows, texts, q, "alpha", 50, metric=metric).collect()} == set(range(30))
    placed = segments.assign(rows, "vec_id", 100)
    assert {r["vec_id"] for r in hnsw.ann_topk(placed, hnsw.build_index(placed, metric), q, 50, metric, ef=64).collect()} == set(range(30))
    assert exact.batch_knn(rows, queries.limit(0), 3).count() == 0


def test_queries_in_parts(spark, data, monkeypatch):
    rows = vectors(spark, data)
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, exact.batch_knn(rows, queries, 4, "l2").collect()))
    monkeypatch.setattr(exact, "QUERY_BYTES", 8 * 64 * 3)
    monkeypatch.setattr(exact, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, exact.batch_knn(rows, queries, 4, "l2").collect())) == whole and len(whole) == 80
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r["vec_id"] for r in exact.batch_knn(ties, one, 25).orderBy("rank").collect()] == list(range(25))


def test_should_compact(spark):
    check = lambda sizes: segments.should_compact(spark.createDataFrame(list(enumerate(sizes)), "segment_id long, records long"), 10).first()["should_compact"]
    assert check([2, 3, 10]) and not check([2, 10]) and not check([2]) and not check([5, 5])


def test_hybrid(spark):
    texts = ["apple red sweet"] * 4 + ["yellow banana fruits"] * 2
    e = embedders.Gaussian(16)
    rows = spark.createDataFrame([(i, e.one(t), 1) for i, t in enumerate(texts)], "vec_id long, embedding array<float>, status int")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "vec_id long, text string")
    top = hybrid.hybrid_topk(rows, docs, e.one("yellow fruits"), "yellow fruits", 3).collect()
    assert [r["vec_id"] for r in top[:2]] == [4, 5] and top[0]["keyword"] == 1.0
    only = spark.createDataFrame([(i,) for i in range(4)], "vec_id long")
    assert {r["vec_id"] for r in hybrid.hybrid_topk(rows, docs, e.one("yellow fruits"), "yellow fruits", 9, ids=only).collect()} == {0, 1, 2, 3}
    hits = hybrid.hydrate(hybrid.hybrid_topk(rows, docs, e.one("apple"), "apple", 2), docs, "vec_id", ["text"]).collect()
    assert {r["payload"]["text"] for r in hits} == {"apple red sweet"}


def test_graph_recall_and_degrees(data):
    g = hnsw.build(data, Metric.COSINE)
    found = []
    for q in data[:15].astype(float):
        truth = set(np.lexsort((np.arange(200), -exact.scores(Metric.COSINE, data.astype(float), q)))[:5].tolist())
        found.append(len(truth & {n for _, n in g.search(q, 5)}) / 5)
    assert np.mean(found) >= 0.9
    assert all(len(x) <= 32 for x in g.links[0].values()) and all(len(x) <= 16 for layer in g.links[1:] for x in layer.values())
    assert hnsw.build(data[:0]).search(data[0], 3) == []


def test_graph_filter_fills_k(data):
    g = hnsw.build(data, Metric.L2)
    ok = np.zeros(200, dtype=bool)
    ok[::10] = True
    hits = g.search(data[1].astype(float), 5, 64, ok)
    assert len(hits) == 5 and all(ok[n] for _, n in hits)


def test_index_in_spark(spark, data):
    rows = segments.assign(vectors(spark, data, [2 if i == 7 else 1 for i in range(200)]), "vec_id", 80)
    sealed = rows.where("segment_id < 2")
    index = hnsw.build_index(sealed)
    got = hnsw.ann_topk(rows, index, data[7].tolist(), 10, ef=64).collect()
    want = exact.exact_topk(rows, data[7].tolist(), 10).collect()
    assert 7 not in [r["vec_id"] for r in got] and len(set(r["vec_id"] for r in got) & set(r["vec_id"] for r in want)) >= 9
    again = hnsw.build_index(sealed).orderBy("vec_id").collect()
    assert again == index.orderBy("vec_id").collect()


def test_ingest(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, ""), (4, "ghi"), (5, None)], "doc_id long, text string")
    from vectrail.functions.chunking import Fixed

    c = Collection("c", 8, segment_capacity=2)
    got = ingest.ingest(docs, c, chunker=Fixed(2))
    assert (got.documents.count(), got.chunks.count()) == (2, 5)
    assert sorted((r["segment_id"], r["vector_idx"]) for r in got.embeddings.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert ingest.ingest(docs, c, existing=got.documents, chunker=Fixed(2)).documents.count() == 0
    with pytest.raises(ValueError):
        ingest.ingest(docs, c, embedder=embedders.FeatureHash(9))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_moves_texts_once(spark):
    from vectrail.functions.chunking import Recursive

    # One row twice, one key with two texts, and a copy of a larger key.
    docs = spark.createDataFrame([(2, "abcdef"), (2, "abcdef"), (2, "ghi"), (5, "ghi"), (1, "jk"), (None, "l")], "doc_id long, text string")
    for chunker in (ingest.chunking.Fixed(2), Recursive(2, 0, [""])):
        got = ingest.ingest(docs, Collection("c", 8, segment_capacity=4), chunker=chunker, start=3)
        for made in (got.chunks, got.embeddings, got.documents, got.audit):
            assert "Exchange" not in plan_of(made)  # from written copies, with nothing to shuffle
        places = sorted((r["segment_id"], r["vector_idx"], r["source_key"], r["chunk_index"]) for r in got.embeddings.collect())
        assert [4 * s + i for s, i, *_ in places] == list(range(3, 9)) and places[0][2:] == (1, 0)
        assert sorted(r["text_content"] for r in got.chunks.collect()) == ["ab", "cd", "ef", "gh", "i", "jk"]
        assert {r["id"] for r in got.chunks.collect()} == {r["chunk_id"] for r in got.embeddings.collect()} and got.documents.count() == got.audit.count() == 3
    other = ingest.new_documents(docs.union(spark.createDataFrame([(9, "new")], docs.schema)), Collection("c", 8))
    with pytest.raises(RuntimeError, match="changed"):
        ingest.ingest(docs, Collection("c", 8), new=other).chunks  # noqa: B018


def test_cache(spark, data):
    rows = segments.assign(vectors(spark, data[:30]), "vec_id", 10)
    c = cache.SegmentCache.of(rows, max_bytes=2 * 10 * 64 * 4 + 100)
    assert c.row(0, 3)["vec_id"] == 3 and c.row(1, 0)["vec_id"] == 10 and (c.hits, c.misses, c.hit_ratio) == (0, 2, 0.0)
    c.row(0, 1)
    c.segment(2)  # segment 1 was used least recently
    assert 0 in c and 1 not in c and 2 in c and c.hit_ratio == 0.25
    with pytest.raises(IndexError):
        c.row(0, 10)
    c.clear()
    assert 0 not in c and c.bytes == 0 and c.hit_ratio == 0.0


def test_cache_finds_all_sizes_at_once(spark, data):
    rows = segments.assign(vectors(spark, data[:120]), "vec_id", 4).persist()
    rows.count()
    sc = spark.sparkContext
    sc.setJobGroup("cache-sizes", "")
    c = cache.SegmentCache.of(rows, max_bytes=10 * 4 * 64 * 4)
    for s in range(30):
        c.segment(s)
    c.segment(99)  # no such segment
    jobs = len(sc.statusTracker().getJobIdsForGroup("cache-sizes"))
    sc.setJobGroup("", "")
    assert jobs < 10 and c.misses == 31 and c.bytes == 10 * 4 * 64 * 4 and 19 not in c and 20 in c
    c.clear()
    rows.unpersist()
    assert c.bytes == 0


def test_tables(spark):
    from vectrail import schemas

    for t in schemas.TABLES:
        spark.sql(schemas.ddl(t))
        assert spark.table(t).columns == schemas.TABLES[t].fieldNames()
        spark.sql(f"DROP TABLE {t}")
    with pytest.raises(ValueError):
        Collection("c", 3).check([1.0])


def test_delete_and_soft_delete(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1)], "vec_id long, status int")
    gone = spark.createDataFrame([(2,), (2,), (9,)], "vec_id long")
    assert {(r["vec_id"], r["status"]) for r in segments.mark_deleted(rows, gone, "vec_id").collect()} == {(1, 1), (2, 2)}
    every = {"documents": spark.createDataFrame([("a",), ("b",)], "id string"), "chunks": spark.createDataFrame([("a0", "a"), ("b0", "b")], "id string, document_id string"), "embeddings": spark.createDataFrame([("a0",), ("b0",)], "chunk_id string"), "metadata": spark.createDataFrame([("a", "a0"), ("b", "b0")], "document_id string, chunk_id string")}
    left = segments.delete_cascade(every, every["documents"].where("id = 'a'"))
    assert all(df.count() == 1 for df in left.values())


def store_of(spark, tmp_path, x, capacity=50):
    from vectrail.operators import lifecycle
    from vectrail.sources.store import Store

    s = Store(spark, f"file://{tmp_path}/c")
    lifecycle.add_vectors(s, vectors(spark, x), capacity)
    return s, lifecycle


def test_sealed_segments_have_graphs(spark, data, tmp_path):
    s, lifecycle = store_of(spark, tmp_path, data[:120])
    assert {r[0] for r in s.read("graphs").select("segment_id").distinct().collect()} == {0, 1}
    more = spark.createDataFrame([(i, data[i].tolist(), 1) for i in range(120, 160)], "vec_id long, embedding array<float>, status int")
    lifecycle.add_vectors(s, more, 50)  # the growing segment fills up and is sealed
    assert {r[0] for r in s.read("graphs").select("segment_id").distinct().collect()} == {0, 1, 2} and lifecycle.unindexed(s, 50).count() == 0
    assert [(r["segment_id"], r["count"]) for r in s.read("vectors").groupBy("segment_id").count().orderBy("segment_id").collect()] == [(0, 50), (1, 50), (2, 50), (3, 10)]
    q = data[7].tolist()
    names = lifecycle.of_store(s, ef=50)
    exact_rows, graph_rows = (names.get(n)(q, 10, None).collect() for n in ("EXACT", "HNSW"))
    assert [r["vec_id"] for r in exact_rows] == [r["vec_id"] for r in graph_rows]
    only = spark.createDataFrame([(i,) for i in range(40, 60)], "vec_id long")
    assert {r["vec_id"] for r in names.get("hnsw")(q, 30, only).collect()} == set(range(40, 60))


def test_compaction_redirects_and_rolls_back(spark, data, tmp_path, monkeypatch):
    s, lifecycle = store_of(spark, tmp_path, data[:150])
    assert not lifecycle.compact(s, 50)  # nothing to do
    lifecycle.delete_vectors(s, spark.createDataFrame([(i,) for i in range(0, 100, 3)], "vec_id long"))
    before = sorted(map(tuple, s.read("vectors").select("vec_id", "status", "segment_id", "vector_idx").collect()))
    number = s.manifest()["number"]
    with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
        m.setattr(lifecycle.hnsw, "build_index", lambda *a: 1 / 0)
        lifecycle.compact(s, 50)
    assert s.manifest()["number"] == number and sorted(map(tuple, s.read("vectors").select("vec_id", "status", "segment_id", "vector_idx").collect())) == before
    old = s.staged(s.read("vectors").where("status = 1").select("vec_id", "segment_id", "vector_idx"), "old")
    assert lifecycle.compact(s, 50)
    now = {r["vec_id"]: (r["segment_id"], r["vector_idx"]) for r in s.read("vectors").collect()}
    live = [v for v, status, *_ in before if status == 1]
    assert sorted(now) == live and {p[0] for p in now.values()} == {2, 3, 4}
    assert {r[0] for r in s.read("graphs").select("segment_id").distinct().collect()} == {2, 3}
    assert {r["vec_id"]: (r["segment_id"], r["vector_idx"]) for r in lifecycle.redirected(s, old).collect()} == now
    q = data[8].tolist()
    names = lifecycle.of_store(s, ef=50)
    assert [r["vec_id"] for r in names.get("EXACT")(q, 8, None).collect()] == [r["vec_id"] for r in names.get("HNSW")(q, 8, None).collect()]
    # A second compaction: redirects of the first lead on.
    lifecycle.delete_vectors(s, spark.createDataFrame([(i,) for i in range(100, 150)], "vec_id long"))
    assert lifecycle.compact(s, 50)
    now = {r["vec_id"]: (r["segment_id"], r["vector_idx"]) for r in s.read("vectors").collect()}
    moved = {r["vec_id"]: (r["segment_id"], r["vector_idx"]) for r in lifecycle.redirected(s, old).collect()}
    assert set(now) == {v for v in live if v < 100} and all(moved[v] == p for v, p in now.items())
    gone = s.vacuum()
    assert gone and s.read("vectors").count() == len(now) and s.vacuum() == []


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_small_graphs_are_built_from_one_table_of_distances(data, metric, monkeypatch):
    calls = []
    whole = hnsw.Graph.distance
    monkeypatch.setattr(hnsw.Graph, "distance", lambda g, q, nodes: calls.append(1) or whole(g, q, nodes))
    x = np.concatenate([data[:90], data[:10]])  # with copies
    a = hnsw.build(x, Metric.of(metric), seed=3)
    assert len(calls) == len(x) and a.pairs is None
    monkeypatch.setattr(hnsw, "PAIRS", 10)
    b = hnsw.build(x[:90], Metric.of(metric), seed=3)
    monkeypatch.setattr(hnsw, "PAIRS", 90)
    c = hnsw.build(x[:90], Metric.of(metric), seed=3)
    assert (b.levels, b.links, b.entry) == (c.levels, c.links, c.entry)


@pytest.mark.parametrize(("metric", "ef"), [("cosine", 40), ("l2", 100), ("dotproduct", 100)])
def test_many_queries_find_what_single_ones_find(data, metric, ef):
    g = hnsw.build(data[:100], Metric.of(metric), seed=2)
    ok = np.arange(100) % 3 > 0
    for allowed in (None, ok, np.zeros(100, dtype=bool)):
        d, nodes = g.search_many(data[100:150], 10, ef, allowed)
        for q, ds, ns in zip(data[100:150], d, nodes, strict=True):
            one = g.search(q, 10, ef, allowed)
            assert [n for _, n in one] == ns[~np.isnan(ds)].tolist()
            assert [x for x, _ in one] == pytest.approx(ds[~np.isnan(ds)].tolist(), abs=1e-6)
    assert hnsw.Graph(Metric.of(metric), hnsw.Parameters(), data[:0]).search_many(data[:2], 3)[0].shape == (2, 0)


def test_results_of_many_queries_do_not_grow_with_segments(spark, data, monkeypatch):
    rows = segments.assign(vectors(spark, data), "vec_id", 10)
    index = hnsw.build_index(rows)
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 200, 2)], "query_id long, query_vector array<float>")
    few = queries.where("query_id < 40")
    one = hnsw.search_index(index, rows, few, 3, 10)
    many = hnsw.search_index(index, rows, queries, 3, 10)
    assert one.groupBy("query_id").count().first()[1] == 20 * 6  # six of each of 20 segments
    assert many.count() == 100 * 6  # and of a block of all
    monkeypatch.setattr(hnsw, "DENSE", 0)
    plain = hnsw.search_index(index, rows, queries, 3, 10)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, plain.collect()))
    truth = exact.batch_knn(rows, queries, 3)
    assert {r["recall"] for r in exact.recall(many.orderBy("query_id").join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]), truth, 3).collect()} == {1.0}


def test_hybrid_over_graphs(spark, data):
    rows = segments.assign(vectors(spark, data), "vec_id", 80)
    index = hnsw.build_index(rows.where("segment_id < 2"))
    texts = spark.createDataFrame([(i, "green apple" if i % 9 == 0 else "stone") for i in range(200)], "vec_id long, text string")
    q = data[5].tolist()
    got = hybrid.hybrid_ann_topk(rows, index, texts, q, "green apple", 6, ef=80, overfetch=20).collect()
    want = hybrid.hybrid_topk(rows, texts, q, "green apple", 6).collect()
    assert [r["vec_id"] for r in got] == [r["vec_id"] for r in want] and [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=2e-6)


def test_graph_statistics(spark, data):
    from vectrail.plans import stats

    rows = segments.assign(vectors(spark, data[:100]), "vec_id", 50)
    index = hnsw.build_index(rows).persist()
    r = stats.collection_statistics(rows, index, 50).first()
    graphs = [hnsw.build(data[i : i + 50], seed=i // 50) for i in (0, 50)]
    assert (r["graph_nodes"], r["graph_layers"]) == (100, max(len(g.links) for g in graphs))
    assert r["average_degree"] == pytest.approx(np.mean([len(x) for g in graphs for x in g.links[0].values()]))


def test_graph_snapshots(spark, data, tmp_path):
    from vectrail.sources import graph_files

    rows = segments.assign(vectors(spark, data[:100]), "vec_id", 50)
    index = hnsw.build_index(rows).persist()
    folder = f"file://{tmp_path}/snap"
    sizes = graph_files.snapshot(index, folder, "cosine", hnsw.Parameters(ef_search=40)).collect()
    assert sorted((r["segment_id"], r["nodes"]) for r in sizes) == [(0, 50), (1, 50)]
    back = graph_files.restore(spark, folder)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.select(*back.columns).collect()))
    assert graph_files.metadata(spark, folder)["ef_search"] == 40 and sorted(r["nodes"] for r in graph_files.headers(spark, folder).collect()) == [50, 50]
    q = data[9].tolist()
    assert hnsw.ann_topk(rows, back, q, 5).collect() == hnsw.ann_topk(rows, index, q, 5).collect()
    at = tmp_path / "snap" / "graph-0.bin"
    at.write_bytes(at.read_bytes()[:-40])
    with pytest.raises(Exception, match="cut off"):
        graph_files.restore(spark, folder).count()


def test_jdbc(spark):
    from vectrail.sources.store import jdbc

    url = "jdbc:derby:memory:vectrail;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    rows.write.jdbc(url, "things", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = jdbc(spark, url, "things", "id", (0, 20), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted((r[0], r[1]) for r in got.collect()) == [(i, f"n{i}") for i in range(20)]
