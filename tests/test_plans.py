import pytest

from vectrail.plans.cost import HNSW, CostEstimate, CostEstimator, Cpu, Io, Memory, Stats, cost_columns
from vectrail.plans.planner import Feedback, Planner, StrategyRegistry, explain_search


def test_cpu():
    s = Stats(collection_size=1000, graph_nodes=1000, graph_layers=3, average_degree=16)
    c = Cpu(2.0)
    assert (c.cost(s, 5), c.cost(s, 5, mode="LOWEST_LATENCY"), c.cost(s, 5, strategy=HNSW), c.cost(s, 5, 0.1, strategy=HNSW)) == (2000, 3000, 2560, 25600)
    assert Cpu().cost(Stats(), 5, strategy=HNSW) == float("inf")


def test_io():
    cold = Stats(collection_size=1000, dimension=128, graph_nodes=1000, graph_layers=3)
    warm = Stats(collection_size=1000, dimension=128, cache_hits=9)
    assert (Io().cost(warm, 5), Io().cost(cold, 5), Io().cost(cold, 5, strategy=HNSW)) == (0, 163, 800)


def test_memory():
    s = Stats(collection_size=10_000, dimension=128, graph_nodes=10_000, graph_layers=1)
    mb = 1024 * 1024
    assert Memory().cost(s, 5) * mb == pytest.approx(6_360_000) and Memory().cost(s, 5, strategy=HNSW) * mb == pytest.approx(6_782_018)


def test_estimates():
    a, b = CostEstimate(cpu=1), CostEstimate(cpu=1, io=2)
    assert a < b and b.total == 3 and b.breakdown()["io"] == pytest.approx(2 / 3) and "total" in b.to_markdown()
    with pytest.raises(AttributeError):
        a.cpu = 3
    assert CostEstimator().estimate(Stats(), 5).confidence == 0.3
    assert CostEstimator().estimate(Stats(collection_size=5, sealed_segments=1), 5).confidence == 0.5


def test_rows_agree_with_the_model(spark):
    s = Stats(collection_size=5000, dimension=64, graph_nodes=5000, graph_layers=2, average_degree=16)
    rows = spark.createDataFrame([(5000, 64, 5000, 2, 16, 1.0, 0.1)], "collection_size long, dimension long, graph_nodes long, graph_layers long, average_degree long, miss_ratio double, selectivity double")
    for r in cost_columns(rows).collect():
        e = CostEstimator().estimate(s, 5, 0.1, r["mode"], r["strategy"])
        assert r["total_cost"] == pytest.approx(e.total, abs=1e-4)


def registry(spark, fail=False):
    reg = StrategyRegistry()
    reg.register("exact", lambda q, k, ids: spark.range(1))
    reg.register(HNSW, (lambda q, k, ids: spark.range(2).selectExpr("assert_true(id > 5)")) if fail else (lambda q, k, ids: spark.range(2)))
    return reg


def test_registry(spark):
    reg = registry(spark)
    assert reg.get("Hnsw") and reg.names() == ["EXACT", "HNSW"]
    with pytest.raises(KeyError):
        reg.get("x")


def test_choice(spark):
    small = Planner(registry(spark), lambda: Stats(collection_size=50))
    large = Planner(registry(spark), lambda: Stats(collection_size=10_000, graph_nodes=10_000, graph_layers=1))
    assert small.plan(5).strategy == "EXACT" and large.plan(5).strategy == "HNSW" and "HNSW" in large.plan(5).trace[-1]
    assert Planner(registry(spark), lambda: 1 / 0).plan(5).strategy == "EXACT"
    assert "graph" in small.plan(5).to_markdown() and small.plan(5).to_json()


def test_break_even():
    """The first size at which the graph costs less, as the formulas have it."""
    for dim, want in ((64, 1135), (1536, 492)):
        e = CostEstimator()
        better = lambda n: e.estimate(s := Stats(collection_size=n, dimension=dim, graph_nodes=n, graph_layers=1), 5, strategy=HNSW) < e.estimate(s, 5)
        assert not better(want - 1) and better(want)


def test_fallback_and_explain(spark):
    p = Planner(registry(spark, fail=True), lambda: Stats(collection_size=10_000, graph_nodes=10_000, graph_layers=1))
    got = explain_search(p, [1.0], 5)
    assert got.plan.strategy == "HNSW" and len(got.rows) == 1  # EXACT took over
    assert got.predicted_ms == pytest.approx(got.plan.estimate.total * 1e-4) and p.feedback.observed == 1 and "ms predicted" in got.to_markdown()


def test_feedback():
    f = Feedback(learning_rate=0.5)
    f.record(100.0, 50.0)
    assert f.ratio == pytest.approx(0.5 * 0.5 + 0.5 * 1e-4)
    f.record(0, 50)
    f.record(float("inf"), 50)
    assert f.observed == 1
    f.reset()
    assert f.ratio == 1e-4


def test_explained_runs_say_what_the_cache_did(spark):
    from types import SimpleNamespace

    from vectrail.plans import planner
    from vectrail.plans.cost import Stats

    cache = SimpleNamespace(hits=5, misses=7)

    def search(q, k, ids):
        cache.hits += 1
        return spark.range(k)

    registry = planner.StrategyRegistry()
    registry.register("EXACT", search)
    done = planner.explain_search(planner.Planner(registry, lambda: Stats(collection_size=10)), [1.0], 3, cache=cache)
    assert (done.cache_hits, done.cache_misses, len(done.rows)) == (1, 0, 3) and "1 cache hits, 0 misses" in done.to_markdown() and done.to_dict()["cache_hits"] == 1
