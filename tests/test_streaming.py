import pytest

from vectrail.functions.chunking import Fixed
from vectrail.operators import lifecycle
from vectrail.schemas import Collection
from vectrail.sources.store import Store
from vectrail.streaming import ingest, tasks


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("documents").count() == 0
    doc = lambda i: lifecycle.as_table(spark.createDataFrame([(str(i), "c")], "id string, collection_id string"), "documents")
    store.append({"documents": doc(1)})
    store.append({"documents": doc(2)})
    assert store.read("documents").count() == 2
    with pytest.raises(Exception):
        store.append({"documents": doc(3), "chunks": spark.range(1).selectExpr("assert_true(id > 5) AS id")})
    assert store.read("documents").count() == 2
    store.replace({"documents": doc(4)})
    assert [r["id"] for r in store.read("documents").collect()] == ["4"]


def test_two_writers_lose_nothing(spark, tmp_path):
    from vectrail.sources import store as module

    root = f"file://{tmp_path}/s"
    a, b = Store(spark, root), Store(spark, root)
    doc = lambda i: {"documents": lifecycle.as_table(spark.createDataFrame([(str(i), "c")], "id string, collection_id string"), "documents")}
    a.append(doc(1))
    # While a commits, b takes the number that a was about to take.
    create, other = a.files.create, doc(2)
    calls = []

    def late(name, data):
        calls.append(name)
        if len(calls) == 1:
            b.append(other)
        return create(name, data)

    a.files.create = late
    a.append(doc(3))
    assert len(calls) == 2 and {r["id"] for r in a.read("documents").collect()} == {"1", "2", "3"} and a.rows("documents") == 3
    a.files.create = create
    read = a.manifest()
    b.append(doc(4))
    with pytest.raises(module.ConcurrentChange):
        a.replace(doc(5), read=read)
    assert a.read("documents").count() == 4 and a.tidy("documents", 3) and a.read("documents").count() == 4 and not a.tidy("documents", 3)


def test_states_of_documents(spark, tmp_path):
    from vectrail.functions import embedders

    store, c = Store(spark, str(tmp_path / "store")), Collection("c", 8)
    docs = spark.createDataFrame([(1, "one text"), (2, "other text"), (3, " "), (4, "one text")], "doc_id long, text string")

    def down():
        raise ConnectionError("the model is down")

    with pytest.raises(Exception, match="down"):
        lifecycle.ingest_documents(store, docs, c, embedder=embedders.Remote(down, 8))
    assert sorted((r["status"], r["attempt"]) for r in lifecycle.states(store).collect()) == [("failed", 1)] * 2 and store.read("documents").count() == 0
    assert all("down" in r["message"] for r in lifecycle.states(store).collect())
    lifecycle.ingest_documents(store, docs, c)
    assert sorted((r["status"], r["attempt"]) for r in lifecycle.states(store).collect()) == [("completed", 2)] * 2 and store.read("documents").count() == 2
    lifecycle.ingest_documents(store, docs, c)
    assert {r["attempt"] for r in lifecycle.states(store).collect()} == {2} and store.read("documents").count() == 2


def test_failed_model_writes_no_chunks_and_collections_have_their_own_states(spark, tmp_path):
    from vectrail.functions import embedders

    store = Store(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(1, "one text"), (2, "other text")], "doc_id long, text string")

    def down():
        raise ConnectionError("the model is down")

    with pytest.raises(Exception, match="down"):
        lifecycle.ingest_documents(store, docs, Collection("a", 8), embedder=embedders.Remote(down, 8))
    assert store.files.names("chunks") == []
    for name in "ab":
        lifecycle.ingest_documents(store, docs, Collection(name, 8))
    assert sorted((r["status"], r["attempt"]) for r in lifecycle.states(store).collect()) == [("completed", 1)] * 2 + [("completed", 2)] * 2
    assert store.rows("documents") == store.rows("embeddings") == 4


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 6}") for i in range(10)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    store, c = Store(spark, str(tmp_path / "store")), Collection("c", 8, segment_capacity=4)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start(stream, store, c, str(tmp_path / "cp"), available_now=True, chunker=Fixed(5)).awaitTermination()
    assert store.read("documents").count() == 6
    n = store.read("embeddings").count()
    places = {(r["segment_id"], r["vector_idx"]) for r in store.read("embeddings").collect()}
    assert len(places) == n and max(p[1] for p in places) == 3
    ingest.write_batch(store, docs, c, chunker=Fixed(5))
    assert store.read("documents").count() == 6 and store.read("embeddings").count() == n


def test_tasks(spark, tmp_path):
    q, done = tasks.TaskQueue(spark, str(tmp_path / "q")), []
    q.handle(tasks.INGEST, lambda p: done.append(p["n"]))
    q.handle(tasks.COMPACT, lambda p: p["missing"])
    q.submit(tasks.INGEST, {"n": 1})
    bad = q.submit(tasks.COMPACT, {})
    q.submit(tasks.INGEST, {"n": 2})
    unknown = q.submit("NOPE", {})
    stuck = q.submit(tasks.INGEST, {"n": 3})
    q._note(stuck, tasks.PROCESSING, None)
    q.start(available_now=True).awaitTermination()
    state = {r["task_id"]: r for r in q.states().collect()}
    assert done == [1, 2, 3] and state[stuck]["status"] == tasks.COMPLETED
    assert state[bad]["status"] == tasks.FAILED and "KeyError" in state[bad]["message"] and "no handler" in state[unknown]["message"]


def test_recovery_message(spark, tmp_path):
    q = tasks.TaskQueue(spark, str(tmp_path / "q"))
    t = q.submit(tasks.BUILD, {})
    q._note(t, tasks.PROCESSING, None)
    assert q.recover() == 1 and q.states().first()["status"] == tasks.PENDING and q.states().first()["message"].startswith("Recovered")
