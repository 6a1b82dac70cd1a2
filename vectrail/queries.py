"""The engine's own queries over the fixture tables, each with its SQL.

The collection has the vectors of ``embeddings``; a vector's document is the one of the same id; every
17th vector is a tombstone; segments have 100 places. Scores are rounded to 6 decimals before ranking.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunking, embedders
from .functions import text as X
from .functions import vectors as V
from .operators import cache, exact, filters, hnsw, hybrid, ingest, lifecycle, segments
from .plans import cost, planner, stats
from .schemas import Collection, Metric
from .session import shared_dir, ship
from .sources import graph_files, segment_files, store
from .streaming import ingest as streaming
from .streaming import tasks
from .streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CAPACITY = 100
PHRASE = "the shthing that of tion and er"
FILTERS = {"lang": "en", "source": "src3"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their status."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return rows.withColumn("status", F.when(F.col("vec_id") % 17 == 0, 2).otherwise(1))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query is the vector of one id: one row, found by a pushed-down filter."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, CASE WHEN vec_id % 17 = 0 THEN 2 ELSE 1 END AS status FROM embeddings)"
_L1 = "list_sum(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2])))"


def _topk_sql(score: str, order: str, k: int = 10, where: str = "status = 1") -> str:
    return f"WITH {_Q}, {_V} SELECT vec_id, round({score}, 6) AS score FROM v, q WHERE {where} ORDER BY round({score}, 6) {order}, vec_id LIMIT {k}"


# --- exact search ---------------------------------------------------------------------------------------


@query(_topk_sql("list_cosine_similarity(e, q)", "DESC"))
def exact_cosine_topk(spark, sf_dir):
    return exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10)


@query(_topk_sql("list_distance(e, q)", "ASC"))
def exact_l2_topk(spark, sf_dir):
    return exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, "euclidean")


@query(_topk_sql("list_inner_product(e, q)", "DESC"))
def exact_dot_topk(spark, sf_dir):
    return exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, "DotProduct")


@query(_topk_sql(_L1, "ASC"))
def exact_manhattan_topk(spark, sf_dir):
    return exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, "Manhattan")


@query(_topk_sql("list_cosine_similarity(e, q)", "DESC"))
def exact_blocked_topk(spark, sf_dir):
    return exact.blocked_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10)


@query(f"WITH {_Q}, {_V} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS cosine, round(1 - list_cosine_similarity(e, q), 6) AS cosine_distance, round(list_distance(e, q), 6) AS l2, round(list_inner_product(e, q), 6) AS dot, round({_L1}, 6) AS manhattan, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(1 / (1 + list_distance(e, q)), 6) AS l2_similarity, round(1 / (1 + {_L1}), 6) AS manhattan_similarity FROM v, q")
def vector_measures(spark, sf_dir):
    q, e = V.literal(query_vector(spark, sf_dir)), F.col("embedding")
    columns = {
        "cosine": V.cosine(e, q), "cosine_distance": V.cosine_distance(e, q), "l2": V.l2(e, q), "dot": V.dot(e, q), "manhattan": V.manhattan(e, q), "norm": V.norm(e),
        "l2_similarity": V.similarity("l2", V.l2(e, q)), "manhattan_similarity": V.similarity("manhattan", V.manhattan(e, q)),
    }
    return vectors(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(n) for n, c in columns.items()))


@query(_topk_sql("list_distance(e, q)", "ASC", where="status = 1 AND vec_id % 13 > 2"))
def guarded_l2_topk(spark, sf_dir):
    """Vectors that are null, too short or have a null or NaN within are never neighbours."""
    rows, r = vectors(spark, sf_dir), F.col("vec_id") % 13
    e = F.col("embedding")
    broken = F.when(r == 0, F.lit(None)).when(r == 1, F.slice(e, 1, 63)).when(r == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(e)
    return exact.exact_topk(rows.withColumn("embedding", broken), query_vector(spark, sf_dir), 10, "l2")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 17 <> 0 AND label IN (1, 3) AND vec_id IS NOT NULL")
def active_rows(spark, sf_dir):
    return exact.active(vectors(spark, sf_dir)).where(F.col("label").isin(1, 3) & F.col("vec_id").isNotNull()).select("vec_id", "label")


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings d WHERE d.vec_id = e.vec_id AND d.vec_id % 17 = 0)")
def active_anti_join(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id").join(rows.where(F.col("status") == 2).select("vec_id"), "vec_id", "left_anti")


@query(f"WITH {_V}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(b.e, a.e), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.status = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def batch_knn(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return exact.batch_knn(rows, queries, 10)


@query(f"WITH {_V}, x AS (SELECT label, i, avg(e[i]) AS c FROM v, range(1, 65) t(i) WHERE status = 1 GROUP BY ALL) SELECT label, (i - 1)::INTEGER AS dim, round(c, 5) AS value FROM x")
def label_centroids(spark, sf_dir):
    rows = exact.active(vectors(spark, sf_dir)).select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("value"))


# --- text and chunks --------------------------------------------------------------------------------------


@query("SELECT doc_id, i::INTEGER AS chunk_index, substring(text, i * 500 + 1, 500) AS chunk FROM documents, unnest(range(0, ceil(length(text) / 500.0)::BIGINT)) t(i)")
def chunk_fixed(spark, sf_dir):
    return chunking.Fixed(500).chunk(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, i::INTEGER AS chunk_index, substring(text, i * 400 + 1, 500) AS chunk FROM documents, unnest(range(0, 1 + greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT)) t(i) WHERE length(text) > 0")
def chunk_sliding(spark, sf_dir):
    return chunking.Sliding(500, 100).chunk(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.Recursive(500, 100).chunk(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS token_count, length(text)::INTEGER AS chars FROM documents")
def whitespace_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("token_count"), F.char_length("text").alias("chars"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(rf"WITH w AS (SELECT list_filter(regexp_split_to_array(lower('{PHRASE}'), '\s+'), lambda x: length(x) > 2) AS w) SELECT doc_id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS keyword FROM documents, w")
def keyword_overlap(spark, sf_dir):
    return hybrid.keyword_scores(table(spark, sf_dir, "documents"), PHRASE, "doc_id", "text")


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"


@query(f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


_FEATURES = """w AS (SELECT k, md5(w) AS h FROM (SELECT k, regexp_replace(lower(unnest(regexp_split_to_array(t, '\\s+'))), '[^\\p{L}\\p{N}]', '', 'g') AS w FROM src) WHERE w <> ''),
f AS (SELECT k, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN -1.0 ELSE 1.0 END) AS x FROM w GROUP BY ALL),
n AS (SELECT k, sqrt(sum(x * x)) AS n FROM f GROUP BY k)"""


@query(f"WITH src AS (SELECT doc_id AS k, text AS t FROM documents), {_FEATURES} SELECT k AS doc_id, i::INTEGER AS dim, round(x / n, 6) AS value FROM f JOIN n USING (k) WHERE x <> 0")
def feature_hash_embed(spark, sf_dir):
    made = embedders.FeatureHash(64).embed(table(spark, sf_dir, "documents"), "text", ["doc_id"], "v")
    return made.select("doc_id", F.posexplode("v").alias("dim", "value")).where(F.col("value") != 0).withColumn("value", F.round("value", 6))


@query()
def gaussian_embed(spark, sf_dir):
    return embedders.Gaussian(64).embed(table(spark, sf_dir, "documents"), "text", ["doc_id"]).drop("text")


@query(rf"""WITH s AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
src AS (SELECT doc_id * 1000000 + pos AS k, sentence AS t FROM s), {_FEATURES},
d AS (SELECT a.k, sum(a.x * b.x) AS d FROM f a JOIN f b ON b.k = a.k - 1 AND a.i = b.i GROUP BY a.k),
c AS (SELECT s.doc_id, pos, sentence, CASE WHEN pos = 0 THEN 0 WHEN round(coalesce(d.d / nullif(a.n * b.n, 0), 0), 9) < 0.3 THEN 1 ELSE 0 END AS first
  FROM s LEFT JOIN n a ON a.k = s.doc_id * 1000000 + pos LEFT JOIN n b ON b.k = s.doc_id * 1000000 + pos - 1 LEFT JOIN d ON d.k = s.doc_id * 1000000 + pos),
g AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS chunk_index FROM c)
SELECT doc_id, chunk_index, string_agg(sentence, ' ' ORDER BY pos) AS chunk FROM g GROUP BY ALL""")
def chunk_semantic(spark, sf_dir):
    return chunking.Semantic(embedders.FeatureHash(64), 0.3).chunk(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- segments ---------------------------------------------------------------------------------------------


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assign(vectors(spark, sf_dir), "vec_id", CAPACITY)


_P = f"p AS (SELECT vec_id, label, CASE WHEN vec_id % 17 = 0 THEN 2 ELSE 1 END AS status, (row_number() OVER (ORDER BY vec_id) - 1) // {CAPACITY} AS segment_id, (row_number() OVER (ORDER BY vec_id) - 1) % {CAPACITY} AS vector_idx FROM embeddings)"
_S = f"s AS (SELECT segment_id, count(*) AS records, count(*) FILTER (WHERE status <> 1) AS deleted, count(*) FILTER (WHERE status = 1) AS active, CASE WHEN count(*) >= {CAPACITY} THEN 'sealed' ELSE 'growing' END AS state FROM p GROUP BY segment_id)"


@query(f"WITH {_P} SELECT vec_id, status, segment_id, vector_idx FROM p")
def segment_assignment(spark, sf_dir):
    return placed(spark, sf_dir).select("vec_id", "status", "segment_id", "vector_idx")


@query(f"WITH {_P}, {_S} SELECT * FROM s")
def segment_stats(spark, sf_dir):
    return segments.stats(placed(spark, sf_dir), CAPACITY)


@query(f"WITH {_P} SELECT DISTINCT segment_id FROM p WHERE segment_id IS NOT NULL")
def segment_distinct(spark, sf_dir):
    return placed(spark, sf_dir).where(F.col("segment_id").isNotNull()).select("segment_id").distinct()


@query(f"WITH {_P}, {_S} SELECT count(*) AS segments, count(*) FILTER (WHERE records < {CAPACITY // 2}) AS small, count(*) >= 2 AND count(*) FILTER (WHERE records < {CAPACITY // 2}) >= 2 AS should_compact FROM s")
def should_compact(spark, sf_dir):
    return segments.should_compact(segments.stats(placed(spark, sf_dir), CAPACITY), CAPACITY)


@query(f"WITH {_P}, l AS (SELECT *, row_number() OVER (ORDER BY segment_id, vector_idx) - 1 AS o FROM p WHERE status = 1) SELECT vec_id, segment_id AS old_segment_id, vector_idx AS old_vector_idx, o // {CAPACITY} AS segment_id, o % {CAPACITY} AS vector_idx FROM l")
def compact_segments(spark, sf_dir):
    return segments.compact(placed(spark, sf_dir), CAPACITY).select("vec_id", "old_segment_id", "old_vector_idx", "segment_id", "vector_idx")


@query(f"WITH {_P}, {_S} SELECT segment_id, records, deleted, active FROM s WHERE active < {CAPACITY // 2} OR deleted > 0.05 * records")
def compaction_candidates(spark, sf_dir):
    return segments.eligible(segments.stats(placed(spark, sf_dir), CAPACITY), CAPACITY, 0.05).drop("state")


@query(f"WITH {_P} SELECT vec_id, status, label FROM p WHERE segment_id = 2 AND vector_idx = 7")
def segment_point_lookup(spark, sf_dir):
    return segments.lookup(placed(spark, sf_dir), 2, 7).select("vec_id", "status", "label")


@query("SELECT vec_id, CASE WHEN vec_id % 17 = 0 OR label = 4 THEN 2 ELSE 1 END AS status FROM embeddings")
def soft_delete(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return segments.mark_deleted(rows, rows.where(F.col("label") == 4), "vec_id").select("vec_id", "status")


@query("SELECT (SELECT count(*) FROM documents WHERE source <> 'src3') AS documents, (SELECT coalesce(sum(ceil(length(text) / 500.0)), 0)::BIGINT FROM documents WHERE source <> 'src3') AS chunks")
def delete_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = chunking.Fixed(500).chunk(docs.select(F.col("doc_id").alias("document_id"), "text"))
    chunks = pieces.select(F.concat_ws(":", "document_id", "chunk_index").alias("id"), "document_id")
    every = {"documents": docs.withColumnRenamed("doc_id", "id"), "chunks": chunks, "embeddings": chunks.select(F.col("id").alias("chunk_id"))}
    left = segments.delete_cascade(every, every["documents"].where(F.col("source") == "src3"))
    return left["documents"].agg(F.count("*").alias("documents")).crossJoin(left["chunks"].agg(F.count("*").alias("chunks")))


@query(f"WITH {_P} SELECT vec_id, segment_id FROM p WHERE segment_id % 2 = 0 UNION ALL SELECT vec_id + 1000000 AS vec_id, segment_id FROM p WHERE segment_id % 2 = 1")
def append_union(spark, sf_dir):
    """All rows: those of even segments, and those of odd ones under shifted ids."""
    p = placed(spark, sf_dir).select("vec_id", "segment_id")
    return p.where(F.col("segment_id") % 2 == 0).unionByName(p.where(F.col("segment_id") % 2 == 1).withColumn("vec_id", F.col("vec_id") + 1_000_000))


@query(f"WITH {_P} SELECT segment_id, count(*) AS records, (count(*) * 64 * 4 + sum(length(label::VARCHAR)))::BIGINT AS bytes FROM p GROUP BY segment_id")
def segment_memory(spark, sf_dir):
    return cache.memory(placed(spark, sf_dir).withColumn("payload", F.col("label").cast("string")), payload="payload")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_dir(spark)}/vectrail-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_P} SELECT segment_id, vector_idx, vec_id, status, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM p JOIN embeddings USING (vec_id)")
def segment_files_roundtrip(spark, sf_dir):
    """Segments written as checksummed binary files and read back."""
    p = placed(spark, sf_dir)
    ident = lambda c: F.regexp_replace(F.lpad(F.lower(F.hex(c)), 32, "0"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = p.select(ident(F.col("segment_id")).alias("segment_id"), "vector_idx", ident(F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("payload"), "status")
    folder = fresh(spark, "segments")
    segment_files.write_segments(rows, folder, 64).count()
    back = segment_files.read_segments(spark, folder, 64)
    number = lambda c: F.conv(F.regexp_replace(c, "-", ""), 16, 10).cast("long")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return back.select(number("segment_id").alias("segment_id"), "vector_idx", number("id").alias("vec_id"), "status", F.round(total, 4).alias("total"))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT -1, (SELECT count(*) FROM region)")
def store_appends(spark, sf_dir):
    """Rows appended in two commits and read back, and a table whose contents are replaced."""
    s = store.Store(spark, fresh(spark, "store"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = lambda df, k, name: lifecycle.as_table(df.select(F.col(k).cast("string").alias("id"), F.col(name).cast("string").alias("namespace")), "collections")
    s.append({"collections": rows(nation.where("n_nationkey < 10"), "n_nationkey", "n_regionkey"), "users": lifecycle.as_table(nation.select(F.lit("x").alias("id")), "users")})
    s.append({"collections": rows(nation.where("n_nationkey >= 10"), "n_nationkey", "n_regionkey")})
    s.replace({"users": lifecycle.as_table(region.select(F.lit("y").alias("id")), "users")})
    out = s.read("collections").groupBy(F.col("namespace").cast("int").alias("region")).agg(F.count("*").alias("n"))
    return out.unionByName(s.read("users").where("id = 'y'").agg(F.lit(-1).alias("region"), F.count("*").alias("n")))


_ELIGIBLE = f"x AS (SELECT segment_id FROM s WHERE active < {CAPACITY // 2} OR deleted > 0.05 * records), t AS (SELECT max(segment_id) + 1 AS first FROM s)"


@query(f"""WITH {_P}, {_S}, {_ELIGIBLE}, m AS (SELECT vec_id, status, row_number() OVER (ORDER BY segment_id, vector_idx) - 1 AS o FROM p WHERE status = 1 AND segment_id IN (SELECT segment_id FROM x))
SELECT vec_id, status, segment_id, vector_idx FROM p WHERE segment_id NOT IN (SELECT segment_id FROM x)
UNION ALL SELECT vec_id, status, first + o // {CAPACITY} AS segment_id, o % {CAPACITY} AS vector_idx FROM m, t""")
def stored_compaction(spark, sf_dir):
    """The stored collection after a compaction: new segments, graphs and redirects in one commit."""
    s = store.Store(spark, fresh(spark, "compaction"))
    lifecycle.add_vectors(s, vectors(spark, sf_dir), CAPACITY, index=False)
    lifecycle.compact(s, CAPACITY, 0.05)
    return s.read("vectors").select("vec_id", "status", "segment_id", "vector_idx")


@query(f"WITH {_P}, {_S}, {_ELIGIBLE}, m AS (SELECT vec_id, segment_id, vector_idx, row_number() OVER (ORDER BY segment_id, vector_idx) - 1 AS o FROM p WHERE status = 1 AND segment_id IN (SELECT segment_id FROM x)) SELECT vec_id, segment_id AS old_segment_id, vector_idx AS old_vector_idx, first + o // {CAPACITY} AS segment_id, o % {CAPACITY} AS vector_idx FROM m, t")
def compaction_redirects(spark, sf_dir):
    """Old places looked up through the stored redirects."""
    s = store.Store(spark, fresh(spark, "redirects"))
    lifecycle.add_vectors(s, vectors(spark, sf_dir), CAPACITY, index=False)
    before = s.read("vectors").where(F.col("status") == 1).select("vec_id", F.col("segment_id").alias("old_segment_id"), F.col("vector_idx").alias("old_vector_idx"), "segment_id", "vector_idx")
    before = s.staged(before, "before")
    lifecycle.compact(s, CAPACITY, 0.05)
    return lifecycle.redirected(s, before).where(F.col("segment_id") != F.col("old_segment_id"))


@query(_topk_sql("list_cosine_similarity(e, q)", "DESC"))
def stored_index_topk(spark, sf_dir):
    """A search of stored graphs, built when the segments were sealed and only read here."""
    s = store.Store(spark, fresh(spark, "collection"))
    lifecycle.add_vectors(s, vectors(spark, sf_dir), CAPACITY)
    return lifecycle.of_store(s, ef=CAPACITY).get("HNSW")(query_vector(spark, sf_dir), 10, None)


@query(f"WITH {_P}, n AS (SELECT count(DISTINCT segment_id) AS n FROM p) SELECT n AS hits, n AS misses, round(CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0 END, 6)::DOUBLE AS hit_ratio FROM n")
def cache_hit_ratio(spark, sf_dir):
    """Two rounds over all segments through the cache: the first misses, the second hits.

    Places are written once, segment by segment: a segment is then loaded by a filter on its files.
    """
    rows = store.Store(spark, fresh(spark, "cached")).staged(placed(spark, sf_dir).repartitionByRange("segment_id").sortWithinPartitions("segment_id"), "placed")
    c = cache.SegmentCache.of(rows)
    numbers = [r[0] for r in rows.select("segment_id").distinct().orderBy("segment_id").collect()]  # a segment each
    for s in [*numbers, *numbers]:
        c.segment(s)
    out = spark.createDataFrame([(c.hits, c.misses, c.hit_ratio)], "hits long, misses long, hit_ratio double")
    c.clear()
    return out


# --- metadata filters -------------------------------------------------------------------------------------


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filters.unpivot(docs, "doc_id", ["lang", "source"]).unionByName(filters.unpivot(labels, "doc_id", ["quality", "toxic"]))


_M = """m AS (SELECT doc_id, 'lang' AS key, '"' || lang || '"' AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', '"' || source || '"' FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, 'quality', quality::VARCHAR FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels WHERE toxic IS NOT NULL)"""
_R = """r AS (SELECT doc_id FROM m WHERE key = 'lang' AND value = '"en"' INTERSECT SELECT doc_id FROM m WHERE key = 'source' AND value = '"src3"')"""


@query(f"WITH {_M} SELECT * FROM m")
def metadata_eav(spark, sf_dir):
    return metadata(spark, sf_dir)


@query(f"WITH {_M}, {_R} SELECT * FROM r")
def filter_resolve_and(spark, sf_dir):
    return filters.resolve(metadata(spark, sf_dir), FILTERS, "doc_id")


@query(f"WITH {_M}, {_R} SELECT greatest(0.001, (SELECT count(*) FROM r) / (SELECT count(*) FROM documents)::DOUBLE)::DOUBLE AS selectivity")
def filter_selectivity(spark, sf_dir):
    return filters.selectivity(metadata(spark, sf_dir), FILTERS, table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {_M}, {_Q}, {_V}, f AS (SELECT doc_id FROM m WHERE key = 'lang' AND value = '\"de\"') SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE status = 1 AND vec_id IN (SELECT doc_id FROM f) ORDER BY 2 DESC, 1 LIMIT 10")
def filtered_exact_topk(spark, sf_dir):
    ids = filters.resolve(metadata(spark, sf_dir), {"lang": "de"}, "doc_id").withColumnRenamed("doc_id", "vec_id")
    return exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, ids=ids)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') = '7'")
def json_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props").where(X.json_equal(F.col("props"), '{ "k": 7.0 }'))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- hybrid search ----------------------------------------------------------------------------------------

_HYBRID = rf"""w AS (SELECT list_filter(regexp_split_to_array(lower('{PHRASE}'), '\s+'), lambda x: length(x) > 2) AS w),
t AS (SELECT doc_id AS vec_id, lang, source, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS keyword FROM documents, w),
h AS (SELECT v.vec_id, list_cosine_similarity(e, q) AS semantic, coalesce(t.keyword, 0.0) AS keyword, lang, source FROM v CROSS JOIN q LEFT JOIN t USING (vec_id) WHERE status = 1)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source", "n_chars")


@query(f"WITH {_Q}, {_V}, {_HYBRID} SELECT vec_id, round(semantic, 6) AS semantic, keyword, round(0.5 * semantic + 0.5 * keyword, 6) AS score FROM h ORDER BY 4 DESC, 1 LIMIT 10")
def hybrid_topk(spark, sf_dir):
    return hybrid.hybrid_topk(vectors(spark, sf_dir), texts(spark, sf_dir), query_vector(spark, sf_dir), PHRASE, 10).withColumn("semantic", F.round("semantic", 6))


@query(f"WITH {_Q}, {_V}, {_HYBRID} SELECT vec_id, round(0.3 * semantic + 0.7 * keyword, 6) AS score FROM h WHERE lang = 'en' ORDER BY 2 DESC, 1 LIMIT 10")
def hybrid_filtered_topk(spark, sf_dir):
    ids = texts(spark, sf_dir).where(F.col("lang") == "en").select("vec_id")
    return hybrid.hybrid_topk(vectors(spark, sf_dir), texts(spark, sf_dir), query_vector(spark, sf_dir), PHRASE, 10, 0.3, ids=ids).select("vec_id", "score")


@query(f"WITH {_Q}, {_V}, {_HYBRID}, x AS (SELECT a.a AS alpha, vec_id, round(a.a * semantic + (1 - a.a) * keyword, 6) AS score FROM h, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) a(a)), r AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, vec_id) AS rank FROM x) SELECT alpha, vec_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def hybrid_alpha_sweep(spark, sf_dir):
    from pyspark.sql import Window

    s = hybrid.semantic_scores(vectors(spark, sf_dir), query_vector(spark, sf_dir), "cosine", "vec_id", "embedding")
    both = hybrid.fuse(s, hybrid.keyword_scores(texts(spark, sf_dir), PHRASE, "vec_id", "text"), 0.5, "vec_id").drop("score")
    rows = both.withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    rows = rows.withColumn("score", F.round(F.col("alpha") * F.col("semantic") + (1 - F.col("alpha")) * F.col("keyword"), 6))
    w = Window.partitionBy("alpha").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5).select("alpha", "vec_id", "score", "rank")


@query(f"WITH {_Q}, {_V}, x AS (SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE status = 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT vec_id, score, source, n_chars FROM x JOIN documents ON doc_id = vec_id")
def hydrate_hits(spark, sf_dir):
    hits = exact.exact_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return hybrid.hydrate(hits, texts(spark, sf_dir), "vec_id", ["source", "n_chars"]).select("vec_id", "score", "payload.source", "payload.n_chars")


@query(f"WITH {_Q}, {_V}, {_HYBRID}, a AS (SELECT vec_id, row_number() OVER (ORDER BY round(semantic, 6) DESC, vec_id) AS r FROM h QUALIFY r <= 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY keyword DESC, vec_id) AS r FROM h QUALIFY r <= 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM u GROUP BY vec_id")
def rank_fusion(spark, sf_dir):
    from pyspark.sql import Window

    s = hybrid.semantic_scores(vectors(spark, sf_dir), query_vector(spark, sf_dir), "cosine", "vec_id", "embedding").withColumn("semantic", F.round("semantic", 6))
    both = hybrid.fuse(s, hybrid.keyword_scores(texts(spark, sf_dir), PHRASE, "vec_id", "text"), 0.5, "vec_id")
    lists = []
    for c in ("semantic", "keyword"):
        top = both.orderBy(F.desc(c), "vec_id").limit(20)  # ranks of 20 rows
        lists.append(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "vec_id"))))
    return hybrid.reciprocal_rank(lists, "vec_id")


# --- approximate search -------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Placed vectors, and graphs of the sealed segments: built once, written, and read by every use."""
    rows = placed(spark, sf_dir)
    sealed = segments.stats(rows, CAPACITY).where(F.col("state") == "sealed").select("segment_id")
    return rows, store.Store(spark, fresh(spark, "index")).staged(hnsw.build_index(rows.join(sealed, "segment_id", "left_semi")), "graphs")


@query(_topk_sql("list_cosine_similarity(e, q)", "DESC"))
def hnsw_topk(spark, sf_dir):
    """A search list as long as a segment finds every node that a graph connects, so the result is the exact one."""
    rows, index = _index(spark, sf_dir)
    return hnsw.ann_topk(rows, index, query_vector(spark, sf_dir), 10, ef=CAPACITY)


@query(f"WITH {_Q}, {_V}, {_HYBRID}, c AS (SELECT * FROM h ORDER BY round(semantic, 6) DESC, vec_id LIMIT 40) SELECT vec_id, round(semantic, 6) AS semantic, keyword, round(0.5 * round(semantic, 6) + 0.5 * keyword, 6) AS score FROM c ORDER BY 4 DESC, 1 LIMIT 10")
def hybrid_ann_topk(spark, sf_dir):
    """Graphs and the scan of growing segments give 40 candidates, which the keywords re-rank."""
    rows, index = _index(spark, sf_dir)
    return hybrid.hybrid_ann_topk(rows, index, texts(spark, sf_dir), query_vector(spark, sf_dir), PHRASE, 10, ef=CAPACITY, overfetch=4)


@query(f"WITH {_P}, {_S} SELECT p.segment_id, p.vec_id, p.vector_idx FROM p JOIN s USING (segment_id) WHERE s.state = 'sealed' AND p.status = 1")
def graph_snapshot(spark, sf_dir):
    """Graphs written as files and read back: the nodes of sealed segments, and no node without links to others."""
    _, index = _index(spark, sf_dir)
    folder = fresh(spark, "graphs")
    graph_files.snapshot(index, folder, "cosine", hnsw.Parameters()).count()
    back = graph_files.restore(spark, folder)
    return back.where(F.size(F.get("neighbors", F.lit(0))) > 0).select("segment_id", "vec_id", "vector_idx")


@query(f"WITH {_P}, {_S} SELECT active AS nodes FROM s WHERE state = 'sealed'")
def graph_headers(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    folder = fresh(spark, "graph-headers")
    graph_files.snapshot(index, folder, "cosine").count()
    return graph_files.headers(spark, folder).select("nodes")


@query(_topk_sql("list_cosine_similarity(e, q)", "DESC"))
def planned_topk(spark, sf_dir):
    """The planner's choice between the registered strategies, run and explained."""
    rows, index = _index(spark, sf_dir)
    chosen = planner.Planner(lifecycle.strategies(lambda: rows, lambda: index, ef=CAPACITY), lambda: stats.snapshot(rows, index, CAPACITY))
    done = planner.explain_search(chosen, query_vector(spark, sf_dir), 10)
    return spark.createDataFrame([tuple(r) for r in done.rows], "vec_id long, score double")  # ten rows


@query(f"WITH {_P}, {_S} SELECT 'EXACT' AS strategy, 10::BIGINT AS results, count(*) AS candidates, count(*) FILTER (WHERE x >= 0) AS priced FROM (VALUES (1.0), (2.0)) t(x)")
def explain_search(spark, sf_dir):
    """The explanation of a search without graphs: both strategies are priced, the scan is chosen and runs."""
    rows = vectors(spark, sf_dir)
    chosen = planner.Planner(lifecycle.strategies(lambda: rows, lambda: rows.limit(0)), lambda: stats.snapshot(placed(spark, sf_dir), None, CAPACITY))
    said = planner.explain_search(chosen, query_vector(spark, sf_dir), 10).to_dict()
    priced = [c for c in said["plan"]["candidates"].values() if c]
    return spark.createDataFrame([(said["plan"]["strategy"], said["results"], len(said["plan"]["candidates"]), len(priced))], "strategy string, results long, candidates long, priced long")


@query()
def hnsw_recall(spark, sf_dir):
    """Recall at 10 of each query against the exact search."""
    rows, index = _index(spark, sf_dir)
    queries = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    sealed = rows.join(index.select("segment_id").distinct(), "segment_id", "left_semi")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = hnsw.search_index(index, rows, queries, 10, 64).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)
    return exact.recall(found, exact.batch_knn(sealed, queries, 10), 10)


# --- planning -----------------------------------------------------------------------------------------------


@query(f"WITH {_P}, {_S} SELECT coalesce(sum(active), 0)::BIGINT AS collection_size, coalesce(sum(deleted), 0)::BIGINT AS deleted, 64::BIGINT AS dimension, count(*) FILTER (WHERE state = 'sealed') AS sealed_segments, count(*) FILTER (WHERE state = 'growing') AS growing_segments, coalesce(sum(active) FILTER (WHERE state = 'sealed'), 0)::BIGINT AS graph_nodes FROM s")
def collection_statistics(spark, sf_dir):
    """Layers and degrees depend on drawn levels and are checked in a test."""
    rows, index = _index(spark, sf_dir)
    return stats.collection_statistics(rows, index, CAPACITY).drop("graph_layers", "average_degree")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's own size and others, as statistics."""
    n = vectors(spark, sf_dir).agg(F.count_if(F.col("status") == 1).alias("n"))
    sizes = n.select(F.explode(F.array(F.col("n"), F.lit(0), F.lit(1000), F.lit(10000), F.lit(100000))).alias("collection_size"))
    nodes = F.when(F.col("collection_size") >= 1000, F.col("collection_size")).otherwise(0).alias("graph_nodes")
    rows = sizes.select("collection_size", F.lit(64).alias("dimension"), nodes, F.lit(1).alias("graph_layers"), F.lit(16).alias("average_degree"), F.lit(1.0).alias("miss_ratio"))
    return rows.withColumn("selectivity", F.explode(F.array(F.lit(1.0), F.lit(0.1))))


_COSTS = """g AS (SELECT n AS collection_size, CASE WHEN n >= 1000 THEN n ELSE 0 END AS nodes, s AS selectivity, mode, strategy FROM
  (SELECT unnest([(SELECT count(*) FROM embeddings WHERE vec_id % 17 <> 0), 0, 1000, 10000, 100000]) AS n), (VALUES (1.0::DOUBLE), (0.1::DOUBLE)) s(s),
  (VALUES ('BALANCED'), ('LOWEST_LATENCY'), ('LOWEST_MEMORY'), ('LOWEST_IO')) m(mode), (VALUES ('EXACT'), ('HNSW')) t(strategy)),
c AS (SELECT *, greatest(1, ceil((64 + collection_size * 408) / 4096.0))::DOUBLE AS pages, floor(collection_size * selectivity) AS seen FROM g),
d AS (SELECT collection_size, selectivity, mode, strategy,
  round(CASE WHEN strategy = 'EXACT' THEN greatest(1, seen) WHEN nodes = 0 THEN 'inf'::DOUBLE ELSE 768 * CASE WHEN selectivity < 1 THEN greatest(1.0, 1.0 / greatest(0.01, selectivity)) ELSE 1.0 END END * CASE mode WHEN 'LOWEST_LATENCY' THEN 1.5 WHEN 'LOWEST_MEMORY' THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS cpu_cost,
  round(CASE WHEN strategy = 'EXACT' THEN pages * selectivity WHEN nodes = 0 THEN 'inf'::DOUBLE ELSE least(pages, 48) * 10 END * CASE mode WHEN 'LOWEST_IO' THEN 2.0 WHEN 'LOWEST_MEMORY' THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS io_cost,
  round(CASE WHEN strategy = 'EXACT' THEN seen * 380 WHEN nodes = 0 THEN 'inf'::DOUBLE ELSE nodes * 422 + greatest(1, nodes // 8) + 768 END / 1048576.0::DOUBLE * CASE mode WHEN 'LOWEST_MEMORY' THEN 2.0 WHEN 'LOWEST_LATENCY' THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS memory_cost FROM c),
e AS (SELECT *, round(cpu_cost + io_cost + memory_cost, 6) AS total_cost FROM d)"""


@query(f"WITH {_COSTS} SELECT * FROM e WHERE strategy = 'EXACT' OR collection_size >= 1000")
def cost_estimates(spark, sf_dir):
    rows = cost.cost_columns(_grid(spark, sf_dir)).where((F.col("strategy") == "EXACT") | (F.col("collection_size") >= 1000))
    return rows.select("collection_size", "selectivity", "mode", "strategy", "cpu_cost", "io_cost", "memory_cost", "total_cost")


@query(f"WITH {_COSTS} SELECT collection_size, selectivity, mode, CASE WHEN max(CASE WHEN strategy = 'HNSW' THEN total_cost END) < max(CASE WHEN strategy = 'EXACT' THEN total_cost END) THEN 'HNSW' ELSE 'EXACT' END AS strategy FROM e GROUP BY ALL")
def plan_choice(spark, sf_dir):
    rows = cost.cost_columns(_grid(spark, sf_dir))
    return rows.groupBy("collection_size", "selectivity", "mode").agg(F.min_by("strategy", F.struct("total_cost", "strategy")).alias("strategy"))


@query("WITH v AS (SELECT value, row_number() OVER (ORDER BY event_id DESC) - 1 AS later FROM events WHERE value > 0) SELECT round(coalesce(sum(0.2::DOUBLE * (50.0 / value) * pow(0.8::DOUBLE, later)), 0) + 1e-4 * pow(0.8::DOUBLE, count(*)), 6) AS ratio, (SELECT count(*) FROM events) AS observations FROM v")
def latency_ema(spark, sf_dir):
    """The fold of all observations in closed form: one weighs 0.2 * 0.8^(valid observations after it), the start 0.8^(all)."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    valid = segments.ordinals(rows.where(F.col("value") > 0), "event_id", "k")
    m = valid.count()
    parts = valid.select((F.lit(0.2) * (50.0 / F.col("value")) * F.pow(F.lit(0.8), m - 1 - F.col("k"))).alias("part"))
    ratio = F.coalesce(F.sum("part"), F.lit(0.0)) + F.lit(1e-4 * 0.8**m)
    return parts.agg(F.round(ratio, 6).alias("ratio"), F.lit(rows.count()).cast("long").alias("observations"))


# --- ingestion and events -------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1),
c AS (SELECT d.doc_id, i::INTEGER AS chunk_index, substring(text, i * 500 + 1, 500) AS chunk FROM documents d JOIN f USING (doc_id), unnest(range(0, ceil(length(text) / 500.0)::BIGINT)) t(i)),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS o FROM c)
SELECT doc_id, chunk_index, o // {CAPACITY} AS segment_id, o % {CAPACITY} AS vector_idx FROM n""")
def ingest_pipeline(spark, sf_dir):
    done = ingest.ingest(table(spark, sf_dir, "documents"), Collection("docs", 64, Metric.COSINE, segment_capacity=CAPACITY))
    return done.embeddings.select(F.col("source_key").alias("doc_id"), "chunk_index", "segment_id", "vector_idx")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir):
    return event_windows(table(spark, sf_dir, "events"))


_FIRST = "f AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1)"


@query(f"WITH {_FIRST} SELECT 'INGEST_DOCUMENT' AS action, count(*) AS n, count(DISTINCT h) AS targets FROM f")
def ingest_audit(spark, sf_dir):
    done = ingest.ingest(table(spark, sf_dir, "documents"), Collection("docs", 64))
    return done.audit.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


@query(f"WITH {_FIRST} SELECT h AS content_hash, 'completed' AS status, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS attempt FROM f")
def ingest_states(spark, sf_dir):
    """Documents' states: a first batch of those with an even first id fails and is noted so; a second takes all."""
    s, c = store.Store(spark, fresh(spark, "states")), Collection("docs", 64, segment_capacity=CAPACITY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = ingest.new_documents(docs, c).where("key % 2 = 0").select("content_hash", F.col("key").alias("doc_id"))
    even = s.staged(docs.withColumn("content_hash", X.content_hash(F.col("text"))).join(first, ["content_hash", "doc_id"], "left_semi"), "even")
    try:
        lifecycle.ingest_documents(s, even, c, embedder=embedders.Remote(_no_client, 64))
    except Exception as e:
        if "no client" not in str(e):
            raise
    lifecycle.ingest_documents(s, docs, c)
    return lifecycle.states(s).select("content_hash", "status", "attempt")


def _no_client():
    raise ConnectionError("no client")


@query(f"""WITH {_FIRST}, c AS (SELECT sum(ceil(length(text) / 500.0))::BIGINT AS chunks FROM documents JOIN f USING (doc_id)) SELECT (SELECT count(*) FROM f) AS documents, chunks, chunks AS embeddings, chunks AS places FROM c""")
def incremental_ingest(spark, sf_dir):
    """The documents as a stream into a store, half of them before a restart from the checkpoint."""
    root = fresh(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = store.Store(spark, f"{root}/store")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{root}/in")
        streaming.start(stream, s, Collection("docs", 64, segment_capacity=CAPACITY), f"{root}/checkpoint", available_now=True).awaitTermination()
    count = lambda t: s.read(t).agg(F.count("*")).first()[0]
    places = s.read("embeddings").select("segment_id", "vector_idx").distinct().count()
    return spark.createDataFrame([(count("documents"), count("chunks"), count("embeddings"), places)], "documents long, chunks long, embeddings long, places long")


@query("SELECT r_regionkey AS n, CASE WHEN r_regionkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, row_number() OVER (ORDER BY r_regionkey)::INTEGER AS place FROM region")
def task_queue(spark, sf_dir):
    """A task for each region, polled oldest first by a streaming query; those of odd numbers fail."""
    q, ran = tasks.TaskQueue(spark, fresh(spark, "tasks")), []

    def handler(payload):
        ran.append(payload["n"])
        if payload["n"] % 2:
            raise ValueError("odd")

    q.handle(tasks.BUILD, handler)
    for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect():  # five rows
        q.submit(tasks.BUILD, {"n": int(r[0])})
    q.start(available_now=True).awaitTermination()
    place = spark.createDataFrame([(n, i) for i, n in enumerate(ran, 1)], "n int, place int")
    return q.states().select(F.get_json_object("payload", "$.n").cast("int").alias("n"), "status").join(place, "n")


@query("SELECT a.vec_id, len(list_intersect(a.s, b.s)) AS shared, len(list_distinct(list_concat(a.s, b.s))) AS every, list_contains(a.s, 3) AS has_3 FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 10)::INTEGER) AS s FROM embeddings) a, (SELECT list_transform(embedding::DOUBLE[], lambda x: floor(x * 10)::INTEGER) AS s FROM embeddings WHERE vec_id = 0) b")
def array_functions(spark, sf_dir):
    tens = lambda v: F.transform(v.cast("array<double>"), lambda x: F.floor(x * 10).cast("int"))
    q = tens(V.literal(query_vector(spark, sf_dir)))
    s = tens(F.col("embedding"))
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", F.size(F.array_intersect(s, q)).cast("long").alias("shared"), F.size(F.array_union(s, q)).cast("long").alias("every"), F.array_contains(s, 3).alias("has_3"))
