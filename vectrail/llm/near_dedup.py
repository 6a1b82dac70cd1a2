"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

Sketch of a document with ``t`` coordinates: in round i < t every shingle is thrown into one of the t bins,
with the value (i, hash); in the rounds after these, round t + j throws all shingles into bin j, so that every
bin fills. A bin keeps its least value. Rounds end as soon as all bins are full, which takes O(t log t)
throws for small sets and one round for large ones, and the share of agreeing coordinates has
Chernoff-type bounds around the Jaccard similarity (Dahlgaard, Knudsen and Thorup, 2017).

Documents that agree on a whole band and aren't too different in size are candidates; links are confirmed
on the full shingle sets. Documents of one set are one class, and only class representatives take part. A
document is compared with the smallest document of its buckets first, then with each bucket's smallest one
where they are still apart. Buckets that then hold several components are compared exhaustively: members
outside the largest component, in blocks, with all members. No list of pairs of a group is ever made.

Cases: text with fewer words than a shingle is one shingle of all its words; without words (null, empty) a
document is linked with nothing; rows of one id are one document, linked by any of its texts; a null id
links with nothing, has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import mix, pair_hash, words
from .common import cut, release
from .components import components

_U = np.uint64
#: Band keys are computed from this many throws at a time.
_THROWS = 1 << 13
#: Members of a bucket in a block, about, and bytes of their sets. A task compares two blocks.
BLOCK, BLOCK_BYTES = 512, 64 << 20


def shingle_hashes(w_hash: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document, as 64-bit hashes."""
    n = len(w_hash)
    h = w_hash.copy()
    for k in range(1, size):
        h[: n - k] = pair_hash(h[: n - k], w_hash[k:])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        elif hi > lo:
            whole = w_hash[lo : lo + 1].copy()
            for k in range(lo + 1, hi):
                whole = pair_hash(whole, w_hash[k : k + 1])
            out.append(mix(whole ^ _U(0x5851F42D4C957F2D)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes: t values of (round, hash)."""
    full = _U(0xFFFFFFFFFFFFFFFF)
    bins = np.full(t, full)
    step = max(1, _THROWS // len(items))
    for first in range(0, t, step):
        rounds = np.arange(first, min(t, first + step), dtype=np.uint64)
        h = mix(items[None, :] ^ mix(rounds + _U(0x2545F4914F6CDD1D))[:, None])
        place = ((h >> _U(40)) * _U(t) >> _U(24)).astype(np.int64)
        value = (rounds[:, None] << _U(40)) | (h & _U((1 << 40) - 1))
        np.minimum.at(bins, place.ravel(), value.ravel())
        if (bins != full).all():
            return bins
    for j in np.flatnonzero(bins == full):
        h = mix(items ^ mix(np.array([t + int(j) + 0x2545F4914F6CDD1D], dtype=np.uint64)))
        bins[j] = (_U(t + int(j)) << _U(40)) | (h & _U((1 << 40) - 1)).min()
    return bins


def band_keys(bins: np.ndarray, bands: int) -> np.ndarray:
    rows = bins.reshape(bands, -1)
    key = mix(np.arange(bands, dtype=np.uint64) + _U(0x632BE59BD9B4E019))
    for c in range(rows.shape[1]):
        key = pair_hash(key, rows[:, c])
    return key


def sketches(docs: DataFrame, key: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, set_hash, keys) of each row; keys is null for documents without words."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for w in words(b.column(1)):
                sets = shingle_hashes(w.hash, w.bounds, shingle)
                n = pa.array([len(s) for s in sets], pa.int64())
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
                keys = pa.array([band_keys(sketch(s, bands * rows), bands).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_docs), n, digest, keys], names=["id", "n", "set_hash", "keys"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, set_hash binary, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of (id, text): items are the sorted hashes as bytes."""

    def run(batches):
        for b in batches:
            for w in words(b.column(1)):
                sets = shingle_hashes(w.hash, w.bounds, shingle)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.n_docs), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _none_missing(t: pa.RecordBatch | pa.Table) -> None:
    if any(t.column(c).null_count for c in ("x", "y", "items") if c in t.schema.names):
        raise ValueError("a document to be compared has no shingle set")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets are similar enough; an id without a set is an error."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a", "left").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b", "left").select("a", "b", "x", "y")

    def run(batches):
        for t in batches:
            _none_missing(t)
            ok = pa.array([linked(x, y, percent) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(ok)

    return both.mapInArrow(run, "a long, b long").distinct()


def _labelled(rows: DataFrame, comp: DataFrame, column: str = "id", name: str = "comp", label: str = "component") -> DataFrame:
    """``rows`` with the component of the id in a column, itself where it has no link."""
    own = comp.select(F.col("node").alias(column), F.col(label).alias("__c"))
    return rows.join(own, column, "left").select(*rows.columns, F.coalesce("__c", column).alias(name))


def _apart(labelled: DataFrame) -> DataFrame:
    """(bucket, id, comp, main, kq, km) of buckets of three members or more with several components.

    ``main`` is the bucket's largest component. Its members needn't be compared with each other, so the
    others are the bucket's queries. Buckets of the same members (other bands of one group) are kept once.
    Members are reduced to a row for each component in their tasks first, and the join with the open buckets
    can be split where a bucket is large.
    """
    own = [F.count("*").alias("c"), F.sum("n").alias("items"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(3))).alias("x2")]
    parts = labelled.groupBy("bucket", "comp").agg(*own)
    whole = [F.sum("c").alias("m"), F.sum("items").alias("items"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("main")]
    open_ = parts.groupBy("bucket").agg(*whole).where((F.col("m") > 2) & (F.col("comps") > 1))
    once = open_.groupBy("m", "items", "x1", "x2").agg(F.min(F.struct("bucket", "main")).alias("b"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    heavy = F.ceil(F.col("items") * 8 / F.lit(BLOCK_BYTES)).cast("int")
    once = once.select("b.bucket", F.col("b.main.comp").alias("main"), blocks(F.col("m") - F.col("b.main.c")).alias("kq"), F.greatest(blocks(F.col("m")), heavy).alias("km"))
    return labelled.select("bucket", "id", "comp").join(once, "bucket")


def _exhaustive(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between each bucket's queries and all its members, block against block.

    A block has at most about BLOCK members or BLOCK_BYTES; a task holds two. It gives pairs of components
    (ca, cb) that a link joins, one for each query and component, however many links there are. A member
    without a set is an error.
    """
    place = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    queries = apart.where(F.col("comp") != F.col("main")).select("bucket", "id", "comp", F.lit(True).alias("asks"), place(5, "kq").alias("i"), every("km").alias("j"))
    members = apart.select("bucket", "id", "comp", F.lit(False).alias("asks"), place(7, "km").alias("j"), every("kq").alias("i")).select("bucket", "id", "comp", "asks", "i", "j")
    full = queries.unionByName(members).join(sets, "id", "left").select("bucket", "i", "j", "comp", "asks", "items")

    def compare(t: pa.Table) -> pa.Table:
        _none_missing(t)
        asks = np.array(t.column("asks").to_pylist(), dtype=bool)
        comps = np.array(t.column("comp").to_pylist())
        items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        a, b = [], []
        if asks.any() and not asks.all():
            both = intersections([x for x, q in zip(items, asks, strict=True) if q], [x for x, q in zip(items, asks, strict=True) if not q])
            n = np.array([len(x) for x in items], dtype=np.int64)
            ok = (100 * both >= percent * (n[asks][:, None] + n[~asks][None, :] - both)) & (comps[asks][:, None] != comps[~asks][None, :])
            for i in np.flatnonzero(ok.any(1)):
                other = np.unique(comps[~asks][ok[i]])
                b += other.tolist()
                a += [int(comps[asks][i])] * len(other)
        return pa.table({"ca": pa.array(a, pa.int64()), "cb": pa.array(b, pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "ca long, cb long").distinct()


#: Columns of the 0/1 matrices that are multiplied at once.
_COLUMNS = 4096


def intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each x with each y: products of 0/1 matrices, some shared items at a time."""
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    row_x, row_y = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    shared = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(xs), len(ys)), np.int64)

    def places(flat, row):
        if not len(shared):
            return flat[:0].astype(np.int64), row[:0]
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        ok = shared[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order]

    (cx, rx), (cy, ry) = places(flat_x, row_x), places(flat_y, row_y)
    for lo in range(0, len(shared), _COLUMNS):
        hi = min(lo + _COLUMNS, len(shared))
        m = []
        for c, r, n in ((cx, rx, len(xs)), (cy, ry, len(ys))):
            i, j = np.searchsorted(c, (lo, hi))
            x = np.zeros((n, hi - lo), np.float32)
            x[r[i:j], c[i:j] - lo] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _members(reps: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, n, center) of the buckets with two members or more, from (id, n, keys).

    A bucket is a band key, split wherever its sets' sizes leave a gap that no link can bridge; its center is its
    smallest id. Gaps and centers are found among a bucket's size classes, one row each and pre-aggregated in
    the tasks, not among its members, and the join with these can be split where a bucket is large.
    """
    dealt = reps.select("id", "n", F.floor(F.ln("n") / F.lit(0.05)).cast("int").alias("k"), F.explode("keys").alias("bucket"))
    classes = dealt.groupBy("bucket", "k").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("id").alias("first"), F.max("id").alias("last"))
    order = Window.partitionBy("bucket").orderBy("k")
    gap = F.when(100 * F.lag("hi").over(order) < percent * F.col("lo"), 1).otherwise(0)
    parts = classes.withColumn("gap", gap).withColumn("part", F.sum("gap").over(order))
    part = Window.partitionBy("bucket", "part")
    parts = parts.select("bucket", "k", "part", F.min("first").over(part).alias("center"), F.max("last").over(part).alias("last")).where(F.col("center") < F.col("last"))
    parts = parts.select("bucket", "k", F.xxhash64("bucket", "part").alias("name"), "center")
    return dealt.join(parts, ["bucket", "k"]).select(F.col("name").alias("bucket"), "id", "n", "center")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = 36, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``.

    With 36 bands of 5 rows, a pair at similarity 0.8 is a candidate with probability 1 - 6e-7.
    """
    sk = cut(sketches(docs, key, text, shingle, bands, rows), "sketches")
    named = sk.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull())
    # Rows of one set have the same keys: tasks reduce a class to one row before the shuffle.
    classes = cut(named.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "keys")
    of_set = classes.select("set_hash", "rep")
    members = cut(_members(reps, percent), "members")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # An id of several texts is one document: it links their classes.
    several = named.groupBy("id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where(F.col("lo") < F.col("hi")).select("id")
    same = named.join(several, "id").join(of_set, "set_hash").select(F.col("id").alias("a"), F.col("rep").alias("b")).where(F.col("a") != F.col("b"))
    # First each document with the smallest of its buckets' centers: one pair for each document. A document that
    # is the smallest of all its buckets is in no such pair, but later steps compare it: every member has its set.
    least = cut(members.groupBy("id").agg(F.min("center").alias("b")), "pairs")
    first = least.where(F.col("id") != F.col("b")).withColumnRenamed("id", "a")
    sets = cut(_sets_of(texts, least.select("id"), shingle), "sets")
    links = cut(verified(first, sets, percent).unionByName(same), "links")
    # Then with the other centers, where these aren't known to belong together: by a link, or by a link of the link.
    near = links.groupBy("a").agg(F.min("b").alias("b"))
    comp = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("component"))
    others = members.select(F.col("id").alias("a"), F.col("center").alias("b"), "n").where(F.col("a") != F.col("b")).distinct().join(first, ["a", "b"], "left_anti")
    others = _labelled(_labelled(others, comp, "a", "ca"), comp, "b", "cb").where(F.col("ca") != F.col("cb"))
    sizes = reps.groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select(F.col("id").alias("b"), "lo", "hi")
    others = others.join(sizes, "b").where((100 * F.col("n") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("n")))
    comp = components(links.unionByName(verified(others.select("a", "b").distinct(), sets, percent)))
    # What is still apart within a bucket is compared exhaustively; its links join whole components.
    labelled = cut(_labelled(members.select("bucket", "id", "n"), comp), "labelled")
    apart = cut(_apart(labelled), "apart")
    release(members, least, links, labelled)
    if not apart.isEmpty():
        found = _exhaustive(apart, sets.join(apart.select("id").distinct(), "id", "left_semi"), percent)
        joined = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        comp = _labelled(comp, joined.withColumnRenamed("component", "whole"), "component", "final", "whole").select("node", F.col("final").alias("component")).unionByName(joined.join(comp, "node", "left_anti"))
    release(sets, apart)
    out = sk.join(of_set, "set_hash", "left").select("id", "set_hash", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"))
    return out.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


#: Most ids that are broadcast to pick their texts (8 bytes each); beyond it texts and ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sets_of(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, items): sets are made anew from the texts of those that need them; an id of several texts has several."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return shingle_sets(texts.join(ids, "id", "left_semi").dropDuplicates(["id", "text"]), shingle)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component; columns as they were. Rows of one id stay together."""
    found = near_components(docs, key, text, shingle, percent)
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
