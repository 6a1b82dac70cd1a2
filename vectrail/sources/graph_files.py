"""The raw graph format (VHNS): a header and nodes with their links by layer; snapshots of an index in that format.

A snapshot is a folder with one graph file for each segment and ``metadata.json``. Its nodes are named by their
vec_id and have their segment and place; vectors aren't in it and are joined by (segment_id, vector_idx).
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blobs import put

# Fixed values of the format.
MAGIC, FORMAT = b"VHNS", 1
HEADER = struct.Struct("<4sHH16sI36x")  # magic, version, highest layer, entry node, nodes
NODE = struct.Struct("<16s16sIH")  # node, segment, vector index, layer
COUNT = struct.Struct("<H")
NOWHERE = uuid.UUID(int=0)


@dataclass
class Node:
    id: uuid.UUID
    segment: uuid.UUID = NOWHERE
    vector_idx: int = 0
    links: list[list[uuid.UUID]] = field(default_factory=lambda: [[]])

    @property
    def level(self) -> int:
        return len(self.links) - 1


def encode(nodes: list[Node], entry: uuid.UUID | None) -> bytes:
    """An empty graph is a header alone."""
    out = [HEADER.pack(MAGIC, FORMAT, max((n.level for n in nodes), default=0), (entry or NOWHERE).bytes, len(nodes))]
    for n in nodes:
        out.append(NODE.pack(n.id.bytes, n.segment.bytes, n.vector_idx, n.level))
        out += [COUNT.pack(len(layer)) for layer in n.links]
        out += [x.bytes for layer in n.links for x in layer]
    return b"".join(out)


class _Bytes:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"the graph is cut off at byte {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]


def header(data: bytes) -> dict:
    """What the header says, for statistics: nothing else is read."""
    if len(data) < HEADER.size:
        raise ValueError("shorter than a graph header")
    magic, version, top, entry, count = HEADER.unpack_from(data)
    if magic != MAGIC or version != FORMAT:
        raise ValueError(f"not a graph: {magic!r}, version {version}")
    return {"max_level": top, "entry": uuid.UUID(bytes=entry), "nodes": count}


def decode(data: bytes, interleaved: bool = False) -> tuple[list[Node], uuid.UUID | None]:
    """Nodes and entry. Counts of all layers come before the links; ``interleaved`` has each count before its own links."""
    h, rest, nodes = header(data), _Bytes(data, HEADER.size), []
    for _ in range(h["nodes"]):
        key, segment, idx, level = NODE.unpack(rest.take(NODE.size))
        read = lambda n: [uuid.UUID(bytes=rest.take(16)) for _ in range(n)]
        if interleaved:
            links = [read(COUNT.unpack(rest.take(2))[0]) for _ in range(level + 1)]
        else:
            counts = [COUNT.unpack(rest.take(2))[0] for _ in range(level + 1)]
            links = [read(n) for n in counts]
        nodes.append(Node(uuid.UUID(bytes=key), uuid.UUID(bytes=segment), idx, links))
    known = {n.id for n in nodes}
    for n in nodes:
        n.links = [[x for x in layer if x in known] for layer in n.links]
    return nodes, h["entry"] if h["entry"] in known else None


INDEX = "segment_id long, vec_id long, vector_idx long, level int, is_entry boolean, neighbors array<array<long>>"
_INDEX = pa.schema([("segment_id", pa.int64()), ("vec_id", pa.int64()), ("vector_idx", pa.int64()), ("level", pa.int32()), ("is_entry", pa.bool_()), ("neighbors", pa.list_(pa.list_(pa.int64())))])


def snapshot(index: DataFrame, folder: str, metric: str, parameters=None) -> DataFrame:
    """Write the graph rows of each segment of ``index``, and the metadata; gives (segment_id, nodes, bytes)."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("vector_idx").to_pylist()
        segment = rows[0]["segment_id"]
        ids = {r["vector_idx"]: uuid.UUID(int=r["vec_id"]) for r in rows}
        nodes = [Node(ids[r["vector_idx"]], uuid.UUID(int=segment), r["vector_idx"], [[ids[n] for n in layer if n in ids] for layer in r["neighbors"]]) for r in rows]
        data = encode(nodes, next((ids[r["vector_idx"]] for r in rows if r["is_entry"]), None))
        put(folder, f"graph-{segment}.bin", data)
        return pa.table({"segment_id": pa.array([segment], pa.int64()), "nodes": pa.array([len(nodes)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    put(folder, "metadata.json", json.dumps({"metric": metric, **(asdict(parameters) if parameters else {})}, indent=2).encode())
    return index.groupBy("segment_id").applyInArrow(run, "segment_id long, nodes long, bytes long")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "graph-*.bin").load(folder).select("content")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The index rows of a snapshot, by Spark's own file source. A file that is cut off or of another format is an error."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                nodes, entry = decode(content.as_py())
                place = {n.id: n.vector_idx for n in nodes}
                rows = [{"segment_id": n.segment.int, "vec_id": n.id.int, "vector_idx": n.vector_idx, "level": n.level, "is_entry": n.id == entry, "neighbors": [[place[x] for x in layer] for layer in n.links]} for n in nodes]
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return _files(spark, folder).mapInArrow(run, INDEX)


def metadata(spark: SparkSession, folder: str) -> dict:
    """The metric and parameters of a snapshot; FileNotFoundError where there is none."""
    found = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "metadata.json").load(folder).select("content").collect()]  # one small file
    if not found:
        raise FileNotFoundError(f"no snapshot in {folder}")
    return json.loads(found[0])


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(max_level, nodes) of each graph file, from its header."""

    def run(batches):
        for b in batches:
            found = [header(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([h["max_level"] for h in found], pa.int32()), pa.array([h["nodes"] for h in found], pa.int64())], names=["max_level", "nodes"])

    return _files(spark, folder).mapInArrow(run, "max_level int, nodes long")
