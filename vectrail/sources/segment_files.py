"""The raw segment format (VSEG): a header, fixed-size records, padded float32 vectors, JSON payloads."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blobs import put

# Fixed values of the format.
MAGIC, FORMAT = b"VSEG", 1
HEADER = struct.Struct("<4sH16sIIdQ18x")  # magic, version, segment, records, deleted, created, CRC-32 of the body
RECORD = struct.Struct("<16sIIIB3x")  # id, vector offset, payload offset, payload length, status
LENGTH = struct.Struct("<I")
ALIGN = 64

SCHEMA = "segment_id string, vector_idx long, id string, vector array<float>, payload string, status int"


@dataclass(frozen=True)
class Record:
    id: uuid.UUID
    vector: list[float]
    payload: str = "{}"  # JSON
    status: int = 1


def _up(n: int) -> int:
    return -(-n // ALIGN) * ALIGN


def encode(segment: uuid.UUID, records: list[Record], dimension: int, created: float = 0.0) -> bytes:
    if any(len(r.vector) != dimension for r in records):
        raise ValueError(f"a vector doesn't have {dimension} dimensions")
    matrix = np.zeros((len(records), _up(4 * dimension) // 4), dtype="<f4")
    if records:
        matrix[:, :dimension] = [r.vector for r in records]
    payloads = [r.payload.encode() for r in records]
    vectors_at = _up(HEADER.size + RECORD.size * len(records))
    sizes = np.cumsum([0, *(LENGTH.size + len(p) for p in payloads)])
    payloads_at = vectors_at + matrix.nbytes
    table = b"".join(RECORD.pack(r.id.bytes, vectors_at + i * matrix.strides[0], payloads_at + int(sizes[i]), len(payloads[i]), r.status) for i, r in enumerate(records))
    body = table.ljust(vectors_at - HEADER.size, b"\0") + matrix.tobytes() + b"".join(LENGTH.pack(len(p)) + p for p in payloads)
    return HEADER.pack(MAGIC, FORMAT, segment.bytes, len(records), sum(r.status == 2 for r in records), created, zlib.crc32(body)) + body


def decode(data: bytes, dimension: int) -> tuple[uuid.UUID, list[Record]]:
    """Refuses data that is too short, of another format, or damaged."""
    if len(data) < HEADER.size:
        raise ValueError("shorter than a segment header")
    magic, version, segment, count, _, _, crc = HEADER.unpack_from(data)
    if magic != MAGIC or version != FORMAT:
        raise ValueError(f"not a segment: {magic!r}, version {version}")
    if zlib.crc32(data[HEADER.size :]) != crc:
        raise ValueError("the segment's checksum is wrong")
    out = []
    for i in range(count):
        key, at, payload_at, length, status = RECORD.unpack_from(data, HEADER.size + i * RECORD.size)
        begin = payload_at + LENGTH.size
        out.append(Record(uuid.UUID(bytes=key), np.frombuffer(data, "<f4", dimension, at).tolist(), data[begin : begin + length].decode(), status))
    return uuid.UUID(bytes=segment), out


def read_segments(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Rows of all segment files of a folder, through Spark's own file source: any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vseg").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                segment, records = decode(content.as_py(), dimension)
                yield pa.RecordBatch.from_pylist(
                    [{"segment_id": str(segment), "vector_idx": i, "id": str(r.id), "vector": r.vector, "payload": r.payload, "status": r.status} for i, r in enumerate(records)],
                    schema=pa.schema([("segment_id", pa.string()), ("vector_idx", pa.int64()), ("id", pa.string()), ("vector", pa.list_(pa.float32())), ("payload", pa.string()), ("status", pa.int32())]),
                )

    return files.mapInArrow(run, SCHEMA)


def write_segments(rows: DataFrame, folder: str, dimension: int) -> DataFrame:
    """One file per segment_id under a folder that all executors see; gives (segment_id, records, bytes)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vector_idx")
        segment = uuid.UUID(t.column("segment_id")[0].as_py())
        data = encode(segment, [Record(uuid.UUID(r["id"]), r["vector"], r["payload"] or "{}", r["status"]) for r in t.to_pylist()], dimension)
        put(folder, f"{segment}.vseg", data)
        return pa.table({"segment_id": [str(segment)], "records": pa.array([t.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return rows.select("segment_id", "vector_idx", "id", "vector", "payload", "status").groupBy("segment_id").applyInArrow(run, "segment_id string, records long, bytes long")


class SegmentSource(DataSource):
    """``spark.read.format("vseg").option("dimension", 64).load(folder)`` once registered: a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "vseg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["dimension"]))


class _Reader(DataSourceReader):
    def __init__(self, path: str, dimension: int):
        self.path, self.dimension = path.removeprefix("file://"), dimension

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).rglob("*.vseg"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            segment, records = decode(f.read(), self.dimension)
        for i, r in enumerate(records):
            yield str(segment), i, str(r.id), r.vector, r.payload, r.status


def payload(**fields) -> str:
    return json.dumps(fields, ensure_ascii=False)


def with_payload(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    return rows.withColumn("payload", F.to_json(F.struct(*columns)))
