"""Shared pieces: the folder that all executors see, written cuts of lineage, column helpers."""

from __future__ import annotations

import atexit
import os
import sys
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: White space between words: exactly these six ASCII characters.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


_scratch: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder of the shared one; the folder is deleted when the driver's Python ends."""
    own = f"{shared_dir(spark)}/vectrail-{spark.sparkContext.applicationId}"
    if own not in _scratch:
        _scratch[own] = spark
        atexit.register(_leave, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _leave(own: str) -> None:
    try:
        delete(_scratch.pop(own), own)
    except Exception as e:  # the JVM may be gone by then
        print(f"{own} is left behind: {type(e).__name__}", file=sys.stderr)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above starts from files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete cuts that no plan reads any more."""
    for df in cuts:
        delete(df.sparkSession, df._cut_path)


def _local(uri: str) -> str | None:
    """The path of a ``file:`` URI, whose folder is mounted everywhere; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri.split(":", 1)[1].lstrip("/")
    return None if "://" in uri else uri


def mapped_file(uri: str) -> np.ndarray | None:
    """The bytes of a file of the shared folder, or None where there is none.

    A mounted file is mapped; one of another store is read into memory, so callers hold few at a time.
    """
    if path := _local(uri):
        return np.memmap(path, np.uint8, "r") if os.path.exists(path) else None
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(inner) as src:
        return np.frombuffer(src.read(), np.uint8)


def store_bytes(uri: str, data: bytes) -> None:
    """Write a file of the shared folder so that a repeated attempt replaces it whole."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"  # attempts don't meet
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, inner)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys give null."""
    return F.crc32(key.cast("string")) % F.lit(n)


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the columns, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def append_arrow(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with new columns computed from its text column in Arrow batches, without a shuffle.

    Columns of ``df`` that have a new column's name are replaced. ``make`` runs once per task and
    returns the function from a batch's texts to the new columns.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    if text not in names:
        raise ValueError(f"the text column {text!r} has the name of a result column")
    at = names.index(text)

    def run(batches):
        fn = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *fn(b.column(at))], names=names + [f.name for f in fields])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*kept, *fields]))


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose lengths sum to about ``most`` at the most; a longer one is alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n + 64
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out
