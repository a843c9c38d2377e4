"""Length-delimited binary records with a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.scratch import stored
from attesta.llm.tokens import encoder, slices

HEAD, FOOT, WIDTH = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<B")
INDEX = "doc_id long, part int, file string, offset long, length long, first long, n_tokens long"
#: bytes of neighbouring records read at once
STRETCH = 4 << 20


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and moved by a constant, so that checksums of data that
    hold checksums don't degenerate."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """u64 length, masked checksum of these eight bytes, payload, masked checksum of it."""
    size = struct.pack("<Q", len(payload))
    return b"".join([size, FOOT.pack(masked(size)), payload, FOOT.pack(masked(payload))])


def unframe(data: memoryview) -> bytes:
    length, check = HEAD.unpack_from(data)
    payload = bytes(data[HEAD.size:HEAD.size + length])
    if check != masked(bytes(data[:8])) or FOOT.unpack_from(data, HEAD.size + length)[0] != masked(payload):
        raise ValueError("a record does not match its checksum")
    return payload


def serialise(ids: bytes) -> bytes:
    """One byte for the width of an id, 2 or 4, then the ids."""
    values = np.frombuffer(ids, "<u4")
    if len(values) and values.max() > 0xFFFF:
        return WIDTH.pack(4) + ids
    return WIDTH.pack(2) + values.astype("<u2").tobytes()


def deserialise(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts into record files below ``folder``; returns the index.

    Documents are dealt out by ranges of the id (and, where many rows share one, of the
    text's hash), so files in order of ``part`` and records in order of ``offset`` are in
    ascending order of the id, nulls first. Each task streams its range into one file of
    its own name; an attempt that fails leaves a file that no index names. The index, a
    table of its own, has per document doc_id, part, file, offset and length of the framed
    record, ``start`` (ids of all documents before it) and n_tokens. Null texts count as
    empty; repeated rows are records of their own; an empty table has an empty index.
    ``folder`` is any place that pyarrow and all executors can write to.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("__tie"))
    ordered = rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = encoder(tokenizer, end_id)
        fs, place = _open(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec")
        uri = f"{folder}/{place.rsplit('/', 1)[1]}"
        out, offset, first = None, 0, 0
        for batch in slices(batches):
            if out is None and batch.num_rows:
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(place)
            at, sizes, firsts, counts = [], [], [], []
            for ids in own.encode(batch.column(1)):
                record = frame(serialise(ids))
                out.write(record)
                at.append(offset)
                sizes.append(len(record))
                firsts.append(first)
                counts.append(len(ids) // 4)
                offset += len(record)
                first += counts[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([uri] * n, pa.string()),
                 *(pa.array(x, pa.int64()) for x in (at, sizes, firsts, counts))],
                names=["doc_id", "part", "file", "offset", "length", "first", "n_tokens"])
        if out is not None:
            out.close()

    index = stored(ordered.mapInArrow(write, INDEX), "record-index")
    # one row per file
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return index.join(starts, "part").select(
        "doc_id", "part", "file", "offset", "length", (F.col("first") + F.col("__before")).alias("start"), "n_tokens")


def read_records(index: DataFrame) -> DataFrame:
    """The index rows with ``ids`` (little-endian unsigned 32-bit) read from the files.

    Works for any rows of the index in any order, so a shuffled reader passes a shuffled
    index; rows that are neighbours in a file are read in one stretch. Both checksums of
    every record are verified.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        try:
            for batch in batches:
                at = batch.column("offset").to_numpy()
                ends = at + batch.column("length").to_numpy()
                files = batch.column("file").to_pylist()
                lo = 0
                while lo < len(files):
                    hi = lo + 1
                    while (hi < len(files) and files[hi] == files[lo] and at[hi] == ends[hi - 1]
                           and ends[hi] - at[lo] <= STRETCH):
                        hi += 1
                    if files[lo] != name:
                        if source is not None:
                            source.close()
                        fs, place = _open(files[lo])
                        name, source = files[lo], fs.open_input_file(place)
                    data = memoryview(source.read_at(int(ends[hi - 1] - at[lo]), int(at[lo])))
                    ids = [deserialise(unframe(data[int(a - at[lo]):int(b - at[lo])])).tobytes()
                           for a, b in zip(at[lo:hi], ends[lo:hi], strict=True)]
                    piece = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.binary())],
                                                     names=[*piece.schema.names, "ids"])
                    lo = hi
        finally:
            if source is not None:
                source.close()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(read, f"{fields}, ids binary")
