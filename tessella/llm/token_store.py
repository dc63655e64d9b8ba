"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, in ascending doc_id order (null
first), then two skippable frames: an index of doc_ids, and the seek table of
the public zstd seekable format with the sizes and the checksum of every frame.
A reader finds a document in the index at a file's end, adds up compressed sizes,
and reads and decompresses that frame alone. Any zstd tool still decompresses a whole file.

Defined results: a null or empty text has the end id only; rows that share a
doc_id all stay, ordered by the checksum of their ids; an empty table gives no
file. Columns besides doc_id and text are not stored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Pieces in each of the two generations of a worker's memo: more than elsewhere, as encoding is most of the work here.
MEMO_PIECES = 400_000

SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
ENCODED = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, frame binary, check bigint"
DECODED = "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def encode_frames(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """One row for each document: its frame and its seek-table entry."""
    common.ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        import xxhash
        import zstandard

        enc, pack = encoder(tokenizer, kind, MEMO_PIECES), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))):
                ids += end
                for to, x in zip(rows, (doc, len(ids) // 4, zlib.crc32(ids), pack.compress(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["doc_id", "n_tokens", "ids_crc32", "frame", "check"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, ENCODED)


def file_bytes(rows: list[tuple]) -> bytes:
    """rows: (doc_id, n_tokens, frame, check), in order."""
    frames = b"".join(r[2] for r in rows)
    index = b"".join(struct.pack("<Bq", r[0] is None, r[0] or 0) for r in rows)
    table = b"".join(struct.pack("<III", len(r[2]), 4 * r[1], r[3]) for r in rows)
    table += struct.pack("<IBI", len(rows), 0x80, FOOTER_MAGIC)
    return frames + struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(table)) + table


def seek_table(data: bytes, total: int | None = None) -> list[tuple]:
    """(doc_id, offset, compressed size, size, checksum) for each frame; ValueError if it is not such a file.

    data is a whole file, or its end, from the index on, and total the file's length.
    """
    total = len(data) if total is None else total
    n = frames_of(data[-9:])
    at = len(data) - 9 - 12 * n
    head = at - 8 - 9 * n - 8
    if head < 0 or struct.unpack("<II", data[at - 8 : at]) != (SEEK_MAGIC, 12 * n + 9) or struct.unpack("<II", data[head : head + 8]) != (INDEX_MAGIC, 9 * n):
        raise ValueError("damaged seek table")
    out, offset = [], 0
    for (null, doc), (size, full, check) in zip(struct.iter_unpack("<Bq", data[head + 8 : at - 8]), struct.iter_unpack("<III", data[at : at + 12 * n])):
        out.append((None if null else doc, offset, size, full, check))
        offset += size
    if offset != total - len(data) + head:
        raise ValueError("frames and seek table differ")
    return out


def frames_of(foot: bytes) -> int:
    """Number of frames, from a file's last 9 bytes."""
    n, flags, magic = struct.unpack("<IBI", foot) if len(foot) == 9 else (0, 0, 0)
    if magic != FOOTER_MAGIC or flags != 0x80:
        raise ValueError("no seek table")
    return n


def tail_size(n: int) -> int:
    """Bytes of the index and the seek table of n frames."""
    return 8 + 9 * n + 8 + 12 * n + 9


def read_frame(data: bytes, entry: tuple) -> bytes:
    """Ids of one document as bytes, from a file's bytes; ValueError if the checksum differs."""
    _, offset, size, full, check = entry
    return unpacked(data[offset : offset + size], full, check)


def unpacked(frame: bytes, full: int, check: int) -> bytes:
    """The ids of one frame."""
    import xxhash
    import zstandard

    ids = zstandard.ZstdDecompressor().decompress(frame, max_output_size=full)
    if len(ids) != full or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
        raise ValueError("checksum")
    return ids


def write(encoded: DataFrame, folder: str, file_mb: float = 16) -> DataFrame:
    """Writes encode_frames' rows as files into folder; a row for each file.

    A file gets its final name only when it is whole, so that a task that runs
    again replaces it. Files' names ascend with doc_id. A range of doc_ids that
    exceeds file_mb is cut into several files.
    """
    size = encoded.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(1, int(size / (file_mb * 1e6)) + 1)

    def run(batches):
        import pandas as pd
        import pyarrow.fs as fs
        from pyspark import TaskContext

        part, n, rows, held, found = TaskContext.get().partitionId(), 0, [], 0, []
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)

        def flush():
            nonlocal n, rows, held
            name = f"part-{part:06d}-{n:06d}.tokens.zst"
            with store.open_output_stream(temp := f"{top}/_{uuid.uuid4().hex}") as out:
                out.write(file_bytes(rows))
            store.move(temp, f"{top}/{name}")
            found.append((name, len(rows), sum(r[1] for r in rows)))
            n, rows, held = n + 1, [], 0

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                rows.append(r)
                held += len(r[2])
                if held > 1.5e6 * file_mb:
                    flush()
        if rows:
            flush()
        import pyarrow as pa

        yield from pa.Table.from_pandas(pd.DataFrame(found, columns=["file", "n_docs", "n_tokens"]).astype({"file": "object", "n_docs": "int64", "n_tokens": "int64"}), schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]), preserve_index=False).to_batches()

    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids_crc32")
    return common.staged(ordered.mapInArrow(run, "file string, n_docs bigint, n_tokens bigint"), "token-files")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files in folder, frame by frame, checked; at: ids before it in its file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows, at, name = [], 0, os.path.basename(path)
                for entry in seek_table(data):
                    ids = read_frame(data, entry)
                    rows.append((name, entry[0], at, len(ids) // 4, zlib.crc32(ids)))
                    at += len(ids) // 4
                out = pd.DataFrame(rows, columns=["file", "doc_id", "at", "n_tokens", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens.zst").load(folder)
    return files.select("path", "content").mapInPandas(run, DECODED)


INDEX = "file string, doc_id bigint, offset bigint, size bigint, full bigint, check bigint"


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's frame lies, see INDEX; of every file only its end is read."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = os.path.basename(path)
                with store.open_input_file(f"{top}/{name}") as f:
                    end = tail_size(frames_of(f.read_at(9, length - 9)))
                    rows = [(name, *e) for e in seek_table(f.read_at(end, length - end), length)]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens.zst").load(folder)
    return files.select("path", "length").mapInArrow(run, INDEX)


def fetch(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted documents (doc_id, any number of them): only their frames are read and decompressed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as fs

        store, top = fs.FileSystem.from_uri(folder)
        name, f = None, None
        for batch in batches:
            docs, lists = [], []
            for file, doc, offset, size, full, check in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, store.open_input_file(f"{top}/{file}")
                docs.append(doc)
                lists.append(np.frombuffer(unpacked(f.read_at(size, offset), full, check), "<u4").astype("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    wanted = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = index(spark, folder).join(wanted, "doc_id", "left_semi").select(*(x.split()[0] for x in INDEX.split(", ")))
    # Frames of one file are dealt by ranges of it: a file of many wanted documents is no single task.
    ordered = found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "doc_id bigint, ids array<bigint>")


def store_tokens(docs: DataFrame, tokenizer: str, kind: str, end_id: int, folder: str | None = None, file_mb: float = 16) -> tuple[str, DataFrame]:
    """Encodes, writes and reads back; the folder, and a row for each document with the ids before it."""
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "tokens")
    encoded = common.staged(encode_frames(docs, tokenizer, kind, end_id), "token-frames")
    files = write(encoded, folder, file_mb)
    common.drop(encoded)
    if not files.head(1):
        return folder, spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    before = common.running_sum(files.select("file", "n_tokens"), ["file"], "n_tokens", "before").select("file", "before")
    back = common.staged(read(spark, folder), "token-rows")
    return folder, back.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
