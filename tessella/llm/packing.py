"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, which need no partner, and a rest;
the rest is cut into pieces of at most a quarter window. When a task has
gathered pieces for about WINDOWS windows, it deals them out: every piece starts
as a partition with one loaded window, and the two partitions of the largest
imbalance merge, heavy windows of one onto light windows of the other, until one
is left. Its windows are then nearly equal; if the heaviest exceeds the
capacity, the window count rises by one and it starts again. Nothing is
shuffled, and a task holds one such batch at a time.

Defined results: a null or empty text is its end id alone; a null doc_id stays null;
repeated rows are packed each for itself; extra columns are ignored; an empty table
gives no row. sequence_id is unique, and
the same again for the same input files.
"""

from __future__ import annotations

import heapq
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Windows' worth of pieces that are dealt out at once.
WINDOWS = 96
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of sizes for each of the windows, nearly equal in sum."""
    import numpy as np

    if windows == 1:
        return [list(range(len(sizes)))]
    heap, order = [], 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        loads = np.zeros(windows, dtype=np.int64)
        loads[-1] = sizes[k]
        heap.append((-sizes[k], order, loads, [None] * (windows - 1) + [(k, None)]))
        order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        loads = a + b[::-1]
        joined = [x if y is None else y if x is None else (x, y) for x, y in zip(own, reversed(other))]
        by = np.argsort(loads, kind="stable")
        loads = loads[by]
        order += 1
        heapq.heappush(heap, (int(loads[0] - loads[-1]), order, loads, [joined[k] for k in by.tolist()]))
    return [flat(x) for x in heap[0][3]] if heap else [[] for _ in range(windows)]


def flat(tree) -> list[int]:
    """Indexes in a tree of pairs; (k, None) is a leaf."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if x is None:
            continue
        if x[1] is None and isinstance(x[0], int):
            out.append(x[0])
        else:
            stack += [x[0], x[1]]
    return sorted(out)


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows that differencing keeps within the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[k] for k in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 1024, windows: int = WINDOWS) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece, see PIECES."""
    common.ship(docs.sparkSession)
    end, most = struct.pack("<I", end_id), max(1, capacity // 4)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, sequence = encoder(tokenizer, kind), TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def flush():
            nonlocal sequence, rest, held
            for window in deal([p[2] for p in rest], capacity):
                offset = 0
                for k in window:
                    out.append((*rest[k], sequence, offset))
                    offset += rest[k][2]
                sequence += 1
            rest, held = [], 0

        def batch():
            nonlocal out
            columns = list(zip(*out)) or [()] * 7
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for part in batches:
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode_column(part.column(1))):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    out.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, sequence, 0))
                    sequence += 1
                for at in range(whole, n, most):
                    size = min(most, n - at)
                    rest.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    held += size
                if held >= windows * capacity:
                    flush()
            if len(out) > 20_000:
                yield batch()
        if rest:
            flush()
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
