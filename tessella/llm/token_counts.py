"""Token counts of whole texts by a two-tier lookup in the map tasks.

A pre-token here is a stretch at whose ends the tokenizer's own pre-tokenizer always
cuts (tokens.py), so a text's count is the sum of its pre-tokens' counts. The first
tier is a compact table of the frequent pre-tokens' counts, broadcast; the second is
a worker's cache, which the library fills with what the table lacks. No pre-token is
ever shuffled: the tasks that look for frequent ones keep a summary of bounded size
each (Misra-Gries: among SUMMARY counters is every pre-token that makes up more than
1 / SUMMARY of a task's), and only summaries are added up, over all tasks.

The table decides on speed alone: counts are the library's whatever it holds. It has
at most TABLE pre-tokens of at most tokens.MEMO_CHARS characters, so its size is
bounded. A lost executor's tasks read the broadcast again and fill their cache anew.

Defined results: a null or empty text has no bytes and no tokens; strings of special
tokens count as those tokens, as the library has it; repeated rows each count;
extra columns pass, but for those named n_bytes, n_tokens and over_limit, which are
replaced; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import MEMO_CHARS, MEMO_PIECES, Encoder

SUMMARY, TABLE, LIMIT = 16_384, 32_768, 1024
MADE = ("n_bytes", "n_tokens", "over_limit")


def summarise(counts: dict[str, int], keep: int) -> dict[str, int]:
    """A Misra-Gries cut: the counters above the keep-th largest, less that one's count."""
    if len(counts) <= keep:
        return counts
    least = sorted(counts.values(), reverse=True)[keep]
    return {p: n - least for p, n in counts.items() if n > least}


def frequent(docs: DataFrame, tokenizer: str, kind: str, text: str = "text", summary: int = SUMMARY, table: int = TABLE) -> DataFrame:
    """(piece, tokens): the most frequent pre-tokens of all texts, and their counts; at most ``table`` of them."""
    common.ship(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        find, seen = _lengths(tokenizer, kind, b"").enc.find, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(find(t))
                if len(seen) > 8 * summary:
                    seen = Counter(summarise(seen, summary))
        seen = {p: n for p, n in summarise(seen, summary).items() if len(p) <= MEMO_CHARS}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    def measure(batches):
        import pyarrow as pa

        enc = _lengths(tokenizer, kind, b"").enc
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            got = enc.learn(pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(got[p]) // 4 for p in pieces], pa.int64())], names=["piece", "tokens"])

    summed = docs.select(text).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "piece").limit(table).select("piece").mapInArrow(measure, "piece string, tokens long")


class Lengths:
    """Counts the tokens of texts; the worker's."""

    def __init__(self, path: str, kind: str, packed: bytes):
        self.enc = Encoder(path, kind)
        self.first: dict[str, int] = _unpacked(packed)
        self.second: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for part in self.enc.parts(text):
            total += part if isinstance(part, int) else self._plain(part)
        return total

    def _plain(self, text: str) -> int:
        pieces = self.enc.find(text)
        known = list(map(self.first.get, pieces))
        if None not in known:
            return sum(known)
        lacking = [p for p, n in zip(pieces, known) if n is None]
        found = list(map(self.second.get, lacking))
        if None not in found:
            return sum(filter(None, known)) + sum(found)
        new = {p: self.old.get(p) for p, n in zip(lacking, found) if n is None}
        rest = [p for p, n in new.items() if n is None]
        new.update((p, len(ids) // 4) for p, ids in self.enc.learn(rest).items())
        total = sum(filter(None, known)) + sum(filter(None, found)) + sum(map(new.get, lacking, repeat(0)))
        self.second.update(new if max(map(len, new)) <= MEMO_CHARS else {p: n for p, n in new.items() if len(p) <= MEMO_CHARS})
        if len(self.second) > MEMO_PIECES:
            self.old, self.second = self.second, {}
        return total


def _packed(rows: list) -> bytes:
    """The table as one string of bytes: lengths, counts, texts."""
    import numpy as np

    texts = [r.piece.encode("utf-8", "surrogatepass") for r in rows]
    head = np.array([[len(t) for t in texts], [r.tokens for r in rows]], np.int32).reshape(2, len(rows))
    return zlib.compress(len(rows).to_bytes(4, "little") + head.tobytes() + b"".join(texts), 1)


def _unpacked(packed: bytes) -> dict[str, int]:
    import numpy as np

    if not packed:
        return {}
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    sizes, counts = np.frombuffer(raw, np.int32, 2 * n, 4).reshape(2, n)
    ends = (np.cumsum(sizes) + 4 + 8 * n).tolist()
    return {raw[b - s : b].decode("utf-8", "surrogatepass"): c for b, s, c in zip(ends, sizes.tolist(), counts.tolist())}


def _lengths(path: str, kind: str, packed: bytes) -> Lengths:
    return common.resident(f"token counts {kind} {path} {zlib.crc32(packed)}", lambda: Lengths(path, kind, packed))


def count_tokens(docs: DataFrame, tokenizer: str, kind: str, text: str = "text", limit: int = LIMIT, summary: int = SUMMARY, table: int = TABLE) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) in place of the text."""
    spark = docs.sparkSession
    common.ship(spark)
    packed = _packed(frequent(docs, tokenizer, kind, text, summary, table).collect())  # at most TABLE rows of at most MEMO_CHARS characters
    shared = spark.sparkContext.broadcast(packed)
    keep = [c for c in docs.columns if c not in MADE]
    at, out = keep.index(text), [c for c in keep if c != text]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = _lengths(tokenizer, kind, shared.value)
        for batch in batches:
            texts = batch.column(at)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = pa.array([lengths.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, c in enumerate(keep) if c != text), size, n], names=[*out, "n_bytes", "n_tokens"])

    schema = docs.select(*out, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.select(*keep).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
