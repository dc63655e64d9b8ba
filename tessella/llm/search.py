"""Ranked lexical search as a blocked sparse matrix product.

Terms are runs of ASCII letters and digits and of any character beyond ASCII; A to Z
are lower-cased, nothing else. Items are the rows of one sparse matrix (item, term:
multiplicity, or 1 where each term counts once), documents the columns of the other
(term, document: an impact in 64-bit integers). A task builds the second matrix for
a block of documents, with the terms as rows, and multiplies row by row, as Gustavson
has it: an item's row of the product is the merged rows of its terms. Of each item's
row only the k best stay, first of a block, then of a task, then of a salted group,
at last of all.

A document is read once: its terms that some item has, with their counts, and its
length are written to the shared folder, and the numbers N, L and df are sums of
that. Items travel to the tasks as a table of at most ITEM_BYTES; more items are
searched in several rounds, each with its own table.

Defined results: null and empty texts and items have no term; documents with score 0
are not returned, so neither are items without a match; each row of the items is an
item of its own, each row of the documents a document of its own, repeats included;
a null doc_id comes last among equal scores; item columns besides the id and the text
and document columns besides those are not used; empty tables give no row.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 50
#: Bytes of item texts in one round; an item that is longer has a round of its own.
ITEM_BYTES = 16 << 20
#: Documents and postings of one block of the product, and the groups that a long list of an item's candidates is dealt to.
BLOCK_DOCS, BLOCK_POSTINGS, SALTS = 16_384, 1 << 21, 64

#: Upper to lower case, and a blank for every ASCII character that is neither letter nor digit.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Items:
    """The items of a round as a sparse matrix over their terms."""

    def __init__(self, packed: bytes, once: bool):
        import numpy as np

        raw = zlib.decompress(packed)
        n = int.from_bytes(raw[:4], "little")
        sizes = np.frombuffer(raw, np.int32, n, 4)
        ends = (np.cumsum(sizes) + 4 + 4 * n).tolist()
        self.vocabulary: dict[bytes, int] = {}
        self.rows = []
        for b, s in zip(ends, sizes.tolist()):
            own: dict[int, int] = {}
            for t in terms(raw[b - s : b]):
                k = self.vocabulary.setdefault(t, len(self.vocabulary))
                own[k] = 1 if once else own.get(k, 0) + 1
            self.rows.append(list(own.items()))


def _items(packed: bytes, once: bool) -> Items:
    return common.resident(f"items {zlib.crc32(packed)} {once}", lambda: Items(packed, once))


def postings(docs: DataFrame, shared, once: bool) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, ids, counts): number of terms, and those that an item has."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known = _items(shared.value, once).vocabulary
        for batch in batches:
            n, size, ids, counts = [], [0], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                own = terms(t) if t else []
                found = Counter(filter(known.__contains__, own))
                n.append(len(own))
                ids += map(known.__getitem__, found)
                counts += found.values()
                size.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, counts array<int>")


def impacts(weights, term, count, n, total: int, docs: int):
    """What each posting adds to a score, in 64-bit integers."""
    import numpy as np

    m = 100 - 50 + 50 * n * docs // max(1, total)
    return weights[term] * (np.int64(1_000_000_000) * count // (1000 * count + 20 * m))


def best(score, doc, k: int):
    """Places of the k highest scores, equal ones by ascending doc; doc is (null, id)."""
    import numpy as np

    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((doc[1][at], doc[0][at], -score[at]))[:k]]


def product(rows, term, column, value, width: int):
    """The rows of items times (term, column, value), one after the other: (item, columns, values) of the positive ones."""
    import numpy as np

    order = np.argsort(term, kind="stable")
    term, column, value = term[order], column[order], value[order]
    first = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1)).tolist()
    sums = np.zeros(width, np.int64)
    for k, row in enumerate(rows):
        hit = [(column[first[t] : first[t + 1]], value[first[t] : first[t + 1]], times) for t, times in row if t + 1 < len(first) and first[t] < first[t + 1]]
        if not hit:
            continue
        for where, what, times in hit:  # a term has a document once
            sums[where] += what if times == 1 else what * times
        found = np.flatnonzero(sums)
        yield k, found, sums[found]
        sums[found] = 0


def _round(docs: DataFrame, packed: bytes, k: int, once: bool) -> DataFrame:
    """(item, doc_id, score): of each item of the round the k best of every salted group."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(packed)
    rows = common.staged(postings(docs, shared, once), "postings")
    total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, length = total[0], total[1] or 0
    df = rows.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    weighed = df.select("term", w.alias("w")).toArrow()  # a row for each term of the round's items at most
    told = spark.sparkContext.broadcast((weighed["term"].to_numpy(), weighed["w"].to_numpy()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        items = _items(shared.value, once).rows
        weights = np.zeros(1 + max(told.value[0], default=0), np.int64)
        weights[told.value[0]] = told.value[1]
        top: dict[int, tuple] = {}
        held: list[tuple] = []

        def settle():
            ids, null, n, size, term, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            column = np.repeat(np.arange(len(n)), size)
            value = impacts(weights, term, count.astype(np.int64), n[column], length, n_docs)
            for item, where, score in product(items, term, column, value, len(n)):
                new = (score, null[where], ids[where])
                if item in top:
                    new = tuple(np.concatenate(x) for x in zip(top[item], new))
                at = best(new[0], new[1:], k)
                top[item] = tuple(x[at] for x in new)

        docs_held = postings_held = 0
        for batch in batches:
            doc, n, ids, counts = batch.columns
            if not len(doc):
                continue
            size = np.diff(ids.offsets.to_numpy())
            held.append((doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), n.to_numpy(), size, ids.flatten().to_numpy(), counts.flatten().to_numpy()))
            docs_held, postings_held = docs_held + len(doc), postings_held + int(size.sum())
            if docs_held >= BLOCK_DOCS or postings_held >= BLOCK_POSTINGS:
                settle()
                docs_held = postings_held = 0
        if held:
            settle()
        for item, (score, null, ids) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    found = rows.where(F.size("ids") > 0).mapInArrow(run, "item long, doc_id long, score long")
    return _top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["item", "salt"], k).drop("rank", "salt")


def _top(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first k of each key with their rank; Spark keeps no more than k of a task before it shuffles."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, id: str = "item_id", k: int = K, once: bool = True, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs (doc_id, text), items (id, text) -> (id, rank, doc_id, score): the k best documents of each item.

    once: a term that an item has several times counts once; otherwise as often.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = items.select(F.col(id).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = common.staged(rows.withColumn("item", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("text").cast("long")), "items")
    dealt = common.staged(common.running_sum(numbered.select("item", "bytes"), ["item"], "bytes", "before").select("item", F.floor(F.col("before") / item_bytes).alias("round")), "rounds")
    out = None
    for r in sorted(x.round for x in dealt.select("round").distinct().collect()):
        own = numbered.join(dealt.where(F.col("round") == r).select("item"), "item").orderBy("item").select("item", "text").collect()  # item_bytes, and the rest of one item
        texts = [x.text.encode() for x in own]
        packed = zlib.compress(len(texts).to_bytes(4, "little") + b"".join(len(t).to_bytes(4, "little") for t in texts) + b"".join(texts), 1)
        found = _round(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), packed, k, once)
        names = spark.createDataFrame([(place, x.item) for place, x in enumerate(own)], "place long, number long")
        found = found.join(F.broadcast(names), F.col("item") == F.col("place")).select(F.col("number").alias("item"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, doc_id long, score long")
    ranked = _top(out, ["item"], k)
    return ranked.join(numbered.select("item", "_id"), "item").select(F.col("_id").alias(id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS ts FROM benchmark WHERE text IS NOT NULL), it AS (SELECT item, item_id, unnest(ts) AS term FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS ts FROM documents), g AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM g) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
s AS (SELECT item, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n_docs) // total)))) AS BIGINT) AS score FROM it JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY item, item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""
