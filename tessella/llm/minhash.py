"""Near-duplicate documents by an inverted join on MinHash coordinates.

1. A pass over the texts gives each document's set of distinct word shingles (as
   64-bit hashes), a 128-bit fingerprint of the set and a signature of K
   coordinates. Documents with one set form a class that one of them stands for.
2. Classes are posted under their coordinate values. Values of one class alone
   are left out; a class with fewer than T values left has no partner with T
   collisions. Of the others only the rarest ones are posted: two classes with
   at least T collisions in all share one of them (prefix).
3. Pairs come from posting lists: in two rounds every member of a list meets the
   list's leader; verified links join components, and members that are linked
   already are skipped. Lists that still hold several components are compared
   pair by pair, long ones in blocks, pairs within a component being skipped.
   Pairs with at least T collisions in their whole signatures, and all pairs in
   blocks, are confirmed on the full sets.

T is far below the K * similarity collisions that a pair expects: at K = 40 and
0.75 a linked pair has fewer than 21 with probability 0.0006. No list is cut, and
lists of one component cost no pairs, so large groups of near copies stay linear.

Defined results: null and empty texts, and texts without words, have an empty
set and link with nothing; rows with a null doc_id link with nothing and have a
null component; repeated rows share component and decision; rows of one doc_id
with several texts count as one document; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components

from . import common

WIDTH, K, T = 5, 40, 21
#: Posting lists of so few members are compared pair by pair; longer ones in blocks of so many.
FEW, LIST_BLOCK = 16, 512
#: Texts that are hashed at once, in bytes.
CHUNK = 400_000

SKETCH = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, coords array<bigint>"


def _mix(x):
    """The finaliser of splitmix64 on an array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, width: int = WIDTH):
        import numpy as np

        self.width = width
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.factors = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(self.BASE)) | np.uint64(1)
        self.powers = self.inverse = None

    def _room(self, n: int) -> None:
        import numpy as np

        if self.powers is None or len(self.powers) < n:
            n = max(n, CHUNK + 1)
            step = np.full(n, self.BASE, dtype=np.uint64)
            back = np.full(n, pow(self.BASE, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverse = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def sets(self, texts: list[str | None]):
        """A sorted array of distinct hashes for each text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "")
                end += 1
            out += self._sets([(t or "").encode("utf-8", "surrogatepass") for t in texts[at:end]])
            at = end
        return out

    def _sets(self, texts: list[bytes]):
        import numpy as np

        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._room(len(raw))
        blank = self.space[raw]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        begin = np.flatnonzero(edge == -1)
        end = np.flatnonzero(edge == 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((self.lower[raw].astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64)])
        words = _mix((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sizes = np.array([len(t) + 1 for t in texts])
        bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
        w = self.width
        rolled = np.zeros(max(0, len(words) - w + 1), dtype=np.uint64)
        for j in range(w):
            rolled += words[j : len(words) - w + 1 + j] * self.factors[j] if len(rolled) else np.uint64(0)
        rolled = _mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= w:
                out.append(np.unique(rolled[a : b - w + 1]))
            elif b > a:
                short = (words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
                out.append(_mix(short))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def signatures(sets, k: int):
    """(f1, f2, coordinate values) of each set, which must not be empty; values carry their coordinate."""
    import numpy as np

    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), k), dtype=np.uint64)
    seeds = _mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    for i in range(k):
        out[:, i] = np.minimum.reduceat(flat * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1], starts)
    out = _mix(out ^ (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)))
    f1 = np.add.reduceat(_mix(flat ^ np.uint64(0x589965CC75374CC3)), starts)
    f2 = np.add.reduceat(_mix(flat ^ np.uint64(0x1D8E4E27C47D124F)), starts)
    return f1, f2, out


def sketch(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, set size, fingerprint and signature of every document; see SKETCH."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        common.release()
        shingler = Shingler(width)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                sets = shingler.sets(texts[at:end])
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                count = np.zeros(len(sets) + 1, np.int32)
                flat = np.zeros(0, np.int64)
                if len(full):
                    a, b, coords = signatures([sets[i] for i in full], k)
                    f1[full], f2[full] = a.view(np.int64), b.view(np.int64)
                    count[1:][full] = k
                    flat = coords.view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), lists], names=["doc_id", "n_shingles", "f1", "f2", "coords"])
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, hashes): the whole set of each document as sorted 64-bit integers."""

    def run(batches):
        import pyarrow as pa

        common.release()
        shingler = Shingler(width)
        for batch in batches:
            sets = shingler.sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    one = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    two = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        common.release()
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = len(y) - 1
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.join(one, "b").join(two, "a").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def colliding(pairs: DataFrame, classes: DataFrame, t: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) with at least t collisions whose set sizes allow the similarity."""
    left = classes.select(F.col("id").alias("a"), F.col("coords").alias("ca"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("coords").alias("cb"), F.col("n").alias("nb"))
    both = pairs.distinct().join(left, "a").join(right, "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(fits & (F.size(F.array_intersect("ca", "cb")) >= t)).select("a", "b")


def in_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components in posting lists (key, id, component) of at most FEW members."""
    left = members.select("key", F.col("id").alias("a"), F.col("component").alias("c"))
    right = members.select("key", F.col("id").alias("b"), F.col("component").alias("d"))
    return left.join(right, "key").where("a < b and c <> d").select("a", "b")


def in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in long posting lists (key, id, component, n: set size), block by block, on full sets (id, hashes).

    Members are dealt by size first: tiers of sizes, of which each ends where percent of
    the next one's begin, so that similar sets are in one tier or in neighbouring ones.
    Within a tier they are dealt into blocks of about LIST_BLOCK. A pair of blocks
    compares its sets at once and returns links enough to join the components that it
    links, not every pair. Sets join when pairs of blocks are known, and move once for each.
    """
    step = math.log(100 / percent) if 0 < percent < 100 else 1e-9 if percent else 1e9
    sized = members.select("key", "id", "component", F.floor(F.log("n") / step + 1e-9).cast("long").alias("tier"))
    # Staged, so that adaptive execution can split the members of a very long list.
    counts = common.staged(sized.groupBy("key", "tier").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks")), "tiers")
    up, down = (counts.select("key", (F.col("tier") - d).alias("tier"), F.col("blocks").alias(c)) for d, c in ((1, "up"), (-1, "down")))
    tiers = common.staged(counts.join(up, ["key", "tier"], "left").join(down, ["key", "tier"], "left"), "tiers")
    own = sized.join(tiers, ["key", "tier"]).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    # Every member goes to the pairs of its block with the blocks of its own tier and of its neighbours.
    spot = lambda t, b: F.struct(t.alias("tier"), b.cast("long").alias("block"))
    me = spot(F.col("tier"), F.col("block"))
    blocks = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    same = F.transform(blocks(F.col("blocks")), lambda b: F.struct(F.least(me, spot(F.col("tier"), b)).alias("lo"), F.greatest(me, spot(F.col("tier"), b)).alias("hi")))
    over = F.transform(blocks(F.col("up")), lambda b: F.struct(me.alias("lo"), spot(F.col("tier") + 1, b).alias("hi")))
    under = F.transform(blocks(F.col("down")), lambda b: F.struct(spot(F.col("tier") - 1, b).alias("lo"), me.alias("hi")))
    dealt = own.select("key", "id", "component", me.alias("me"), F.explode(F.concat(same, over, under)).alias("x"))
    dealt = dealt.select("key", "id", "component", (F.col("me") == F.col("x.lo")).alias("low"), (F.col("me") == F.col("x.hi")).alias("high"), "x.lo", "x.hi").join(sets, "id")

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        comps, ids = pdf["component"].to_numpy(), pdf["id"].to_numpy()
        x, y = np.flatnonzero(pdf["low"].to_numpy()), np.flatnonzero(pdf["high"].to_numpy())
        found: list[tuple] = []
        if len(np.unique(comps)) > 1 and len(x) and len(y):
            sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
            both = overlaps(sets, x, y)
            n = np.array([len(s) for s in sets])
            near = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (comps[x][:, None] != comps[y][None, :])
            i, j = np.nonzero(near)
            pairs = pd.DataFrame({"c": comps[x[i]], "d": comps[y[j]], "a": ids[x[i]], "b": ids[y[j]]}).drop_duplicates(["c", "d"])
            root: dict = {}

            def top(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for c, d, a, b in pairs.itertuples(index=False):
                c, d = top(c), top(d)
                if c != d:
                    root[max(c, d)] = min(c, d)
                    found.append((min(a, b), max(a, b)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "lo", "hi").applyInPandas(run, "a bigint, b bigint").distinct()


def overlaps(sets, x, y, width: int = 4096):
    """Sizes of the intersections of sets x with sets y, by products of incidence matrices, some columns at a time."""
    import numpy as np

    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what one set has alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[x] @ m[y].T
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, k: int = K, t: int = T, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, for each row."""
    spark = docs.sparkSession
    common.ship(spark)
    sketched = common.staged(sketch(docs, k, width), "sketches")
    ids = sketched.where("doc_id is not null and n_shingles > 0")
    # Staged, so that the join below reads two shuffles, of which adaptive execution splits that of a class with very many copies.
    members = common.staged(ids.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), "members")
    member = common.staged(ids.select("doc_id", "f1", "f2").join(members, ["f1", "f2"]).select("doc_id", "id"), "classes")
    classes = common.staged(ids.join(member.where("doc_id = id").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "coords").dropDuplicates(["id", "coords"]), "signatures")

    posted = classes.select("id", F.explode("coords").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    prefix = posted.join(shared, "key").groupBy("id").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(F.struct("f", "key"))).alias("keys")).where(F.col("c") >= t)
    prefix = common.staged(prefix.select("id", F.explode(F.slice("keys", F.lit(1), F.col("c").cast("int") - (t - 1))).alias("x")).select("id", F.col("x.key").alias("key")), "postings")
    wanted = common.staged(prefix.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    small = common.stored_bytes(wanted) <= 16 << 20
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    sets = common.staged(full_sets(texts, width), "sets")
    candidates = classes.join(F.broadcast(wanted.withColumnRenamed("doc_id", "id")) if small else wanted.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    candidates = common.staged(candidates, "candidates")

    # Several texts of one doc_id: its classes are one document.
    first = member.groupBy("doc_id").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    links = common.staged(member.join(first.where("id <> last").select("doc_id", F.col("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "found")
    labels = common.staged(components(links), "labels") if links.head(1) else None
    spent: list = [links]
    for r in range(rounds + 1):
        lists = prefix.withColumn("component", F.col("id")) if labels is None else prefix.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).select("id", "key", "component")
        lists = common.staged(lists, "lists")
        mixed = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "component")).alias("leader")).where("lo <> hi")
        if r < rounds:
            pairs = lists.join(mixed.select("key", "leader"), "key").where(F.col("component") != F.col("leader.component"))
            pairs = colliding(pairs.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")), candidates, t, percent)
        else:
            length = lists.groupBy("key").agg(F.count("*").alias("m"))
            rest = common.staged(lists.join(mixed.select("key").join(length, "key"), "key"), "mixed-lists")
            pairs = colliding(in_pairs(rest.where(F.col("m") <= FEW)), candidates, t, percent)
        found = confirmed(pairs, sets, percent)
        if r == rounds:
            found = found.unionByName(in_blocks(rest.where(F.col("m") > FEW).join(candidates.select("id", "n"), "id"), sets, percent))
        found = common.staged(found, "found")
        spent += [lists, found]
        if found.head(1):
            links = links.unionByName(found)
            spent.append(labels)
            labels = common.staged(components(links), "labels")
    known = first.select("doc_id", "id")
    known = known.join(labels, "id", "left") if labels is not None else known.withColumn("component", F.lit(None).cast("long"))
    known = common.staged(known.select("doc_id", F.coalesce("component", "id").alias("component_id")), "decisions")
    common.drop(members, member, classes, prefix, wanted, sets, candidates, labels, *spent)
    out = sketched.select("doc_id", "n_shingles").join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
