"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label form a class first, so that copies fill no window. Each
pass signs the classes with fresh random projections, sorts them by label and the
concatenated signs, and compares every one with its WINDOW predecessors. What is
sorted is a vector's form in 16-bit numbers, with its scale and the length of what
rounding took off: from these a pair's cosine follows within known bounds. Pairs that are
surely at the threshold are united; those within the bounds are looked up and
decided in double precision on the vectors themselves. Tasks return the pairs at
their borders as well, so that a window does not end with a partition.

Passes come in rounds: PASSES, as many again, then as many as have run so far. A
label is done when a round after the first joins none of its components. So passes
follow the label: few where directions are spread evenly, more where vectors share a
direction and signs hardly split them, or where a label is very large. Two linked
vectors stay apart only if all passes miss them, no others that the earlier rounds
missed show up in the last one, and no third vector joins them.

Links of different passes are united into components. Within a component, which
windows may have covered only in part, all links are then counted on the vectors, in
blocks of them, without a row for each pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or have a null label or a null vec_id, link with nothing and are kept;
vectors of different lengths never link; repeated rows count as other vectors, as do
rows of one vec_id with several vectors, which link only if those do; a cosine of
exactly the threshold is a link; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import components

from . import common

PASSES, WINDOW, BITS = 4, 512, 63
#: Rows that are compared with their predecessors at once; sizes of blocks in which links are counted.
ROWS, SMALL_BLOCK, BLOCK = 256, 256, 4096
FORM = "round int, dim int, label bigint, key bigint, cid bigint, q binary, scale double, lost double"
FOUND = "kind int, label bigint, dim int, a bigint, b bigint, part bigint, round int, q binary, scale double, lost double"
#: Kinds of rows in FOUND: joined, to be decided, first and last rows of a task.
JOINED, OPEN, HEAD, TAIL = range(4)


def _unit(column):
    import numpy as np

    x = np.array(column.tolist(), dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(classes: DataFrame, passes: int = PASSES, seed: int = 9, first: int = 0) -> DataFrame:
    """A row for each class (cid, label, vec) and pass, from the first on: its sign key and its form in 16-bit numbers, see FORM."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cids, labels, vecs = (batch.column(k) for k in range(3))
            sizes = np.diff(vecs.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == dim))
                x = vecs.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                scale = np.abs(x).max(axis=1) / 32767
                q = np.rint(x / scale[:, None]).astype(np.int16)
                lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
                n = len(x)
                form = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * dim).astype(np.int32)), pa.py_buffer(q.tobytes())])
                for p in range(first, first + passes):
                    planes = np.random.default_rng([seed, p, dim]).standard_normal((dim, BITS))
                    key = ((x @ planes > 0).astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, dim, np.int32)), labels.take(at), pa.array(key), cids.take(at), form, pa.array(scale), pa.array(lost)], names=[c.split()[0] for c in FORM.split(", ")])

    return classes.select("cid", "label", "vec").mapInArrow(run, FORM)


def stars(i, j, n: int):
    """The least index that each of n reaches by the links i-j."""
    import numpy as np

    root = np.arange(n)
    while (root[i] != root[j]).any():
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    return root


def compare(q, scale, lost, fresh: int, least: float, window: int):
    """Rows of one pass and label in order: joined index pairs, enough to unite what is surely linked, and pairs to decide; pairs of rows before fresh are known."""
    import numpy as np

    x = (q * scale[:, None]).astype(np.float32)
    joined, undecided = [], []
    for s in range(fresh, len(x), ROWS):
        e, lo = min(len(x), s + ROWS), max(0, s - window)
        slack = 1e-5 + 2.1 * float(lost[lo:e].max())
        i, j = np.nonzero(x[s:e] @ x[lo:e].T >= np.float32(least - slack))
        i, j = i + s, j + lo
        keep = (j < i) & (i - j <= window)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        dot = np.einsum("ij,ij->i", x[i], x[j]).astype(np.float64)
        bound = 1e-5 + lost[i] + lost[j] + 3 * lost[i] * lost[j]
        sure = dot - bound >= least
        root = stars(i[sure] - lo, j[sure] - lo, e - lo)
        moved = np.flatnonzero(root != np.arange(e - lo))
        joined.append(np.stack([moved + lo, root[moved] + lo]))
        maybe = ~sure & (dot + bound >= least) & (root[i - lo] != root[j - lo])
        undecided.append(np.stack([i[maybe], j[maybe]]))
    none = np.zeros((2, 0), np.int64)
    return np.concatenate([none, *joined], axis=1), np.concatenate([none, *undecided], axis=1)


def _form(column):
    import numpy as np

    return np.frombuffer(b"".join(column), np.int16).reshape(len(column), -1)


def passed(rows: DataFrame, least: float, window: int) -> DataFrame:
    """What neighbours in each pass have in common, see FOUND; rows comes from keyed()."""
    order = ["round", "dim", "label", "key", "cid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        part, group, held, seen = TaskContext.get().partitionId(), ["round", "dim", "label"], None, 0
        types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FOUND.split(", ")])

        def out(kind, pdf, a, b):  # b: the other one, or the row's place among the first or last
            n = len(a)
            full = pdf if kind in (HEAD, TAIL) else pdf.assign(q=None, scale=None, lost=None)
            columns = {"kind": np.full(n, kind, np.int32), "a": a, "b": b, "part": np.full(n, part)}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, full[c] if c in full else None), schema.field(c).type, from_pandas=True) for c in names], schema=schema)

        for batch in batches:
            pdf = batch.to_pandas()
            if seen < window:
                head = pdf.iloc[: window - seen]
                yield out(HEAD, head, head["cid"].to_numpy(), seen + np.arange(len(head)))
            seen += len(pdf)
            fresh = 0 if held is None else len(held)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            for _, at in pdf.groupby(group, sort=False).indices.items():
                if at[-1] < fresh:
                    continue
                own = pdf.iloc[at]
                cid = own["cid"].to_numpy()
                joined, undecided = compare(_form(own["q"]), own["scale"].to_numpy(), own["lost"].to_numpy(), int(np.searchsorted(at, fresh)), least, window)
                for kind, (i, j) in ((JOINED, joined), (OPEN, undecided)):
                    if len(i):
                        yield out(kind, own.iloc[i], cid[i], cid[j])
            held = pdf.iloc[-window:]
        if held is not None:
            yield out(TAIL, held, held["cid"].to_numpy(), np.arange(len(held)))

    return common.staged(ordered.mapInArrow(run, FOUND), "passes")


def across(found: DataFrame, least: float, window: int) -> DataFrame:
    """The same for pairs of rows on both sides of a border between tasks, as (kind, label, dim, a, b)."""
    ends = found.where(F.col("kind").isin(HEAD, TAIL))
    parts = ends.select("part").distinct().select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))  # a row for each task
    last = ends.where(F.col("kind") == TAIL).join(F.broadcast(parts), "part").where("next is not null").withColumn("border", F.col("next"))
    both = last.drop("next").unionByName(ends.where(F.col("kind") == HEAD).withColumn("border", F.col("part")))

    def run(pdf):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"kind": [], "label": [], "dim": [], "a": [], "b": []}, dtype="int64")]
        for (_, dim, label), own in pdf.groupby(["round", "dim", "label"]):
            own = own.sort_values(["kind", "b"], ascending=[False, True])  # last rows of the one task, first ones of the next
            fresh, cid = int((own["kind"] == TAIL).sum()), own["a"].to_numpy()
            if 0 < fresh < len(own):
                for kind, (i, j) in zip((JOINED, OPEN), compare(_form(own["q"]), own["scale"].to_numpy(), own["lost"].to_numpy(), fresh, least, window)):
                    out.append(pd.DataFrame({"kind": kind, "label": label, "dim": dim, "a": cid[i], "b": cid[j]}))
        return pd.concat(out, ignore_index=True).astype(np.int64)

    return both.groupBy("border").applyInPandas(run, "kind bigint, label bigint, dim bigint, a bigint, b bigint")


def decided(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose vectors have the cosine, in double precision."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in (x, y))
                keep.append(bool((x / np.sqrt((x * x).sum())) @ (y / np.sqrt((y * y).sum())) >= least))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (*batch.columns[:2], *batch.columns[4:])], names=["a", "b", "label", "dim"])

    one, two = (classes.select(F.col("cid").alias(c), F.col("vec").alias(v)) for c, v in (("a", "left"), ("b", "right")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right", "label", "dim")
    return both.mapInArrow(run, "a bigint, b bigint, label bigint, dim int")


def pass_links(classes: DataFrame, least: float, passes: int = PASSES, window: int = WINDOW) -> DataFrame | None:
    """(id, component) of classes (cid, label, dim, vec) that are linked, after rounds of passes over each label and dim until a round joins nothing in it; None without any link."""
    live = classes.groupBy("label", "dim").agg(F.count("*").alias("m")).where("m > 1").select("label", "dim")
    live = common.staged(live, "live-labels")
    done, n, state, first = 0, passes, None, True
    while live.head(1):
        active = classes.join(live, ["label", "dim"], "left_semi")
        fresh = None
        for at in range(done, done + n, passes):
            found = passed(keyed(active, passes, first=at), least, window)
            small = found.where(F.col("kind").isin(JOINED, OPEN)).select("kind", "label", "dim", "a", "b").unionByName(across(found, least, window))
            small = common.staged(small.select("kind", "label", F.col("dim").cast("int").alias("dim"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            common.drop(found)
            part = small.where(F.col("kind") == JOINED).select("a", "b", "label", "dim")
            open_ = small.where(F.col("kind") == OPEN).select("a", "b", "label", "dim")
            if state is not None:  # what is in one component needs no decision
                open_ = told(open_, state).where("c <> d").select("a", "b", "label", "dim")
            part = common.staged(part.unionByName(decided(open_, classes, least)), "vector-links")
            common.drop(small)
            fresh = part if fresh is None else fresh.unionByName(part)
        new = fresh if state is None else told(fresh, state).where("c <> d")
        joined = common.staged(new.select("label", "dim").distinct(), "live-labels")
        if joined.head(1):
            known = fresh.select("a", "b") if state is None else fresh.select("a", "b").unionByName(state.select(F.col("component").alias("a"), F.col("id").alias("b")))
            state = common.staged(components(known), "vector-components")
        live, first = live if first else joined, False  # the first round has nothing to be measured by
        done, n = done + n, done + n
    return state


def told(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """pairs (a, b) with c and d, the components of both."""
    one, two = (state.select(F.col("id").alias(x), F.col("component").alias(y)) for x, y in (("a", "c"), ("b", "d")))
    return pairs.join(one, "a", "left").join(two, "b", "left").withColumn("c", F.coalesce("c", "a")).withColumn("d", F.coalesce("d", "b"))


def link_counts(members: DataFrame, least: float) -> DataFrame:
    """members (component, cid, vec, copies) -> (cid, others): rows of other classes of the component that link with cid.

    A component of under 2048 members is cut into blocks of SMALL_BLOCK, a larger one
    into eight, or into blocks of BLOCK; every pair of blocks is a group.
    """
    m = F.col("m")
    # Staged, so that adaptive execution can split the members of a very large component.
    members = common.staged(members, "members")
    size = common.staged(members.groupBy("component").agg(F.count("*").alias("m")), "component-sizes")
    cut = F.when(m <= 8 * SMALL_BLOCK, F.ceil(m / SMALL_BLOCK)).otherwise(F.greatest(F.lit(8), F.ceil(m / BLOCK)))
    own = members.join(size.withColumn("blocks", cut.cast("int")), "component")
    own = own.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = own.select("component", "cid", "vec", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        lo, hi = int(key[1]), int(key[2])
        block, cid, copies = pdf["block"].to_numpy(), pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        i, j = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if not len(i) or not len(j):
            return pd.DataFrame({"cid": [], "others": []}, dtype="int64")
        x = _unit(pdf["vec"])
        rows, columns = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        for s in range(0, len(i), 512):
            at = i[s : s + 512]
            linked = (x[at] @ x[j].T >= least) & (cid[at][:, None] != cid[j][None, :])
            rows[s : s + 512] = linked @ copies[j]
            columns += copies[at] @ linked
        if lo == hi:
            return pd.DataFrame({"cid": cid[i], "others": rows})
        return pd.DataFrame({"cid": np.concatenate([cid[i], cid[j]]), "others": np.concatenate([rows, columns])})

    return dealt.groupBy("component", "lo", "hi").applyInPandas(run, "cid bigint, others bigint").groupBy("cid").agg(F.sum("others").alias("others"))


def _good(vec: Column) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    common.ship(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"))
    whole = rows.where(_good(F.col("vec"))).withColumn("f1", F.xxhash64("vec")).withColumn("f2", F.xxhash64(F.lit(7), "vec"))
    own = whole.groupBy("label", "f1", "f2").agg(F.min(F.struct("vec_id", "vec")).alias("x"), F.count("*").alias("copies"))
    classes = own.select("label", "f1", "f2", F.col("x.vec_id").alias("id"), F.col("x.vec").alias("vec"), F.size("x.vec").alias("dim"), "copies", F.monotonically_increasing_id().alias("cid"))
    classes = common.staged(classes, "vectors")
    state = pass_links(classes, least, passes, window)
    small = classes.select("cid", "label", "f1", "f2", "id", "copies")
    if state is None:
        known = small.select("label", "f1", "f2", "copies", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("others"))
    else:
        found = state.withColumnRenamed("id", "cid")
        counts = link_counts(classes.select("cid", "vec", "copies").join(found, "cid"), least)
        lowest = small.join(found, "cid").groupBy("component").agg(F.min("id").alias("lowest"))
        known = small.join(found, "cid", "left").join(lowest, "component", "left").join(counts, "cid", "left")
        known = known.select("label", "f1", "f2", "copies", F.coalesce("lowest", "id").alias("component_id"), F.coalesce("others", F.lit(0)).alias("others"))
    # Staged, so that adaptive execution can split the rows of a vector with very many copies.
    known = common.staged(known, "vector-classes")
    common.drop(classes)
    out = whole.select("vec_id", "label", "f1", "f2").join(known, ["label", "f1", "f2"]).select("vec_id", (F.col("copies") - 1 + F.col("others")).cast("long").alias("n_links"), "component_id")
    alone = rows.where(~_good(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
