"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sources they belong to).
Source quotas come from weights, capped at ``most`` times what a source holds. A
flow network routes the words of the patterns to the quotas: a pattern's first
pass costs 1 a word, the second 2, the third 3, so repetition is convex and comes
last. The flow of a pattern then becomes whole passes and a rest, which is filled
with documents in the order of a seeded hash: buckets of the hash as a prefix,
then, within the bucket where the rest runs out, documents that still fit, again up
to ``most`` times where the documents left are too long.

Everything stays in Spark, sources and patterns as well: quotas follow from one
number, the words a unit of weight, found by a few sums over the sources; patterns
that share no source, over any number of others, are networks of their own, and a
task solves one at a time. Of a network a task holds its patterns, never documents.
A task that fills a rest sees one bucket of about BUCKET documents at a time.

Defined results: null and empty texts have size 0 and are never taken, nor are
documents without any source; a null source is a source of its own, last in order;
repeated rows share one decision; documents of one hash value and pattern do so too;
an empty table gives no row; extra columns pass, but for one named copies, which
sized() and copies() replace like size and sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.components import components

from . import common

MOST, BUCKET, BROADCAST_BYTES = 3, 1000, 32 << 20


def quotas(sources: DataFrame, total: float, most: float = MOST) -> DataFrame:
    """sources (size, weight) with quota: shares of total by weight, none above most times its size, the excess shared again by weight.

    A source is full when its weight times the unit exceeds most times its size. The
    unit only grows as sources fill up, so it alone tells which ones are full.
    """
    unit, n = None, -1
    full = lambda u: F.lit(False) if u is None else F.col("weight") * u > most * F.col("size")
    live = sources.where("weight > 0")
    while True:
        taken, open_, now = live.agg(F.sum(F.when(full(unit), F.col("size"))), F.sum(F.when(~full(unit), F.col("weight"))), F.count_if(full(unit))).first()
        if not open_ or now == n:
            break
        unit, n = (total - most * (taken or 0)) / open_, now
    share = F.when(F.col("weight") > 0, F.when(full(unit), F.lit(float(most)) * F.col("size")).otherwise(F.col("weight") * F.lit(unit or 0.0)))
    return sources.withColumn("quota", F.coalesce(share, F.lit(0.0)).cast("double"))


def route(patterns: list[tuple[tuple, int]], quota: dict, most: int = MOST) -> list[dict]:
    """Min-cost flow: words from each pattern (sources, size) to each source; pass k of a pattern costs k a word.

    Successive cheapest paths: a path leads from a pattern's next pass over any
    patterns that already serve a source and can move to another of theirs.
    """
    flow: list[dict] = [{} for _ in patterns]
    used = [0.0] * len(patterns)
    need = {s: float(q) for s, q in quota.items()}
    members: dict = {}
    for k, (sources, size) in enumerate(patterns):
        for s in sources if size else ():
            members.setdefault(s, []).append(k)
    for level in range(1, most + 1):  # a dearer pass helps only when no cheaper one can reach the quota
        for k in (k for k, (_, size) in enumerate(patterns) if size):
            while (room := level * patterns[k][1] - used[k]) > 1e-9:
                path = _path(k, patterns, flow, need, members)
                if path is None:
                    break
                amount = min([room, need[path[-1][1]], *(flow[q][s] for q, s in path[1::2])])
                used[k] += amount
                need[path[-1][1]] -= amount
                for i, (q, s) in enumerate(path):
                    flow[q][s] = flow[q].get(s, 0.0) + (amount if i % 2 == 0 else -amount)
    return flow


def _path(start: int, patterns, flow, need, members):
    """Steps (pattern, source): even ones gain words, odd ones lose them to the pattern before."""
    gained, lost = {}, {}  # source -> pattern that would serve it; pattern -> source that it would leave
    order, seen = [start], {start}
    for p in order:
        for s in sorted(set(patterns[p][0]), key=str):
            if s in gained or s not in need:
                continue
            gained[s] = p
            if need[s] > 1e-9:
                steps, q = [(p, s)], p
                while q != start:
                    s = lost[q]
                    steps += [(q, s), (gained[s], s)]
                    q = gained[s]
                return steps[::-1]
            for q in members.get(s, ()):
                if q not in seen and flow[q].get(s, 0.0) > 1e-9:
                    seen.add(q)
                    order.append(q)
                    lost[q] = s
    return None


def _hash(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 40))


def cyclic(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, in the order of rank."""
    return sources.withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))


def ranked(patterns: DataFrame) -> DataFrame:
    """(source, size, rank): each source's words and its place by code point, from 0, null last."""
    each = patterns.select(F.explode(F.array_distinct("pattern")).alias("source"), "words")
    sizes = each.groupBy("source").agg(F.sum("words").cast("long").alias("size")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    return common.running_sum(sizes, ["last", "source"], "one", "rank").select("source", "size", "rank")


def networks(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """patterns with ``network``: the least rank of the sources that are tied to a pattern's."""
    ranks = patterns.select("pattern", F.explode(F.array_distinct("pattern")).alias("s")).join(sources.select(F.col("source").alias("n"), "rank"), F.col("s").eqNullSafe(F.col("n")))
    ends = common.staged(ranks.groupBy("pattern").agg(F.min("rank").alias("first"), F.collect_list("rank").alias("ranks")), "pattern-ranks")
    ties = ends.where(F.size("ranks") > 1).select(F.col("first").alias("a"), F.explode("ranks").alias("b")).where("a <> b")
    if ties.head(1):
        found = components(ties).withColumnRenamed("id", "first")
        ends = ends.join(found, "first", "left").select("pattern", F.coalesce("component", "first").alias("network"))
    else:
        ends = ends.select("pattern", F.col("first").alias("network"))
    return patterns.join(ends, "pattern")


def flows(tied: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(pattern, base, rest): what route() sends through each pattern, network by network."""
    quota = sources.select(F.col("source").alias("n"), "quota")
    named = tied.select("pattern", "words", "network", F.posexplode(F.array_distinct("pattern")).alias("at", "s")).join(quota, F.col("s").eqNullSafe(F.col("n")))
    own = named.groupBy("pattern", "words", "network").agg(F.array_sort(F.collect_list(F.struct("at", F.col("s").alias("source"), "quota"))).alias("members"))

    def run(pdf):
        import pandas as pd

        order = sorted(range(len(pdf)), key=lambda k: str(list(pdf["pattern"].iloc[k])))
        found, quota = [], {}
        for k in order:
            found.append((tuple(m["source"] for m in pdf["members"].iloc[k]), int(pdf["words"].iloc[k])))
            quota |= {m["source"]: float(m["quota"]) for m in pdf["members"].iloc[k]}
        base, rest = [], []
        for (_, words), f in zip(found, route(found, quota, most)):
            sent = sum(f.values())
            base.append(min(most, int(sent // words)) if words else 0)
            rest.append(sent - base[-1] * words if words else 0.0)
        return pd.DataFrame({"pattern": [pdf["pattern"].iloc[k] for k in order], "base": base, "rest": rest})

    return own.groupBy("network").applyInPandas(run, "pattern array<string>, base int, rest double")


def plan(rows: DataFrame, weights: Callable[[DataFrame], DataFrame] | dict, total: float | None = None, most: int = MOST, seed: int = 4) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, size, sources array<string>) -> copies of each pattern's documents, and the sources with their quotas.

    weights: a dict of source to weight, or a function that adds ``weight`` to
    sources (source, size, rank), as cyclic(). The plan has a row for each pattern:
    see copies(). The sources: source, size, rank, weight, quota. A source's size
    is that of the documents that have it.
    """
    spark = rows.sparkSession
    patterns = common.staged(rows.groupBy(F.col("sources").alias("pattern")).agg(F.sum("size").cast("long").alias("words"), F.count("*").alias("docs")), "patterns")
    sources = ranked(patterns)
    if callable(weights):
        sources = weights(sources)
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "n string, weight double")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("n")), "left").drop("n").fillna(0.0, ["weight"])
    sources = common.staged(sources, "sources")
    words = patterns.agg(F.sum("words")).first()[0] or 0
    sources = common.staged(quotas(sources, float(words if total is None else total), most), "quotas")
    routed = flows(networks(patterns.where("words > 0"), sources), sources, most)
    sent = common.staged(routed.join(patterns, "pattern").withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).cast("long")).select("pattern", "base", "rest", "buckets"), "flows")

    keyed = _met(rows.where("size > 0").select("doc_id", "size", "sources"), sent)
    keyed = keyed.withColumn("h", _hash(seed)).withColumn("bucket", F.shiftright(F.col("h") * F.col("buckets"), 40))
    sums = keyed.groupBy("pattern", "base", "rest", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("words")
    edge = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    edge = common.staged(edge.select("pattern", "bucket", "base", (F.col("rest") - F.col("before")).alias("need")), "edges")
    small = common.stored_bytes(edge) <= BROADCAST_BYTES
    inside = keyed.drop("base").join(F.broadcast(edge) if small else edge, ["pattern", "bucket"]).groupBy("pattern", "bucket", "base", "need", "h", "doc_id", "size").agg(F.count("*").alias("n"))

    def fill(pdf):
        import pandas as pd

        need, most_more, chosen = float(pdf["need"].iloc[0]), most - int(pdf["base"].iloc[0]), []
        pdf = pdf.sort_values(["h", "doc_id", "size"])
        words = dict(pdf.assign(words=pdf["size"] * pdf["n"]).groupby("h", sort=False)["words"].sum())
        # What is still lacking when a pass ends, since the documents left are longer, comes from those that fit once more.
        for _ in range(most_more):
            for h, n in words.items():
                if n <= need:
                    chosen.append(h)
                    need -= n
        rest = [(n, h) for h, n in words.items() if chosen.count(h) < most_more and n < 2 * need]
        return pd.DataFrame({"pattern": [pdf["pattern"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]], "chosen": [chosen + [min(rest)[1]] if rest else chosen]})

    picks = inside.groupBy("pattern", "bucket").applyInPandas(fill, "pattern array<string>, bucket bigint, chosen array<bigint>")
    # A rest that ends with a bucket has that one as its edge, chosen whole. Without an edge it is nothing, or by rounding the whole pattern.
    out = sent.join(picks, "pattern", "left").select("pattern", "base", "buckets", F.coalesce("bucket", F.when(F.col("rest") > 0.5, F.col("buckets")).otherwise(F.lit(0))).alias("edge"), F.coalesce("chosen", F.array().cast("array<bigint>")).alias("chosen"))
    out = common.staged(out, "mix-plan")
    common.drop(patterns, sent, edge)
    return out, sources


def _met(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (sources) with the columns of their pattern; the table is broadcast up to BROADCAST_BYTES on disk, else adaptive execution splits a hot pattern's rows."""
    small = common.stored_bytes(table) <= BROADCAST_BYTES
    return rows.join(F.broadcast(table) if small else table, rows["sources"] == table["pattern"])


def copies(rows: DataFrame, planned: DataFrame, seed: int = 4) -> DataFrame:
    """rows with ``copies``: how often the mix takes each."""
    small = common.stored_bytes(planned) <= BROADCAST_BYTES
    p = planned.select(F.struct(*planned.columns).alias("_mix"))
    own = rows.join(F.broadcast(p) if small else p, F.col("sources") == F.col("_mix.pattern"), "left")
    bucket = F.shiftright(_hash(seed) * F.col("_mix.buckets"), 40)
    times = F.size(F.filter("_mix.chosen", lambda h: h == _hash(seed)))
    more = F.when(bucket < F.col("_mix.edge"), 1).when(bucket == F.col("_mix.edge"), times).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("_mix.base") + more).otherwise(F.lit(0))
    return own.withColumn("copies", F.coalesce(taken, F.lit(0)).cast("int")).select(*(c for c in rows.columns if c != "copies"), "copies")


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """docs with their words and, as sources, the one source of each; a null source stays null in the list."""
    return docs.withColumn("size", common.n_words(F.col("text"))).withColumn("sources", F.array(F.col(source).cast("string")))
