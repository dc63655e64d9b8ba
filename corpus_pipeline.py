"""A training corpus from documents: language, lines, near duplicates, mix, packing.

Every stage works on the whole Parquet table that the one before has written. Rows of
any doc_id, null or repeated, go through the first two stages one by one; of repeated
rows near_dedup keeps one. An empty table stays empty in every stage. Columns besides
those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, langid, lines, minhash, mixing, packing
from tessella.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected when even its best language needs more than so many bits a letter, and so many in all beyond
#: that: prose needs 3 to 5 a letter, and two phrases of any kind, which a name alone may be, some 32.
MOST_BITS, SPARE_BITS = 9.0, 32.0
TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 1024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; null, empty, letterless and unparsable texts go. A null lang is filled in.

    Without any labelled document no language is known, and all documents go.
    """
    model = langid.learn(docs.where(~langid.held_out("doc_id")).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != "und") & ((F.col("bits") - MOST_BITS) * F.length("text") <= SPARE_BITS))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; documents stay, with shorter texts and their n_chars. A null text stays null, with n_chars null."""
    out = lines.drop_boilerplate(docs.select(*COLUMNS), "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id; of several rows of one doc_id the least.

    Texts without words link with nothing and stay. Rows of a null doc_id link with
    nothing; of equal ones one stays.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # Only rows of repeated doc_ids are compared as a whole; the ids of the others alone are counted.
    again = common.staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not again.head(1):
        return left
    known = again.select(F.col("doc_id").alias("_id"))
    own = F.col("doc_id").eqNullSafe(F.col("_id"))
    some = left.join(known, own, "left_semi")
    least = some.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    nulls = some.where("doc_id is null").dropDuplicates()
    return left.join(known, own, "left_anti").unionByName(least).unionByName(nulls).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target; a document that the mix takes k times is there k times. Texts without words are never taken."""
    rows = common.staged(mixing.sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    planned, _ = mixing.plan(rows, mixing.cyclic)
    taken = mixing.copies(mixing.sized(docs.select(*COLUMNS)), planned).where(F.col("copies") > 0)
    return taken.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of CAPACITY ids; see packing.PIECES. A null text is its end id alone, and every row is packed for itself."""
    return packing.pack(docs, tokenizer(TOKENIZER), "byte", END_ID, CAPACITY)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Language identification and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.staged(docs, name)
            common.drop(before)
            before = docs
    return docs
