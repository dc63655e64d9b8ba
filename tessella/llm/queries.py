"""The queries of this subpackage: thin digests of the operators' results on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fim, langid, lines, media, minhash, mixing, packing, pii, search, token_counts, token_store, urls
from .common import staged, stored_bytes, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "word", 2)[1]


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out("doc_id")).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    rows = staged(docs, "sizes")
    planned, sources = mixing.plan(rows, mixing.cyclic)
    told = sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), F.col("quota").alias("target"))
    told = F.broadcast(told) if stored_bytes(sources) <= mixing.BROADCAST_BYTES else told
    out = mixing.copies(rows, planned).join(told, F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "clean_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), "byte", 0)


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    size = F.octet_length(data)
    padded = F.greatest(F.lit(64), F.ceil(size / 64).cast("int") * 64)
    payload = F.concat(data, F.unhex(F.repeat(F.lit("00"), padded - size)))
    rows = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("n_bytes"), payload.alias("payload"))
    read = media.probe(media.with_streams(rows, "payload"))
    feature = F.format_string("packets=%d;units=%d;random_access=%d;first_pts=%d;last_pts=%d;discontinuities=%d;stream_type=%d", "packets", F.size("times").cast("long"), F.size("random_access").cast("long"), F.element_at("times", 1), F.element_at("times", -1), "discontinuities", "stream_type")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), "byte")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.arrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_minhash_dedup, op2_token_store, op3_language_id, op4_mix_sources, op5_personal_data, op6_url_filter, op7_pack, op8_transport_stream, op9_embedding_dedup, op10_line_dedup, op11_token_counts, op12_lexical_search, op13_fill_in_middle, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": urls.oracle(), "op10_line_dedup": lines.ORACLE, "op12_lexical_search": search.ORACLE, "op13_fill_in_middle": fim.ORACLE}
