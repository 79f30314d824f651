"""The numbered queries over the training-data tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.warc import convert, pages_as_arc

    return convert(pages_as_arc(read(spark, sf_dir, "pages"))).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.toxicity import scored, trained

    docs = read(spark, sf_dir, "documents")
    machine = trained(docs, read(spark, sf_dir, "labels").where(~_held_out()))
    out = scored(docs, machine)
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.pii import annotated, spans_of

    return spans_of(annotated(read(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.shared import shared_dir
    from codequarry.llm.sharding import arrival, arrive_and_compact

    docs = read(spark, sf_dir, "documents")
    store = arrive_and_compact(docs, shared_dir(spark))
    rows = store.read()
    rows = docs.where("false") if rows is None else rows
    return rows.select("doc_id", arrival(4).alias("arrival"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85).drop("fp")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.language import labelled, trained

    docs = read(spark, sf_dir, "documents")
    model = trained(docs.where(~_held_out()))
    return labelled(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codequarry.llm.bpe import encoded

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.leaks import occurrences

    return occurrences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("fp")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.quality import judged

    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_e", "n_other")
    return judged(read(spark, sf_dir, "documents")).select("doc_id", *measures, "base_failed", "kept")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.urls import judged

    return judged(read(spark, sf_dir, "pages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.negatives import hard_negatives, usable

    rows = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return hard_negatives(vectors, F.col("id") % 100 == 0)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.llm.trie import nodes, rebuilt, sequences

    return nodes(rebuilt(sequences(read(spark, sf_dir, "conversations"))))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codequarry.llm.chat import TRICKY, formatted, read_back
    from codequarry.llm.shared import stored

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(stored(formatted(read(spark, sf_dir, "conversations").select(*added.columns).union(added), path)), path)


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_pii": op3_pii,
        "op4_sharding": op4_sharding,
        "op5_minhash": op5_minhash,
        "op6_language": op6_language,
        "op7_bpe": op7_bpe,
        "op8_leaks": op8_leaks,
        "op9_quality": op9_quality,
        "op10_urls": op10_urls,
        "op11_negatives": op11_negatives,
        "op12_trie": op12_trie,
        "op13_chat": op13_chat,
    }


def oracle_sql() -> dict[str, str]:
    from codequarry.llm import chat, negatives, quality, sharding, trie, warc

    return {"op1_warc": warc.SQL, "op4_sharding": sharding.SQL, "op9_quality": quality.SQL, "op11_negatives": negatives.SQL, "op12_trie": trie.SQL, "op13_chat": chat.SQL}
