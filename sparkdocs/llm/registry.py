"""Queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.llm.bpe import decode, encode
from sparkdocs.llm.chat import ROTATION_SQL, rotate
from sparkdocs.llm.embed_dedup import near_vectors
from sparkdocs.llm.langid import identify, learn
from sparkdocs.llm.license import recognise
from sparkdocs.llm.manifest import MANIFEST_SQL, lower_ascii, manifest
from sparkdocs.llm.minhash import near_duplicates
from sparkdocs.llm.packing import pack_documents, tokenizer_text
from sparkdocs.llm.ppm import score_texts
from sparkdocs.llm.quality import judged
from sparkdocs.llm.ranked import RANKED_SQL, rank_documents
from sparkdocs.llm.suffix import REPEATS_SQL, remove_repeats
from sparkdocs.llm.warc import MERKLE_SQL, archive, audit, damaged, leaves


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_rest(column: str, modulus: int):
    """crc32 of a number as text, modulo `modulus`; null for a null number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_rotation(spark: SparkSession, folder: str) -> DataFrame:
    found = rotate(_table(spark, folder, "conversations"))
    runs = F.transform("mask", lambda r: F.concat(r["length"].cast("string"), F.when(r["trained"], ":1").otherwise(":0")))
    return found.select("conv_id", "viewer", "part", "n_turns", "text", F.array_join(runs, " ").alias("mask_runs"), "n_trained")


def op2_merkle(spark: SparkSession, folder: str) -> DataFrame:
    records = archive(_table(spark, folder, "pages"))
    return audit(leaves(records), leaves(damaged(records)))


def op3_hyperplanes(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op4_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_rest("doc_id", 7) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return score_texts(docs, F.col("held_out"), ["doc_id", "held_out"], plain_scan=True)


def op5_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(_table(spark, folder, "documents"), model)


def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return judged(docs.select("doc_id", "text"), "q").select("doc_id", "q.*")


def op7_sentence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return recognise(_table(spark, folder, "documents"))


def op8_automaton(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    encoded = encode(_table(spark, folder, "documents").select("doc_id", "text"), model).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    numbered = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decode(numbered, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc32_rest("doc_id", 4) == 2, F.lit(False))
    model = learn(docs, held_out)
    found = identify(docs, model, "found", keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score", "found.rejected", "found.cross_entropy")


def op11_index_family(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = remove_repeats(docs, ["doc_id", "text"])
    zero = F.lit(0).cast("long")
    removed = F.aggregate("spans", zero, lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text").cast("long"), zero).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_term_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_bitmap_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = {"text": lower_ascii(F.col("text"))}
    return manifest(_table(spark, folder, "documents"), tampered=tampered, changed=crc32_rest("doc_id", 5) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rotation": op1_rotation,
    "op2_merkle": op2_merkle,
    "op3_hyperplanes": op3_hyperplanes,
    "op4_ppm": op4_ppm,
    "op5_best_fit": op5_best_fit,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_sentence_rules": op7_sentence_rules,
    "op8_automaton": op8_automaton,
    "op9_bbit_minhash": op9_bbit_minhash,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_index_family": op11_index_family,
    "op12_term_pipeline": op12_term_pipeline,
    "op13_bitmap_manifest": op13_bitmap_manifest,
}

ORACLES: dict[str, str] = {
    "op1_rotation": ROTATION_SQL, "op2_merkle": MERKLE_SQL, "op11_index_family": REPEATS_SQL,
    "op12_term_pipeline": RANKED_SQL, "op13_bitmap_manifest": MANIFEST_SQL,
}
