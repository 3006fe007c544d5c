"""From raw documents to packed training sequences; every stage works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.llm.langid import identify, learn
from sparkdocs.llm.minhash import linked, text_hash
from sparkdocs.llm.packing import pack_documents, tokenizer_text
from sparkdocs.llm.quality import free_name, judged
from sparkdocs.session import fresh_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior, or the length and repetition floor, rejects go.

    A null or empty text has no words and goes; every row is judged by its own text, repeated ones and those
    without an id too. An empty table stays empty.
    """
    name = free_name(docs, "quality")
    return judged(docs, name).filter(F.col(name).getField("kept")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, above their language's calibrated cross-entropy or of unsure language go.

    The models are learned from labelled rows that are still there. A null text goes; of languages with
    equal cross-entropy the first by name counts. Every row is judged by its own text, repeated ones and
    those without an id too; null languages are not learned from. An empty table stays empty.
    """
    name = free_name(docs, "language")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs, learn(docs, held_out), name)
    return found.filter(~F.col(name).getField("rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one with the smallest id.

    Rows that repeat an id and its text are one document, rows that share an id alone are several; of near
    copies that share the smallest id one stays. Rows without an id link with nothing and stay.
    """
    found = linked(docs, percent=80).filter("kept AND doc_id IS NOT NULL")
    first = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    empty = found.filter("group IS NULL").select("doc_id", "text_hash").distinct()
    keep = first.select("first.*").unionByName(empty).toDF("_id", "_hash")
    named = docs.join(
        keep, (docs["doc_id"] == keep["_id"]) & (text_hash(docs["text"]) == keep["_hash"]), "left_semi"
    )
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id")
    if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, each with its sequence and place in it.

    A null or empty text is the end token alone; repeated rows and rows without an id are documents of their
    own. An empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_text(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# Trained models, unions of links and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
