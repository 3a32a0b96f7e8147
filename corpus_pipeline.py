"""A corpus pipeline: language, near-duplicates, benchmark passages, packing. Part of lumaframe.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.decontamination import decontaminated
from lumaframe.llm.language_id import held_out, keep_identified, train
from lumaframe.llm.near_copies import distinct_rows
from lumaframe.llm.packing import pack
from lumaframe.llm.queries import tokenizer_file
from lumaframe.llm.shared import remove_folder, shared_dir

#: A document goes if it has no letter, or if no learned language has at least this share of its probability.
LEAST_SCORE = 0.3
#: Near-duplicates share this part, by Jaccard, of their sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Learns from the labelled rows that are not held out; keeps what is in a language it learned."""
    network, langs = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return keep_identified(docs, network, langs, LEAST_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Of each class of near-duplicates one row stays: that with the least doc_id, or one without if none has any."""
    return distinct_rows(docs, SHINGLE, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Documents with a passage of a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Training sequences; the ids themselves are left to their CRC-32."""
    pieces = pack(docs, tokenizer_file("word_bpe_49k.json"), end=2, remember=150_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("language_id", language_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: No stage can be stated in SQL; tests/llm/test_pipeline.py holds run() against stages in plain Python on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read again.

    A stage's folder goes when the next one's is written; the last one's stays, as the result reads it. Rows are told apart by
    doc_id and text: null and repeated doc_ids are rows like others, repeated rows count once. Null and blank texts have
    no language and go. All columns of documents stay up to the packing, whatever their names; an empty table gives no rows.
    """
    home, docs, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{home}/{name}"
        docs = spark.read.parquet(before)
    return docs
