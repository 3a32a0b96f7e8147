"""The corpus queries by name, over the whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.decontamination import overlaps
from lumaframe.llm.html_text import extract_text
from lumaframe.llm.language_id import languages
from lumaframe.llm.licenses import COPYRIGHT, HEADS, NOTICES, SPELLINGS, TEXTS, license_scan
from lumaframe.llm.lm_scoring import scores
from lumaframe.llm.multiset_hash import edited_fingerprints
from lumaframe.llm.packing import pack
from lumaframe.llm.sharding import shard_documents
from lumaframe.llm.simhash import near_duplicates
from lumaframe.llm.token_counts import count_tokens



def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, which every node must have: in TOKENIZER_DIR, or where the package of the files says."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    digits = F.lower(F.hex("fp"))
    return rows.select("doc_id", F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]).alias("fingerprint"), "component_id")


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_elias_fano_lm, op2_feistel_shards, op3_simhash_golay, op4_multiset_hash, op5_packed_sequences, op6_language_gru, op7_spaced_seeds, op8_token_counts, op9_main_text, op10_license_digests)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """The scan in SQL, from the same texts, pattern and spellings."""
    known = [(k, t) for k, ts in NOTICES.items() for t in ts] + list(TEXTS.items()) + [(k, f"{h}\n\n{TEXTS[k]}") for k, hs in HEADS.items() for h in hs]
    spelled = " ".join(f"WHEN {_quoted(old)} THEN {_quoted(new)}" for old, new in SPELLINGS.items())
    words = "list_filter(string_split_regex(regexp_replace(lower(x), " + _quoted(COPYRIGHT) + ", ' ', 'g'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    form = f"array_to_string(list_transform({words}, lambda w: CASE w {spelled} ELSE w END), ' ')"
    return f"""WITH k(license_id, x) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known)}),
 kd AS (SELECT DISTINCT license_id, sha256({form}) AS digest FROM k),
 u AS (SELECT doc_id, 'document' AS scope, text AS x FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
 ud AS (SELECT doc_id, scope, sha256({form}) AS digest FROM u)
 SELECT doc_id, scope, license_id, digest, count(*) AS n FROM ud JOIN kd USING (digest) GROUP BY ALL"""


ORACLE: dict[str, str] = {"op10_license_digests": _license_sql()}
