"""Corpus pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of ``docs``; extra columns are carried along, whatever their names. Null ids, null texts and repeated rows are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfwise.llm import byte_bpe, decontaminate, quality, similar_texts, suffix_dedup  # noqa: E402
from shelfwise.llm.common import read_table, stash  # noqa: E402

#: No SQL: the stages hold fitted models, hashes and merges.
ORACLE_SQL = None
_ROW = "_row"
#: Passages that the third stage cuts.
PASSAGE_BYTES, PASSAGE_WORDS = suffix_dedup.PASSAGE


#: Rows per Arrow batch: whole texts are sent to Python, and a batch is held several times over.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(suffix_dedup.NO_ID)).alias("_did"),
            F.xxhash64("doc_id", "text").alias("_th")]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents the classifier scores below its threshold; it learns from the labelled rows of ``docs``."""
    _small_batches(spark)
    model = quality.train_quality_model(docs, read_table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias(_ROW), "text")
    scored = quality.score_quality(whole, model, [_ROW])
    return scored.where(F.col("score") >= quality.THRESHOLD).select(f"{_ROW}.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least id of each group of similar texts, and one of rows that repeat id and text.

    Similar: five-word shingles, Jaccard similarity 0.8, found by op7's SimHash index and then by one of minima, and
    confirmed on whole sets (similar_texts).
    """
    _small_batches(spark)
    keyed = docs.select(F.struct(*_keys()).alias("key"), "text")
    groups = similar_texts.near_duplicates(keyed, "key")
    kept = stash(groups.groupBy("component_id").agg(
        F.sum((F.col("key") == F.col("component_id")).cast("int")).alias("rows")
    ).select("component_id._did", "component_id._th", "rows"), "kept")
    rows = docs.select(*_keys(), F.struct(*docs.columns).alias(_ROW))
    here = ["_did", "_th"]
    single = rows.join(kept.where("rows = 1"), here, "left_semi")
    repeated = rows.join(kept.where("rows > 1"), here, "left_semi").dropDuplicates(here)
    return single.unionByName(repeated).select(f"{_ROW}.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of PASSAGE_WORDS whole words and more that occur twice, at whole characters; ``n_chars`` follows.

    Passages are found from PASSAGE_BYTES on: four bytes a word with its space. op5's 400 bytes are its own contract.
    """
    _small_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    whole = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias("_no_text")).alias(_ROW))
    cut = suffix_dedup.remove_repeats(whole, [_ROW], with_text=True, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    text = F.when(~F.col(f"{_ROW}._no_text"), F.col("kept_text"))
    own = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col(f"{_ROW}.n_chars").cast("long"))
           if "n_chars" in others else None}
    return cut.select(*[(own[c] if c in own else F.col(f"{_ROW}.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    _small_batches(spark)
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select(F.col("did").alias("_did"), F.col("th").alias("_th")).distinct()
    rows = docs.select(*_keys(), F.struct(*docs.columns).alias(_ROW))
    return rows.join(stash(hit, "contaminated"), ["_did", "_th"], "left_anti").select(f"{_ROW}.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document left."""
    _small_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True, reuse=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
