"""From raw documents to packed sequences: each stage reads what the one before has written.

Counted as part of ``tablecensus.llm``. A stage takes the session, the documents
left by its predecessor and the folder of the given tables.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.llm.frames import TEXT_BATCH_BYTES, ship_package, shipped, stored, table
from tablecensus.llm.near_dups import NO_ID, near_duplicates, row_key
from tablecensus.llm.packing import packed_sequences
from tablecensus.llm.quality import judged
from tablecensus.llm.suffixes import without_repeats
from tablecensus.llm.toxicity import learn, toxicity_score


# A repeated passage is looked for by this many bytes, fewer than 51 words have, on a cover of this order.
PASSAGE = 200, 7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores below 0.5; learned from the labels of those there are.

    Written here, so that texts go to Python in small batches: what a task holds of them outside of the heap, on
    both sides, would stay with the executor in the stages that follow.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    return stored(docs.where(toxicity_score(docs, model) < 0.5), "toxicity", TEXT_BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and that the voting rules find good."""
    rows = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return judged(rows, carry=["document"]).where("kept").select("document.*").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of repeated rows one, too."""
    kept = near_duplicates(docs).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("document"), *row_key())
    one = rows.dropDuplicates(["id", "text_hash"])
    return one.join(kept, ["id", "text_hash"], "left_semi").select("document.*").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that occur twice."""
    return without_repeats(docs, *PASSAGE, least_words=51)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, shipped(f)) for f in (toxicity, quality, near_dedup, suffix_dedup, packing)]

# Compression, registers and tokens have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again for the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
