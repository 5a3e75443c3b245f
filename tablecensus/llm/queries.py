"""The registered queries of this subpackage, over whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.llm import bpe
from tablecensus.llm.conversation_tries import conversation_trie
from tablecensus.llm.decontamination import contamination
from tablecensus.llm.frames import shipped, table, utf8
from tablecensus.llm.licences import scan_licences
from tablecensus.llm.near_dups import near_duplicates
from tablecensus.llm.neighbours import nearest
from tablecensus.llm.packing import packed_sequences
from tablecensus.llm.quality import judged
from tablecensus.llm.sharding import interleaved_shards
from tablecensus.llm.spelling import LEAST_COUNT, spelling_forms, word_counts
from tablecensus.llm.suffixes import repeated_spans, row_key
from tablecensus.llm.toxicity import held_out, learn, score_toxicity
from tablecensus.llm.warc import read_warc, write_warc
from tablecensus.session import new_folder


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    found = repeated_spans(docs).select(
        "id",
        "text_hash",
        length.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    # texts without a repeated string are whole
    whole = docs.select(
        "doc_id", *row_key(), F.octet_length(utf8()).cast("bigint").alias("n_bytes"), F.sha2(utf8(), 256).alias("sha256")
    )
    none = F.lit(0).cast("bigint")
    return whole.join(found, ["id", "text_hash"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def op2_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).drop("text_hash")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(utf8()) + 1).cast("bigint").alias("size"),
        F.crc32(utf8()).alias("text_crc32"),
    )
    return interleaved_shards(docs, 8, carry=["size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Source and language stand for the directories of a document."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = F.concat_ws("/", part("source"), part("lang"), part("doc_id"))
    docs = table(spark, folder, "documents").select("doc_id", path.alias("path"), F.col("text"))
    return scan_licences(docs, carry=["doc_id", "path"])


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks), ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    records = read_warc(spark, path)
    return records.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        # of responses from the payload read back, of revisits from the record
        F.coalesce(F.octet_length("payload").cast("bigint"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
        "complete",
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_sequences(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = word_counts(table(spark, folder, "documents"))
    return spelling_forms(words.where(F.col("n") >= LEAST_COUNT))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_suffix_dedup,
        op2_near_dups,
        op3_sharding,
        op4_licences,
        op5_byte_bpe,
        op6_nearest,
        op7_quality_rules,
        op8_warc,
        op9_toxicity,
        op10_packing,
        op11_spelling,
        op12_decontamination,
        op13_conversation_trie,
    )
}
ORACLES: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT CAST(p.page_id AS BIGINT) AS page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
 CASE WHEN p.page_id < g.first THEN 'revisit' ELSE 'response' END AS record_type,
 CAST(CASE WHEN p.page_id < g.first THEN g.first END AS BIGINT) AS refers_to, TRUE AS complete
FROM p LEFT JOIN g ON g.html = p.html
""",
    "op12_decontamination": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, W(text) AS w FROM documents),
b AS (SELECT item_id, W(text) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(len(w) - 9), lambda i: w[i + 1:i + 10]) END) AS x
 FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(x) AS n FROM iw),
dw AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS s, w FROM d, sizes WHERE len(w) >= n),
dx AS (SELECT r, n, s, w[s + 1:s + n] AS x FROM dw),
hits AS (SELECT DISTINCT r, n, s, x FROM dx WHERE x IN (SELECT x FROM iw)),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
n_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (x)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)
""".replace(
        "W(text)",
        r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')",
    ),
}
