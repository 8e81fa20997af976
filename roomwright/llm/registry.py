"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import bpe_encode
from .chat import CONTROL, END, ROLE, TEXT, conversation_digests, expand_conversations
from .common import read_table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_id import fit_profiles, predict_language
from .packing import pack
from .quality import fit_quality, score_quality
from .secret_scan import BASE, fit_ratios, labelled_samples, secret_spans, span_text
from .simhash import simhash_classes


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts imitate control strings, read back from the formatted examples."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversation_digests(expand_conversations(turns.unionByName(extra)))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model may learn a language from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.where(~is_held_out()))
    return predict_language(docs, profiles).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, links at 3 or fewer differing bits."""
    found = simhash_classes(read_table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(read_table(spark, sf_dir, "pages"), carry=("url",))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, and decoded again from its ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_encode(read_table(spark, sf_dir, "documents"), vocabulary, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and those that the Markov models add, in all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secret_spans(docs, fit_ratios(labelled_samples(docs)))
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))


#: Grades of the ratings: 0 toxic, 1 poor, 2 good; and the probability of a good document from which one is kept.
GRADES, LEAST_GOOD = 3, 0.4


def grades_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of a good document, and selection, for all documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, grades_of(read_table(spark, sf_dir, "labels")), GRADES)
    scored = score_quality(docs, model)
    return scored.select("doc_id", "expected_grade", F.get("tail", F.lit(1)).alias("p_good"), (F.get("tail", F.lit(1)) >= LEAST_GOOD).alias("kept"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, neighbours on the curve together."""
    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(ROLE + TEXT + END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') + CASE WHEN arg_max(role, turn) = 'assistant' THEN 0 ELSE 1 END AS n_examples
FROM t GROUP BY conv_id
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {
    "op1_ann_search": op1_ann_search,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_html_text": op5_html_text,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}
ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op7_exact_dedup": OP7_SQL,
}
