"""The registered queries of the text operators, over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, merkle, packing, prefix_trie, quality_classifier, quality_rules, token_counts
from .decontaminate import contained_items
from .mixing import mix
from .simhash import near_duplicates
from .sql import OP12, OP13
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes

#: A public byte-level vocabulary, where the session's setting `spark.millrace.vocabulary` names no other.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The same for packing, where the setting is `spark.millrace.packing.vocabulary`.
PACKED = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    vocabulary = vocabulary or spark.conf.get("spark.millrace.vocabulary", VOCABULARY)
    histogram = token_counts.length_histogram(_table(spark, sf_dir, "documents"), token_counts.load_ranks(spark, vocabulary))
    return token_counts.context_answers(token_counts.suffix_sums(histogram))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 5, 0)
    model = language_id.train(docs.filter(~out))
    return language_id.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rate")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents")).drop("kept")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 4, 2)
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels").filter(~out))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = packing.load_vocabulary(spark, vocabulary or spark.conf.get("spark.millrace.packing.vocabulary", PACKED))
    pieces = packing.pack(_table(spark, sf_dir, "documents"), ranks)
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction,
            op2_token_counts,
            op3_language_id,
            op4_quality_rules,
            op5_substring_dedup,
            op6_source_mixing,
            op7_suffix_dedup,
            op8_benchmark_decontamination,
            op9_quality_classifier,
            op10_simhash_near_dedup,
            op11_packing,
            op12_prefix_trie,
            op13_merkle_manifest,
            pipeline,
        )
    }


#: op5: windows of 13 words, first document of each, words covered by a window of a smaller first document.
OP5 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 12] AS win FROM words, unnest(range(1, len(w) - 11)) AS t(i)
), firsts AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM windows JOIN firsts USING (win), unnest(range(0, 13)) AS s(j) WHERE first < doc_id
), numbered AS (
  SELECT doc_id, p AS pos, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS rest FROM numbered ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: op8: distinct shingles of five words in lower case, and the share of an item's that a document holds.
OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)
), bs AS (
  SELECT DISTINCT item_id, w[i:i + 4] AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)
), sizes AS (
  SELECT item_id, count(*) AS n FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(n)::BIGINT AS item_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5, "op8_benchmark_decontamination": OP8, "op12_prefix_trie": OP12, "op13_merkle_manifest": OP13}
