"""Registered queries of this subpackage: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, jaccard, language, lines, mixing, neighbours, packing, pages, phrases, quality, scoring, suffix, urls
from .common import table
from .oracle import SQL  # noqa: F401 - read by the entry point

#: The rules every ``pages`` url is judged by.
URL_RULES = urls.parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])
MIX_LEVELS = ["domain", "lang", "source"]
#: Weights of the mix by level; values not named weigh 1.
MIX_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
LANGUAGE_FOLDS, HELD_OUT = 3, 1
LM_FOLDS = 10


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def domain_of(source):
    """The table has no domain; four domains are dealt from the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(4)).cast("string"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.weak_labels(listed))
    return urls.judge(listed, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % LANGUAGE_FOLDS
    model = language.fit(docs, fold != HELD_OUT)
    judged = language.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("text").alias("kept_md5"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.apply_policy(book, max(quality.POLICIES)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language over all documents."""
    found = phrases.phrases(table(spark, sf_dir, "documents"), least=100, share=100, top=2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a trigram model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.score(docs, F.crc32(F.col("doc_id").cast("string")) % LM_FOLDS == 0, order=3)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its cluster after five rounds and a last assignment."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), dimensions=64, count=40, rounds=5, seed=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filters, op2_html_extraction, op3_language_id, op4_best_fit_packing, op5_line_dedup, op6_nearest_neighbours, op7_suffix_array_dedup, op8_ngram_jaccard, op9_quality_rules, op10_mixing,
    op11_phrase_collocations, op12_lm_scoring, op13_centroid_clustering)}


def in_utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run
