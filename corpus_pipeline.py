"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. Language ID drops what it rejects, line dedup deletes later copies of repeated runs
of lines, the n-gram join keeps one document of each group of near copies, mixing selects documents by target weights, and packing
turns what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import jaccard, language, lines, mixing, packing, queries
from tickloom.llm.common import SPACE_CHARS, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mix keeps; no document is taken twice.
MIX_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null texts, texts without a letter, and scores below the calibrated floor.

    A missing language is filled with the predicted one.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % queries.LANGUAGE_FOLDS
    judged = language.predict(docs, language.fit(docs, fold != queries.HELD_OUT))
    return judged.filter("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which no word is left."""
    cut = lines.dedup_lines(docs)
    empty = F.translate(F.coalesce("text", F.lit("")), SPACE_CHARS, "") == ""
    return cut.filter((F.col("n_removed") == 0) | ~empty).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more the one with the smallest id stays.

    Rows without an id are in no group and stay.
    """
    groups = jaccard.jaccard_components(docs, size=5, percent=80)
    gone = groups.filter("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by the domain, language and source budgets, each once; rows without an id or a word are not."""
    chosen = mixing.mix(docs.withColumn("domain", queries.domain_of(F.col("source"))), queries.MIX_LEVELS,
                        queries.MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1)
    return docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
          ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Language ID, the n-gram components and the packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
