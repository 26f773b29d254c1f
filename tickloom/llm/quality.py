"""Quality rules: a ledger of measurements and failure bits, judged by versioned policies.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a bit mask, so a new policy version, or what one rule alone removes, needs no second look at a text.
Everything is DataFrame functions and needs no shuffle; only the report aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_CHARS, words_of

WINDOW = 8
#: Characters counted as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to each row.

    Null and empty texts measure 0 everywhere. A line counts when it has a word; a line equal to an earlier one is
    a duplicate. Words covered by an eight-word window that occurs twice or more in the text are repeats, the first included.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumns({"__t": t, "__w": words_of(F.col(text))})
    n = F.size("__w")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    hashed = staged.withColumns({
        "__h": F.transform("__w", lambda w: F.xxhash64(w)),
        "__l": lines,
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("__t", SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
    })
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)]))
    windowed = hashed.withColumn("__g", grams)
    return windowed.withColumns({
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__g")) < F.size("__g"), _covered(F.col("__g")))
                           .otherwise(F.lit(0)).cast("long"),
    }).drop("__t", "__w", "__h", "__l", "__g")


def _covered(grams: Column) -> Column:
    """Words under the windows whose hash occurs twice or more: sort the windows, keep those equal to a neighbour."""
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # one element array, so that the sorted windows are computed once and bound to a name
    return F.transform(F.array(pairs), lambda s: _union_length(F.array_sort(F.transform(
        F.filter(F.transform(s, lambda x, k: F.struct(
            x["i"].alias("i"), ((F.get(s, k - 1)["g"].eqNullSafe(x["g"]))
                                | (F.get(s, k + 1)["g"].eqNullSafe(x["g"]))).alias("r"))), lambda y: y["r"]),
        lambda y: y["i"]))))[0]


def _union_length(starts: Column) -> Column:
    return F.transform(F.array(starts), lambda s: F.aggregate(
        F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b))[0]


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` is its place in the mask and never reused."""
    bit: int
    name: str
    fails: Column


def default_rules() -> list[Rule]:
    n, c = F.col("n_words"), F.col
    return [
        Rule(0, "too_few_words", n < 20),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 30 * n),
        Rule(2, "symbols", 100 * c("n_symbols") > 30 * n),
        Rule(3, "duplicate_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule(4, "word_length", (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)),
    ]


#: Bits that count, by policy version. Bits 0 and 1 are the base every version holds.
BASE_MASK = 0b00011
POLICIES = {1: 0b00111, 2: 0b11111}


def ledger(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (long, one bit per failed rule) for each row; every rule is evaluated once."""
    rules = default_rules() if rules is None else rules
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return with_measures(df, text).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: int) -> DataFrame:
    """Add ``base_failed`` and ``kept`` by the mask of a policy version."""
    mask = POLICIES[version] | BASE_MASK
    return book.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(BASE_MASK) != 0,
                             "kept": F.col("fail_bits").bitwiseAND(mask) == 0})


def ablations(book: DataFrame, version: int, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it removes (kept without it).

    The documents are counted by distinct bit pattern first, so no more than 2^rules rows leave the aggregation.
    """
    rules = default_rules() if rules is None else rules
    mask = POLICIES[version] | BASE_MASK
    seen = F.col("fail_bits").bitwiseAND(mask)
    patterns = book.groupBy(seen.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    ones = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m"))
            for r in rules if mask & (1 << r.bit)]
    one = patterns.select("bits", "n", F.explode(F.array(*ones)).alias("x"))
    return one.groupBy(F.col("x.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("x.m")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("x.m"), F.col("n")).otherwise(0)).alias("n_only"))
