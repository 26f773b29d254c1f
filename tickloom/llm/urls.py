"""URL filters: longest matching host and path rule first, else gradient-boosted trees on lexical features.

The trees see only the url's letters: length, depth, digit ratio, entropy, parameter counts, separators, and the
block rate of the host's suffix among the labelled urls. All columns are DataFrame functions; training and scoring
are Spark's own tree ensemble.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

#: Labelled urls used for training at most (expected number; chosen by hash).
TRAIN_URLS = 20_000
#: Fixed words that mark a host as unwanted when no labelled urls are given.
SEED_TERMS = ("casino", "bet", "bets", "pills", "spam", "adult", "ads", "track", "xxx", "porn", "viagra", "loan")
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params",
            "f_query_length", "f_hyphens", "f_host_hyphens", "f_marks", "f_vowels", "f_suffix_rate", "f_suffix_seen"]


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def parse_rules(lines: Sequence[str]) -> list[UrlRule]:
    """``allow org/`` or ``block example.org/es/``: verdict, host, and path from the first slash on."""
    rules = []
    for line in lines:
        verdict, _, rest = line.strip().partition(" ")
        host, slash, path = rest.strip().partition("/")
        rules.append(UrlRule(verdict, host, slash + path))
    return rules


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, null without one; ties go to the first in order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character of a text, 0 for an empty one."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    def term(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)
    return F.coalesce(F.aggregate(F.transform(F.array_distinct(F.split(text, "")), term), F.lit(0.0),
                                  lambda a, b: a + F.coalesce(b, F.lit(0.0))), F.lit(0.0))


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the lexical features (doubles, never null) and ``__suffix``, the last label of the host."""
    u = lower_ascii(F.coalesce(F.col(url), F.lit("")))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    staged = df.withColumns({"__u": u, "__h": host, "__p": path, "__q": F.regexp_extract(u, r"\?([^#]*)", 1)})
    n = F.greatest(F.length("__u"), F.lit(1))
    def count(column: str, chars: str) -> Column:
        return F.length(column) - F.length(F.translate(column, chars, ""))
    f = {
        "f_length": F.length("__u"), "f_host_length": F.length("__h"), "f_path_length": F.length("__p"),
        "f_depth": count("__p", "/"), "f_labels": count("__h", "."), "f_digits": count("__u", "0123456789") / n,
        "f_entropy": _entropy(F.col("__u")),
        "f_params": F.when(F.col("__q") == "", 0).otherwise(1 + count("__q", "&;")),
        "f_query_length": F.length("__q"), "f_hyphens": count("__u", "-"), "f_host_hyphens": count("__h", "-"),
        "f_marks": count("__u", "_%=~@,+"),
        "f_vowels": count("__h", "aeiou") / F.greatest(F.length("__h"), F.lit(1)),
    }
    return staged.withColumns({k: v.cast("double") for k, v in f.items()}) \
        .withColumn("__suffix", F.element_at(F.split("__h", r"\."), -1)).drop("__u", "__h", "__p", "__q")


@dataclass
class UrlModel:
    """Fitted trees, the suffix statistics of the training urls (at most one row per training url) and the prior."""
    trees: GBTClassificationModel
    suffixes: DataFrame
    prior: float

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Add ``p_block`` (0 to 1) to each row."""
        # the table's own columns travel in a struct, so that none of them can clash with a helper column
        held = df.select(F.col(url).alias("url"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
        rows = _with_suffix(with_features(held), self.suffixes, self.prior)
        scored = self.trees.transform(_assembler().transform(rows))
        own = [F.col("__row").getField(c).alias(c) for c in df.columns if c.lower() != "p_block"]
        return scored.select(*own, vector_to_array("__prob")[1].alias("p_block"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="__x")


def _with_suffix(df: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """The suffix table comes from the bounded training sample, so it may be broadcast."""
    return df.join(F.broadcast(suffixes), "__suffix", "left") \
        .withColumns({"f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(prior)),
                      "f_suffix_seen": F.coalesce("f_suffix_seen", F.lit(0.0))})


def weak_labels(urls: DataFrame, url: str = "url", terms: Sequence[str] = SEED_TERMS) -> DataFrame:
    """Labelled urls from seed words: 1 where a word of the host (between dots and hyphens) is a seed term, else 0."""
    tokens = F.split(host_of(F.col(url)), r"[.\-]")
    hit = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))
    return urls.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.when(hit, 1.0).otherwise(0.0).alias("label"))


def fit(labelled: DataFrame, limit: int = TRAIN_URLS, seed: int = 17, trees: int = 20, depth: int = 4) -> UrlModel | None:
    """Train on (url, label) rows; equal urls count once (label: their mean, 0.5 and more is 1).

    About ``limit`` urls are used, half of each class where it has them, chosen by hash. With one class only, or no row, there is
    nothing to learn and the result is None.
    """
    once = labelled.groupBy("url").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, limit / 2 / n))) for k, n in counts.items()])
    u01 = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = with_features(once.filter(u01 < share)).persist()
    try:
        prior = sample.agg(F.avg("label")).first()[0]
        if prior is None or prior in (0.0, 1.0):
            return None
        suffixes = sample.groupBy("__suffix").agg(
            ((F.sum("label") + 10 * F.lit(prior)) / (F.count(F.lit(1)) + 10)).alias("f_suffix_rate"),
            F.log1p(F.count(F.lit(1)).cast("double")).alias("f_suffix_seen"))
        rows = sample.sparkSession.createDataFrame(suffixes.collect(), suffixes.schema)
        x = _assembler().transform(_with_suffix(sample, rows, prior)).select("__x", "label")
        gbt = GBTClassifier(featuresCol="__x", labelCol="label", predictionCol="__pred", maxIter=trees,
                            maxDepth=depth, stepSize=0.3, seed=seed) \
            .setRawPredictionCol("__raw").setProbabilityCol("__prob")
        return UrlModel(gbt.fit(x), rows, prior)
    finally:
        sample.unpersist()


def judge(urls: DataFrame, rules: Sequence[UrlRule], model: UrlModel | None, url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, p_block and verdict to each row.

    A rule decides where one fits; else the model blocks from ``threshold`` on; without a model everything else is
    allowed. Null urls have empty host and path and are judged like an empty url. Columns of these names are replaced.
    """
    own = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "p_block", "verdict")]
    df = urls.select(*[F.col(f"`{c}`") for c in own])
    df = model.score(df, url) if model else df.withColumn("p_block", F.lit(0.0))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule = matched_rule(host, path, rules)
    return df.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), "p_block",
                     F.coalesce(rule["verdict"], F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"))
