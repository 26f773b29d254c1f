"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords (1 to 4 bytes inside a word, word borders included, lower
case), hashed into ``BUCKETS``. The embeddings and the softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled texts; Spark extracts the subword counts and predicts. A temperature and a rejection
score are set on a part of the sample that was not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

BUCKETS, DIM, SIZES = 1 << 15, 16, (1, 2, 3, 4)
#: Texts of a mini-batch.
BATCH = 16
#: Training texts of one language at most (expected number; chosen by hash).
TRAIN_PER_LANGUAGE = 500
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Share of doubt in the labels of the calibration texts; it keeps scores below certainty where all of them are right.
SMOOTHING = 0.02
#: No score from here on is rejected.
DOUBT = 0.4
#: Bytes of a subword: letters a to z and all bytes of other scripts; everything else is a word border.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of the whole text."""
    a = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    gap = a == 32
    a = a[~(gap & np.concatenate(([False], gap[:-1])))].astype(np.uint32)
    gap, found, h = a == 32, [], np.zeros(len(a), np.uint32)
    inside = np.ones(len(a), bool)
    for size in range(1, max(SIZES) + 1):
        n = len(a) - size + 1
        if n <= 0:
            break
        h = h[:n] * np.uint32(0x01000193) ^ a[size - 1:]
        # a border may open or close a subword, never lie inside it
        inside = inside[:n] if size < 3 else inside[:n] & ~gap[size - 2:size - 2 + n]
        keep = inside & ~gap[:n] if size == 1 else inside
        if size in SIZES:
            x = (h + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found.append(((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1))[keep])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    """Languages, score of each bucket (embedding times softmax weights), bias, temperature, and the least accepted score."""
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float

    def probabilities(self, text: str) -> np.ndarray:
        s = subwords(text)
        z = self.bias + (self.table[s].mean(0) if len(s) else 0)
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(counts: list[np.ndarray], buckets: list[np.ndarray], labels: np.ndarray, languages: list[str],
          epochs: int = 12, steps: int = 1200, rate: float = 2.0, seed: int = 3) -> LanguageModel:
    """Stochastic gradient descent over mini-batches; every fifth text is kept for calibration.

    Small samples are passed more often, so that there are about ``steps`` batches at least.
    """
    rng = np.random.default_rng(seed)
    k, n = len(languages), len(labels)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    order = rng.permutation(n)
    held = order[::5] if n >= 10 * k else order
    fit = np.setdiff1d(order, held) if n >= 10 * k else order
    shares = [(c / max(1, c.sum())).astype(np.float32) for c in counts]

    def mean(i: int) -> np.ndarray:
        return shares[i] @ embed[buckets[i]] if len(buckets[i]) else np.zeros(DIM, np.float32)

    epochs = max(epochs, -(-steps * BATCH // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            if not len(batch):
                continue
            x = np.stack([mean(i) for i in batch])
            grad = _softmax(x @ weight + bias)
            grad[np.arange(len(batch)), labels[batch]] -= 1
            grad /= len(batch)
            back = grad @ weight.T
            weight -= step * x.T @ grad
            bias -= step * grad.sum(0)
            for i, g in zip(batch, back):
                embed[buckets[i]] -= 20 * step * shares[i][:, None] * g
    logits = np.stack([mean(i) for i in held]) @ weight + bias
    truth = labels[held]
    grid = np.geomspace(0.01, 5, 80)
    loss = []
    for t in grid:
        p = np.log(_softmax(logits / t) + 1e-12)
        loss.append(-((1 - SMOOTHING) * p[np.arange(len(held)), truth] + SMOOTHING * p.mean(1)).mean())
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == truth]
    # rejects at most one in a thousand of the rightly predicted texts, and only scores below a bound
    floor = min(DOUBT, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return LanguageModel(languages, (embed @ weight).astype(np.float32), bias, temperature, floor)


def fit(docs: DataFrame, allowed: Column, per_language: int = TRAIN_PER_LANGUAGE, seed: int = 11, doc_id: str = "doc_id",
        text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Train on the rows where ``allowed`` holds and text and language are not null; None when there are none.

    About ``per_language`` texts of each language are used, chosen by hash; only their subword counts reach the driver.
    """
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / totals[k]))) for k in languages])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share * float(1 << 20))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if not len(df):
                continue
            pairs = [np.unique(subwords(t), return_counts=True) for t in df["text"]]
            yield pd.DataFrame({"lang": df["lang"], "doc_id": df["doc_id"], "b": [p[0].astype("<i4").tobytes() for p in pairs],
                                "c": [p[1].astype("<f4").tobytes() for p in pairs]})

    small_batches(docs.sparkSession)
    sample = chosen.mapInPandas(count, f"lang string, doc_id {dict(rows.dtypes)['doc_id']}, b binary, c binary") \
        .toPandas().sort_values("doc_id", kind="stable")
    labels = np.array([languages.index(x) for x in sample["lang"]], int)
    if not len(labels):
        return None
    # Counts arrive as bytes: as arrays of numbers each would be a Python object here.
    return train([np.frombuffer(c, "<f4") for c in sample["c"]], [np.frombuffer(b, "<i4") for b in sample["b"]], labels, languages)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected to each row; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything without a model. Other texts get a
    learned language; they are rejected when the calibrated score is below the model's floor.
    """
    small_batches(docs.sparkSession)
    schema = "lang_pred string, score double, rejected boolean"

    @F.pandas_udf(schema)
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                if model is None or t is None or not _LETTER.search(t):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = model.probabilities(t)
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best]), bool(p[best] < model.floor)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected")
    return kept.withColumn("__judged", judge(F.col(text))).select(*kept.columns, "__judged.*")
