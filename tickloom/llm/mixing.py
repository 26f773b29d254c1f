"""Mixing sources to target weights: hierarchical budgets, then a token prefix of seeded epochs for each leaf.

A token budget flows down the tree domain, language, source. Among siblings it is shared by weight; what a child can not use goes
to its siblings first and leaves the parent only when the whole subtree is used up. A leaf then takes its
documents in a seeded order, epoch after epoch, until its budget is reached. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, materialize

#: Slices of a leaf's seeded order; a leaf's running sum is taken over slices first, so no task sorts a whole leaf.
SLICES = 1 << 14


def _weight(column: Column, weights: Mapping[str, int] | None, default: int) -> Column:
    w = F.lit(default)
    for value, x in (weights or {}).items():
        w = F.when(column == value, F.lit(int(x))).otherwise(w)
    return w.cast("double")


def shared(nodes: DataFrame, parents: Sequence[str], budget: str, weight: str, supply: str, out: str) -> DataFrame:
    """Add ``out``: the parent's ``budget`` shared among siblings by ``weight``, none above its ``supply``.

    In the order of supply per weight the first siblings are filled; the rest divides what is left by weight.
    A sibling of weight 0 gets nothing.
    """
    own = Window.partitionBy(*parents).orderBy("__ratio", weight, *[c for c in nodes.columns if c not in (budget, weight, supply)])
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    after = own.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*parents)
    usable = F.when(F.col(weight) > 0, F.col(supply)).otherwise(0).cast("double")
    df = nodes.withColumns({"__use": usable, "__ratio": F.when(F.col(weight) > 0, F.col(supply) / F.col(weight)).otherwise(0.0)})
    df = df.withColumns({"__full": F.coalesce(F.sum("__use").over(before), F.lit(0.0)),
                         "__open": F.sum(weight).over(after)})
    df = df.withColumn("__is_full", (F.col(weight) == 0) | (F.col("__full") + F.col("__ratio") * F.col("__open") <= F.col(budget)))
    df = df.withColumns({"__taken": F.coalesce(F.sum(F.when(F.col("__is_full"), F.col("__use"))).over(every), F.lit(0.0)),
                         "__left": F.sum(F.when(~F.col("__is_full"), F.col(weight))).over(every)})
    return df.withColumn(out, F.when(F.col("__is_full"), F.col("__use")).otherwise(
        (F.col(budget) - F.col("__taken")) * F.col(weight) / F.col("__left"))) \
        .drop("__use", "__ratio", "__full", "__open", "__is_full", "__taken", "__left")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], total: Column, weights: Mapping[str, Mapping[str, int]],
                 max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves`` has the level columns and ``tokens``; adds ``budget`` (long, tokens of this leaf).

    ``weights`` gives integer weights by level and value; other values weigh ``default_weight``.
    """
    df = leaves.withColumn("__supply", (F.col("tokens") * max_epochs).cast("double")) \
        .withColumn("__b0", total.cast("double"))
    for depth, level in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = df.groupBy(*path).agg(F.sum("__supply").alias("__s"), F.max(f"__b{depth}").alias("__b")) \
            .withColumn("__w", _weight(F.col(level), weights.get(level), default_weight))
        got = shared(nodes, path[:-1] or [], "__b", "__w", "__s", f"__b{depth + 1}") if depth else \
            shared(nodes.withColumn("__root", F.lit(0)), ["__root"], "__b", "__w", "__s", "__b1")
        df = df.join(got.select(*path, f"__b{depth + 1}"), path)
    last = f"__b{len(levels)}"
    return df.withColumn("budget", F.floor(F.col(last) + 1e-6).cast("long")) \
        .select(*levels, "tokens", "budget")


def mix(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float = 0.5,
        max_epochs: int = 2, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, levels, n_tokens, epoch) per chosen document and epoch.

    The whole budget is ``share`` of all tokens (words). The documents of a leaf are ordered by a seeded hash,
    newly for each epoch, and taken while the tokens before a document are below the leaf's budget, so a leaf overshoots by less than one
    document. Documents without words (null or empty text) cost nothing and are never taken. Null level values form
    a leaf of their own (empty name). Repeated rows with one id are taken together in one order, ties by tokens.
    """
    empty = F.lit("")
    words = F.size(F.split(F.coalesce(F.col(text), empty), SPACE, -1)) \
        - F.when(F.coalesce(F.col(text), empty).rlike("^" + SPACE), 1).otherwise(0) \
        - F.when(F.coalesce(F.col(text), empty).rlike(SPACE + r"\z"), 1).otherwise(0)
    has = F.translate(F.coalesce(F.col(text), empty), " \t\n\x0b\f\r", "") != ""
    named = [F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in levels]
    rows = materialize(docs.filter(has).select(F.col(doc_id).alias("doc_id"), *named, words.cast("long").alias("n_tokens")),
                       "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    planned = leaf_budgets(leaves, levels, F.lit(float(int(total * share))), weights, max_epochs)
    # whole epochs before the last one, and what the last one gives
    planned = materialize(planned.withColumns({
        "__whole": F.floor(F.col("budget") / F.col("tokens")).cast("int"),
        "__rest": F.col("budget") % F.col("tokens")}).drop("tokens"), "mix-plan")
    last = rows.join(planned, list(levels))
    order = F.xxhash64(F.col("doc_id"), F.col("__whole"), F.lit(seed))
    last = last.withColumns({"__u": order, "__slice": F.shiftrightunsigned(order, 64 - 14)})
    slices = last.groupBy(*levels, "__slice").agg(F.sum("n_tokens").alias("__in"), F.max("__rest").alias("__rest"))
    running = Window.partitionBy(*levels).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__in").over(running), F.lit(0)))
    border = slices.filter("__before < __rest").select(*levels, "__slice", "__before", "__in")
    cut = last.join(border, [*levels, "__slice"])
    inside = cut.filter("__before + __in <= __rest")
    across = cut.filter("__before + __in > __rest")
    within = Window.partitionBy(*levels, "__slice").orderBy("__u", "doc_id", "n_tokens") \
        .rowsBetween(Window.unboundedPreceding, -1)
    across = across.withColumn("__t", F.col("__before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))) \
        .filter("__t < __rest").drop("__t")
    out = ["doc_id", *levels, "n_tokens", "epoch"]
    partial = inside.unionByName(across).withColumn("epoch", F.col("__whole"))
    whole = rows.join(planned.filter("__whole > 0"), list(levels)) \
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__whole") - 1)))
    return whole.select(*out).unionByName(partial.select(*out))
