"""Mix sources to target weights by fitting subset sums to word budgets.

Each source's target becomes a number of whole passes over it plus a remaining
budget. The remaining budget is met by counts of documents per exact length: a
proportional share of every length first, the largest shortfalls next, and a
bounded-knapsack dynamic program for the rest. Only (source, length) counts
take part in the fit. Documents are then chosen by seeded rank within their
source and length, which spreads over buckets so that no task holds a source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, cut_lineage, row_keys, salted_rank

SHARE, MOST, ORDER_SEED = 1.5, 2, 19
#: Words that the dynamic program has at least.
WINDOW = 1 << 16


def cyclic_weights(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights in turn by code point order of the source, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """``share`` of all sizes dealt by weight; no source above ``most`` times its own size,
    the excess dealt again by weight among the others until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * left / weight > most * sizes[s]] if weight else []
        if not over:
            out |= {s: weights[s] * left / weight if weight else 0.0 for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
            left -= out[s]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, so that the words come near ``budget``.

    The sum never exceeds the budget. The dynamic program has the last words:
    ``WINDOW`` or twice the longest length, whichever is more, so that even the
    longest documents can still be swapped for others; what is above goes by
    share. A budget within the window gets the best sum there is.
    """
    taken = np.zeros_like(counts)
    usable = (lengths > 0) & (counts > 0)
    total = int((lengths * counts)[usable].sum())
    budget = min(int(budget), total)
    if budget <= 0 or not total:
        return taken
    window = max(WINDOW, 2 * int(lengths[usable].max()))
    # A share of what is above the window alone: else a few long documents could be fixed before the program sees them.
    spread = max(0, budget - window)
    exact = counts[usable].astype(object) * spread
    taken[usable] = (exact // total).astype(np.int64)
    short = np.zeros(len(lengths))
    short[usable] = (exact % total / total).astype(float)
    rest = budget - int((lengths * taken).sum())
    for i in np.lexsort((np.random.default_rng(ORDER_SEED).permutation(len(lengths)), -short)):
        if usable[i] and taken[i] < counts[i] and rest - int(lengths[i]) >= window:
            taken[i] += 1
            rest -= int(lengths[i])
    return taken + _knapsack(lengths, np.where(usable, counts - taken, 0), rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack for the largest sum up to ``budget``: counts split into powers of two;
    each sum remembers the lot that reached it first, so lots are used at most once. Lengths
    come in a seeded order, so that none is preferred for being short or long."""
    take = np.zeros_like(counts)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    via = np.full(budget + 1, -1)
    lots: list[tuple[int, int]] = []
    for i in np.random.default_rng(ORDER_SEED).permutation(np.flatnonzero((counts > 0) & (lengths <= budget))):
        n, k = min(int(counts[i]), budget // int(lengths[i])), 1
        while n and not reached[budget]:
            k = min(k, n)
            w = k * int(lengths[i])
            if w <= budget:
                new = np.zeros_like(reached)
                new[w:] = reached[: budget + 1 - w]
                new &= ~reached
                via[new] = len(lots)
                reached |= new
                lots.append((int(i), k))
            n, k = n - k, 2 * k
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = lots[via[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def mix(docs: DataFrame, weigh: Callable[[list], dict] = cyclic_weights, share: float = SHARE, most: int = MOST, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and ``times`` (how often the mix takes it).

    ``most`` is a whole number: no document is taken more often. Whole texts
    count; a null text has size 0 and a null source is a source of its own.
    Rows that repeat a doc_id, or have a null one, count as documents of their
    own; those alike in doc_id, source, size and ``keep`` are interchangeable.
    Columns other than those and ``keep`` are ignored. An empty table gives no
    rows. One row a source comes to the driver: the weights are the mixture's
    configuration, and it has one entry a source in any case.
    """
    spark = docs.sparkSession
    keep = keep or []
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_key")
    sized = cut_lineage(docs.select("doc_id", key, size.alias("size"), *keep))
    histogram = cut_lineage(sized.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("_n")))
    totals = {r[0]: int(r[1]) for r in histogram.groupBy("_key").agg(F.sum(F.col("size") * F.col("_n"))).collect()}
    name = lambda k: None if k == "n" else k[1:]
    weights = weigh([name(k) for k in totals])
    wanted = targets({name(k): v for k, v in totals.items()}, weights, share, most)
    rows = [(k, totals[k], float(wanted[name(k)])) for k in totals]
    source = spark.createDataFrame(rows, "_key string, source_size long, target double")

    def fit(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("size", ignore_index=True)
        whole = int(lot["source_size"].iloc[0])
        budget = int(round(lot["target"].iloc[0]))
        passes = min(most, budget // whole) if whole else 0
        extra = fit_counts(lot["size"].to_numpy(), lot["_n"].to_numpy(), budget - passes * whole) if passes < most else 0
        return lot.assign(_passes=passes, _extra=extra)

    plan = histogram.join(source, "_key").groupBy("_key").applyInPandas(fit, "_key string, size long, _n long, source_size long, target double, _passes long, _extra long")
    ranked = salted_rank(sized.join(cut_lineage(plan), ["_key", "size"]), ["_key", "size"], "_n", ["doc_id", *keep], seed)
    times = F.col("_passes") + (F.col("rank") < F.col("_extra")).cast("long")
    named = F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")).alias("source")
    return ranked.select("doc_id", named, "size", "source_size", "target", times.alias("times"), *keep)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    Rows are told apart by two hashes of all their columns, so that rows which
    share a doc_id or have a null one are each taken as often as ``mix`` says;
    rows alike in every column are taken as often as all of them together.
    """
    a, b, times, copy = (f"{n}_{uuid.uuid4().hex}" for n in ("a", "b", "times", "copy"))  # clash with no column
    keyed = docs.withColumns(dict(zip((a, b), row_keys(docs.columns))))
    chosen = mix(keyed, keep=[a, b], **how).where("times > 0").groupBy(a, b).agg(F.sum("times").alias(times))
    taken = keyed.dropDuplicates([a, b]).join(chosen, [a, b])
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(copy)).drop(copy)
