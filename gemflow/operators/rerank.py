"""Greedy re-rankers.

Where the rule itself looks at the best so many rows of a query only (``diversify``, ``spread``), that pool is cut in
Spark and settled in Arrow batches. Browsing streams whole categories through a window of bounded size, and slates and
budgets are filled in rounds of aggregates, so none of them drops a row or gathers a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemflow.functions.vectors import dot, normalise
from gemflow.operators.prefix import running_sum
from gemflow.session import materialise


def _bounded(rows: DataFrame, by: str, pool: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "item")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= pool).drop("_n")


def diversify(rows: DataFrame, k: int = 8, relevance: float = 0.8, pool: int | None = None) -> DataFrame:
    """(query, item, position): maximal marginal relevance over (query, item, score, family, vec).

    Scores are scaled to 0..1 over the pool; each place goes to the row with the largest ``relevance`` * score minus
    (1 - ``relevance``) * largest cosine to those chosen, among families not shown yet; ties to the better score,
    then the smaller id. A query with fewer families than k gets fewer places. The rule is one over the best ``pool``
    rows of a query (by default 80, or four for every place if that is more).
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = pdf["score"].to_numpy(np.float64)
        s = (s - s.min()) / (s.max() - s.min() + 1e-9)
        near, families, chosen = np.zeros(len(pdf)), pdf["family"].to_numpy(), []
        free = np.ones(len(pdf), dtype=bool)
        while free.any() and len(chosen) < k:
            value = np.where(free, relevance * s - (1 - relevance) * near, -np.inf)
            i = int(np.argmax(value))
            chosen.append(i)
            free &= families != families[i]
            sim = x @ x[i]
            near = sim if len(chosen) == 1 else np.maximum(near, sim)
        return pd.DataFrame({"query": pdf["query"].iloc[0], "item": pdf["item"].to_numpy()[chosen], "position": np.arange(1, len(chosen) + 1)})

    slim = _bounded(rows.where("vec IS NOT NULL AND score IS NOT NULL"), "query", pool or max(80, 4 * k)).select("query", "item", "score", "family", "vec")
    return slim.groupBy("query").applyInPandas(pick, "query long, item long, position int")


def spread(rows: DataFrame, k: int = 8, penalty: float = 0.12, same: float = 0.97) -> DataFrame:
    """(query, item, shop, position): each place to the best score less ``penalty`` per product of the shop already shown;
    a product whose vector is nearly one already shown (cosine above ``same``) is left out. The rule is one over the best
    six rows for every place."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s, shops = pdf["score"].to_numpy(np.float64), pdf["shop"].to_numpy()
        free, shown, chosen = np.ones(len(pdf), dtype=bool), np.zeros(len(pdf)), []
        while free.any() and len(chosen) < k:
            i = int(np.argmax(np.where(free, s - penalty * shown, -np.inf)))
            chosen.append(i)
            shown += shops == shops[i]
            free &= x @ x[i] <= same
            free[i] = False
        return pd.DataFrame({"query": pdf["query"].iloc[0], "item": pdf["item"].to_numpy()[chosen], "shop": shops[chosen], "position": np.arange(1, len(chosen) + 1)})

    slim = _bounded(rows.where("vec IS NOT NULL AND score IS NOT NULL"), "query", 6 * k).select("query", "item", "score", F.col("shop").cast("long").alias("shop"), "vec")
    return slim.groupBy("query").applyInPandas(pick, "query long, item long, shop long, position int")


class _Shelf:
    """The rows of one category on their way into browsing order; holds the rows of a window and no more.

    Every waiting row knows until which place it must wait: placing a row makes all rows like it wait ``back`` places.
    """

    def __init__(self, window: int, back: int, apart: float):
        self.window, self.back, self.apart, self.place = window, back, apart, 0
        self.items, self.x, self.wait = np.zeros(0, dtype=np.int64), None, np.zeros(0, dtype=np.int64)
        self.recent: list[np.ndarray] = []

    def add(self, items: np.ndarray, x: np.ndarray) -> None:
        """Rows that arrive behind those waiting; they wait for what was placed last, too."""
        wait = np.full(len(items), -1, dtype=np.int64)
        for age, v in enumerate(reversed(self.recent)):  # the last one was placed at place - 1
            alike = x @ v >= self.apart
            wait[alike] = np.maximum(wait[alike], self.place - 1 - age + self.back)
        self.items, self.wait = np.concatenate([self.items, items]), np.concatenate([self.wait, wait])
        self.x = x if self.x is None else np.concatenate([self.x, x])

    def take(self, last: bool) -> list[int]:
        """Places rows as long as a whole window waits (``last``: until none does)."""
        out, gone = [], np.zeros(len(self.items), dtype=bool)
        first = 0
        while len(self.items) - len(out) >= (1 if last else self.window):
            while gone[first]:
                first += 1
            reach = first + np.flatnonzero(~gone[first : first + self.window + len(out)])[: self.window]
            free = reach[self.wait[reach] < self.place]
            at = int(free[0]) if len(free) else first
            gone[at] = True
            out.append(int(self.items[at]))
            alike = self.x @ self.x[at] >= self.apart
            self.wait[alike] = self.place + self.back
            self.recent = [*self.recent, self.x[at]][-self.back :]
            self.place += 1
        self.items, self.x, self.wait = self.items[~gone], self.x[~gone] if self.x is not None else None, self.wait[~gone]
        return out


def browse(rows: DataFrame, window: int = 50, back: int = 6, apart: float = 0.93) -> DataFrame:
    """(category, item, position): whole categories for browsing, one row per family, richest first, similar pieces apart.

    Missing richness counts as the median of all rows. From the first ``window`` waiting rows the first whose cosine to
    each of the last ``back`` placed is under ``apart`` comes next, else the first waiting. Rows without a vector or
    category take no part. A category is one sorted stream; what a task holds is a window and the batch it reads.
    """
    known = rows.where("vec IS NOT NULL AND category IS NOT NULL")
    median = rows.agg(F.coalesce(F.percentile_approx("richness", 0.5, 10_000), F.lit(0.0)).alias("_median"))
    filled = known.crossJoin(F.broadcast(median)).withColumn("_rich", F.coalesce("richness", "_median"))  # one row
    best = filled.groupBy("category", "family").agg(F.max(F.struct("_rich", (-F.col("item")).alias("_back"))).alias("_b"))
    keys = best.select("category", "family", (-F.col("_b._back")).alias("item"), F.col("_b._rich").alias("_rich"))
    slim = keys.join(known.select("category", "item", "vec"), ["category", "item"]).select(F.col("category").cast("string").alias("category"), "item", "_rich", "vec")
    slim = slim.dropDuplicates(["category", "item"]).repartition("category").sortWithinPartitions("category", F.col("_rich").desc(), "item")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, shelf = None, None

        def placed(last: bool) -> pd.DataFrame:
            at = shelf.place
            items = shelf.take(last)
            return pd.DataFrame({"category": name, "item": items, "position": np.arange(at + 1, at + 1 + len(items))})

        for pdf in batches:
            for category, part in pdf.groupby("category", sort=False):
                if category != name:
                    if shelf is not None:
                        yield placed(True)
                    name, shelf = category, _Shelf(window, back, apart)
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                shelf.add(part["item"].to_numpy(np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
                yield placed(False)
        if shelf is not None:
            yield placed(True)

    return slim.select("category", "item", "vec").mapInPandas(order, "category string, item long, position long")


def slate(rows: DataFrame, k: int = 5, most: dict[str, int] | None = None, per_type: int = 3, relevance: float = 0.7) -> DataFrame:
    """(user_id, item, kind, position): a constrained list per user from (user_id, item, score, kind, type, meaning, vec).

    Recent candidates come first, at most ``most['recent']``; the rest by ``relevance`` * score - 0.9 * largest cosine to
    those picked, with at most ``most[kind]`` per kind and ``per_type`` per type, and no meaning twice. Rows without
    user, vector or score take no part; ties go to the smaller id.

    A place is one round: an aggregate finds every user's best candidate, and all candidates learn what it was. A row is
    out for good once it doesn't fit, so a round's work shrinks, and users with most candidates are no hot group.
    """
    limits = {"recent": 2, "popular": 1, "explore": 1} | (most or {})
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind")), F.lit(k))
    columns = ["item", "score", "kind", "type", "meaning", "vec"]
    left = rows.where("user_id IS NOT NULL AND vec IS NOT NULL AND score IS NOT NULL").select("user_id", *columns)
    left = left.withColumn("vec", normalise("vec")).withColumn("_near", F.lit(None).cast("double")).withColumn("_kinds", F.lit(0)).withColumn("_types", F.lit(0))
    done = None
    for place in range(1, k + 1):
        left = materialise(left.where((F.col("_kinds") < limit) & (F.col("_types") < per_type)), "slate")
        recent = F.col("kind") == "recent"
        value = F.when(recent, F.col("score")).otherwise(relevance * F.col("score") - 0.9 * F.coalesce("_near", F.lit(0.0)))
        key = F.struct(recent.cast("int").alias("r"), value.alias("v"), F.col("score").alias("s"), (-F.col("item")).alias("i"))
        best = left.groupBy("user_id").agg(F.max_by(F.struct(*columns), key).alias("_b"))
        best = materialise(best.select("user_id", "_b.*").withColumn("position", F.lit(place)), "slate")
        done = best if done is None else done.unionByName(best)
        chosen = best.select("user_id", *[F.col(c).alias(f"_{c}") for c in columns])
        joined = left.join(chosen, "user_id").where((F.col("item") != F.col("_item")) & ~F.col("meaning").eqNullSafe(F.col("_meaning")))
        left = joined.select(
            "user_id", *columns, F.greatest("_near", dot("vec", "_vec")).alias("_near"),
            (F.col("_kinds") + F.col("kind").eqNullSafe(F.col("_kind")).cast("int")).alias("_kinds"), (F.col("_types") + F.col("type").eqNullSafe(F.col("_type")).cast("int")).alias("_types"),
        )
    return done.select("user_id", "item", "kind", F.col("position").cast("int").alias("position"))


def budget_fill(rows: DataFrame, size: str, order: list[str], budget: int, key: str) -> DataFrame:
    """Rows taken in order until the budget is used; one too large is passed over and later ones may still fit.

    Rounds of running sums: a round takes all rows up to the first that no longer fits, and drops that one and every
    later row larger than what is left. Rows without a size are never taken; negative sizes count as zero.
    """
    left, taken = budget, None
    amount = F.greatest(F.col(size).cast("long"), F.lit(0))
    open_ = rows.where(F.col(size).isNotNull()).select(key, *[c for c in order if c != key], amount.alias("_size")).where(F.col("_size") <= left)
    while True:
        laid = materialise(running_sum(open_, [], [*order, key], "_size", "_before"), "budget")
        over = F.col("_before") + F.col("_size") > left
        first = laid.where(over).agg(F.min("_before")).first()[0]  # all rows after the first that is too large have a larger sum before them
        fits = laid.where(~over) if first is None else laid.where(~over & (F.col("_before") <= first))
        taken = fits.select(key) if taken is None else taken.unionByName(fits.select(key))
        if first is None:
            return rows.join(taken, key, "left_semi")
        left -= first
        open_ = laid.where((F.col("_before") > first) & (F.col("_size") <= left)).drop("_before")
