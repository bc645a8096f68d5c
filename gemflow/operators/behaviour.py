"""What users do: profiles, popularity, repeats, from an event log with decaying weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(events: DataFrame, user: str, values: Column, weight: Column) -> DataFrame:
    """(user, value, share): each event's weight split over its values, as shares of the user's whole."""
    each = events.where(F.col(user).isNotNull()).select(user, F.explode(values).alias("value"), (weight / F.size(values)).alias("_w"))
    sums = each.groupBy(user, "value").agg(F.sum("_w").alias("_w"))
    whole = sums.groupBy(user).agg(F.sum("_w").alias("_t"))
    return sums.join(whole, user).select(user, "value", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).alias("share"))


def by_meaning(events: DataFrame, user: str, meaning: Sequence[str], weight: Column, text: str, at: str) -> DataFrame:
    """(user, meaning..., n, weight, first_text): a user's searches of one meaning as one row."""
    return events.groupBy(user, *meaning).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.min_by(text, F.struct(F.col(at), F.col(text))).alias("first_text"))


def popular(events: DataFrame, meaning: Sequence[str], user: str, weight: Column, top: int = 30, least_users: int = 2) -> DataFrame:
    """(meaning..., score, users, popularity): the ``top`` meanings by decayed count, of these those of enough users.

    The limit comes before the condition on users. Ties by meaning.
    """
    sums = events.where(F.col(user).isNotNull()).groupBy(*meaning).agg(F.sum(weight).alias("score"), F.count_distinct(user).alias("users"))
    first = sums.orderBy(F.round("score", 9).desc(), *[F.col(m).asc_nulls_first() for m in meaning]).limit(top)
    return first.where(F.col("users") >= least_users).withColumn("popularity", F.log1p("score"))


def repeat_rate(events: DataFrame, user: str, meaning: Sequence[str], least: int = 4) -> DataFrame:
    """(user, rate): one less the share of distinct meanings, for users with enough searches."""
    per = events.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*meaning)).alias("d"))
    return per.where(F.col("n") >= least).select(user, (1 - F.col("d") / F.col("n")).alias("rate"))


def round_robin(rows: DataFrame, facet: str, order: Sequence[Column], facet_order: Column, by: Sequence[str] = ()) -> DataFrame:
    """Add ``position``: first rows of all facets, then all second rows, and so on."""
    n = F.row_number().over(Window.partitionBy(*by, facet).orderBy(*order))
    turn = rows.withColumn("_n", n)
    return turn.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_n", facet_order))).drop("_n")


def rate_limited(events: DataFrame, key: str, at: str, window_s: int, most: int) -> DataFrame:
    """Add ``recent`` (events of the key in the window up to this one) and ``over``; every event counts, refused ones too."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-window_s * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("over", F.col("recent") > most)
