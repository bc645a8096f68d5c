"""Declarative filters that relax, with an explanation, when too few rows survive.

The batch form takes a table of queries; every count is per query. Filters are applied in a fixed order and
each looks at the survivors of the one before: one aggregate per relaxable step, joined back by query.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strict:
    """A hard filter: rows where ``where`` is not true go; null counts as not true."""

    name: str
    where: Column


@dataclass(frozen=True)
class AtLeast:
    """A filter that is dropped, with a note, when fewer than ``rows`` would be left."""

    name: str
    where: Column
    rows: int = 8


@dataclass(frozen=True)
class Probable:
    """Keep p >= ``least`` (null p counts as ``missing``); with fewer than ``rows`` left, keep the survivors at or above
    their own ``quantile`` instead; if that is still too few, drop the filter."""

    name: str
    p: Column
    least: float = 0.3
    missing: float = 1.0
    rows: int = 16
    quantile: float = 0.7


@dataclass(frozen=True)
class Unwanted:
    """Keep rows whose summed probability (null counts as zero) is at most ``most``; dropped when fewer than ``rows`` are left."""

    name: str
    p: Sequence[Column]
    most: float = 0.6
    rows: int = 16


def apply_filters(rows: DataFrame, steps: Sequence, by: str = "query_id", strict: bool = False) -> DataFrame:
    """The surviving rows with ``relaxed`` (names of filters loosened or dropped for the query) and ``notes``.

    With ``strict`` nothing is ever relaxed. A query without survivors has no rows. Rows of a null query form a
    query of their own.
    """
    current = rows.withColumn("relaxed", F.array().cast("array<string>")).withColumn("notes", F.array().cast("array<string>"))

    def counted(test: Column, extra: list[Column] | None = None) -> DataFrame:
        stats = current.groupBy(by).agg(F.count_if(test).alias("_n"), *(extra or []))
        names = [c for c in stats.columns if c != by]
        stats = stats.withColumnRenamed(by, "_by")
        return current.join(stats, F.col(by).eqNullSafe(F.col("_by"))).select(*current.columns, *names)

    def told(test: Column, name: str, note: str) -> list[Column]:
        return [F.when(test, F.array_append("relaxed", F.lit(name))).otherwise(F.col("relaxed")).alias("relaxed"), F.when(test, F.array_append("notes", F.lit(note))).otherwise(F.col("notes")).alias("notes")]

    for step in steps:
        if isinstance(step, Strict) or (strict and isinstance(step, AtLeast)):
            current = current.where(step.where)
            continue
        if isinstance(step, AtLeast):
            got = counted(step.where)
            short = F.col("_n") < step.rows
            kept = got.where(short | step.where)
            current = kept.select(*rows.columns, *told(short, step.name, f"{step.name}: fewer than {step.rows}, shown without it"))
        elif isinstance(step, Unwanted):
            total = sum((F.coalesce(p, F.lit(0.0)) for p in step.p), F.lit(0.0))
            test = total <= step.most
            if strict:
                current = current.where(test)
                continue
            got = counted(test)
            short = F.col("_n") < step.rows
            current = got.where(short | test).select(*rows.columns, *told(short, f"not {step.name}", f"{step.name}: could not be left out"))
        else:
            p = F.coalesce(step.p, F.lit(step.missing))
            if strict:
                current = current.where(p >= step.least)
                continue
            got = counted(p >= step.least, [F.percentile(p, F.lit(step.quantile)).alias("_q")])
            second = got.groupBy(by).agg(F.count_if(p >= F.col("_q")).alias("_n2")).withColumnRenamed(by, "_by")
            got = got.join(second, F.col(by).eqNullSafe(F.col("_by")))
            short, few = F.col("_n") < step.rows, F.col("_n2") < step.rows
            kept = got.where((~short & (p >= step.least)) | (short & ~few & (p >= F.col("_q"))) | (short & few))
            current = kept.select(*rows.columns, *told(short, step.name, f"{step.name}: closest shown"))
    return current


def available_in_other(metals, unwanted) -> Column:
    """Whether something is to be had in a metal other than the unwanted one."""
    return F.size(F.array_except(metals, F.array(F.lit(unwanted) if isinstance(unwanted, str) else unwanted))) > 0


def override(asked: Column, parsed: Column) -> Column:
    """A picked value over a parsed one: null keeps the parsed one, ``any`` means no filter."""
    return F.when(asked == "any", F.lit(None)).otherwise(F.coalesce(asked, parsed))


def search_box(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive search for text in any of the columns; wildcards in it are plain characters."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False))
    return out


def facet_counts(rows: DataFrame, options: DataFrame, picks: dict[str, str], group: str = "grp", option: str = "opt") -> DataFrame:
    """(group, option, n): rows per option under the picks of the other groups.

    ``rows`` has ``id`` and a map column ``facets`` from group to array of options. An option nobody has counts zero.
    """
    have = rows.select("id", F.explode("facets").alias(group, "_opts"), "facets")
    fits = F.lit(True)
    for g, value in picks.items():
        fits = fits & (F.coalesce(F.array_contains(F.col("facets")[g], value), F.lit(False)) | (F.col(group) == g))
    counts = have.where(fits).select("id", group, F.explode("_opts").alias(option)).groupBy(group, option).agg(F.countDistinct("id").alias("n"))
    return options.join(counts, [group, option], "left").select(group, option, F.coalesce("n", F.lit(0)).alias("n"))
