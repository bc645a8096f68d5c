"""Joins, merges and per-key choices over catalogue and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemflow.operators.prefix import running_sum


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order ``version``. Null keys are keys of their own."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with those of ``new`` in place of or added to them, by key; of repeated new keys one row by content."""
    tagged = stored.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    content = F.xxhash64(*[c for c, t in new.dtypes if not t.startswith("map")])
    return latest_per_key(tagged, keys, [F.col("_src").desc(), content]).drop("_src")


def insert_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those of ``new`` whose key is not stored; repeated new keys count once."""
    content = F.xxhash64(*[c for c, t in new.dtypes if not t.startswith("map")])
    return stored.unionByName(latest_per_key(new.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns), keys, [content]))


def update_if_unchanged(stored: DataFrame, changes: DataFrame, key: str, version: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table, refused): changes apply where the version they saw is still the stored one; the others are refused.

    ``changes`` has the key, ``seen`` (version read), the new version and the values. At most one change per key.
    """
    c = changes.select(F.col(key).alias("_k"), F.col("seen").alias("_seen"), F.col(version).alias("_v"), *[F.col(v).alias(f"_{v}_new") for v in values])
    joined = stored.join(c, stored[key] == c["_k"], "left")
    hit = F.col("_k").isNotNull() & F.col(version).eqNullSafe(F.col("_seen"))
    pick = {v: F.when(hit, F.col(f"_{v}_new")).otherwise(F.col(v)) for v in values}
    pick[version] = F.when(hit, F.col("_v")).otherwise(F.col(version))
    table = joined.select(*[pick[x].alias(x) if x in pick else F.col(x) for x in stored.columns])
    now = stored.select(F.col(key).alias("_sk"), F.col(version).alias("_sv"))
    refused = changes.join(now, changes[key] == now["_sk"], "left").where(F.col("_sk").isNull() | ~F.col("_sv").eqNullSafe(F.col("seen"))).select(*changes.columns)
    return table, refused


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` has too, nulls equal to nulls; columns meet by place and are named as in ``a``.

    One aggregate over both, combined map-side: a join would leave it to an estimate from file sizes whether all rows of
    a side, exploded ones too, are sent to the driver.
    """
    side = lambda df, i: df.toDF(*a.columns).withColumn("_side", F.lit(i))
    held = side(a, 0).union(side(b, 1)).groupBy(*a.columns).agg(F.min("_side").alias("_min"), F.max("_side").alias("_max"))
    return held.where("_min = 0 AND _max = 1").select(*a.columns)


def best_match(left: DataFrame, right: DataFrame, on: str, rank: Column, order: Sequence[Column], keep: str) -> DataFrame:
    """Left rows with the best right row of the same key: smallest non-null ``rank``, then ``order``; without one, nulls."""
    joined = left.join(right, on, "left").withColumn("_rank", rank)
    w = Window.partitionBy(keep).orderBy(F.col("_rank").asc_nulls_last(), *order)
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest_ancestor(paths: DataFrame, owners: DataFrame, path: str = "path", folder: str = "folder", owner: str = "owner") -> DataFrame:
    """(path, folder, owner): for every path its deepest ancestor folder that exactly one owner has; without one, nulls."""
    single = owners.groupBy(folder).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")
    parts = F.split(path, "/")
    depth = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    above = paths.select(path, F.explode(F.transform(depth, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias(folder))
    found = above.join(single, folder).groupBy(path).agg(F.max_by(F.struct(folder, owner), F.length(folder)).alias("_b"))
    return paths.join(found, path, "left").select(path, F.col(f"_b.{folder}").alias(folder), F.col(f"_b.{owner}").alias(owner))


def alias_copies(files: DataFrame, content: str, path: str, priority: Sequence[Column]) -> DataFrame:
    """Add ``keeper``: the path that all files of the same content point at."""
    return files.withColumn("keeper", F.first_value(path).over(Window.partitionBy(content).orderBy(*priority, path)))


def repair_ids(rows: DataFrame, catalogue: DataFrame, uid: str, code: str) -> DataFrame:
    """Add ``resolved``: the uid where the catalogue has it under that code, else the code's uid, else null. Codes must be unique."""
    byuid = catalogue.select(F.col(uid).alias("_u"), F.col(code).alias("_uc"))
    bycode = catalogue.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_c")).agg(F.min(uid).alias("_cu"))
    joined = rows.join(byuid, rows[uid] == byuid["_u"], "left").join(bycode, F.col(code) == F.col("_c"), "left")
    right = F.col("_u").isNotNull() & (F.col("_uc").eqNullSafe(F.col(code)) | F.col(code).isNull() | (F.col(code) == ""))
    return joined.select(*rows.columns, F.when(right, F.col("_u")).otherwise(F.col("_cu")).alias("resolved"))


def ordered_lookup(rows: DataFrame, items: str, table: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """(by, values): the values of an array of keys, in its order; keys the table lacks are left out."""
    each = rows.select(by, F.posexplode(items).alias("_p", key))
    found = each.join(table.select(key, value), key).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("_l"))
    return found.select(by, F.transform("_l", lambda x: x[value]).alias("values"))


def interpolate(rows: DataFrame, x: str, chart: DataFrame, chart_x: str, chart_y: str, out: str) -> DataFrame:
    """Add ``out``: y by linear interpolation on a chart of ascending points; below and above by the cube of x to the end point.

    The chart is a fixed table of points (checked: at most 10 000).
    """
    if chart.limit(10_001).count() > 10_000:
        raise ValueError("the chart has more than 10 000 points")
    w = Window.orderBy("_x0")
    steps = chart.select(F.col(chart_x).cast("double").alias("_x0"), F.col(chart_y).cast("double").alias("_y0")).withColumn("_x1", F.lead("_x0").over(w)).withColumn("_y1", F.lead("_y0").over(w))
    ends = steps.agg(F.min(F.struct("_x0", "_y0")).alias("_lo"), F.max(F.struct("_x0", "_y0")).alias("_hi"))
    v = F.col(x).cast("double")
    joined = rows.crossJoin(F.broadcast(ends)).join(F.broadcast(steps.where("_x1 IS NOT NULL")), (v >= F.col("_x0")) & (v < F.col("_x1")), "left")
    cube = lambda end: F.col(f"{end}._y0") * F.pow(v / F.col(f"{end}._x0"), 3)
    inside = F.col("_y0") + (v - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    y = F.when(v < F.col("_lo._x0"), cube("_lo")).when(v >= F.col("_hi._x0"), cube("_hi")).otherwise(inside)
    return joined.select(*rows.columns, y.alias(out))


def interval_join(points: DataFrame, at: str, windows: DataFrame, start: str, end: str, step_days: int = 30) -> DataFrame:
    """Points with the windows [start, end] (dates) that hold them, by buckets of days instead of all pairs."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / step_days)
    spread = windows.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return points.withColumn("_b", bucket(F.col(at).cast("date"))).join(spread, "_b").where((F.col(at).cast("date") >= F.col(start)) & (F.col(at).cast("date") <= F.col(end))).drop("_b")


def near_points(points: DataFrame, key: str, coords: Sequence[str], within: float) -> DataFrame:
    """(a, b): pairs of points no further apart than ``within``, by a grid of that width and its neighbouring cells."""
    cells = [F.floor(F.col(c) / within).alias(f"_{c}") for c in coords]
    left = points.select(F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in coords], *cells)
    right = points.select(F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in coords], *cells)
    for c in coords:
        right = right.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + d for d in (-1, 0, 1)])))
    far = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in coords), F.lit(0.0))
    return left.join(right, [f"_{c}" for c in coords]).where((F.col("a") < F.col("b")) & (far <= within * within)).select("a", "b")


def majority(rows: DataFrame, group: str, value: str, least: float = 0.5) -> DataFrame:
    """(group, value, share): the commonest value where its share is at least ``least``, else null; ties to the smaller value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    total = n.groupBy(group).agg(F.sum("_n").alias("_t"))
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_n").desc(), value))).where("_r = 1")
    share = F.col("_n") / F.col("_t")
    return first.join(total, group).select(group, F.when(share >= least, F.col(value)).alias(value), share.alias("share"))


def merge_maps(rows: DataFrame, keys: Sequence[str], column: str, preferred: Column, seq: Column) -> DataFrame:
    """(keys, column): the union of map columns; per entry the last preferred row wins, else the first of the others."""
    entry = rows.select(*keys, F.explode(column).alias("_k", "_v"), preferred.alias("_p"), seq.alias("_s"))
    order = F.struct("_p", F.when(F.col("_p"), F.col("_s")).otherwise(-F.col("_s")))
    one = entry.groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))


def numbered_names(rows: DataFrame, name: str, seq: Sequence[str], out: str = "unique_name") -> DataFrame:
    """Add ``out``: the name, with -2, -3 ... from its second use on, in the order ``seq``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*seq))
    return rows.withColumn(out, F.when(n > 1, F.concat_ws("-", name, n)).otherwise(F.col(name)))


def evict(files: DataFrame, size: str, used: str, key: str, cap: int, young: Column | None = None) -> DataFrame:
    """Files to remove, least recently used first, until the rest fits ``cap``; ``young`` files stay. Ties by key.

    Runs as running sums over range partitions, so no single task holds all files.
    """
    ranked = running_sum(files.withColumn("_newest", -F.col(used).cast("long")), [], ["_newest", key], size, "_before")
    over = F.col("_before") + F.col(size) > cap
    return ranked.where(over & ~(young if young is not None else F.lit(False))).select(*files.columns)
