"""Items that appear together: pair counts over baskets, and association beyond chance.

Ordinary baskets expand to their pairs in place. A huge basket is split into chunks of items by a hash of the
item, as many as its size asks for; every pair of chunks is a product of its own, keyed by (basket, chunk,
chunk), so neither the items nor the products of one basket ever meet in one task. Pair counts are combined
map-side before the one shuffle on the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemflow.session import materialise

#: Items up to which a basket is ordinary, and items a chunk of a huge one has on average.
CHUNK = 64
#: Parts that the rows of a basket are spread over while its size is looked up.
SALTS = 32


def array_baskets(rows: DataFrame, key: str, items: str, version: str | None = None) -> DataFrame:
    """(kind-less) baskets from an array column: one per key, items distinct and sorted, nulls and empty baskets dropped.

    Repeated keys count once: the row with the largest ``version`` holds, ties by content.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())))
    rank = F.struct(*([F.col(version)] if version else []), clean.alias("_i"))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("basket_id"), clean.alias("_i"), rank.alias("_r")).groupBy("basket_id").agg(F.max_by("_i", "_r").alias("items")).where("size(items) > 0")


def row_baskets(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Members of baskets from rows: (basket_id, item). Repeated rows count once, nulls take no part."""
    return rows.select(F.col(key).cast("string").alias("basket_id"), F.col(item).cast("long").alias("item")).dropna().distinct()


def _within(sets: DataFrame) -> DataFrame:
    """Pairs inside sorted arrays: (kind, a, b)."""
    first = sets.select("kind", "items", F.posexplode("items").alias("_p", "a"))
    return first.select("kind", "a", F.explode(F.slice("items", F.col("_p") + 2, F.size("items"))).alias("b"))


def _products(members: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(arrays, pairs) of huge baskets (kind, basket_id, item, n): the items of each chunk, and the pairs across chunks."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    placed = members.select("kind", "basket_id", "item", chunks.alias("of")).withColumn("no", F.pmod(F.xxhash64("item", F.lit(17)), F.col("of")).cast("int"))
    held = materialise(placed.groupBy("kind", "basket_id", "of", "no").agg(F.array_sort(F.collect_list("item")).alias("items")), "chunks")
    # every chunk goes to each product it takes part in
    sent = held.select("kind", "basket_id", "no", "items", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("_o")).where("no <> _o")
    sent = sent.select("kind", "basket_id", F.least("no", "_o").alias("lo"), F.greatest("no", "_o").alias("hi"), "items")
    met = sent.groupBy("kind", "basket_id", "lo", "hi").agg(F.collect_list("items").alias("_c")).where("size(_c) = 2")  # chunks without items send nothing
    cross = met.select("kind", F.col("_c")[1].alias("_r"), F.explode(F.col("_c")[0]).alias("_x")).select("kind", "_x", F.explode("_r").alias("_y"))
    return held.select("kind", "items"), cross.select("kind", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def pair_counts(kinds: dict[str, DataFrame], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, items, baskets): n_ab per pair, n per item and n per kind of basket, for baskets as built above."""

    def union(parts: list[DataFrame], schema: str) -> DataFrame:
        out = next(iter(kinds.values())).sparkSession.createDataFrame([], schema)
        for part in parts:
            out = out.unionByName(part)
        return out

    arrays = [b.select(F.lit(k).alias("kind"), "basket_id", F.col("items").cast("array<long>").alias("items")) for k, b in kinds.items() if "items" in b.columns]
    rows = [b.select(F.lit(k).alias("kind"), "basket_id", F.col("item").cast("long").alias("item")) for k, b in kinds.items() if "item" in b.columns]
    # read for the pairs, the items and the totals
    whole = materialise(union(arrays, "kind string, basket_id string, items array<long>"), "baskets")
    members = materialise(union(rows, "kind string, basket_id string, item long"), "members")
    sizes = materialise(members.groupBy("kind", "basket_id").agg(F.count("*").alias("n")), "sizes")
    # a basket's size reaches its rows by (basket, part): a huge basket has more rows than parts
    huge = sizes.where(F.col("n") > chunk).select("kind", "basket_id", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    sized = members.withColumn("_salt", F.pmod(F.xxhash64("item", F.lit(23)), F.lit(SALTS)).cast("int")).join(huge, ["kind", "basket_id", "_salt"], "left")
    small = sized.where("n IS NULL").groupBy("kind", "basket_id").agg(F.array_sort(F.collect_list("item")).alias("items")).select("kind", "items")
    size = F.size("items")
    large = whole.where(size > chunk).select("kind", "basket_id", F.explode("items").alias("item"), size.cast("long").alias("n"))
    same, cross = _products(sized.where("n IS NOT NULL").select("kind", "basket_id", "item", "n").unionByName(large), chunk)
    pairs = _within(whole.where(size <= chunk).select("kind", "items").unionByName(small).unionByName(same)).unionByName(cross)
    counts = pairs.groupBy("kind", "a", "b").agg(F.count("*").alias("n_ab"))
    per_item = whole.select("kind", F.explode("items").alias("item")).unionByName(members.select("kind", "item")).groupBy("kind", "item").agg(F.count("*").alias("n_item"))
    totals = whole.select("kind").unionByName(sizes.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))  # one basket a row
    return counts, per_item, totals


def associations(kinds: dict[str, DataFrame], least: dict[str, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pairs with n_ab, n_a, n_b, n, lift and pmi. ``least`` gives the smallest n_ab wanted per kind (none: 1).

    Empty baskets do not count in n. No baskets give no rows.
    """
    counts, per_item, totals = pair_counts(kinds, chunk)
    if least:
        keep = F.lit(False)
        for kind in kinds:
            keep = keep | ((F.col("kind") == kind) & (F.col("n_ab") >= least.get(kind, 1)))
        counts = counts.where(keep)
    n_a = per_item.select("kind", F.col("item").alias("a"), F.col("n_item").alias("n_a"))
    n_b = per_item.select("kind", F.col("item").alias("b"), F.col("n_item").alias("n_b"))
    joined = counts.join(n_a, ["kind", "a"]).join(n_b, ["kind", "b"]).join(F.broadcast(totals), "kind")  # one row per kind of basket
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return joined.select("kind", "a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))


def more_than_chance(factor: int = 12) -> Column:
    """Whether n_ab * n >= factor * n_a * n_b, exactly: in decimals of 38 digits, as the products leave the range of long integers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return big("n_ab") * big("n") >= F.lit(factor).cast("decimal(2,0)") * big("n_a") * big("n_b")
