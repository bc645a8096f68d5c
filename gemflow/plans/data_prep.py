"""Queries of the general data-preparation operators: nested records, units, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemflow.operators import nested, sessions, units
from gemflow.session import read_table, scratch_path

SOURCES = {"brand_original": ("brand_designs", "original"), "brand_ours": ("brand_designs", "ours"), "web_pictures": ("web_designs", "pictures")}
MAPS = {"brand_ours": {"prices"}}
ARRIVAL_BATCHES = 3


def _shredded(spark: SparkSession, sf_dir: str):
    return nested.shred_sources({s: (read_table(spark, sf_dir, t), c) for s, (t, c) in SOURCES.items()}, MAPS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list element that is an object or a list, and every entry of ``prices``, with its path."""
    rows, _ = _shredded(spark, sf_dir)
    return rows.where("kind IN ('item', 'entry')").select("src", "row_id", "node")


def p2_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of offers, joined to its parent variants by foreign key."""
    rows, graphs = _shredded(spark, sf_dir)
    tables = nested.flat_tables(rows, graphs)
    offers, variants = tables["brand_original", "variants_offers"], tables["brand_original", "variants"]
    parent = variants.select("row_id", F.col("node").alias("parent"), F.col("sku").alias("variant_sku"))
    return offers.join(parent, ["row_id", "parent"], "left").select("row_id", "node", "parent", "pos", "variant_sku", "seller", "price")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in common units: those whose unit is stated, and those whose unit one level shift of the source's history tells."""
    return p6_quantities(spark, sf_dir).where("amount IS NOT NULL").select("src", "row_id", "quantity", "amount").distinct()


def p6_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quantities with the unit found and how it is known."""
    return units.common_units(read_table(spark, sf_dir, "brand_designs"), read_table(spark, sf_dir, "web_designs"), read_table(spark, sf_dir, "fx_rate"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all searches, from an incremental session table fed in order of arrival."""
    searches = read_table(spark, sf_dir, "search_history").select("id", "user_id", "created_at")
    table = sessions.SessionTable(spark, scratch_path(spark, "sessions"))
    low, high = searches.agg(F.min("id"), F.max("id")).first()
    if low is not None:
        edges = [low + (high - low + 1) * i // ARRIVAL_BATCHES for i in range(ARRIVAL_BATCHES + 1)]
        for a, b in zip(edges, edges[1:]):
            table.ingest(searches.where((F.col("id") >= a) & (F.col("id") < b)))
    return table.read().select("user_id", "start_us", "end_us", F.col("n_events").alias("n_searches"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per length class, with their duration, over the same incremental table."""
    found = p7_found(spark, sf_dir)
    size = F.when(F.col("n_searches") == 1, "single").when(F.col("n_searches") <= 5, "short").otherwise("long")
    return found.groupBy(size.alias("size_class")).agg(
        F.count("*").alias("n_sessions"), F.sum("n_searches").alias("n_searches"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us")
    )


_SESSION_SQL = """
    WITH once AS (SELECT id, user_id, epoch_us(min(created_at)) AS us FROM search_history
                  WHERE created_at IS NOT NULL AND user_id IS NOT NULL AND id IS NOT NULL GROUP BY id, user_id),
         marked AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM once),
         numbered AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM marked),
         found AS (SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_searches FROM numbered GROUP BY user_id, no)
"""

QUERIES = {"p2_found": p2_found, "p2_offers": p2_offers, "p6_found": p6_found, "p6_quantities": p6_quantities, "p7_found": p7_found, "p7_summary": p7_summary}

SQL = {
    "p7_found": _SESSION_SQL + "SELECT user_id, start_us, end_us, n_searches FROM found",
    "p7_summary": _SESSION_SQL
    + """SELECT CASE WHEN n_searches = 1 THEN 'single' WHEN n_searches <= 5 THEN 'short' ELSE 'long' END AS size_class,
                count(*) AS n_sessions, CAST(sum(n_searches) AS BIGINT) AS n_searches, CAST(sum(end_us - start_us) AS BIGINT) AS total_us
         FROM found GROUP BY 1""",
}
