"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemflow.llm import cooccurrence, languages, mixing, neighbours, packing, products, quality
from gemflow.session import read_table

# --- 1: most similar vectors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a probe photo and one of its ten nearest."""
    near = neighbours.most_similar(read_table(spark, sf_dir, "photo_query"), read_table(spark, sf_dir, "photo_probe"))
    return near.select(F.least("query", "neighbour").alias("photo_a"), F.greatest("query", "neighbour").alias("photo_b")).distinct()


def p1_every_fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every photo whose id is divisible by 50, against all photos."""
    photos = read_table(spark, sf_dir, "photo_query")
    near = neighbours.most_similar(photos, photos.where("photo_id % 50 = 0").select("photo_id"))
    return near.select(F.col("query").alias("photo_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


# --- 3: languages


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and segments, with confidence, of every search."""
    searches = read_table(spark, sf_dir, "search_history")
    return languages.identify(searches, languages.fit(searches, "query", "lang"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches whose languages are not exactly the label's, one row per language."""
    searches = read_table(spark, sf_dir, "search_history")
    return languages.mislabelled(languages.identify(searches, languages.fit(searches, "query", "lang"), detail=False))


# --- 4: listings of one product


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages that sell the same product."""
    return products.pairs_of(products.group_listings(read_table(spark, sf_dir, "web_designs")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product group of every page."""
    return products.group_listings(read_table(spark, sf_dir, "web_designs"))


# --- 5: items that appear together

LEAST = {"results": 6, "favorites": 4}


def _baskets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "results": cooccurrence.array_baskets(read_table(spark, sf_dir, "search_history"), "id", "result_uids", "matches"),
        "favorites": cooccurrence.row_baskets(read_table(spark, sf_dir, "favorites"), "user_id", "design_uid"),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design pairs kept or shown together at least twelve times as often as by chance."""
    pairs = cooccurrence.associations(_baskets(spark, sf_dir), LEAST).where(cooccurrence.more_than_chance(12))
    return pairs.select(F.col("kind").alias("basket"), F.col("a").alias("uid_a"), F.col("b").alias("uid_b"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that meet the least count, with lift and pointwise mutual information."""
    pairs = cooccurrence.associations(_baskets(spark, sf_dir), LEAST)
    return pairs.select("kind", "a", "b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


_PAIRS_SQL = """
    WITH shown AS (SELECT id, max_by(result_uids, matches) AS uids FROM search_history WHERE id IS NOT NULL AND result_uids IS NOT NULL GROUP BY id),
    members AS (
        SELECT DISTINCT 'results' AS kind, CAST(id AS VARCHAR) AS basket, CAST(uid AS BIGINT) AS item FROM (SELECT id, unnest(uids) AS uid FROM shown) WHERE uid IS NOT NULL
        UNION ALL
        SELECT DISTINCT 'favorites', user_id, CAST(design_uid AS BIGINT) FROM favorites WHERE user_id IS NOT NULL AND design_uid IS NOT NULL),
    totals AS (SELECT kind, count(DISTINCT basket) AS n FROM members GROUP BY kind),
    singles AS (SELECT kind, item, count(*) AS n_item FROM members GROUP BY kind, item),
    together AS (SELECT x.kind, x.item AS a, y.item AS b, count(*) AS n_ab FROM members x JOIN members y ON x.kind = y.kind AND x.basket = y.basket AND x.item < y.item
                 GROUP BY x.kind, x.item, y.item HAVING count(*) >= CASE x.kind WHEN 'results' THEN 6 ELSE 4 END),
    scored AS (SELECT t.kind, t.a, t.b, t.n_ab, p.n_item AS n_a, q.n_item AS n_b, s.n, t.n_ab * s.n / (p.n_item * q.n_item) AS lift
               FROM together t JOIN singles p ON p.kind = t.kind AND p.item = t.a JOIN singles q ON q.kind = t.kind AND q.item = t.b JOIN totals s ON s.kind = t.kind)
"""

# --- 8: filling containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_size"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut, being larger than the capacity."""
    return _packed(spark, sf_dir).where("n_pieces > 1").select("pack", "doc_id").distinct()


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used per pack, and the share of their room that is filled."""
    return packing.fill(_packed(spark, sf_dir))


# --- 9: mixing sources


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share of a mix as large as all documents with a source."""
    _, shares, _ = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_target"))
    return mixing.short_sources(shares).select("mix", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reached in each mix."""
    _, shares, _ = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_target"))
    return shares.select("mix", "source", "share_pct", "source_size", "mixed_size", F.round("reached_pct", 3).alias("reached_pct"), "reachable")


# --- 10: text quality


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, outlier score and kind of every document."""
    return quality.text_kinds(read_table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part a list, a table or junk."""
    return p10_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    "p1_found": p1_found,
    "p1_every_fiftieth": p1_every_fiftieth,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p8_found": p8_found,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

SQL = {
    "p5_found": _PAIRS_SQL + "SELECT kind AS basket, a AS uid_a, b AS uid_b FROM scored WHERE n_ab * n >= 12 * n_a * n_b",
    "p5_pairs": _PAIRS_SQL + "SELECT kind, a, b, n_ab, n_a, n_b, n, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi FROM scored",
    "p8_found": """SELECT pack, doc_id FROM (SELECT DISTINCT doc_id, octet_length(encode(text)) + 1 AS size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d, pack_size
                   WHERE size > capacity""",
    "p9_found": """WITH sized AS (SELECT doc_id, any_value(source) AS source, max(octet_length(encode(text)) + 1) AS size FROM documents
                                  WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL GROUP BY doc_id)
                   SELECT mix, source FROM mix_target t WHERE 100 * max_repeats * coalesce((SELECT sum(size) FROM sized s WHERE s.source = t.source), 0)
                   < share_pct * (SELECT sum(size) FROM sized)""",
}
