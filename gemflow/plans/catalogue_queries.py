"""Queries over the catalogue: filters that relax, facets, joins, merges, orders and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemflow.functions import text as T
from gemflow.operators import filters as L
from gemflow.operators import relational as R
from gemflow.operators.behaviour import rate_limited
from gemflow.operators.behaviour import round_robin as interleave
from gemflow.operators.rerank import budget_fill
from gemflow.session import read_table
from gemflow.sources.writers import packed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "designs")


def probability(group: str, name: str):
    return F.col("attrs")[group][name]


# --- filters


@query(
    "flt_category_exclusion",
    """SELECT uid, category FROM designs WHERE category IN ('ring', 'pendant', 'necklace') AND category <> 'pendant'
       AND len(list_filter(metals, lambda m: m <> 'yellow_gold')) > 0""",
)
def category_exclusion(spark, sf_dir):
    """FLT-01, FLT-02, FLT-03: wanted and unwanted types; an unwanted metal keeps what another metal offers."""
    d = designs(spark, sf_dir)
    return d.where(F.col("category").isin("ring", "pendant", "necklace") & ~F.col("category").isin("pendant") & L.available_in_other(F.col("metals"), "yellow_gold")).select("uid", "category")


def _per_category(spark, sf_dir):
    return designs(spark, sf_dir).withColumn("query_id", F.col("category"))


@query(
    "flt_min_rows_fallback",
    """WITH d AS (SELECT uid, category AS query_id, coalesce(list_contains(metals, 'rose_gold') AND stone_frac < 0.05, false) AS hit FROM designs WHERE category IS NOT NULL),
       n AS (SELECT query_id, count(*) FILTER (hit) AS n FROM d GROUP BY query_id)
       SELECT d.query_id, count(*) AS n, CAST(max(CASE WHEN n.n < 8 THEN 1 ELSE 0 END) AS INTEGER) AS relaxed FROM d JOIN n USING (query_id) WHERE n.n < 8 OR hit GROUP BY d.query_id""",
)
def min_rows_fallback(spark, sf_dir):
    """FLT-04, FLT-11, FLT-12: a metal filter that is dropped with a note when fewer than eight rows are left; counts per query."""
    test = F.array_contains("metals", "rose_gold") & (F.col("stone_frac") < 0.05)
    kept = L.apply_filters(_per_category(spark, sf_dir).where("category IS NOT NULL"), [L.AtLeast("metal", test, 8)])
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.size("relaxed")).alias("relaxed"))


@query(
    "flt_two_signals",
    """SELECT uid FROM designs WHERE coalesce(stone_frac, 1e9) <= 0.03 AND coalesce(attrs['stones']['plain'], 0) >= 0.5""",
)
def two_signals(spark, sf_dir):
    """FLT-06: no stones only where two signals agree; a missing share fails, a missing probability is zero."""
    return designs(spark, sf_dir).where((F.coalesce("stone_frac", F.lit(1e9)) <= 0.03) & (F.coalesce(probability("stones", "plain"), F.lit(0.0)) >= 0.5)).select("uid")


@query(
    "flt_quantile_relax",
    """WITH d AS (SELECT uid, category AS q, coalesce(attrs['stones']['solitaire'], 1.0) AS p FROM designs WHERE category IS NOT NULL AND stone_frac < 0.2),
       s AS (SELECT q, count(*) FILTER (p >= 0.9) AS n, quantile_cont(p, 0.7) AS cut FROM d GROUP BY q),
       s2 AS (SELECT d.q, count(*) FILTER (p >= cut) AS n2 FROM d JOIN s USING (q) GROUP BY d.q)
       SELECT d.q AS query_id, uid, CAST(CASE WHEN n < 40 THEN 1 ELSE 0 END AS INTEGER) AS relaxed FROM d JOIN s USING (q) JOIN s2 USING (q)
       WHERE (n >= 40 AND p >= 0.9) OR (n < 40 AND n2 >= 40 AND p >= cut) OR (n < 40 AND n2 < 40)""",
)
def quantile_relax(spark, sf_dir):
    """FLT-07, FLT-08: a probability filter that falls back to the survivors' own quantile, then to nothing."""
    rows = _per_category(spark, sf_dir).where("category IS NOT NULL")
    kept = L.apply_filters(rows, [L.Strict("stones", F.col("stone_frac") < 0.2), L.Probable("solitaire", probability("stones", "solitaire"), 0.9, rows=40)])
    return kept.select("query_id", "uid", F.size("relaxed").alias("relaxed"))


@query(
    "flt_unwanted_sum",
    """WITH d AS (SELECT uid, category AS q, coalesce(attrs['stones']['plain'], 0) + coalesce(attrs['weight']['light'], 0) <= 0.6 AS hit FROM designs WHERE category IS NOT NULL),
       n AS (SELECT q, count(*) FILTER (hit) AS n FROM d GROUP BY q) SELECT q AS query_id, uid FROM d JOIN n USING (q) WHERE hit OR n < 16""",
)
def unwanted_sum(spark, sf_dir):
    """FLT-09: rows whose unwanted probabilities sum to little, relaxed when too few."""
    rows = _per_category(spark, sf_dir).where("category IS NOT NULL")
    return L.apply_filters(rows, [L.Unwanted("plain", [probability("stones", "plain"), probability("weight", "light")])]).select("query_id", "uid")


@query(
    "flt_strict_counts",
    """SELECT category AS query_id, count(*) AS n FROM designs WHERE list_contains(metals, 'white_gold') AND coalesce(attrs['stones']['solitaire'], 1.0) >= 0.3 AND category IS NOT NULL GROUP BY category""",
)
def strict_counts(spark, sf_dir):
    """FLT-10: the same steps without ever relaxing."""
    steps = [L.AtLeast("metal", F.array_contains("metals", "white_gold")), L.Probable("solitaire", probability("stones", "solitaire"))]
    kept = L.apply_filters(_per_category(spark, sf_dir).where("category IS NOT NULL"), steps, strict=True)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"))


@query(
    "flt_override",
    """SELECT id, CASE WHEN category_override = 'any' THEN NULL ELSE coalesce(category_override, understood.category) END AS category,
       CASE WHEN metal_override = 'any' THEN NULL ELSE coalesce(metal_override, understood.metal) END AS metal FROM search_history""",
)
def overrides(spark, sf_dir):
    """FLT-13, PRJ-04: a picked value over the parsed one, ``any`` clears it."""
    s = read_table(spark, sf_dir, "search_history")
    return s.select("id", L.override(F.col("category_override"), F.col("understood.category")).alias("category"), L.override(F.col("metal_override"), F.col("understood.metal")).alias("metal"))


@query(
    "flt_id_lookup",
    r"""WITH k AS (SELECT uid, regexp_replace(lower(design_id), '[^0-9a-z#]', '', 'g') AS k FROM designs)
        SELECT CASE WHEN length(k) >= 3 AND regexp_matches(k, '[0-9]') THEN k END AS id_key, uid FROM k WHERE length(k) >= 3 AND regexp_matches(k, '[0-9]')""",
)
def id_lookup(spark, sf_dir):
    """FLT-14: designs by normalised id."""
    return designs(spark, sf_dir).select(T.id_key("design_id").alias("id_key"), "uid").where("id_key IS NOT NULL")


@query("flt_search_box", "SELECT id FROM web_designs WHERE title ILIKE '%pendant%' OR brand ILIKE '%pendant%' OR site ILIKE '%pendant%'")
def search_box(spark, sf_dir):
    """FLT-15: case-insensitive search over several columns."""
    return read_table(spark, sf_dir, "web_designs").where(L.search_box(["title", "brand", "site"], "pendant")).select("id")


@query("flt_recent_days", "SELECT id, user_id FROM search_history WHERE created_at >= TIMESTAMPTZ '2019-01-10 00:00:00+00' AND understood.refused IS NULL")
def recent_days(spark, sf_dir):
    """FLT-17, FLT-18: rows since a time that were not refused."""
    s = read_table(spark, sf_dir, "search_history")
    return s.where((F.col("created_at") >= F.lit("2019-01-10 00:00:00").cast("timestamp")) & F.col("understood.refused").isNull()).select("id", "user_id")


@query("flt_prefix", "SELECT uid, key FROM designs WHERE key LIKE 'DJ-0%'")
def key_prefix(spark, sf_dir):
    """FLT-19, SRC-11: a prefix reaches the scan as StringStartsWith."""
    return designs(spark, sf_dir).where(F.col("key").startswith("DJ-0")).select("uid", "key")


@query(
    "facet_counts",
    """WITH f AS (SELECT uid, category, metals FROM designs),
       o(grp, opt) AS (VALUES ('category', 'ring'), ('category', 'pendant'), ('category', 'crown'), ('metal', 'white_gold'), ('metal', 'rose_gold'), ('metal', 'yellow_gold'))
       SELECT grp, opt, CASE grp WHEN 'category' THEN (SELECT count(*) FROM f WHERE category = opt AND list_contains(metals, 'white_gold'))
                        ELSE (SELECT count(*) FROM f WHERE list_contains(metals, opt) AND category = 'ring') END AS n FROM o""",
)
def facets(spark, sf_dir):
    """AGG-35, FLT-10: strict counts of every option under the picks of the other groups."""
    rows = designs(spark, sf_dir).select(F.col("uid").alias("id"), F.create_map(F.lit("category"), F.array("category"), F.lit("metal"), F.col("metals")).alias("facets"))
    options = spark.createDataFrame([("category", "ring"), ("category", "pendant"), ("category", "crown"), ("metal", "white_gold"), ("metal", "rose_gold"), ("metal", "yellow_gold")], "grp string, opt string")
    return L.facet_counts(rows, options, {"category": "ring", "metal": "white_gold"})


# --- projections


@query(
    "prj_card",
    """WITH n AS (SELECT family, count(*) AS n FROM designs GROUP BY family)
       SELECT uid, CASE WHEN list_contains(metals, 'white_gold') THEN 'white_gold' ELSE coalesce(list_filter(['yellow_gold', 'rose_gold', 'white_gold'], lambda m: list_contains(metals, m))[1], NULL) END AS shown_metal,
       len(list_filter(map_values(coalesce(attrs['stones'], MAP {})), lambda p: p >= 0.5)) AS n_tags, n.n - 1 AS variant_count FROM designs JOIN n USING (family)""",
)
def card(spark, sf_dir):
    """PRJ-01, JOIN-04: result card: shown metal, tags of clear attributes, number of siblings."""
    order = F.array(*[F.lit(m) for m in ("yellow_gold", "rose_gold", "white_gold")])
    first = F.get(F.filter(order, lambda m: F.array_contains("metals", m)), F.lit(0))
    tags = F.size(F.filter(F.map_values(F.coalesce(F.col("attrs")["stones"], F.create_map().cast("map<string,double>"))), lambda p: p >= 0.5))
    d = designs(spark, sf_dir)
    sizes = d.groupBy("family").agg((F.count("*") - 1).alias("variant_count"))
    return d.join(sizes, "family").select("uid", F.when(F.array_contains("metals", "white_gold"), "white_gold").otherwise(first).alias("shown_metal"), tags.cast("long").alias("n_tags"), "variant_count")


@query("prj_media_token", "SELECT uid, substr(sha1(key), 1, 16) AS token, sha256(key) AS content FROM designs")
def media_token(spark, sf_dir):
    """PRJ-06, HS-01: opaque tokens and content keys."""
    return designs(spark, sf_dir).select("uid", F.substring(F.sha1("key"), 1, 16).alias("token"), F.sha2("key", 256).alias("content"))


@query(
    "prj_listing_summary",
    """WITH p AS (SELECT id, from_json(pictures, '["JSON"]') AS p FROM (SELECT DISTINCT id, pictures FROM brand_designs WHERE pictures IS NOT NULL))
       SELECT id, CAST(len(p) AS INTEGER) AS n_pictures, CAST(coalesce(list_sum(list_transform(p, lambda x: CAST(x->>'bytes' AS BIGINT))), 0) AS BIGINT) AS bytes,
       list_max(list_transform(p, lambda x: CAST(x->>'width' AS BIGINT))) AS widest FROM p""",
)
def listing_summary(spark, sf_dir):
    """PRJ-07, JS-05: counts and sums over a JSON array."""
    p = F.from_json("pictures", "array<struct<bytes:long,width:long>>")
    b = read_table(spark, sf_dir, "brand_designs").select("id", "pictures").where("pictures IS NOT NULL").distinct()
    total = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["bytes"], F.lit(0).cast("long")))
    return b.select("id", F.json_array_length("pictures").alias("n_pictures"), total.alias("bytes"), F.array_max(F.transform(p, lambda x: x["width"])).alias("widest"))


# --- joins


@query("join_semi", "SELECT uid FROM designs WHERE category IN (SELECT category FROM photo_query WHERE metal = 'rose_gold')")
def semi(spark, sf_dir):
    """JOIN-05."""
    return designs(spark, sf_dir).join(read_table(spark, sf_dir, "photo_query").where("metal = 'rose_gold'").select("category"), "category", "left_semi").select("uid")


@query("join_anti", "SELECT d.uid FROM designs d LEFT JOIN favorites f ON f.design_uid = d.uid WHERE f.design_uid IS NULL")
def anti(spark, sf_dir):
    """JOIN-06, JOIN-07: designs nobody keeps."""
    return designs(spark, sf_dir).join(read_table(spark, sf_dir, "favorites").select(F.col("design_uid").cast("long").alias("uid")), "uid", "left_anti").select("uid")


@query(
    "join_unservable",
    """SELECT d.uid FROM designs d LEFT JOIN (SELECT DISTINCT design_uid FROM favorites) f ON f.design_uid = d.uid
       LEFT JOIN (SELECT DISTINCT unnest(result_uids) AS u FROM search_history) s ON s.u = d.uid WHERE f.design_uid IS NULL OR s.u IS NULL""",
)
def unservable(spark, sf_dir):
    """JOIN-08, JOIN-09: chained outer joins, rows where a link is missing."""
    f = read_table(spark, sf_dir, "favorites").select(F.col("design_uid").cast("long").alias("fu")).distinct()
    s = read_table(spark, sf_dir, "search_history").select(F.explode(F.col("result_uids").cast("array<long>")).alias("su")).distinct()
    joined = designs(spark, sf_dir).select("uid").join(f, F.col("uid") == F.col("fu"), "left").join(s, F.col("uid") == F.col("su"), "left")
    return joined.where("fu IS NULL OR su IS NULL").select("uid")


@query(
    "join_best_match",
    """WITH w AS (SELECT DISTINCT id, brand_design_id, length(title) AS n FROM web_designs WHERE brand_design_id IS NOT NULL),
       b AS (SELECT DISTINCT id AS bid, site FROM brand_designs),
       j AS (SELECT bid, w.id AS web_id, row_number() OVER (PARTITION BY bid ORDER BY n NULLS LAST, w.id NULLS LAST) AS r FROM b LEFT JOIN w ON w.brand_design_id = b.bid)
       SELECT bid, web_id FROM j WHERE r = 1""",
)
def best_match(spark, sf_dir):
    """JOIN-12: for every listing the page with the shortest title."""
    w = read_table(spark, sf_dir, "web_designs").where("brand_design_id IS NOT NULL").select(F.col("id").alias("web_id"), F.col("brand_design_id").alias("bid"), F.length("title").alias("n")).distinct()
    b = read_table(spark, sf_dir, "brand_designs").select(F.col("id").alias("bid"), "site").distinct()
    return R.best_match(b, w, "bid", F.col("n"), [F.col("web_id").asc_nulls_last()], "bid").select("bid", "web_id")


@query(
    "join_longest_prefix",
    """WITH f AS (SELECT DISTINCT unnest(folders) AS f, category FROM designs), o AS (SELECT split_part(f, '/', 1) || '/' || split_part(f, '/', 2) AS folder, category AS owner FROM f UNION ALL SELECT split_part(f, '/', 1), category FROM f),
       s AS (SELECT folder, min(owner) AS owner FROM o WHERE folder <> '' GROUP BY folder HAVING count(DISTINCT owner) = 1),
       p AS (SELECT DISTINCT f || '/1.png' AS path FROM f WHERE f IS NOT NULL),
       j AS (SELECT path, folder, owner, row_number() OVER (PARTITION BY path ORDER BY length(folder) DESC) AS r FROM p LEFT JOIN s ON starts_with(path, folder || '/'))
       SELECT path, folder, owner FROM j WHERE r = 1""",
)
def longest_prefix(spark, sf_dir):
    """JOIN-13: a file's nearest ancestor folder that one owner alone has, over all folders."""
    f = designs(spark, sf_dir).select(F.explode("folders").alias("f"), "category").where("f IS NOT NULL").distinct()
    parts = F.split("f", "/")
    owners = f.select(F.array_join(F.slice(parts, 1, 2), "/").alias("folder"), F.col("category").alias("owner")).unionByName(f.select(F.get(parts, F.lit(0)).alias("folder"), F.col("category").alias("owner"))).where("folder <> ''")
    return R.nearest_ancestor(f.select(F.concat("f", F.lit("/1.png")).alias("path")).distinct(), owners)


@query(
    "join_copies",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper, count(*) OVER (PARTITION BY octet_length(encode(text))) > 1 AS same_size FROM documents WHERE text IS NOT NULL""",
)
def copies(spark, sf_dir):
    """JOIN-14, HS-03, AGG-05: copies by content point at the first; only equal sizes can be copies."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("keeper"))
    sizes = d.groupBy("size").agg((F.count("*") > 1).alias("same_size"))
    return d.join(first, "h").join(sizes, "size").select("doc_id", "keeper", "same_size")


@query(
    "join_id_repair",
    """WITH c AS (SELECT uid, design_id FROM designs), k AS (SELECT design_id, min(uid) AS cu FROM designs WHERE design_id IS NOT NULL GROUP BY design_id)
       SELECT f.user_id, f.design_uid, CASE WHEN c.uid IS NOT NULL AND (c.design_id IS NOT DISTINCT FROM f.design_id OR f.design_id IS NULL OR f.design_id = '') THEN c.uid ELSE k.cu END AS resolved
       FROM favorites f LEFT JOIN c ON c.uid = f.design_uid LEFT JOIN k ON k.design_id = f.design_id""",
)
def id_repair(spark, sf_dir):
    """JOIN-15: a stored number that no longer fits its code is looked up by the code."""
    f = read_table(spark, sf_dir, "favorites").select("user_id", F.col("design_uid").cast("long").alias("uid"), "design_id")
    fixed = R.repair_ids(f, designs(spark, sf_dir), "uid", "design_id")
    return fixed.select("user_id", F.col("uid").cast("int").alias("design_uid"), "resolved")


@query(
    "join_ordered_unnest",
    """WITH s AS (SELECT id, any_value(result_uids) AS r FROM search_history GROUP BY id), e AS (SELECT id, unnest(r) AS u, generate_subscripts(r, 1) AS p FROM s)
       SELECT e.id, string_agg(d.design_id, ',' ORDER BY p) AS cards FROM e JOIN designs d ON d.uid = e.u GROUP BY e.id""",
)
def ordered_unnest(spark, sf_dir):
    """JOIN-16: result ids to cards, in rank order."""
    s = read_table(spark, sf_dir, "search_history").groupBy("id").agg(F.first("result_uids").cast("array<long>").alias("r"))
    found = R.ordered_lookup(s, "r", designs(spark, sf_dir), "uid", "design_id", "id")
    return found.select("id", F.array_join("values", ",").alias("cards"))


@query(
    "join_interval_occasion",
    """WITH o(occasion, first, last) AS (VALUES ('new_year', DATE '2019-01-01', DATE '2019-01-03'), ('harvest', DATE '2019-01-08', DATE '2019-01-15'), ('fair', DATE '2019-01-12', DATE '2019-01-18'))
       SELECT occasion, count(*) AS n FROM search_history JOIN o ON CAST(created_at AT TIME ZONE 'UTC' AS DATE) BETWEEN first AND last GROUP BY occasion""",
)
def interval_occasion(spark, sf_dir):
    """JOIN-20, DT-05: searches that fall into the window of an occasion."""
    o = spark.createDataFrame([("new_year", "2019-01-01", "2019-01-03"), ("harvest", "2019-01-08", "2019-01-15"), ("fair", "2019-01-12", "2019-01-18")], "occasion string, f string, l string")
    o = o.select("occasion", F.col("f").cast("date").alias("first"), F.col("l").cast("date").alias("last"))
    s = read_table(spark, sf_dir, "search_history").where("created_at IS NOT NULL").select("id", "created_at")
    return R.interval_join(s, "created_at", o, "first", "last", 5).groupBy("occasion").agg(F.count("*").alias("n"))


CHART = [(1.0, 0.005), (1.5, 0.015), (2.0, 0.03), (3.0, 0.11), (5.0, 0.5)]


@query(
    "join_range_interpolate",
    """WITH c(x, y) AS (VALUES (1.0, 0.005), (1.5, 0.015), (2.0, 0.03), (3.0, 0.11), (5.0, 0.5)), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM c),
       p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 8 AS mm FROM part)
       SELECT p_partkey, round(CASE WHEN mm < 1 THEN 0.005 * pow(mm / 1.0, 3) WHEN mm >= 5 THEN 0.5 * pow(mm / 5.0, 3) ELSE y0 + (mm - x0) / (x1 - x0) * (y1 - y0) END, 6) AS carat
       FROM p LEFT JOIN s ON mm >= x0 AND mm < x1 AND x1 IS NOT NULL""",
)
def range_interpolate(spark, sf_dir):
    """JOIN-21, MA-06: stone size to carats on a chart of points."""
    chart = spark.createDataFrame(CHART, "mm double, carat double")
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 8).alias("mm"))
    return R.interpolate(p, "mm", chart, "mm", "carat", "carat").select("p_partkey", F.round("carat", 6).alias("carat"))


@query(
    "join_spatial",
    """WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_custkey * 37 % 101 AS DOUBLE) AS y FROM customer)
       SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25""",
)
def spatial(spark, sf_dir):
    """JOIN-22: points within a distance, by a grid."""
    p = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 37 % 101).cast("double").alias("y"))
    return R.near_points(p, "id", ["x", "y"], 0.5)


@query(
    "join_parent_child",
    """SELECT d.uid, f.user_id FROM designs d LEFT JOIN favorites f ON f.design_uid = d.uid WHERE d.category = 'necklace'""",
)
def parent_child(spark, sf_dir):
    """JOIN-10, JOIN-25: parents with their children, childless ones kept."""
    f = read_table(spark, sf_dir, "favorites").select(F.col("design_uid").cast("long").alias("uid"), "user_id")
    return designs(spark, sf_dir).where("category = 'necklace'").select("uid").join(f, "uid", "left")


@query(
    "join_fallback_union",
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n) AS n, a.user_id IS NOT NULL AS from_first FROM (SELECT user_id, count(*) AS n FROM favorites GROUP BY user_id) a
       FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM search_history WHERE user_id IS NOT NULL GROUP BY user_id) b ON a.user_id = b.user_id""",
)
def fallback_union(spark, sf_dir):
    """SRC-17, SET-03: two stores, the first one wins."""
    a = read_table(spark, sf_dir, "favorites").groupBy("user_id").agg(F.count("*").alias("n1"))
    b = read_table(spark, sf_dir, "search_history").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("u2")).agg(F.count("*").alias("n2"))
    j = a.join(b, F.col("user_id") == F.col("u2"), "full")
    return j.select(F.coalesce("user_id", "u2").alias("user_id"), F.coalesce("n1", "n2").alias("n"), F.col("user_id").isNotNull().alias("from_first"))


# --- aggregates


@query("agg_category", "SELECT category, count(*) AS n, count(DISTINCT family) AS n_families, min(uid) AS cover FROM designs GROUP BY category")
def agg_category(spark, sf_dir):
    """AGG-01: rows, families and cover per category."""
    return designs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("family").alias("n_families"), F.min("uid").alias("cover"))


@query(
    "agg_status_rollup",
    """SELECT archive_status, site, GROUPING(archive_status, site) AS level, count(DISTINCT id) AS n FROM web_designs GROUP BY ROLLUP (archive_status, site)""",
)
def status_rollup(spark, sf_dir):
    """AGG-02, AGG-16: counts with subtotals."""
    return read_table(spark, sf_dir, "web_designs").rollup("archive_status", "site").agg(F.grouping_id().cast("long").alias("level"), F.count_distinct("id").alias("n"))


@query(
    "agg_kind_sizes",
    "SELECT source, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) - count(DISTINCT text) AS copies FROM documents GROUP BY source",
)
def kind_sizes(spark, sf_dir):
    """AGG-03, AGG-04, AGG-05: count and bytes per kind, copies."""
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), (F.count("*") - F.count_distinct(F.xxhash64("text"), F.length("text"))).alias("copies"))


@query("agg_capped_count", "SELECT CAST(least(count(*), 100) AS BIGINT) AS n, count(*) > 0 AS any_row FROM designs WHERE category = 'ring'")
def capped_count(spark, sf_dir):
    """AGG-06, AGG-07: a count that stops at a cap, and existence."""
    r = designs(spark, sf_dir).where("category = 'ring'").select("uid").limit(100)
    return r.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any_row"))


@query(
    "agg_path_list",
    "SELECT family, string_agg(design_id, '|' ORDER BY design_id) AS ids, min(uid) AS first_uid FROM designs GROUP BY family",
)
def path_list(spark, sf_dir):
    """AGG-10: ids of a family as one text."""
    return designs(spark, sf_dir).groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("design_id")), "|").alias("ids"), F.min("uid").alias("first_uid"))


@query(
    "agg_merge_fold",
    """WITH d AS (SELECT uid, upper(regexp_extract(design_id, '^([A-Za-z]+)', 1)) AS series, NOT contains(key, '|PHOTOS/') AS pref, attrs FROM designs WHERE attrs IS NOT NULL),
       g AS (SELECT uid, series, pref, unnest(map_entries(attrs)) AS g FROM d), e AS (SELECT uid, series, pref, g.key AS grp, unnest(map_entries(g.value)) AS e FROM g)
       SELECT series, grp, e.key AS attr, arg_max(e.value, (pref, CASE WHEN pref THEN uid ELSE -uid END)) AS p FROM e WHERE series <> '' GROUP BY 1, 2, 3""",
)
def merge_fold(spark, sf_dir):
    """AGG-14, AGG-15: maps merged by the series in their names; the last outside PHOTOS wins, else the first inside."""
    d = designs(spark, sf_dir).where("attrs IS NOT NULL").select(F.upper(F.regexp_extract("design_id", "^([A-Za-z]+)", 1)).alias("series"), F.explode("attrs").alias("grp", "m"), (~F.contains("key", F.lit("|PHOTOS/"))).alias("pref"), "uid").where("series <> ''")
    return R.merge_maps(d, ["series", "grp"], "m", F.col("pref"), F.col("uid")).select("series", "grp", F.explode("m").alias("attr", "p"))


@query(
    "agg_majority_vote",
    """WITH n AS (SELECT family, front_view, count(*) AS n FROM designs WHERE front_view IS NOT NULL GROUP BY 1, 2), t AS (SELECT family, sum(n) AS t FROM n GROUP BY family),
       r AS (SELECT family, front_view, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, front_view) AS r FROM n)
       SELECT family, CASE WHEN n / t >= 0.5 THEN front_view END AS front_view, round(n / t, 6) AS share FROM r JOIN t USING (family) WHERE r = 1""",
)
def majority_vote(spark, sf_dir):
    """AGG-17, AGG-18: the view most of a family has, if it has half."""
    m = R.majority(designs(spark, sf_dir), "family", "front_view")
    return m.select("family", "front_view", F.round("share", 6).alias("share"))


@query(
    "agg_median_calibration",
    """WITH p AS (SELECT category, stone_frac AS r FROM designs WHERE stone_frac IS NOT NULL), m AS (SELECT category, quantile_cont(r, 0.5) AS m, count(*) AS n FROM p GROUP BY category HAVING count(*) >= 20)
       SELECT category, round(m, 6) AS median, round(avg(CASE WHEN abs(r / m - 1) <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within FROM p JOIN m USING (category) GROUP BY category, m""",
)
def median_calibration(spark, sf_dir):
    """AGG-24: robust level per category and share close to it, where there are enough."""
    p = designs(spark, sf_dir).where("stone_frac IS NOT NULL").select("category", F.col("stone_frac").alias("r"))
    m = p.groupBy("category").agg(F.percentile("r", 0.5).alias("m"), F.count("*").alias("n")).where("n >= 20")
    return p.join(m, "category").groupBy("category", "m").agg(F.avg((F.abs(F.col("r") / F.col("m") - 1) <= 0.1).cast("double")).alias("w")).select("category", F.round("m", 6).alias("median"), F.round("w", 6).alias("within"))


@query(
    "agg_threshold_table",
    """WITH t(cut) AS (VALUES (0.3), (0.5), (0.7), (0.9)), d AS (SELECT attrs['stones']['solitaire'] AS p, stone_frac > 0.1 AS truth FROM designs WHERE attrs['stones']['solitaire'] IS NOT NULL AND stone_frac IS NOT NULL)
       SELECT CAST(cut AS DOUBLE) AS cut, round(avg(CASE WHEN p >= cut THEN 1.0 ELSE 0.0 END), 6) AS shown, round(avg(CASE WHEN p >= cut THEN CASE WHEN truth THEN 1.0 ELSE 0.0 END END), 6) AS precision FROM d, t GROUP BY cut""",
)
def threshold_table(spark, sf_dir):
    """AGG-32: share shown and precision at thresholds; four thresholds."""
    d = designs(spark, sf_dir).select(probability("stones", "solitaire").alias("p"), (F.col("stone_frac") > 0.1).alias("truth")).where("p IS NOT NULL AND truth IS NOT NULL")
    each = d.select("p", "truth", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7, 0.9)])).alias("cut"))
    hit = F.col("p") >= F.col("cut")
    return each.groupBy("cut").agg(F.round(F.avg(hit.cast("double")), 6).alias("shown"), F.round(F.avg(F.when(hit, F.col("truth").cast("double"))), 6).alias("precision"))


@query(
    "agg_section_pivot",
    """SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'hi') AS hi, count(*) FILTER (lang = 'gu') AS gu FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def section_pivot(spark, sf_dir):
    """AGG-34: counts per section, deciders as columns."""
    p = read_table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").pivot("lang", ["en", "hi", "gu"]).agg(F.count(F.lit(1)))
    return p.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("en", "hi", "gu")])


@query(
    "agg_spec_groups",
    """SELECT p_type, round(p_retailprice / 100, 0) AS size_class, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1, 2""",
)
def spec_groups(spark, sf_dir):
    """AGG-25: groups by rounded measure with count and sum."""
    return read_table(spark, sf_dir, "part").groupBy("p_type", F.round(F.col("p_retailprice") / 100, 0).alias("size_class")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


# --- windows, order, sets


@query(
    "win_latest_per_key",
    """SELECT user_id, query, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY created_at DESC NULLS LAST, id DESC, matches DESC NULLS LAST) AS r FROM search_history) WHERE r = 1""",
)
def latest(spark, sf_dir):
    """WIN-14, SNK-05: the newest search per user and text."""
    s = read_table(spark, sf_dir, "search_history").select("user_id", "query", "id", "created_at", "matches")
    return R.latest_per_key(s, ["user_id", "query"], [F.col("created_at").desc_nulls_last(), F.col("id").desc(), F.col("matches").desc_nulls_last()]).select("user_id", "query", "id")


@query(
    "win_lru_evict",
    """SELECT doc_id FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY -epoch_us(created_at) // 1000000, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents WHERE created_at IS NOT NULL) WHERE s > 200000""",
)
def lru_evict(spark, sf_dir):
    """WIN-16: least recently used out until the rest fits."""
    d = read_table(spark, sf_dir, "documents").where("created_at IS NOT NULL").select("doc_id", "n_chars", F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000).alias("used"))
    return R.evict(d, "n_chars", "used", "doc_id", 200_000).select("doc_id")


@query(
    "win_numbered_names",
    """SELECT uid, CASE WHEN n > 1 THEN family || '-' || n ELSE family END AS unique_name FROM (SELECT uid, family, row_number() OVER (PARTITION BY family ORDER BY uid) AS n FROM designs)""",
)
def unique_names(spark, sf_dir):
    """WIN-19: names made unique by number."""
    return R.numbered_names(designs(spark, sf_dir), "family", [F.col("uid")]).select("uid", "unique_name")


@query(
    "win_rate_limit",
    """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 3 AS "over" FROM events""",
)
def rate_limit(spark, sf_dir):
    """WIN-18: events of the last day per user."""
    return rate_limited(read_table(spark, sf_dir, "events"), "user_id", "ts", 86_400, 3).select("event_id", "recent", "over")


@query(
    "win_queue_position",
    "SELECT id, row_number() OVER (PARTITION BY site ORDER BY created_at NULLS LAST, id) AS pos FROM (SELECT DISTINCT id, site, created_at FROM web_designs WHERE archive_status = 'staged')",
)
def queue_position(spark, sf_dir):
    """WIN-17: place among those waiting."""
    w = read_table(spark, sf_dir, "web_designs").where("archive_status = 'staged'").select("id", "site", "created_at").distinct()
    return w.select("id", F.row_number().over(Window.partitionBy("site").orderBy(F.col("created_at").asc_nulls_last(), "id")).cast("long").alias("pos"))


@query(
    "win_round_robin",
    """WITH t AS (SELECT uid, category, row_number() OVER (PARTITION BY category ORDER BY stone_frac DESC NULLS LAST, uid) AS n FROM designs WHERE category IS NOT NULL)
       SELECT uid, CAST(rank AS INTEGER) AS position FROM (SELECT uid, row_number() OVER (ORDER BY n, category) AS rank FROM t) WHERE rank <= 20""",
)
def round_robin(spark, sf_dir):
    """WIN-13: facets in turn; a page of twenty, cut per facet before the turns are merged."""
    d = designs(spark, sf_dir).where("category IS NOT NULL").select("uid", "category", "stone_frac")
    order = [F.col("stone_frac").desc_nulls_last(), F.col("uid")]
    head = d.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where("_r <= 20")
    return interleave(head, "category", order, F.col("category")).where("position <= 20").select("uid", "position")


@query(
    "srt_richness",
    """WITH m AS (SELECT quantile_cont(stone_frac, 0.5) AS m FROM designs) SELECT uid, CAST(row_number() OVER (ORDER BY coalesce(stone_frac, m) DESC, uid) AS INTEGER) AS pos FROM designs, m
       ORDER BY pos LIMIT 50""",
)
def richness(spark, sf_dir):
    """SRT-01, SRT-02, SRT-03: order with the median for missing values, first page."""
    d = designs(spark, sf_dir)
    m = d.agg(F.percentile("stone_frac", 0.5).alias("m"))
    top = d.crossJoin(F.broadcast(m)).orderBy(F.coalesce("stone_frac", "m").desc(), "uid").limit(50)  # one row
    return top.select("uid", F.row_number().over(Window.orderBy(F.coalesce("stone_frac", "m").desc(), "uid")).alias("pos"))


@query("srt_page", "SELECT uid, design_id FROM designs ORDER BY lower(design_id), uid LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    """SRT-04: third page of a case-insensitive order."""
    return designs(spark, sf_dir).orderBy(F.lower("design_id"), "uid").offset(40).limit(20).select("uid", "design_id")


@query(
    "srt_priority_class",
    """SELECT source, CASE WHEN source IN ('product_page', 'blog') THEN 1 WHEN source LIKE '%note' THEN 2 WHEN source IS NULL THEN 4 ELSE 3 END AS class, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def priority_class(spark, sf_dir):
    """SRT-05: classes of priority."""
    c = F.when(F.col("source").isin("product_page", "blog"), 1).when(F.col("source").like("%note"), 2).when(F.col("source").isNull(), 4).otherwise(3)
    return read_table(spark, sf_dir, "documents").groupBy("source", c.alias("class")).agg(F.count("*").alias("n"))


@query("srt_seeded_sample")
def seeded_sample(spark, sf_dir):
    """SRT-08: thirty designs in pseudorandom order by a seeded hash, the same on every run."""
    return designs(spark, sf_dir).orderBy(F.xxhash64("uid", F.lit(17)), "uid").limit(30).select("uid")


@query("srt_budget_fill")
def budget(spark, sf_dir):
    """WIN-15: documents in order of arrival until a budget of characters is used, large ones passed over."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "created_at")
    return budget_fill(d, "n_chars", ["created_at"], 50_000, "doc_id").select("doc_id", "n_chars")


@query(
    "set_union_distinct",
    "SELECT user_id FROM favorites UNION SELECT user_id FROM search_history",
)
def union_distinct(spark, sf_dir):
    """SET-01, SET-02."""
    return read_table(spark, sf_dir, "favorites").select("user_id").union(read_table(spark, sf_dir, "search_history").select("user_id")).distinct()


@query("set_difference", "SELECT user_id FROM search_history WHERE user_id IS NOT NULL EXCEPT SELECT user_id FROM photo_query")
def difference(spark, sf_dir):
    """SET-04."""
    return read_table(spark, sf_dir, "search_history").where("user_id IS NOT NULL").select("user_id").subtract(read_table(spark, sf_dir, "photo_query").select("user_id"))


@query("set_intersection", "SELECT design_uid AS uid FROM favorites INTERSECT SELECT unnest(result_uids) FROM search_history")
def intersection(spark, sf_dir):
    """SET-04, extra: designs both kept and shown."""
    shown = read_table(spark, sf_dir, "search_history").select(F.explode("result_uids").alias("uid"))
    return R.common_rows(read_table(spark, sf_dir, "favorites").select(F.col("design_uid").alias("uid")), shown)


@query(
    "set_arrays",
    """SELECT uid, least(2, len(list_intersect(metals, ['white_gold', 'rose_gold'])))::INTEGER AS common, len(list_filter(['white_gold'], lambda m: NOT list_contains(metals, m))) = 0 AS keeps,
       array_to_string(list_sort(list_filter(['white_gold', 'rose_gold', 'yellow_gold'], lambda m: NOT list_contains(metals, m))), ',') AS missing FROM designs WHERE metals IS NOT NULL""",
)
def set_arrays(spark, sf_dir):
    """SET-05, SET-06, SET-08: intersection, subset and difference of arrays."""
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    d = designs(spark, sf_dir).where("metals IS NOT NULL")
    return d.select(
        "uid", F.least(F.lit(2), F.size(F.array_intersect("metals", a("white_gold", "rose_gold")))).alias("common"), (F.size(F.array_except(a("white_gold"), "metals")) == 0).alias("keeps"),
        F.array_join(F.array_sort(F.array_except(a("white_gold", "rose_gold", "yellow_gold"), "metals")), ",").alias("missing"),
    )


# --- sinks as table functions


@query(
    "snk_upsert",
    """WITH s AS (SELECT DISTINCT user_id, design_uid FROM favorites WHERE design_uid % 2 = 0), n AS (SELECT DISTINCT user_id, design_uid FROM favorites WHERE design_uid % 3 = 0)
       SELECT user_id, design_uid, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.user_id = u.user_id AND n.design_uid = u.design_uid) THEN 'new' ELSE 'old' END AS state
       FROM (SELECT * FROM s UNION SELECT * FROM n) u""",
)
def snk_upsert(spark, sf_dir):
    """SNK-03."""
    f = read_table(spark, sf_dir, "favorites").select("user_id", "design_uid").distinct()
    return R.upsert(f.where("design_uid % 2 = 0").withColumn("state", F.lit("old")), f.where("design_uid % 3 = 0").withColumn("state", F.lit("new")), ["user_id", "design_uid"])


@query(
    "snk_insert_missing",
    """WITH s AS (SELECT DISTINCT user_id, design_uid FROM favorites WHERE design_uid % 2 = 0), n AS (SELECT DISTINCT user_id, design_uid FROM favorites WHERE design_uid % 3 = 0)
       SELECT user_id, design_uid, CASE WHEN design_uid % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM (SELECT * FROM s UNION SELECT * FROM n) u""",
)
def snk_insert(spark, sf_dir):
    """SNK-04."""
    f = read_table(spark, sf_dir, "favorites").select("user_id", "design_uid").distinct()
    return R.insert_missing(f.where("design_uid % 2 = 0").withColumn("state", F.lit("old")), f.where("design_uid % 3 = 0").withColumn("state", F.lit("new")), ["user_id", "design_uid"])


@query(
    "snk_soft_delete",
    "SELECT id, status, CASE WHEN status = 'hidden' THEN 1 ELSE 0 END AS deleted FROM (SELECT DISTINCT id, status FROM brand_designs)",
)
def soft_delete(spark, sf_dir):
    """SNK-08: rows are flagged, not removed."""
    return read_table(spark, sf_dir, "brand_designs").select("id", "status").distinct().withColumn("deleted", F.when(F.col("status") == "hidden", 1).otherwise(0))


@query("snk_compress_choice")
def compress_choice(spark, sf_dir):
    """SNK-10: packed only where that saves a tenth."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return packed(d, "text").select("doc_id", "codec", F.octet_length("body").alias("stored"))
