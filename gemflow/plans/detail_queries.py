"""Queries of record details, evaluation tables and sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemflow.functions import text as T
from gemflow.operators import geometry, phrases
from gemflow.operators import relational as R
from gemflow.session import read_table
from gemflow.sources.tables import request

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand designs, once per id (repeated rows are equal)."""
    return read_table(spark, sf_dir, "brand_designs").dropDuplicates(["id"])


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches once per id: the row with most matches."""
    s = read_table(spark, sf_dir, "search_history").select("id", "user_id", "query", "created_at", "understood", "result_uids", "matches")
    return s.groupBy("id").agg(F.max_by(F.struct("user_id", "query", "created_at", "understood", "result_uids"), F.coalesce("matches", F.lit(-1))).alias("r")).select("id", "r.*")


def readable(column: str):
    """Whether a column holds a JSON object."""
    return F.try_parse_json(column).isNotNull() & F.ltrim(column).startswith("{")


_B = "b AS (SELECT DISTINCT ON (id) * FROM brand_designs)"
_OBJECT = "json_valid({0}) AND json_type({0}) = 'OBJECT'"
_S = "s AS (SELECT id, arg_max(user_id, coalesce(matches, -1)) AS user_id, arg_max(query, coalesce(matches, -1)) AS query, arg_max(created_at, coalesce(matches, -1)) AS created_at, arg_max(understood, coalesce(matches, -1)) AS understood, arg_max(result_uids, coalesce(matches, -1)) AS result_uids FROM search_history GROUP BY id)"


# --- filters and gates


@query(
    "flt_status",
    f"WITH {_B} SELECT 'active' AS mode, id FROM b WHERE status IS DISTINCT FROM 'hidden' UNION ALL SELECT 'hidden', id FROM b WHERE status = 'hidden' UNION ALL SELECT 'all', id FROM b",
)
def status(spark, sf_dir):
    """FLT-16: a list of the active ones, of one status, or of all."""
    b = brands(spark, sf_dir).select("id", "status")
    modes = {"active": ~F.col("status").eqNullSafe("hidden"), "hidden": F.col("status") == "hidden", "all": F.lit(True)}
    return b.select("id", F.explode(F.array_compact(F.array(*[F.when(test, mode) for mode, test in modes.items()]))).alias("mode")).select("mode", "id")


@query(
    "flt_checked_unchanged",
    f"""WITH {_B}, c AS (SELECT brand_design_id AS id, bool_or(archive_status = 'stored') AS pass, max(updated_at) AS at FROM web_designs WHERE brand_design_id IS NOT NULL GROUP BY 1)
        SELECT b.id, coalesce(pass, false) AND b.updated_at <= c.at AS offered FROM b LEFT JOIN c USING (id) WHERE coalesce(coalesce(pass, false) AND b.updated_at <= c.at, false)""",
)
def checked_unchanged(spark, sf_dir):
    """FLT-28: what passed its check and was not changed since."""
    c = read_table(spark, sf_dir, "web_designs").where("brand_design_id IS NOT NULL").groupBy(F.col("brand_design_id").alias("id")).agg(F.bool_or(F.col("archive_status") == "stored").alias("pass"), F.max("updated_at").alias("at"))
    joined = brands(spark, sf_dir).select("id", "updated_at").join(c, "id")
    return joined.select("id", (F.col("pass") & (F.col("updated_at") <= F.col("at"))).alias("offered")).where("offered")


@query(
    "flt_feed",
    f"""WITH {_B}, w AS (SELECT id, title, pictures, original FROM (SELECT DISTINCT ON (id) * FROM web_designs) WHERE {_OBJECT.format("original")}),
        v AS (SELECT id, title, json_valid(pictures) AND json_type(pictures) = 'ARRAY' AND json_array_length(pictures) > 0 AS picture, original->>'url' AS url, CAST(original->>'price' AS DOUBLE) > 0 AS priced FROM w)
        SELECT id, regexp_extract(url, '/([^/?#]+)[?#]?[^/]*$', 1) AS handle FROM v WHERE picture AND priced AND regexp_matches(title, '(?i)\\b(ring|rings|band|earrings?|studs?|pendants?|necklaces?|bracelets?|bangles?|haar|kada)\\b') AND regexp_extract(url, '/([^/?#]+)[?#]?[^/]*$', 1) <> ''""",
)
def feed(spark, sf_dir):
    """FLT-21: a product with a picture, a price, a recognised type and a handle."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "title", "pictures", "original").dropDuplicates(["id"]).where(readable("original"))
    picture = F.try_parse_json("pictures").isNotNull() & F.ltrim("pictures").startswith("[") & (F.json_array_length("pictures") > 0)
    handle = F.regexp_extract(F.get_json_object("original", "$.url"), r"/([^/?#]+)[?#]?[^/]*$", 1)
    typed = F.col("title").rlike(r"(?i)\b(ring|rings|band|earrings?|studs?|pendants?|necklaces?|bracelets?|bangles?|haar|kada)\b")
    return w.where(picture & typed & (F.get_json_object("original", "$.price").try_cast("double") > 0)).select("id", handle.alias("handle")).where("handle <> ''")


@query(
    "flt_picture_accept",
    """WITH p AS (SELECT photo_id, coalesce(attrs['stones:solitaire'], 0) AS jewel, coalesce(attrs['form:floral'], 0) AS closest, coalesce(attrs['band:plain'], 0) AS place, category IS NOT NULL AS about, user_id
                  FROM (SELECT DISTINCT ON (photo_id) * FROM photo_query) WHERE attrs IS NOT NULL),
       ok AS (SELECT *, round(jewel + 2 * closest + 0.05 * place, 6) AS score FROM p WHERE jewel >= 0.5 AND (about OR (jewel >= 0.9 AND closest >= 0.75)))
       SELECT user_id, arg_max(photo_id, (score, -photo_id)) AS photo_id, max(score) AS score FROM ok WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def picture_accept(spark, sf_dir):
    """FLT-23: pictures that are surely of the trade, surer still where the words are not; the best one per page."""
    at = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(0.0))
    p = read_table(spark, sf_dir, "photo_query").where("attrs IS NOT NULL AND user_id IS NOT NULL").dropDuplicates(["photo_id"])
    p = p.select("user_id", "photo_id", at("stones:solitaire").alias("jewel"), at("form:floral").alias("closest"), at("band:plain").alias("place"), F.col("category").isNotNull().alias("about"))
    ok = p.where("jewel >= 0.5 AND (about OR (jewel >= 0.9 AND closest >= 0.75))").withColumn("score", F.round(F.col("jewel") + 2 * F.col("closest") + 0.05 * F.col("place"), 6))
    return ok.groupBy("user_id").agg(F.max_by("photo_id", F.struct("score", -F.col("photo_id"))).alias("photo_id"), F.max("score").alias("score"))


# --- joins


@query(
    "join_composite",
    """WITH n AS (SELECT design_id || '|' || folder AS k, count(*) AS n FROM (SELECT design_id, unnest(folders) AS folder FROM designs) GROUP BY 1)
       SELECT d.uid, d.key, coalesce(n.n, 0) AS n FROM designs d LEFT JOIN n ON n.k = d.key""",
)
def composite(spark, sf_dir):
    """JOIN-10: records by a key made of two fields."""
    d = read_table(spark, sf_dir, "designs")
    n = d.select("design_id", F.explode("folders").alias("folder")).select(F.concat_ws("|", "design_id", "folder").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return d.select("uid", "key").join(n, "key", "left").select("uid", "key", F.coalesce("n", F.lit(0)).alias("n"))


_NORM = "regexp_replace(lower({}), '[^0-9a-z]', '', 'g')"


@query(
    "join_card_near",
    f"""WITH card AS (SELECT uid AS card, {_NORM.format("design_id")} AS k, regexp_replace(folders[1], '/[^/]*$', '') AS lot, regexp_matches(design_id, '[A-Za-z]') AS coded FROM designs WHERE uid % 3 <> 1 AND folders[1] IS NOT NULL),
        d AS (SELECT uid, {_NORM.format("design_id")} AS k, folders, count(*) OVER (PARTITION BY {_NORM.format("design_id")}) AS n FROM designs),
        j AS (SELECT card, uid, coded, n, len(list_filter(folders, lambda f: f = lot OR starts_with(f, lot || '/'))) > 0 AS near FROM card JOIN d USING (k))
        SELECT card, uid, near FROM j WHERE near OR (coded AND n = 1)""",
)
def card_near(spark, sf_dir):
    """JOIN-11: by normalised id within the same batch folder, else a coded id that is unique."""
    d = read_table(spark, sf_dir, "designs").withColumn("k", F.regexp_replace(F.lower("design_id"), "[^0-9a-z]", ""))
    card = d.where((F.col("uid") % 3 != 1) & F.get("folders", F.lit(0)).isNotNull()).select(F.col("uid").alias("card"), "k", F.regexp_replace(F.get("folders", F.lit(0)), "/[^/]*$", "").alias("lot"), F.col("design_id").rlike("[A-Za-z]").alias("coded"))
    counted = d.select("uid", "k", "folders").join(d.groupBy("k").agg(F.count("*").alias("n")), "k")
    near = F.exists("folders", lambda f: (f == F.col("lot")) | f.startswith(F.concat("lot", F.lit("/"))))
    joined = card.join(counted, "k").select("card", "uid", "coded", "n", F.coalesce(near, F.lit(False)).alias("near"))
    return joined.where("near OR (coded AND n = 1)").select("card", "uid", "near")


@query(
    "join_own_file",
    """WITH f AS (SELECT uid, lower(design_id) AS want, unnest(variants) AS file FROM designs),
       r AS (SELECT uid, file, CASE WHEN lower(file) = want THEN 0 WHEN starts_with(lower(file), want) THEN 1 ELSE 2 END AS rank, count(*) OVER (PARTITION BY uid) AS n FROM f),
       b AS (SELECT uid, file, rank, n, row_number() OVER (PARTITION BY uid ORDER BY rank, length(file), file) AS r FROM r)
       SELECT d.uid, CASE WHEN b.rank < 2 OR b.n = 1 THEN b.file END AS file FROM designs d LEFT JOIN b ON b.uid = d.uid AND b.r = 1""",
)
def own_file(spark, sf_dir):
    """JOIN-12: the file of exactly the name, else the shortest that begins with it, else the only one."""
    d = read_table(spark, sf_dir, "designs").select("uid", F.lower("design_id").alias("want"), "variants")
    f = d.select("uid", "want", F.explode("variants").alias("file"))
    rank = F.when(F.lower("file") == F.col("want"), 0).when(F.lower("file").startswith(F.col("want")), 1).otherwise(2)
    best = f.groupBy("uid").agg(F.min(F.struct(rank.alias("rank"), F.length("file").alias("n"), "file")).alias("b"), F.count("*").alias("n"))
    return d.select("uid").join(best, "uid", "left").select("uid", F.when((F.col("b.rank") < 2) | (F.col("n") == 1), F.col("b.file")).alias("file"))


@query(
    "join_yearly_occasion",
    """WITH o(occasion, day, start, lead, yearly) AS (VALUES ('fair', DATE '2018-01-20', NULL::DATE, 10, true), ('season', DATE '2018-12-31', DATE '2018-12-20', 5, true), ('once', DATE '2019-01-10', NULL::DATE, 3, false)),
       y AS (SELECT occasion, day + to_years(CAST(k AS INTEGER)) AS day, coalesce(start, day) + to_years(CAST(k AS INTEGER)) - to_days(CAST(lead AS INTEGER)) AS first FROM o, generate_series(0, 2) t(k) WHERE yearly OR k = 0)
       SELECT occasion, count(*) AS n FROM (SELECT DISTINCT id, created_at FROM search_history WHERE created_at IS NOT NULL) s JOIN y ON CAST(created_at AT TIME ZONE 'UTC' AS DATE) BETWEEN first AND day GROUP BY occasion""",
)
def yearly_occasion(spark, sf_dir):
    """JOIN-20, DT-05: days within an occasion's window, which opens some days before its day or its season, every year."""
    o = spark.createDataFrame([("fair", "2018-01-20", None, 10, True), ("season", "2018-12-31", "2018-12-20", 5, True), ("once", "2019-01-10", None, 3, False)], "occasion string, d string, s string, lead int, yearly boolean")
    years = F.explode(F.sequence(F.lit(0), F.when(F.col("yearly"), 2).otherwise(0)))
    shifted = o.withColumn("k", years).withColumn("day", F.add_months(F.col("d").cast("date"), 12 * F.col("k"))).withColumn("first", F.date_sub(F.add_months(F.coalesce("s", "d").cast("date"), 12 * F.col("k")), F.col("lead")))
    s = read_table(spark, sf_dir, "search_history").where("created_at IS NOT NULL").select("id", "created_at").distinct()
    return R.interval_join(s, "created_at", shifted.select("occasion", "first", "day"), "first", "day", 10).groupBy("occasion").agg(F.count("*").alias("n"))


# --- sums over records


@query(
    "agg_stone_totals",
    f"""WITH {_B}, o AS (SELECT id, CASE WHEN {_OBJECT.format("ours")} AND json_extract_string(ours, '$.stones') LIKE '[%' THEN from_json(json_extract_string(ours, '$.stones'), '["JSON"]') END AS s,
                CASE WHEN {_OBJECT.format("ours")} THEN json_extract_string(ours, '$.gold_g') END AS g FROM b),
        c AS (SELECT id, list_filter(s, lambda x: json_type(x) = 'OBJECT') AS s, g FROM o)
        SELECT id, CASE WHEN len(s) > 0 THEN 'stones' WHEN g LIKE '{{%' THEN 'plain' END AS source,
               CASE WHEN len(s) > 0 THEN CAST(coalesce(list_sum(list_transform(s, lambda x: CAST(x->>'count' AS BIGINT))), 0) AS BIGINT) WHEN g LIKE '{{%' THEN 0 END AS stones,
               CASE WHEN len(s) > 0 THEN CAST(round(coalesce(list_sum(list_transform(s, lambda x: coalesce(CAST(x->>'carat' AS DECIMAL(14,3)), 0))), 0), 2) AS DOUBLE) WHEN g LIKE '{{%' THEN 0 END AS carat FROM c""",
)
def stone_totals(spark, sf_dir):
    """AGG-26: stones and carats of a piece and where they are from: its list of stones, else none on a piece whose weight is known, else unknown."""
    ok, listed = readable("ours"), F.get_json_object("ours", "$.stones")
    b = brands(spark, sf_dir).select("id", F.when(ok & listed.startswith("["), F.from_json(listed, "array<struct<shape:string,count:string,carat:string>>")).alias("s"), F.when(ok, F.get_json_object("ours", "$.gold_g")).startswith("{").alias("g"))
    s = F.filter("s", lambda x: x.isNotNull())
    has, plain = F.size(s) > 0, F.coalesce("g", F.lit(False))
    total = lambda field, zero, kind: F.aggregate(s, zero.cast(kind), lambda a, x: (a + F.coalesce(x[field].try_cast(kind), F.lit(0))).cast(kind))
    return b.select(
        "id", F.when(has, "stones").when(plain, "plain").alias("source"),
        F.when(has, total("count", F.lit(0), "long")).when(plain, F.lit(0).cast("long")).alias("stones"), F.when(has, F.round(total("carat", F.lit(0), "decimal(14,3)"), 2).cast("double")).when(plain, F.lit(0.0)).alias("carat"),
    )


@query(
    "agg_stone_groups",
    f"""WITH {_B}, o AS (SELECT id, unnest(from_json(json_extract_string(ours, '$.stones'), '["JSON"]')) AS x FROM b WHERE {_OBJECT.format("ours")} AND json_extract_string(ours, '$.stones') LIKE '[%'),
        g AS (SELECT id, x->>'shape' AS shape, CAST(round(CAST(x->>'carat' AS DECIMAL(14,3)), 1) AS DOUBLE) AS size, count(*) AS n, CAST(sum(CAST(x->>'carat' AS DECIMAL(14,3))) AS DOUBLE) AS total FROM o WHERE json_type(x) = 'OBJECT' GROUP BY 1, 2, 3)
        SELECT id, shape, size, n, round(total, 6) AS total, CAST(row_number() OVER (PARTITION BY id ORDER BY round(total / n, 9) DESC NULLS LAST, shape NULLS LAST, size NULLS LAST) AS INTEGER) AS pos FROM g""",
)
def stone_groups(spark, sf_dir):
    """AGG-25: stones of a piece by shape and rounded size, with count and sum, in order of mean size."""
    listed = F.get_json_object("ours", "$.stones")
    s = brands(spark, sf_dir).where(readable("ours")).where(listed.startswith("[")).select("id", F.explode(F.from_json(listed, "array<struct<shape:string,carat:decimal(14,3)>>")).alias("x")).where("x IS NOT NULL")
    g = s.groupBy("id", F.col("x.shape").alias("shape"), F.round("x.carat", 1).cast("double").alias("size")).agg(F.count("*").alias("n"), F.sum("x.carat").cast("double").alias("total"))
    w = Window.partitionBy("id").orderBy(F.round(F.col("total") / F.col("n"), 9).desc_nulls_last(), F.col("shape").asc_nulls_last(), F.col("size").asc_nulls_last())
    return g.select("id", "shape", "size", "n", F.round("total", 6).alias("total"), F.row_number().over(w).alias("pos"))


@query(
    "agg_paid_due",
    f"""WITH {_B}, o AS (SELECT id, CAST(json_extract_string(ours, '$.prices.18k.total') AS DECIMAL(14,2)) AS total, json_extract_string(ours, '$.prices.18k.lines') AS l FROM b WHERE {_OBJECT.format("ours")} AND json_type(ours, '$.prices.18k') = 'OBJECT'),
        p AS (SELECT id, total, CASE WHEN l LIKE '[%' THEN coalesce(list_sum(list_transform(from_json(l, '["JSON"]'), lambda x: coalesce(CAST(x->>'amount' AS DECIMAL(14,2)), 0))), 0) WHEN l LIKE '{{%' THEN coalesce(CAST(l->>'amount' AS DECIMAL(14,2)), 0) ELSE 0 END AS paid FROM o)
        SELECT id, CAST(total AS DOUBLE) AS total, CAST(paid AS DOUBLE) AS paid, CAST(total - paid AS DOUBLE) AS due FROM p""",
)
def paid_due(spark, sf_dir):
    """AGG-28: a sum over lines, in decimals, and what is left of the total."""
    price = F.get_json_object("ours", "$.prices.18k")
    b = brands(spark, sf_dir).where(readable("ours")).where(price.startswith("{")).select("id", F.get_json_object(price, "$.total").try_cast("decimal(14,2)").alias("total"), F.get_json_object(price, "$.lines").alias("l"))
    lines = F.from_json(F.when(F.col("l").startswith("["), F.col("l")).when(F.col("l").startswith("{"), F.concat(F.lit("["), "l", F.lit("]"))), "array<struct<amount:string>>")
    zero = F.lit(0).cast("decimal(14,2)")
    paid = F.coalesce(F.aggregate(lines, zero, lambda a, x: (a + F.coalesce(x["amount"].try_cast("decimal(14,2)"), zero)).cast("decimal(14,2)")), zero)
    return b.select("id", F.col("total").cast("double").alias("total"), paid.cast("double").alias("paid"), (F.col("total") - paid).cast("double").alias("due"))


# --- evaluation tables


@query(
    "agg_fit_diversity",
    f"""WITH {_S}, r AS (SELECT id, understood.category AS asked, unnest(result_uids) AS uid FROM s), n AS (SELECT uid, count(*) AS n FROM r GROUP BY uid)
        SELECT (SELECT count(*) FROM r) AS slots, count(*) AS distinct_designs, max(n) AS worst_repeat, count(*) FILTER (n >= 5) AS often,
        (SELECT round(avg(CASE WHEN asked IS NULL OR asked = category THEN 1.0 ELSE 0.0 END), 6) FROM r JOIN designs d ON d.uid = r.uid) AS category_fit,
        (SELECT round(avg(coalesce(stone_frac, 0)), 6) FROM r JOIN designs d ON d.uid = r.uid) AS mean_stones FROM n""",
)
def fit_diversity(spark, sf_dir):
    """AGG-30: how varied and how fitting all results shown are."""
    r = searches(spark, sf_dir).select("id", F.col("understood.category").alias("asked"), F.explode(F.col("result_uids").cast("array<long>")).alias("uid"))
    n = r.groupBy("uid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("slots"), F.count("*").alias("distinct_designs"), F.max("n").alias("worst_repeat"), F.count_if(F.col("n") >= 5).alias("often"))
    fits = F.col("asked").isNull() | (F.col("asked") == F.col("category"))
    j = r.join(read_table(spark, sf_dir, "designs").select("uid", "category", "stone_frac"), "uid")
    f = j.agg(F.round(F.avg(F.coalesce(fits, F.lit(False)).cast("double")), 6).alias("category_fit"), F.round(F.avg(F.coalesce("stone_frac", F.lit(0.0))), 6).alias("mean_stones"))
    return n.crossJoin(F.broadcast(f))  # one row each


@query(
    "agg_found_at",
    f"""WITH {_S}, k AS (SELECT DISTINCT user_id, design_uid FROM favorites), e AS (SELECT id, understood.category AS category, unnest(result_uids) AS uid, generate_subscripts(result_uids, 1) AS pos, user_id FROM s),
        f AS (SELECT e.id, any_value(category) AS category, min(pos) FILTER (k.design_uid IS NOT NULL) AS first FROM e LEFT JOIN k ON k.user_id = e.user_id AND k.design_uid = e.uid GROUP BY e.id)
        SELECT category, GROUPING(category) = 1 AS total, count(*) AS n, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS found_1, round(avg(CASE WHEN first <= 8 THEN 1.0 ELSE 0.0 END), 6) AS found_8,
               round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END) FILTER (first IS NOT NULL), 6) AS when_found FROM f GROUP BY GROUPING SETS ((), (category))""",
)
def found_at(spark, sf_dir):
    """AGG-31: found first and on the first page, per type and in all; how often first where found."""
    k = read_table(spark, sf_dir, "favorites").select("user_id", F.col("design_uid").cast("long").alias("uid")).distinct().withColumn("kept", F.lit(True))
    e = searches(spark, sf_dir).select("id", "user_id", F.col("understood.category").alias("category"), F.posexplode(F.col("result_uids").cast("array<long>")).alias("pos", "uid"))
    f = e.join(k, ["user_id", "uid"], "left").groupBy("id").agg(F.first("category").alias("category"), F.min(F.when(F.col("kept"), F.col("pos") + 1)).alias("first"))
    one, page = (F.col("first") == 1), (F.col("first") <= 8)
    out = f.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(t, F.lit(False)).cast("double")), 6).alias(c) for c, t in (("found_1", one), ("found_8", page))], F.round(F.avg(one.cast("double")), 6).alias("when_found"))
    return out.select("category", (F.col("g") == 1).alias("total"), "n", "found_1", "found_8", "when_found")


@query(
    "agg_hit_rates",
    f"""WITH {_S}, m AS (SELECT user_id, id, coalesce(understood.category, '') || '/' || coalesce(understood.metal, '') AS meaning, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM s WHERE user_id IS NOT NULL),
        top AS (SELECT meaning FROM m GROUP BY meaning ORDER BY count(*) DESC, meaning LIMIT 5), last AS (SELECT user_id, meaning FROM m WHERE r = 1),
        u AS (SELECT l.user_id, EXISTS (SELECT 1 FROM m WHERE m.user_id = l.user_id AND r > 1 AND m.meaning = l.meaning) AS repeat, EXISTS (SELECT 1 FROM m WHERE m.user_id = l.user_id AND r BETWEEN 2 AND 6 AND m.meaning = l.meaning) AS own, l.meaning IN (SELECT meaning FROM top) AS popular FROM last l)
        SELECT CASE WHEN repeat THEN 'repeat' ELSE 'new' END AS kind, count(*) AS n, round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END), 6) AS own_last_5, round(avg(CASE WHEN popular THEN 1.0 ELSE 0.0 END), 6) AS popular_only FROM u GROUP BY 1""",
)
def hit_rates(spark, sf_dir):
    """AGG-33: hits of two ways to suggest a user's last search, for repeated and new ones."""
    meaning = F.concat_ws("/", F.coalesce("understood.category", F.lit("")), F.coalesce("understood.metal", F.lit("")))
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    m = searches(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", meaning.alias("meaning"), F.row_number().over(order).alias("r"))
    top = m.groupBy("meaning").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "meaning").limit(5).select("meaning", F.lit(True).alias("popular"))
    last = m.where("r = 1").select("user_id", "meaning")
    seen = m.where("r > 1").groupBy("user_id", "meaning").agg(F.min("r").alias("r"))
    u = last.join(seen, ["user_id", "meaning"], "left").join(F.broadcast(top), "meaning", "left")  # five rows
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return u.groupBy(F.when(F.col("r").isNotNull(), "repeat").otherwise("new").alias("kind")).agg(F.count("*").alias("n"), share(F.col("r") <= 6).alias("own_last_5"), share(F.col("popular")).alias("popular_only"))


# --- order, sets, text


@query(
    "srt_page_order",
    """WITH w AS (SELECT DISTINCT ON (id) id, pictures FROM web_designs WHERE json_valid(pictures) AND json_type(pictures) = 'ARRAY'), p AS (SELECT id, unnest(from_json(pictures, '["JSON"]')) AS x, generate_subscripts(from_json(pictures, '["JSON"]'), 1) AS pos FROM w),
       r AS (SELECT id, pos, CASE WHEN CAST(x->>'width' AS BIGINT) >= 1200 THEN 1.0 ELSE 0.0 END + CASE WHEN x->>'content_type' = 'image/webp' THEN 2.0 ELSE 0.0 END AS rank FROM p WHERE json_type(x) = 'OBJECT')
       SELECT id, pos - 1 AS pos, rank, CAST(row_number() OVER (PARTITION BY id ORDER BY rank DESC, pos) AS INTEGER) AS place FROM r""",
)
def page_order(spark, sf_dir):
    """SRT-10: pictures by rank; within a rank they stay in page order."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "pictures").dropDuplicates(["id"]).where(F.try_parse_json("pictures").isNotNull() & F.ltrim("pictures").startswith("["))
    p = w.select("id", F.posexplode(F.from_json("pictures", "array<struct<width:string,content_type:string>>")).alias("pos", "x")).where("x IS NOT NULL")
    rank = F.when(F.col("x.width").try_cast("long") >= 1200, 1.0).otherwise(0.0) + F.when(F.col("x.content_type") == "image/webp", 2.0).otherwise(0.0)
    r = p.select("id", F.col("pos").cast("long").alias("pos"), rank.alias("rank"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("rank").desc(), "pos")))


@query("srt_page_more", "SELECT uid, (SELECT count(*) FROM designs) > 60 AS has_more FROM designs ORDER BY lower(design_id), uid LIMIT 20 OFFSET 40")
def page_more(spark, sf_dir):
    """SRT-06: a page and whether another follows: one row more is read than shown."""
    ahead = read_table(spark, sf_dir, "designs").orderBy(F.lower("design_id"), "uid").offset(40).limit(21).select("uid", F.lower("design_id").alias("k"))  # at most 21 rows
    w = Window.orderBy("k", "uid")
    return ahead.select("uid", F.row_number().over(w).alias("r"), (F.count("*").over(Window.partitionBy()) > 20).alias("has_more")).where("r <= 20").select("uid", "has_more")


@query(
    "set_picture_dedupe",
    """WITH w AS (SELECT DISTINCT ON (id) id, pictures FROM web_designs WHERE json_valid(pictures) AND json_type(pictures) = 'ARRAY'), p AS (SELECT id, unnest(from_json(pictures, '["JSON"]')) AS x, generate_subscripts(from_json(pictures, '["JSON"]'), 1) - 1 AS pos FROM w),
       a AS (SELECT id, pos, coalesce(x->>'sha256', x->>'file') AS photo, CAST(x->>'width' AS BIGINT) * CAST(x->>'height' AS BIGINT) AS area, x->>'file' AS file FROM p WHERE json_type(x) = 'OBJECT')
       SELECT id, photo, min(pos) AS pos, max(coalesce(area, -1)) AS area, arg_max(file, (coalesce(area, -1), -pos)) AS file FROM a WHERE photo IS NOT NULL GROUP BY id, photo""",
)
def picture_dedupe(spark, sf_dir):
    """SET-09: the same photo at two sizes counts once, at its first place, as the larger one."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "pictures").dropDuplicates(["id"]).where(F.try_parse_json("pictures").isNotNull() & F.ltrim("pictures").startswith("["))
    p = w.select("id", F.posexplode(F.from_json("pictures", "array<struct<file:string,sha256:string,width:string,height:string>>")).alias("pos", "x")).where("x IS NOT NULL")
    a = p.select("id", F.col("pos").cast("long").alias("pos"), F.coalesce("x.sha256", "x.file").alias("photo"), F.coalesce(F.col("x.width").try_cast("long") * F.col("x.height").try_cast("long"), F.lit(-1)).alias("area"), "x.file").where("photo IS NOT NULL")
    return a.groupBy("id", "photo").agg(F.min("pos").alias("pos"), F.max("area").alias("area"), F.max_by("file", F.struct("area", -F.col("pos"))).alias("file"))


@query(
    "set_ordered_distinct",
    f"WITH {_S}, e AS (SELECT id, unnest(result_uids) AS u, generate_subscripts(result_uids, 1) AS p FROM s), f AS (SELECT id, u, min(p) AS p FROM e GROUP BY id, u) SELECT id, string_agg(CAST(u AS VARCHAR), ',' ORDER BY p) AS uids FROM f WHERE u IS NOT NULL GROUP BY id",
)
def ordered_distinct(spark, sf_dir):
    """SET-07: distinct values, each at its first place."""
    s = searches(spark, sf_dir).select("id", F.array_compact(F.array_distinct("result_uids")).alias("u")).where("size(u) > 0")
    return s.select("id", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("uids"))


@query(
    "win_short_hash",
    """SELECT uid, family || CASE WHEN count(*) OVER (PARTITION BY category, family) > 1 THEN '-' || left(sha1(design_id), 6) ELSE '' END AS name FROM designs""",
)
def short_hash(spark, sf_dir):
    """WIN-20: a short hash only where the name repeats within its type."""
    d = read_table(spark, sf_dir, "designs").select("uid", "category", "family", "design_id")
    n = d.groupBy("category", "family").agg(F.count("*").alias("n")).withColumnRenamed("category", "c").withColumnRenamed("family", "f")
    j = d.join(n, F.col("category").eqNullSafe(F.col("c")) & F.col("family").eqNullSafe(F.col("f")))
    return j.select("uid", F.when(F.col("n") > 1, F.concat("family", F.lit("-"), F.left(F.sha1("design_id"), F.lit(6)))).otherwise(F.col("family")).alias("name"))


@query(
    "js_priced_offer",
    f"""WITH {_B}, v AS (SELECT id, unnest(from_json(json_extract_string(original, '$.variants'), '["JSON"]')) AS v, generate_subscripts(from_json(json_extract_string(original, '$.variants'), '["JSON"]'), 1) AS vp FROM b WHERE {_OBJECT.format("original")} AND json_extract_string(original, '$.variants') LIKE '[%'),
        o AS (SELECT id, vp, unnest(CASE WHEN v->>'offers' LIKE '[%' THEN from_json(v->>'offers', '["JSON"]') WHEN v->>'offers' LIKE '{{%' THEN from_json('[' || (v->>'offers') || ']', '["JSON"]') ELSE [] END) AS o FROM v),
        p AS (SELECT id, vp, TRY_CAST(o->>'price' AS DOUBLE) AS price, o->>'seller' AS seller FROM o)
        SELECT id, arg_min(price, vp) AS price FROM (SELECT id, vp, first(price) AS price FROM (SELECT * FROM p WHERE price > 0) GROUP BY id, vp HAVING count(*) = 1) GROUP BY id""",
)
def priced_offer(spark, sf_dir):
    """JS-03: of the variants with a single priced offer, the first one's price; a lone offer reads as a list of one."""
    v = F.get_json_object("original", "$.variants")
    b = brands(spark, sf_dir).where(readable("original")).select("id", v.alias("v")).where("v LIKE '[%'")
    each = b.select("id", F.posexplode(F.from_json("v", "array<struct<offers:string>>")).alias("vp", "x")).select("id", "vp", F.col("x.offers").alias("o"))
    listed = F.from_json(F.when(F.col("o").startswith("["), F.col("o")).when(F.col("o").startswith("{"), F.concat(F.lit("["), "o", F.lit("]"))), "array<struct<price:string>>")
    p = each.select("id", "vp", F.filter(F.transform(listed, lambda x: x["price"].try_cast("double")), lambda x: x > 0).alias("l")).where("size(l) = 1")
    return p.groupBy("id").agg(F.min_by(F.col("l")[0], "vp").alias("price"))


@query(
    "ql_facts",
    f"""WITH {_S}, f AS (SELECT id, lower(query) AS q, understood AS u FROM s)
        SELECT id, coalesce(CASE WHEN regexp_matches(q, '\\bearrings?|\\bstuds?\\b') THEN 'earrings' WHEN regexp_matches(q, '\\bnecklaces?\\b') THEN 'necklace' WHEN regexp_matches(q, '\\brings?\\b') THEN 'ring' END, u.category) AS kind,
        coalesce(CASE WHEN contains(q, 'rose gold') THEN 'rose gold' WHEN contains(q, 'white gold') THEN 'white gold' WHEN contains(q, 'yellow gold') THEN 'yellow gold' END, replace(u.metal, '_', ' ')) AS metal,
        CASE WHEN regexp_matches(q, '\\brubys?\\b') THEN 'ruby' WHEN regexp_matches(q, '\\bpearls?\\b') THEN 'pearl' WHEN regexp_matches(q, '\\bdiamonds?\\b') THEN 'diamond' END AS stone FROM f""",
)
def facts(spark, sf_dir):
    """QL-15: facts read, where the user's own words win."""
    q = F.lower("query")

    def first(rules):
        out = F.lit(None).cast("string")
        for pattern, value in reversed(rules):
            out = F.when(q.rlike(pattern), value).otherwise(out)
        return out

    kind = first([(r"\bearrings?|\bstuds?\b", "earrings"), (r"\bnecklaces?\b", "necklace"), (r"\brings?\b", "ring")])
    metal = first([(m, m) for m in ("rose gold", "white gold", "yellow gold")])
    stone = first([(rf"\b{s}s?\b", s) for s in ("ruby", "pearl", "diamond")])
    return searches(spark, sf_dir).select("id", F.coalesce(kind, "understood.category").alias("kind"), F.coalesce(metal, F.replace("understood.metal", F.lit("_"), F.lit(" "))).alias("metal"), stone.alias("stone"))


@query(
    "ql_option_table",
    """WITH o(grp, value, kind) AS (VALUES ('type', 'ring', 'filter'), ('type', 'earrings', 'filter'), ('type', 'pendant', 'filter'), ('metal', 'rose_gold', 'filter'), ('metal', 'white_gold', 'filter'), ('metal', 'yellow_gold', 'filter'), ('stones', 'solitaire', 'ai'), ('stones', 'plain', 'ai'), ('weight', 'light', 'ai'), ('cut', 'oval', 'cut'))
       SELECT grp, value, kind, count(uid) AS n FROM o LEFT JOIN designs d ON (grp = 'type' AND d.category = value) OR (grp = 'metal' AND list_contains(d.metals, value)) OR (kind = 'ai' AND d.attrs[grp][value] >= 0.5) OR (kind = 'cut' AND d.design_id LIKE '%-OV') GROUP BY 1, 2, 3""",
)
def option_table(spark, sf_dir):
    """QL-07: options by group, each tagged with how it works, and how many designs it leaves; the table is a parameter."""
    options = [("type", v, "filter") for v in ("ring", "earrings", "pendant")] + [("metal", m, "filter") for m in ("rose_gold", "white_gold", "yellow_gold")] + [("stones", s, "ai") for s in ("solitaire", "plain")] + [("weight", "light", "ai"), ("cut", "oval", "cut")]
    d = read_table(spark, sf_dir, "designs")
    tests = {"filter": lambda g, v: F.col("category") == v if g == "type" else F.array_contains("metals", v), "ai": lambda g, v: F.col("attrs")[g][v] >= 0.5, "cut": lambda g, v: F.col("design_id").endswith("-OV")}
    counts = d.agg(*[F.count_if(tests[k](g, v)).alias(f"{g}|{v}|{k}") for g, v, k in options])  # one pass for all options
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(v).alias("value"), F.lit(k).alias("kind"), F.col(f"{g}|{v}|{k}").alias("n")) for g, v, k in options])
    return counts.select(F.inline(rows))


@query(
    "ql_link_search",
    """WITH w AS (SELECT DISTINCT ON (id) id, title, pictures FROM web_designs),
       p AS (SELECT id, title, CASE WHEN json_valid(pictures) AND json_type(pictures) = 'ARRAY' THEN len(list_filter(from_json(pictures, '["JSON"]'), lambda x: CAST(x->>'width' AS BIGINT) >= 1200)) ELSE 0 END AS good FROM w)
       SELECT CASE WHEN good > 0 THEN 'picture' WHEN regexp_matches(title, '(?i)\\b(rings?|earrings?|pendants?|necklaces?|bracelets?)\\b') THEN 'words' ELSE 'none' END AS via, count(*) AS n FROM p GROUP BY 1""",
)
def link_search(spark, sf_dir):
    """QL-14: a link is searched by its best picture, else by its words, else not at all."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "title", "pictures").dropDuplicates(["id"])
    ok = F.try_parse_json("pictures").isNotNull() & F.ltrim("pictures").startswith("[")
    good = ok & F.exists(F.from_json(F.when(ok, F.col("pictures")), "array<struct<width:string>>"), lambda x: F.coalesce(x["width"].try_cast("long") >= 1200, F.lit(False)))
    via = F.when(good, "picture").when(F.col("title").rlike(r"(?i)\b(rings?|earrings?|pendants?|necklaces?|bracelets?)\b"), "words").otherwise("none")
    return w.groupBy(via.alias("via")).agg(F.count("*").alias("n"))


@query("ql_page_words")
def page_words(spark, sf_dir):
    """QL-13: a page's title and link as a prompt: its terms, each meaning once, in order."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "title", "url").dropDuplicates(["id"])
    return phrases.page_prompts(w.select("id", F.array(F.split("title", r"\s[|–—:-]\s")[0], F.array_join(T.url_words("url"), " ")).alias("texts")), "id", "texts")


@query("str_phrase_insertion")
def phrase_insertion(spark, sf_dir):
    """STR-S22: every search with a metal put before the piece it names, articles put right."""
    return searches(spark, sf_dir).select("id", phrases.insert_before("query", F.lit("rose gold")).alias("text"))


@query(
    "str_label_pairs",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, pos, trim(split_part(line, ':', 1)) AS label, trim(substr(line, strpos(line, ':') + 1)) AS value FROM l WHERE strpos(line, ':') > 0)
        SELECT doc_id, pos - 1 AS pos, label, value FROM c WHERE regexp_matches(label, '^(?i)(design no|metal|purity|gross wt|net wt|stones|size|setting|rate|making|total)$') AND length(value) BETWEEN 1 AND 80 AND NOT ends_with(value, '?')""",
)
def label_pairs(spark, sf_dir):
    """STR-S19: labels and their values in one line."""
    lines = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.instr("line", ":") > 0)
    label, value = F.trim(F.split("line", ":")[0]), F.trim(F.regexp_replace("line", "(?s)^[^:]*:", ""))
    c = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), label.alias("label"), value.alias("value"))
    return c.where(F.col("label").rlike("(?i)^(design no|metal|purity|gross wt|net wt|stones|size|setting|rate|making|total)$") & F.length("value").between(1, 80) & ~F.endswith("value", F.lit("?")))


@query("str_node_pairs")
def node_pairs(spark, sf_dir):
    """STR-S19: labels and values that follow each other as text nodes, over the words of the spec lists."""
    specs = brands(spark, sf_dir).where(readable("original")).select("id", F.from_json(F.get_json_object("original", "$.specs"), "array<struct<label:string,value:string>>").alias("s")).where("s IS NOT NULL")
    nodes = F.flatten(F.transform(F.filter("s", lambda x: x.isNotNull()), lambda x: F.array_compact(F.array(x["label"], x["value"]))))
    return phrases.pair_nodes(specs.select("id", nodes.alias("nodes")), "id", "nodes")


@query(
    "str_real_words",
    f"""WITH {_S}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '([a-z]{{4,}})', 1)) AS word FROM s), v(base) AS (VALUES ('earring'), ('necklace'), ('look'), ('show'), ('wear'), ('stone'), ('carry'), ('make'), ('light'), ('ring')),
        c AS (SELECT word, word AS base FROM w UNION SELECT word, left(word, length(word) - length(e)) || a FROM w, (VALUES ('ies', 'y'), ('es', ''), ('s', ''), ('ed', ''), ('ed', 'e'), ('ing', ''), ('ing', 'e'), ('ly', ''), ('er', ''), ('est', '')) t(e, a) WHERE ends_with(word, e) AND length(word) >= length(e) + 3)
        SELECT DISTINCT word FROM c JOIN v USING (base)""",
)
def real_words(spark, sf_dir):
    """STR-S03: words that are, or are plain inflections of, words of a dictionary."""
    endings = [("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("est", "")]
    w = searches(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("query"), F.lit(r"([a-z]{4,})"), 1)).alias("word")).distinct()
    stems = F.array_compact(F.array(F.col("word"), *[F.when(F.endswith("word", F.lit(e)) & (F.length("word") >= len(e) + 3), F.concat(F.expr(f"left(word, length(word) - {len(e)})"), F.lit(a))) for e, a in endings]))
    base = spark.createDataFrame([(x,) for x in ("earring", "necklace", "look", "show", "wear", "stone", "carry", "make", "light", "ring")], "base string")
    return w.select("word", F.explode(stems).alias("base")).join(F.broadcast(base), "base", "left_semi").select("word").distinct()  # ten rows


# --- measures, grids, meshes


@query(
    "ma_size_class",
    """WITH p AS (SELECT p_partkey, p_size / 8.0 AS mm, 2.2 * least(1.5, greatest(0.7, sqrt(p_retailprice / 100 / 12.0))) AS width FROM part)
       SELECT p_partkey, round(width, 6) AS width, CASE WHEN mm < 1.8 THEN 'tiny' WHEN mm >= 6 THEN 'large' WHEN mm <= width * 1.3 AND mm < 3.5 THEN 'small' ELSE 'medium' END AS class FROM p""",
)
def size_class(spark, sf_dir):
    """MA-11: how wide the metal is for its weight, and how large a stone looks on it."""
    width = 2.2 * F.least(F.lit(1.5), F.greatest(F.lit(0.7), F.sqrt(F.col("p_retailprice") / 100 / 12.0)))
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 8).alias("mm"), width.alias("width"))
    mm = F.col("mm")
    return p.select("p_partkey", F.round("width", 6).alias("width"), F.when(mm < 1.8, "tiny").when(mm >= 6, "large").when((mm <= F.col("width") * 1.3) & (mm < 3.5), "small").otherwise("medium").alias("class"))


@query("ma_closed_volume", "SELECT p_partkey AS mesh, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE round(CAST(p_size AS DOUBLE) * (p_size + 1) * (p_size + 2), 3) END AS volume FROM part")
def closed_volume(spark, sf_dir):
    """MA-12: the volume a mesh encloses, null where it is open (boxes with a face missing)."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh"), *[(F.col("p_size") + i).cast("double").alias(c) for i, c in enumerate("xyz")])
    return geometry.closed_volumes(geometry.boxes(p, "mesh", open_=F.col("mesh") % 7 == 0), "mesh").select("mesh", F.round("volume", 3).alias("volume"))


@query(
    "ma_shape_gap",
    """WITH s AS (SELECT p_partkey, p_brand, p_size AS a, p_size + p_partkey % 3 AS b, CAST(p_partkey % 5 AS DOUBLE) AS c FROM part),
       o AS (SELECT *, first_value(a) OVER w AS a0, first_value(b) OVER w AS b0, first_value(c) OVER w AS c0 FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
       SELECT p_partkey, round(greatest(abs(a - a0) / a0, abs(b - b0) / b0, abs(c - c0) / greatest(c0, 0.5)), 6) AS gap FROM o""",
)
def shape_gap(spark, sf_dir):
    """MA-12: relative difference of two shape signatures, here to the first of the brand."""
    s = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array(F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 3).cast("double"), (F.col("p_partkey") % 5).cast("double")).alias("s"))
    first = s.groupBy("p_brand").agg(F.min_by("s", "p_partkey").alias("s0"))
    return s.join(first, "p_brand").select("p_partkey", F.round(geometry.shape_gap("s", "s0"), 6).alias("gap"))


@query(
    "arr_silhouette",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, x > 0 AS on_ FROM e),
       f AS (SELECT a.vec_id, a.r, a.c, a.on_, b.on_ AS other FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.r = a.r AND b.c = 7 - a.c)
       SELECT vec_id, round(count(*) FILTER (on_ AND other) / greatest(count(*) FILTER (on_ OR other), 1), 4) AS sym, round(avg(CASE WHEN on_ THEN 1.0 ELSE 0.0 END), 4) AS ink,
       round(coalesce((max(r) FILTER (on_) - min(r) FILTER (on_) + 1) * (max(c) FILTER (on_) - min(c) FILTER (on_) + 1), 0) / 64.0, 4) AS fill FROM f GROUP BY vec_id""",
)
def silhouette(spark, sf_dir):
    """AR-10: how symmetrical a mask is, how much of it is ink, how much its box fills; vectors read as grids of eight by eight."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("m"))
    return e.select("vec_id", *geometry.mask_figures("m", 8, 8))


@query(
    "arr_pixel_share",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, CASE WHEN count(*) FILTER (x > 0) >= 30 THEN round(count(*) FILTER (x > 0.1) / count(*) FILTER (x > 0), 4) END AS share FROM e GROUP BY vec_id""",
)
def pixel_share(spark, sf_dir):
    """AR-11: the share of a piece's pixels that pass a test, null for a piece too small to tell."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n"), F.size(F.filter("embedding", lambda x: x > 0.1)).alias("k"))
    return e.select("vec_id", F.when(F.col("n") >= 30, F.round(F.col("k") / F.col("n"), 4)).alias("share"))


# --- sources


@query(
    "src_request",
    """SELECT id, site, status FROM (SELECT DISTINCT id, site, status, category, created_at FROM brand_designs) WHERE status = 'listed' AND category IN ('ring', 'pendant') AND created_at >= TIMESTAMPTZ '2019-01-02 00:00:00+00' AND (site ILIKE '%gold%' OR site ILIKE '%karat%') AND id NOT IN (1, 2) ORDER BY created_at DESC, id LIMIT 50""",
)
def table_request(spark, sf_dir):
    """SRC-09: a table by request parameters."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "site", "status", "category", "created_at").distinct()
    asked = {"select": "id,site,status", "status": "eq.listed", "category": "in.(ring,pendant)", "created_at": "gte.2019-01-02 00:00:00", "id": "not.in.(1,2)", "or": "(site.ilike.*gold*,site.ilike.*karat*)", "order": "created_at.desc,id", "limit": "50"}
    return request(b, asked)


# --- suggestions


@query(
    "ql_refinements",
    f"""WITH {_S}, q AS (SELECT DISTINCT understood.category AS category, understood.metal AS metal FROM s WHERE understood.category IS NOT NULL),
        o(facet, value) AS (VALUES ('metal', 'rose_gold'), ('metal', 'white_gold'), ('metal', 'yellow_gold'), ('stones', 'solitaire'), ('stones', 'plain')),
        c AS (SELECT q.category, q.metal, facet, value, count(*) FILTER ((q.metal IS NULL OR list_contains(d.metals, q.metal)) AND CASE WHEN facet = 'metal' THEN list_contains(d.metals, value) ELSE coalesce(d.attrs[facet][value] >= 0.5, false) END) AS n,
              count(*) FILTER (q.metal IS NULL OR list_contains(d.metals, q.metal)) AS before FROM q, o JOIN designs d ON true WHERE d.category = q.category GROUP BY ALL)
        SELECT category, metal, facet, value, n FROM c WHERE n >= 8 AND n <= 0.9 * before AND NOT (facet = 'metal' AND metal IS NOT NULL)""",
)
def refinements(spark, sf_dir):
    """QL-09, QL-10: what a search may add: it keeps the meaning, adds its own claim, still fills a page, and narrows."""
    q = searches(spark, sf_dir).select(F.col("understood.category").alias("category"), F.col("understood.metal").alias("metal")).where("category IS NOT NULL").distinct()
    options = [("metal", m) for m in ("rose_gold", "white_gold", "yellow_gold")] + [("stones", s) for s in ("solitaire", "plain")]
    d = read_table(spark, sf_dir, "designs").select(F.col("category").alias("c"), "metals", "attrs")
    kept = q.join(d, (F.col("category") == F.col("c")) & (F.col("metal").isNull() | F.array_contains("metals", F.col("metal"))))
    test = lambda f, v: F.array_contains("metals", v) if f == "metal" else F.coalesce(F.col("attrs")[f][v] >= 0.5, F.lit(False))
    counts = kept.groupBy("category", "metal").agg(F.count("*").alias("before"), *[F.count_if(test(f, v)).alias(f"{f}|{v}") for f, v in options])
    rows = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), F.col(f"{f}|{v}").alias("n")) for f, v in options])
    out = counts.select("category", "metal", "before", F.inline(rows))
    return out.where((F.col("n") >= 8) & (F.col("n") <= 0.9 * F.col("before")) & ~((F.col("facet") == "metal") & F.col("metal").isNotNull())).drop("before")


@query(
    "ql_completed",
    f"""WITH {_S}, v(term) AS (VALUES ('rose gold'), ('rose gold ring'), ('ring'), ('rings for men'), ('necklace'), ('pearl necklace'), ('plain band')),
        t AS (SELECT id, string_split(trim(lower(query)), ' ') AS w FROM s WHERE query IS NOT NULL AND trim(query) <> ''), c AS (SELECT id, v.term, n FROM t, (VALUES (1), (2), (3)) k(n), v WHERE len(w) >= n AND starts_with(v.term, array_to_string(w[-n:], ' ')) AND v.term <> array_to_string(w[-n:], ' '))
        SELECT id, term, CAST(max(n) AS INTEGER) AS tail FROM c GROUP BY id, term QUALIFY row_number() OVER (PARTITION BY id ORDER BY max(n) DESC, length(term), term) <= 3""",
)
def completed(spark, sf_dir):
    """QL-08: what continues the last one, two or three words of every search, the longest tail first."""
    terms = ("rose gold", "rose gold ring", "ring", "rings for men", "necklace", "pearl necklace", "plain band")
    t = searches(spark, sf_dir).where("query IS NOT NULL AND trim(query) <> ''").select("id", F.split(F.trim(F.lower("query")), " ").alias("w"))
    tails = F.array_compact(F.array(*[F.when(F.size("w") >= n, F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", -n, n), " ").alias("t"))) for n in (1, 2, 3)]))
    # every beginning of every term: a join on equal texts instead of one on prefixes
    starts = spark.createDataFrame([(x[:i], x) for x in terms for i in range(0, len(x))], "t string, term string")
    hit = t.select("id", F.inline(tails)).join(F.broadcast(starts), "t").groupBy("id", "term").agg(F.max("n").alias("tail"))  # as many as the terms have letters
    w = Window.partitionBy("id").orderBy(F.col("tail").desc(), F.length("term"), "term")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r <= 3").select("id", "term", "tail")


@query(
    "ql_verdict",
    f"""WITH {_S}, f AS (SELECT id, lower(coalesce(query, '')) AS q, understood.category AS c, coalesce(understood.refused.reason, '') AS r FROM s),
        v AS (SELECT id, CASE WHEN regexp_matches(q, '\\b(rings?|necklaces?|earrings?|pendants?|bracelets?|bangles?|gold|diamonds?)\\b') THEN 'words' WHEN q = '' THEN 'empty' WHEN c IS NOT NULL THEN 'judge' WHEN r <> '' THEN 'refused' ELSE 'picture' END AS via FROM f)
        SELECT id, via, via IN ('words', 'judge', 'picture') AS ok, CASE via WHEN 'empty' THEN 'Type what you look for.' WHEN 'refused' THEN 'This is not about jewellery.' END AS message FROM v""",
)
def verdict(spark, sf_dir):
    """FLT-26, QL-06: whether a text is a search at all, by the cheapest test that decides, and what is said if not."""
    s = searches(spark, sf_dir).select("id", F.lower(F.coalesce("query", F.lit(""))).alias("q"), F.col("understood.category").alias("c"), F.coalesce("understood.refused.reason", F.lit("")).alias("r"))
    via = F.when(F.col("q").rlike(r"(?<![a-z0-9_])(rings?|necklaces?|earrings?|pendants?|bracelets?|bangles?|gold|diamonds?)(?![a-z0-9_])"), "words").when(F.col("q") == "", "empty").when(F.col("c").isNotNull(), "judge").when(F.col("r") != "", "refused").otherwise("picture")
    v = s.select("id", via.alias("via"))
    return v.select("id", "via", F.col("via").isin("words", "judge", "picture").alias("ok"), F.when(F.col("via") == "empty", "Type what you look for.").when(F.col("via") == "refused", "This is not about jewellery.").alias("message"))
