"""Queries that combine scores, agreements, admissions and checks into rankings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemflow.functions import text as T
from gemflow.functions import vectors as V
from gemflow.operators import relational as R
from gemflow.operators import rerank, scoring
from gemflow.session import read_table

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


def solitaire():
    return F.col("attrs")["stones"]["solitaire"]


def plain():
    return F.col("attrs")["stones"]["plain"]


@query("flt_folder_words", r"SELECT uid FROM designs WHERE len(list_filter(folders, lambda f: regexp_matches(f, '(?i)\b(photos|lot)\b'))) > 0 OR regexp_matches(design_id, '^KR')")
def folder_words(spark, sf_dir):
    """FLT-05: a word in any folder, or the series of the id."""
    return designs(spark, sf_dir).where(F.exists("folders", lambda f: f.rlike(r"(?i)\b(photos|lot)\b")) | F.col("design_id").rlike("^KR")).select("uid")


@query("flt_type_colour", "SELECT photo_id FROM photo_query WHERE category IN ('ring', 'pendant') AND metal = 'rose_gold' AND NOT coalesce(attrs['solitaire'] > 0.9, false)")
def type_colour(spark, sf_dir):
    """FLT-20: type mask, strict colour, exclusion that lets the unknown pass."""
    p = read_table(spark, sf_dir, "photo_query")
    return p.where(F.col("category").isin("ring", "pendant") & (F.col("metal") == "rose_gold") & ~F.coalesce(F.try_element_at("attrs", F.lit("solitaire")) > 0.9, F.lit(False))).select("photo_id")


@query(
    "flt_feed_admission",
    """WITH b AS (SELECT DISTINCT id, original FROM brand_designs WHERE json_valid(original) AND json_type(original) = 'OBJECT' AND json_extract_string(original, '$.variants') LIKE '[%')
       SELECT id FROM b WHERE len(list_filter(from_json(json_extract_string(original, '$.variants'), '["JSON"]'), lambda v: v->>'available' = 'true')) > 0 AND json_extract_string(original, '$.title') <> ''""",
)
def feed_admission(spark, sf_dir):
    """FLT-21: products with a title and a variant in stock (pictures, types and handles: flt_feed)."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "original").distinct().where(F.try_parse_json("original").isNotNull() & F.ltrim("original").startswith("{"))
    v = F.get_json_object("original", "$.variants")
    b = b.withColumn("v", v).where(F.col("v").startswith("["))
    stock = F.exists(F.from_json("v", "array<struct<available:boolean>>"), lambda x: F.coalesce(x["available"], F.lit(False)))
    return b.where(stock & (F.get_json_object("original", "$.title") != "")).select("id")


@query(
    "flt_picture_choice",
    """WITH e AS (SELECT DISTINCT id, unnest(from_json(pictures, '["JSON"]')) AS p FROM brand_designs WHERE pictures IS NOT NULL),
       w AS (SELECT id, p->>'file' AS file, CAST(p->>'width' AS BIGINT) * CAST(p->>'height' AS BIGINT) AS area FROM e WHERE CAST(p->>'width' AS BIGINT) >= 800 AND NOT regexp_matches(p->>'file', '(?i)icon|logo'))
       SELECT id, max(area) AS area, count(*) AS n FROM w GROUP BY id""",
)
def picture_choice(spark, sf_dir):
    """FLT-24: large enough pictures that are no icons, the largest one's area."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "pictures").where("pictures IS NOT NULL").distinct()
    p = b.select("id", F.explode(F.from_json("pictures", "array<struct<file:string,width:long,height:long>>")).alias("p"))
    fine = p.where((F.col("p.width") >= 800) & ~F.col("p.file").rlike("(?i)icon|logo"))
    return fine.groupBy("id").agg(F.max(F.col("p.width") * F.col("p.height")).alias("area"), F.count("*").alias("n"))


@query(
    "flt_cascade",
    """SELECT DISTINCT id, CASE WHEN regexp_matches(lower(query), '\\b(ring|rings|necklace|earrings|pendant|bracelet)\\b') THEN 'words' WHEN understood.category IS NOT NULL THEN 'parsed' WHEN matches > 0 THEN 'matches' ELSE 'none' END AS via
       FROM (SELECT id, any_value(query) AS query, any_value(understood) AS understood, max(matches) AS matches FROM search_history GROUP BY id)""".replace("\\\\", "\\"),
)
def cascade(spark, sf_dir):
    """FLT-26, QL-06: the cheapest test that decides comes first."""
    s = read_table(spark, sf_dir, "search_history").groupBy("id").agg(F.first("query").alias("query"), F.first("understood").alias("understood"), F.max("matches").alias("matches"))
    via = F.when(F.lower("query").rlike(r"\b(ring|rings|necklace|earrings|pendant|bracelet)\b"), "words").when(F.col("understood.category").isNotNull(), "parsed").when(F.col("matches") > 0, "matches").otherwise("none")
    return s.select("id", via.alias("via"))


@query(
    "flt_conflicts",
    """WITH c(a, b) AS (VALUES ('plain', 'solitaire'), ('light', 'heavy')), o AS (SELECT uid, unnest(map_keys(attrs['stones'])) AS opt FROM designs WHERE attrs['stones'] IS NOT NULL)
       SELECT o.uid, o.opt FROM o WHERE NOT EXISTS (SELECT 1 FROM c JOIN o p ON p.uid = o.uid AND p.opt = c.a WHERE c.b = o.opt)""",
)
def conflicts(spark, sf_dir):
    """FLT-27: options without those that an option before them rules out."""
    o = designs(spark, sf_dir).where(F.col("attrs")["stones"].isNotNull()).select("uid", F.explode(F.map_keys(F.col("attrs")["stones"])).alias("opt"))
    pairs = spark.createDataFrame([("plain", "solitaire"), ("light", "heavy")], "a string, b string")
    out = o.join(pairs, F.col("opt") == F.col("a")).select("uid", F.col("b").alias("opt"))
    return o.join(out, ["uid", "opt"], "left_anti")


@query("flt_stock_check", "SELECT l_orderkey, l_linenumber, l_quantity <= p_size AS enough FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def stock_check(spark, sf_dir):
    """JOIN-24: every pick against what is there; unknown where there is no part."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", (F.col("l_quantity") <= F.col("p_size")).alias("enough"))


@query("prj_detail", "SELECT a.uid, string_agg(b.design_id, ',' ORDER BY b.uid) AS siblings FROM designs a JOIN designs b ON a.family = b.family AND a.uid <> b.uid GROUP BY a.uid")
def detail(spark, sf_dir):
    """PRJ-02: siblings in order, by one list per family instead of a self-join of rows."""
    d = designs(spark, sf_dir).select("uid", "design_id", "family")
    lists = d.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("uid", "design_id"))).alias("l"))
    joined = d.join(lists, "family").withColumn("o", F.expr("filter(l, x -> x.uid <> uid)")).where("size(o) > 0")
    return joined.select("uid", F.array_join(F.transform("o", lambda x: x["design_id"]), ",").alias("siblings"))


@query("prj_front", "SELECT uid, coalesce(nullif(front_view, ''), variants[len(variants)], 'none') AS front, {'c': category, 'n': len(metals)}.c AS c FROM designs")
def front(spark, sf_dir):
    """PRJ-05: the recorded view, else the last one."""
    last = F.when(F.size("variants") > 0, F.element_at("variants", -1))
    return designs(spark, sf_dir).select("uid", F.coalesce(F.nullif("front_view", F.lit("")), last, F.lit("none")).alias("front"), F.struct(F.col("category").alias("c"), F.size("metals").alias("n"))["c"].alias("c"))


@query(
    "agg_key_figures",
    """WITH b AS (SELECT DISTINCT id, original FROM brand_designs WHERE json_valid(original) AND json_type(original) = 'OBJECT' AND json_extract_string(original, '$.specs') LIKE '[%'),
       s AS (SELECT id, unnest(from_json(json_extract_string(original, '$.specs'), '["JSON"]')) AS s FROM b),
       t AS (SELECT id, s->>'label' AS label, s->>'value' AS v FROM s)
       SELECT id, min(v) FILTER (label = 'Purity') AS purity, CAST(coalesce(sum(TRY_CAST(v AS BIGINT)) FILTER (label LIKE '%No. of%'), 0) AS BIGINT) AS stones FROM t WHERE label IS NOT NULL GROUP BY id""",
)
def key_figures(spark, sf_dir):
    """AGG-27: first match and sums over labelled values."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "original").distinct().where(F.try_parse_json("original").isNotNull() & F.ltrim("original").startswith("{"))
    specs = b.select("id", F.get_json_object("original", "$.specs").alias("s")).where("s LIKE '[%'")
    each = specs.select("id", F.explode(F.from_json("s", "array<struct<label:string,value:string>>")).alias("x")).select("id", "x.label", "x.value").where("label IS NOT NULL")
    stones = F.when(F.col("label").contains("No. of"), F.col("value").try_cast("long"))
    return each.groupBy("id").agg(F.min(F.when(F.col("label") == "Purity", F.col("value"))).alias("purity"), F.coalesce(F.sum(stones), F.lit(0)).alias("stones"))


@query("agg_least_of_map", "SELECT uid, list_min(map_values(attrs['stones'])) AS least, list_sum(map_values(attrs['stones'])) AS total FROM designs WHERE attrs['stones'] IS NOT NULL AND cardinality(attrs['stones']) > 0")
def least_of_map(spark, sf_dir):
    """AGG-29: least and sum over the values of a map."""
    m = F.map_values(F.col("attrs")["stones"])
    d = designs(spark, sf_dir).where(F.col("attrs")["stones"].isNotNull() & (F.size(F.col("attrs")["stones"]) > 0))
    return d.select("uid", F.array_min(m).alias("least"), F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("agg_spend_since", "SELECT user_id, round(sum(value), 2) AS spent, count(*) AS n, round(greatest(0, 2000 - sum(value)), 2) AS room FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def spend_since(spark, sf_dir):
    """AGG-08, AGG-09: sums since a time and what is left of a limit."""
    e = read_table(spark, sf_dir, "events").where("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-15'")
    total = F.sum("value")
    return e.groupBy("user_id").agg(F.round(total, 2).alias("spent"), F.count("*").alias("n"), F.round(F.greatest(F.lit(0.0), 2000 - total), 2).alias("room"))


@query(
    "win_zscore_category",
    """SELECT uid, round((stone_frac - avg(stone_frac) OVER (PARTITION BY category)) / (stddev_pop(stone_frac) OVER (PARTITION BY category) + 1e-9), 6) AS z FROM designs WHERE stone_frac IS NOT NULL""",
)
def zscore_category(spark, sf_dir):
    """WIN-01, WIN-08: standardised within the type."""
    z = scoring.standardise(designs(spark, sf_dir).where("stone_frac IS NOT NULL").select("uid", "category", "stone_frac"), ["stone_frac"], by="category")
    return z.select("uid", F.round("z_stone_frac", 6).alias("z"))


@query(
    "win_mean_rank",
    """WITH d AS (SELECT uid, category, (rank() OVER (PARTITION BY category ORDER BY stone_frac DESC) - 1) / count(*) OVER (PARTITION BY category) AS r FROM designs WHERE stone_frac IS NOT NULL)
       SELECT user_id, round(avg(r) - 0.5, 6) AS lift FROM (SELECT DISTINCT user_id, design_uid FROM favorites) f JOIN d ON d.uid = f.design_uid GROUP BY user_id""",
)
def mean_rank(spark, sf_dir):
    """WIN-05: mean rank of what a user keeps, less a half."""
    w = Window.partitionBy("category")
    d = designs(spark, sf_dir).where("stone_frac IS NOT NULL").select("uid", ((F.rank().over(w.orderBy(F.col("stone_frac").desc())) - 1) / F.count("*").over(w)).alias("r"))
    f = read_table(spark, sf_dir, "favorites").select("user_id", F.col("design_uid").cast("long").alias("uid")).distinct()
    return f.join(d, "uid").groupBy("user_id").agg(F.round(F.avg("r") - 0.5, 6).alias("lift"))


@query(
    "win_one_per_family",
    "SELECT family, uid FROM (SELECT family, uid, row_number() OVER (PARTITION BY family ORDER BY stone_frac DESC NULLS LAST, uid) AS r FROM designs) WHERE r = 1",
)
def one_per_family(spark, sf_dir):
    """WIN-02."""
    return R.latest_per_key(designs(spark, sf_dir).select("family", "uid", "stone_frac"), ["family"], [F.col("stone_frac").desc_nulls_last(), F.col("uid")]).select("family", "uid")


@query(
    "srt_newest_per_user",
    """SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r
       FROM (SELECT id, any_value(user_id) AS user_id, any_value(created_at) AS created_at FROM search_history GROUP BY id)) WHERE r <= 5""",
)
def newest_per_user(spark, sf_dir):
    """SRT-07, SRT-09: the newest five per user."""
    s = read_table(spark, sf_dir, "search_history").select("id", "user_id", "created_at").dropDuplicates(["id"])
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return s.withColumn("r", F.row_number().over(w)).where("r <= 5").select("user_id", "id")


@query(
    "vec_intent_score",
    """WITH w(attr, weight) AS (VALUES ('solitaire', 1.5), ('plain', -1.0)), e AS (SELECT uid, unnest(map_entries(attrs['stones'])) AS e FROM designs WHERE attrs['stones'] IS NOT NULL)
       SELECT uid, round(sum(CAST(weight AS DOUBLE) * e.value), 6) AS score FROM e JOIN w ON w.attr = e.key GROUP BY uid""",
)
def intent_score(spark, sf_dir):
    """VEC-04: weighted attributes of what is wanted and not."""
    w = spark.createDataFrame([("solitaire", 1.5), ("plain", -1.0)], "attr string, weight double")
    e = designs(spark, sf_dir).where(F.col("attrs")["stones"].isNotNull()).select("uid", F.explode(F.col("attrs")["stones"]).alias("attr", "p"))
    return e.join(w, "attr").groupBy("uid").agg(F.round(F.sum(F.col("weight") * F.col("p")), 6).alias("score"))


@query(
    "vec_trait_blend",
    """WITH d AS (SELECT uid, coalesce(attrs['stones']['plain'], 0) AS a, coalesce(attrs['stones']['solitaire'], 0) AS b, coalesce(stone_frac, 0.5) AS s FROM designs),
       m AS (SELECT uid, 0.5 * a + 0.5 * (1 - s) AS x, 0.5 * b + 0.5 * s AS y FROM d) SELECT uid, CASE WHEN x >= y THEN 'plain' ELSE 'solitaire' END AS trait, round(greatest(x, y) / (x + y), 6) AS p FROM m WHERE x + y > 0""",
)
def trait_blend(spark, sf_dir):
    """VEC-13, VEC-29: two readings blended, brought to sum one, the larger shown."""
    s = F.coalesce("stone_frac", F.lit(0.5))
    d = designs(spark, sf_dir).select("uid", (0.5 * F.coalesce(plain(), F.lit(0.0)) + 0.5 * (1 - s)).alias("x"), (0.5 * F.coalesce(solitaire(), F.lit(0.0)) + 0.5 * s).alias("y")).where("x + y > 0")
    return d.select("uid", F.when(F.col("x") >= F.col("y"), "plain").otherwise("solitaire").alias("trait"), F.round(F.greatest("x", "y") / (F.col("x") + F.col("y")), 6).alias("p"))


@query(
    "vec_agreement",
    """WITH m AS (SELECT quantile_cont(attrs['stones']['solitaire'], 0.5) AS med FROM designs), d AS (SELECT uid, coalesce(attrs['stones']['solitaire'], med) AS p, stone_frac AS q FROM designs, m)
       SELECT uid, round(1 - abs(p - coalesce(q, 0.5)), 6) AS agreement, CASE WHEN (p >= 0.8 AND q >= 0.8) OR (p <= 0.2 AND q <= 0.2) THEN 1 WHEN (p >= 0.8 OR p <= 0.2) AND (q >= 0.8 OR q <= 0.2) THEN 0 END AS clear FROM d""",
)
def agreement(spark, sf_dir):
    """VEC-17, VEC-18: agreement of two readings, the median for the unseen, clear answers apart."""
    d = designs(spark, sf_dir)
    m = d.agg(F.percentile(solitaire(), 0.5).alias("med"))
    d = d.crossJoin(F.broadcast(m)).select("uid", F.coalesce(solitaire(), F.col("med")).alias("p"), F.col("stone_frac").alias("q"))  # one row
    high, low = (F.col("p") >= 0.8) & (F.col("q") >= 0.8), (F.col("p") <= 0.2) & (F.col("q") <= 0.2)
    both = ((F.col("p") >= 0.8) | (F.col("p") <= 0.2)) & ((F.col("q") >= 0.8) | (F.col("q") <= 0.2))
    return d.select("uid", F.round(1 - F.abs(F.col("p") - F.coalesce("q", F.lit(0.5))), 6).alias("agreement"), F.when(high | low, 1).when(both, 0).alias("clear"))


@query(
    "vec_colour_probability",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT v AS a FROM e WHERE vec_id = 0), k1 AS (SELECT v AS b FROM e WHERE vec_id = 1), k2 AS (SELECT v AS c FROM e WHERE vec_id = 2),
       s AS (SELECT vec_id, exp(20 * list_cosine_similarity(v, a)) AS x, exp(20 * list_cosine_similarity(v, b)) AS y, exp(20 * list_cosine_similarity(v, c)) AS z FROM e, k, k1, k2)
       SELECT vec_id, round(x / (x + y + z), 6) AS p, CASE WHEN greatest(x, y, z) / (x + y + z) >= 0.7 THEN CASE WHEN x >= greatest(y, z) THEN 'yellow' WHEN y >= z THEN 'white' ELSE 'rose' END END AS sure FROM s""",
)
def colour_probability(spark, sf_dir):
    """VEC-25, MA-02, VEC-09: softmax of the similarities to three colours' vectors, and the colour where it is sure."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    colours = e.where("vec_id < 3").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("c"))  # three rows
    s = e.crossJoin(F.broadcast(colours)).select("vec_id", V.softmax(F.array(*[V.cosine(F.col("v"), F.col("c")[i]["v"]) for i in range(3)]), 20.0).alias("p"))
    sure = F.when(F.array_max("p") >= 0.7, F.element_at(F.array(F.lit("yellow"), F.lit("white"), F.lit("rose")), V.argmax(F.col("p")) + 1))
    return s.select("vec_id", F.round(F.col("p")[0], 6).alias("p"), sure.alias("sure"))


@query(
    "vec_fidelity",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT vec_id AS fid, label, v FROM e WHERE vec_id % 50 = 0)
       SELECT fid, round(max(list_cosine_similarity(e.v, f.v)), 6) AS best, max(list_cosine_similarity(e.v, f.v)) >= 0.3 AS passes FROM f JOIN e ON e.label = f.label AND e.vec_id <> fid GROUP BY fid""",
)
def fidelity(spark, sf_dir):
    """VEC-30: best cosine to one's own pictures against a threshold."""
    items = read_table(spark, sf_dir, "embeddings")
    pairs = scoring.pair_scores(items, items.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", same_label=True, reduce="max")
    return pairs.select(F.col("query").alias("fid"), F.round("score", 6).alias("best"), (F.col("score") >= 0.3).alias("passes"))


@query(
    "vec_stone_labels",
    """WITH s AS (SELECT DISTINCT id, from_json(json_extract_string(ours, '$.stones'), '["JSON"]') AS s FROM brand_designs WHERE json_valid(ours) AND json_type(ours) = 'OBJECT' AND json_extract_string(ours, '$.stones') LIKE '[%'),
       c AS (SELECT id, list_sort(list_filter(list_transform(s, lambda x: TRY_CAST(x->>'carat' AS DOUBLE)), lambda y: y IS NOT NULL), 'DESC') AS c FROM s)
       SELECT id, CASE WHEN len(c) = 1 OR c[1] >= 1.6 * c[2] THEN 'solitaire' ELSE 'cluster' END AS label FROM c WHERE len(c) > 0""",
)
def stone_labels(spark, sf_dir):
    """VEC-31: the largest stone against the next."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "ours").distinct().where(F.try_parse_json("ours").isNotNull() & F.ltrim("ours").startswith("{"))
    s = b.select("id", F.get_json_object("ours", "$.stones").alias("s")).where("s LIKE '[%'")
    c = F.sort_array(F.filter(F.transform(F.from_json("s", "array<struct<carat:double>>"), lambda x: x["carat"]), lambda y: y.isNotNull()), asc=False)
    c = s.select("id", c.alias("c")).where("size(c) > 0")
    return c.select("id", F.when((F.size("c") == 1) | (F.col("c")[0] >= 1.6 * F.get("c", F.lit(1))), "solitaire").otherwise("cluster").alias("label"))


@query(
    "ql_recommender_score",
    """WITH s AS (SELECT id, arg_max(user_id, coalesce(matches, -1)) AS user_id, arg_max(created_at, coalesce(matches, -1)) AS t, arg_max(understood, coalesce(matches, -1)) AS u FROM search_history GROUP BY id),
       m AS (SELECT user_id, coalesce(u.category, '') AS category, coalesce(u.metal, '') AS metal, pow(0.5, coalesce(greatest(0.0, (epoch_us(TIMESTAMP '2019-01-21') - epoch_us(t)) / 86400e6), 365.0) / 14) AS w,
                    row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS LAST, id DESC) AS r FROM s WHERE user_id IS NOT NULL),
       k AS (SELECT user_id, category, metal, min(r) AS r FROM m GROUP BY 1, 2, 3),
       tot AS (SELECT user_id, sum(w) AS t FROM m GROUP BY 1), ca AS (SELECT user_id, category, sum(w) AS w FROM m GROUP BY 1, 2), ma AS (SELECT user_id, metal, sum(w) AS w FROM m GROUP BY 1, 2),
       last AS (SELECT user_id, category FROM m WHERE r = 1), pop AS (SELECT category, metal, count(*) AS n FROM m GROUP BY 1, 2),
       d AS (SELECT uid, category, metals, stone_frac, (rank() OVER (ORDER BY stone_frac) - 1) / count(*) OVER () AS pr FROM designs WHERE stone_frac IS NOT NULL),
       fav AS (SELECT user_id, avg(pr) - 0.5 AS lift, avg(stone_frac) AS stones FROM (SELECT DISTINCT user_id, design_uid FROM favorites) f JOIN d ON d.uid = f.design_uid GROUP BY user_id),
       look AS (SELECT category, avg(stone_frac) AS stones FROM d GROUP BY 1), deep AS (SELECT pop.category, pop.metal, (SELECT count(*) FROM designs x WHERE x.category = pop.category AND (pop.metal = '' OR list_contains(x.metals, pop.metal))) AS n FROM pop)
       SELECT k.user_id, k.category, k.metal, round(1.2 * (ca.w / t + ma.w / t) + 0.8 * CASE WHEN last.category = k.category THEN 1 ELSE 0 END + 1.0 * coalesce(1 - abs(fav.stones - look.stones), 0) + 1.5 * coalesce(fav.lift, 0)
              - 0.8 * CASE WHEN k.r <= 5 THEN 1 ELSE 0 END + 0.8 * pop.n / (SELECT max(n) FROM pop) + 0.3 * ln(1 + deep.n) / ln(1 + (SELECT count(*) FROM designs)), 6) AS score
       FROM k JOIN tot USING (user_id) JOIN ca ON ca.user_id = k.user_id AND ca.category = k.category JOIN ma ON ma.user_id = k.user_id AND ma.metal = k.metal JOIN last ON last.user_id = k.user_id
       JOIN pop ON pop.category = k.category AND pop.metal = k.metal JOIN deep ON deep.category = k.category AND deep.metal = k.metal LEFT JOIN fav ON fav.user_id = k.user_id LEFT JOIN look ON look.category = k.category""",
)
def recommender_score(spark, sf_dir):
    """QL-12: what a user looked for, scored by affinity, session, taste, favourites, novelty, popularity and depth.

    Likeness of looks is the share of stones here, as there is no picture model among the tables.
    """
    raw = read_table(spark, sf_dir, "search_history").select("id", "user_id", "created_at", "understood", "matches")
    s = raw.groupBy("id").agg(F.max_by(F.struct("user_id", "created_at", "understood"), F.coalesce("matches", F.lit(-1))).alias("r")).select("id", "r.*").where("user_id IS NOT NULL")
    weight = T.decay(T.age_days("created_at", "2019-01-21"), 14)
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    m = s.select("user_id", F.coalesce("understood.category", F.lit("")).alias("category"), F.coalesce("understood.metal", F.lit("")).alias("metal"), weight.alias("w"), F.row_number().over(order).alias("r"))
    k = m.groupBy("user_id", "category", "metal").agg(F.min("r").alias("r"), F.sum("w").alias("w"), F.count("*").alias("n"))
    user = Window.partitionBy("user_id")
    share = lambda *by: F.sum("w").over(Window.partitionBy("user_id", *by)) / F.sum("w").over(user)
    k = k.withColumn("affinity", share("category") + share("metal")).withColumn("session", (F.min_by("category", "r").over(user) == F.col("category")).cast("int"))
    pop = k.groupBy("category", "metal").agg(F.sum("n").alias("pop"))
    d = designs(spark, sf_dir)
    deep = pop.join(d.select(F.col("category").alias("c"), "metals"), (F.col("category") == F.col("c")) & ((F.col("metal") == "") | F.array_contains("metals", F.col("metal"))), "left")
    deep = deep.groupBy("category", "metal", "pop").agg(F.count("c").alias("deep"))
    most = deep.agg(F.max("pop").alias("most")).crossJoin(d.agg(F.count("*").alias("all")))  # one row
    known = d.where("stone_frac IS NOT NULL").select("uid", "category", "stone_frac")
    total = known.agg(F.count("*").alias("n"))
    below = known.groupBy("stone_frac").agg(F.count("*").alias("c")).withColumn("below", F.coalesce(F.sum("c").over(Window.orderBy("stone_frac").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per measured share
    ranked = known.join(below, "stone_frac").crossJoin(F.broadcast(total)).select("uid", "stone_frac", (F.col("below") / F.col("n")).alias("pr"))
    f = read_table(spark, sf_dir, "favorites").select("user_id", F.col("design_uid").cast("long").alias("uid")).distinct().join(ranked, "uid")
    fav = f.groupBy("user_id").agg((F.avg("pr") - 0.5).alias("lift"), F.avg("stone_frac").alias("stones"))
    look = known.groupBy("category").agg(F.avg("stone_frac").alias("look"))
    j = k.join(F.broadcast(deep), ["category", "metal"]).join(fav, "user_id", "left").join(F.broadcast(look), "category", "left").crossJoin(F.broadcast(most))  # one row per meaning, per type, one row
    score = (
        1.2 * F.col("affinity") + 0.8 * F.col("session") + F.coalesce(1 - F.abs(F.col("stones") - F.col("look")), F.lit(0.0)) + 1.5 * F.coalesce("lift", F.lit(0.0))
        - 0.8 * (F.col("r") <= 5).cast("int") + 0.8 * F.col("pop") / F.col("most") + 0.3 * F.log1p("deep") / F.log1p("all")
    )
    return j.select("user_id", "category", "metal", F.round(score, 6).alias("score"))


@query("ql_slate")
def slate(spark, sf_dir):
    """WIN-12, QL-11, AR-06: a constrained slate per user out of kept, popular and unseen designs."""
    f = read_table(spark, sf_dir, "favorites").select("user_id", F.col("design_uid").cast("long").alias("item")).distinct()
    n = f.groupBy("item").agg(F.count("*").alias("n"))
    top = n.orderBy(F.col("n").desc(), "item").limit(20)  # the twenty most kept
    users = f.select("user_id").distinct()
    rows = f.withColumn("kind", F.lit("recent")).unionByName(users.crossJoin(F.broadcast(top.select("item"))).withColumn("kind", F.lit("popular")))
    d = designs(spark, sf_dir).select(F.col("uid").alias("item"), F.col("category").alias("type"), F.col("family").alias("meaning"), F.coalesce("stone_frac", F.lit(0.0)).alias("sf"))
    v = rows.join(n, "item").join(d, "item").select("user_id", "item", (F.log1p("n") / 10).alias("score"), "kind", "type", "meaning", F.array(F.lit(1.0), F.col("sf"), F.col("n") / 100).alias("vec"))
    return rerank.slate(v.dropDuplicates(["user_id", "item", "kind"]))


@query("ql_recommend")
def recommend(spark, sf_dir):
    """QL-11, WIN-12: five suggestions per user: what they looked for last, what their scores favour, what is popular and not looked for yet."""
    scored = recommender_score(spark, sf_dir)
    meaning = F.concat_ws("/", "category", "metal")
    # the order of a user's own meanings by score stands for their kinds: the first two are recent ones
    own = scored.select("user_id", meaning.alias("meaning"), F.col("category").alias("type"), "score", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc(), meaning)).alias("r"))
    own = own.withColumn("kind", F.when(F.col("r") <= 2, "recent").otherwise("for_you"))
    top = scored.groupBy(meaning.alias("meaning"), F.col("category").alias("type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "meaning").limit(10)  # ten meanings
    users = scored.select("user_id").distinct()
    popular = users.crossJoin(F.broadcast(top)).join(own.select("user_id", "meaning"), ["user_id", "meaning"], "left_anti").select("user_id", "meaning", "type", F.lit(0.3).alias("score"), F.lit("popular").alias("kind"))
    rows = own.select("user_id", "meaning", "type", "score", "kind").unionByName(popular)
    vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.pmod(F.xxhash64("type", i), F.lit(2)) * 2 - 1).cast("double"))
    return rerank.slate(rows.withColumn("item", F.xxhash64("meaning")).withColumn("vec", vec))


@query(
    "prj_explain",
    """WITH s AS (SELECT id, any_value(query) AS query, any_value(understood) AS u FROM search_history GROUP BY id)
       SELECT id, query AS raw, u.category AS category, u.metal AS metal, u.shape AS shape, coalesce(array_to_string(u.intents, '+'), '') AS intents, coalesce(len(u.intents), 0) AS n_intents, u.refused.reason AS refused FROM s""",
)
def explain(spark, sf_dir):
    """PRJ-03: what a search was understood as."""
    s = read_table(spark, sf_dir, "search_history").select("id", "query", "understood").dropDuplicates(["id"])
    intents = F.coalesce("understood.intents", F.array().cast("array<string>"))
    return s.select("id", F.col("query").alias("raw"), "understood.category", "understood.metal", "understood.shape", F.array_join(intents, "+").alias("intents"), F.size(intents).cast("long").alias("n_intents"), F.col("understood.refused.reason").alias("refused"))


@query(
    "join_view_max",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), views AS (SELECT vec_id, label, v FROM e WHERE vec_id % 50 = 0)
       SELECT e.vec_id AS product, round(max(list_cosine_similarity(e.v, w.v)), 6) AS best FROM e JOIN views w ON w.label = e.label AND w.vec_id <> e.vec_id GROUP BY e.vec_id""",
)
def view_max(spark, sf_dir):
    """JOIN-27: views of designs against all products of the label, the best view per product."""
    e = read_table(spark, sf_dir, "embeddings")
    best = scoring.pair_scores(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label", same_label=True, reduce="max")
    return best.select(F.col("query").alias("product"), F.round("score", 6).alias("best"))


@query("ql_count_shown", "SELECT category, count(*) FILTER (list_contains(metals, 'rose_gold')) AS n, CASE WHEN count(*) FILTER (list_contains(metals, 'rose_gold')) <= 0.9 * count(*) THEN true ELSE false END AS shown FROM designs GROUP BY category")
def count_shown(spark, sf_dir):
    """QL-09, QL-10: a refinement's count, shown only where it narrows."""
    n = F.count_if(F.array_contains("metals", "rose_gold"))
    return designs(spark, sf_dir).groupBy("category").agg(n.alias("n"), (n <= 0.9 * F.count("*")).alias("shown"))


@query("ql_options", "SELECT opt, count(*) AS n FROM (SELECT unnest(understood.intents) AS opt FROM search_history) GROUP BY opt")
def options(spark, sf_dir):
    """QL-07: how often searches name each option."""
    return read_table(spark, sf_dir, "search_history").select(F.explode("understood.intents").alias("opt")).groupBy("opt").agg(F.count("*").alias("n"))


@query(
    "ma_ring_size",
    """WITH c AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part WHERE p_size BETWEEN 12 AND 25),
       g AS (SELECT p_partkey, r, cents * r // 10000 AS q, cents * r % 10000 AS rest FROM c, (VALUES (85), (100), (114)) t(r)),
       h AS (SELECT p_partkey, r, (q + CASE WHEN rest > 5000 OR (rest = 5000 AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS w FROM g)
       SELECT c.p_partkey, round_even((p_size - 11.63) / 0.8128 * 2, 0) / 2 AS us, CAST(round_even(pi() * p_size - 40, 0) AS BIGINT) AS indian, 11.63 + 0.8128 * 7 AS us7_mm, (12 + 40) / pi() AS indian12_mm,
       max(w) FILTER (r = 85) AS k14, max(w) FILTER (r = 100) AS k18, max(w) FILTER (r = 114) AS k22 FROM c JOIN h USING (p_partkey) GROUP BY c.p_partkey, p_size""",
)
def ring_size(spark, sf_dir):
    """MA-07, MA-08: an inner diameter in millimetres (valid from 12 to 25) as US half sizes and Indian sizes, both ways; gold by purity."""
    d, weight = F.col("p_size").cast("double"), F.col("p_retailprice").cast("decimal(14,2)") * F.lit("0.01").cast("decimal(3,2)")
    gold = [F.bround(weight * F.lit(r).cast("decimal(3,2)"), 2).cast("double").alias(k) for k, r in (("k14", "0.85"), ("k18", "1.00"), ("k22", "1.14"))]
    p = read_table(spark, sf_dir, "part").where("p_size BETWEEN 12 AND 25")
    return p.select("p_partkey", T.ring_us(d).alias("us"), T.ring_indian(d).alias("indian"), T.us_diameter(F.lit(7)).cast("double").alias("us7_mm"), T.indian_diameter(F.lit(12)).alias("indian12_mm"), *gold)
