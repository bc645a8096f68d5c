"""Queries of the vector operators, over embeddings and photos. Query set: every id divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemflow.functions import vectors as V
from gemflow.operators import rerank, scoring
from gemflow.operators.search import fused_search
from gemflow.session import read_table


def _family_of(column: str):
    """Stand-in: three neighbouring ids are one family."""
    return (F.col(column) / 3).cast("long")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _asked(items: DataFrame) -> DataFrame:
    return items.where("vec_id % 50 = 0")


def _pairs(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    items = _items(spark, sf_dir)
    return scoring.pair_scores(items, _asked(items), "vec_id", "embedding", "label", **kw)


def _family(pairs: DataFrame, column: str = "item") -> DataFrame:
    return pairs.withColumn("family", _family_of(column))


def topk_cosine(spark, sf_dir):
    """JOIN-01, SRT-01: the eight nearest of every query."""
    found = scoring.best(_pairs(spark, sf_dir, top=8), 8)
    return found.select("query", "item", F.round("score", 6).alias("score"), "rank")


def similar_other_family(spark, sf_dir):
    """VEC-06, JOIN-26: more like this, same label, own family left out, one per family."""
    pairs = _family(_pairs(spark, sf_dir, same_label=True)).where("family <> CAST(query / 3 AS BIGINT)")
    one = scoring.best(pairs.withColumn("_k", F.concat_ws("/", "query", "family")), 1, by="_k").drop("rank", "_k")
    return scoring.best(one, 8).select("query", "item", F.round("score", 6).alias("score"), "rank")


def zscore_fusion(spark, sf_dir):
    """VEC-08, WIN-01: sum of standardised scores of two views of the vectors, within the query's own label."""
    items = _items(spark, sf_dir)
    views = lambda df, key, kind: df.select(F.col("vec_id").alias(key), kind, F.col("embedding").alias("whole"), F.slice("embedding", 1, 32).alias("front"))
    label = F.col("label").cast("string")
    found = fused_search(views(items, "item", label.alias("kind")), views(_asked(items), "query", F.array(label).alias("kinds")), {"whole": 1.0, "front": 0.5}, own=True)
    return found.select("query", "item", F.col("score").alias("fused"), "rank")


def hub_bias(spark, sf_dir):
    """VEC-03, WIN-06: mean of the thirty largest similarities to the query bank of the item's own label."""
    items = _items(spark, sf_dir)
    bank = scoring.pair_scores(items, _asked(items), "vec_id", "embedding", "label", same_label=True)
    return scoring.hub_bias(bank).select("item", F.round("bias", 6).alias("bias"))


def knn_vote(spark, sf_dir):
    """VEC-11, JOIN-23: label by the votes of the ten nearest."""
    near = scoring.best(_pairs(spark, sf_dir, top=10), 10)
    labels = _items(spark, sf_dir).select(F.col("vec_id").alias("item"), "label")
    return scoring.vote(near.join(labels, "item"), "label").select("query", "label", F.round("p", 6).alias("p"))


def neighbour_attribute(spark, sf_dir):
    """VEC-12, AR-04: the neighbours' attribute, those without one left out of the weights."""
    near = scoring.best(_pairs(spark, sf_dir, top=10), 10)
    attr = _items(spark, sf_dir).select(F.col("vec_id").alias("item"), F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 10) / 10).alias("attr"))
    return scoring.neighbour_attribute(near.join(attr, "item"), "attr").select("query", F.round("value", 6).alias("value"))


def percentile_rank(spark, sf_dir):
    """WIN-04: share of items that score strictly less, for the best ten of every query."""
    ranked = scoring.strictly_below(_pairs(spark, sf_dir))
    return scoring.best(ranked, 10).select("query", "item", F.round("percentile", 6).alias("percentile"))


def centred_scores(spark, sf_dir):
    """WIN-07, VEC-14: scores less the item's mean over all queries, the two best."""
    c = scoring.centred(_pairs(spark, sf_dir)).withColumn("centred", F.round("centred", 6))
    return scoring.best(c, 2, score="centred").select("query", "item", "centred", "rank")


def lead_next_family(spark, sf_dir):
    """WIN-03, VEC-19: lead of the first over the best of another family."""
    first = scoring.lead_over_next_family(_family(_pairs(spark, sf_dir)), "family")
    return first.select("query", "item", F.round("score", 6).alias("score"), F.round("lead", 6).alias("lead"))


def mean_by_label(spark, sf_dir):
    """AGG-11: unit mean vector per label, long form."""
    means = scoring.mean_vectors(_items(spark, sf_dir), "label", "embedding")
    return means.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def taste_vectors(spark, sf_dir):
    """AGG-12: weighted mean vector of the items a user touched (events spread over all embeddings), weights halving every 14 days."""
    events = read_table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    age = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-31").cast("timestamp_ntz")) / 86400.0
    items = _items(spark, sf_dir)
    spread = events.crossJoin(F.broadcast(items.agg(F.count("*").alias("_n"))))  # one row
    liked = spread.select("user_id", (F.col("event_id") % F.col("_n")).alias("vec_id"), F.pow(F.lit(0.5), age / 14).alias("w")).join(items, "vec_id")
    means = scoring.mean_vectors(liked, "user_id", "embedding", "w")
    return means.select("user_id", F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(F.get("vec", F.lit(1)), 6).alias("x1"), F.round(V.norm("vec"), 6).alias("size"))


def best_view(spark, sf_dir):
    """AGG-13, JOIN-17, VEC-07: best view per design, the design's own score where it has none."""
    pairs = _family(_pairs(spark, sf_dir))
    views = pairs.where("item % 3 > 0").groupBy("query", "family").agg(F.max("score").alias("view_score"))
    base = pairs.where("item % 3 = 0").select("query", "family", "score")
    out = base.join(views, ["query", "family"], "left").select("query", "family", F.round(F.coalesce("view_score", "score"), 6).alias("sim"))
    return scoring.best(out, 5, score="sim", tie="family").select("query", "family", "sim")


def duplicate_families(spark, sf_dir):
    """JOIN-02, AGG-36: near-duplicate photos as classes, exactly, by cells instead of all pairs."""
    return scoring.duplicate_classes(read_table(spark, sf_dir, "photo_query"), "photo_id", "vec", 96, 0.995)


def _by_family(p: DataFrame) -> DataFrame:
    """Class probabilities of the views, averaged per family."""
    return p.groupBy(_family_of("vec_id").alias("family"), "class").agg(F.round(F.avg("p"), 6).alias("p"))


def zero_shot(spark, sf_dir):
    """VEC-10, MA-02: class probabilities of every item by softmax at temperature 20, averaged per family."""
    items = _items(spark, sf_dir)
    classes = scoring.mean_vectors(items, "label", "embedding").select(F.col("label").alias("class"), "vec")
    scored = items.crossJoin(F.broadcast(classes)).select("vec_id", "class", V.cosine("embedding", "vec").alias("s"))  # one row per class
    listed = scored.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("class", "s"))).alias("c"))
    p = V.softmax(F.transform("c", lambda x: x["s"]), 20.0)
    out = listed.select("vec_id", F.posexplode(p).alias("_i", "p"), "c")
    return _by_family(out.select("vec_id", F.get("c", F.col("_i"))["class"].alias("class"), "p"))


def linear_probe(spark, sf_dir):
    """VEC-15: class probabilities of a linear reader over every label and item, averaged over the views of a family."""
    items = _items(spark, sf_dir)
    weights = scoring.mean_vectors(items, "label", "embedding").select(F.col("label").alias("class"), "vec")
    scored = items.crossJoin(F.broadcast(weights)).select("vec_id", "class", F.exp(8 * V.dot("embedding", "vec")).alias("_e"))  # one row per class
    total = scored.groupBy("vec_id").agg(F.sum("_e").alias("_t"))
    return _by_family(scored.join(total, "vec_id").select("vec_id", "class", (F.col("_e") / F.col("_t")).alias("p")))


def distribution_overlap(spark, sf_dir):
    """MA-04, VEC-16: overlap of each photo's attribute shares with an even distribution."""
    photos = read_table(spark, sf_dir, "photo_query").where("attrs IS NOT NULL AND size(attrs) > 0")
    values = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.greatest(F.coalesce(e["value"], F.lit(0.0)), F.lit(0.0)))
    shares = photos.select("photo_id", V.share(values).alias("p")).where("forall(p, x -> x IS NOT NULL)")
    even = F.transform("p", lambda x: F.lit(1.0) / F.size("p"))
    return shares.select("photo_id", F.round(V.overlap("p", even), 6).alias("overlap"))


def picture_score(spark, sf_dir):
    """VEC-20: how much better the best item of a query's label fits than it fits the label in general, in calibrated logits."""
    items = _items(spark, sf_dir)
    generic = scoring.mean_vectors(items, "label", "embedding").select(F.col("label").alias("_l"), "vec")
    best = scoring.pair_scores(items, _asked(items), "vec_id", "embedding", "label", same_label=True, reduce="max")
    plain = items.join(F.broadcast(generic), F.col("label") == F.col("_l")).groupBy("label").agg(F.max(V.cosine("embedding", "vec")).alias("g"))  # one row per label
    asked = _asked(items).select(F.col("vec_id").alias("query"), "label")
    return best.join(asked, "query").join(F.broadcast(plain), "label").select("query", F.round(100 * (F.col("score") - F.col("g")), 6).alias("lead"))


def novelty(spark, sf_dir):
    """WIN-21: a search against the five before it of the same user: only near repeats lose."""
    s = read_table(spark, sf_dir, "search_history").where("user_id IS NOT NULL AND created_at IS NOT NULL").select("id", "user_id", "created_at").dropDuplicates(["id"])
    e = _items(spark, sf_dir)
    n = s.crossJoin(F.broadcast(e.agg(F.count("*").alias("_n"))))  # one row
    v = n.join(e.select(F.col("vec_id"), F.col("embedding").alias("v")), F.col("id") % F.col("_n") == F.col("vec_id"))
    before = F.collect_list("v").over(Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(-5, -1))
    near = F.array_max(F.transform("_b", lambda x: V.cosine(F.col("v"), x)))
    return v.withColumn("_b", before).select("id", F.round(-10 * F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0)) - 0.9), 6).alias("novelty"))


def mmr(spark, sf_dir):
    """VEC-05, WIN-09: diversified first page; greedy, so checked on a fixture."""
    items = _items(spark, sf_dir)
    pool = scoring.best(_pairs(spark, sf_dir, top=80), 80).join(items.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), _family_of("vec_id").alias("family")), "item")
    return rerank.diversify(pool, k=8, relevance=0.8)


def shop_spread(spark, sf_dir):
    """WIN-11: page in which a shop's further products lose score."""
    pool = scoring.best(_pairs(spark, sf_dir, top=80), 80)
    labels = _items(spark, sf_dir).select(F.col("vec_id").alias("item"), F.col("label").alias("shop"), F.col("embedding").alias("vec"))
    return rerank.spread(pool.join(labels, "item"), k=8)


def browse_order(spark, sf_dir):
    """WIN-10: order of a category for browsing, similar pieces kept apart."""
    items = _items(spark, sf_dir).withColumn("richness", F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") * 37 % 101) / 101.0)).withColumn("family", _family_of("vec_id"))
    return rerank.browse(items.select(F.col("label").alias("category"), F.col("vec_id").alias("item"), "family", "richness", F.col("embedding").alias("vec")))


_SQL_PAIRS = """
    WITH items AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    pairs AS (SELECT q.vec_id AS query, i.vec_id AS item, list_cosine_similarity(q.v, i.v) AS score, q.label AS ql, i.label AS il, i.vec_id // 3 AS family
              FROM items q JOIN items i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
"""
_SQL_CLASSES = """
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT label AS class, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2),
    c AS (SELECT class, list(x ORDER BY pos) AS m, sqrt(sum(x * x)) AS n FROM d GROUP BY class)
"""
_RANK = "row_number() OVER (PARTITION BY query ORDER BY score DESC, item)"

QUERIES = {
    "vec_topk_cosine": topk_cosine, "vec_similar_excl_family": similar_other_family, "vec_zscore_fusion": zscore_fusion, "vec_hub_bias_top30": hub_bias,
    "vec_zero_shot_softmax": zero_shot, "vec_knn_vote": knn_vote, "vec_neighbour_attr": neighbour_attribute, "vec_percentile_rank": percentile_rank,
    "vec_centred_scores": centred_scores, "vec_lead_next_family": lead_next_family, "vec_mean_by_label": mean_by_label, "vec_taste_vector": taste_vectors,
    "vec_best_view": best_view, "vec_duplicate_families": duplicate_families, "vec_linear_probe": linear_probe, "vec_distribution_overlap": distribution_overlap,
    "vec_picture_score": picture_score, "win_novelty": novelty, "rerank_mmr": mmr, "rerank_shop_spread": shop_spread, "rerank_browse_order": browse_order,
}

SQL = {
    "vec_topk_cosine": _SQL_PAIRS + f"SELECT query, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_RANK} AS rank FROM pairs) WHERE rank <= 8",
    "vec_similar_excl_family": _SQL_PAIRS + f""", one AS (SELECT query, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query, family ORDER BY score DESC, item) AS r
        FROM pairs WHERE ql = il AND family <> query // 3) WHERE r = 1)
        SELECT query, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_RANK} AS rank FROM one) WHERE rank <= 8""",
    "vec_zscore_fusion": _SQL_PAIRS + """, two AS (SELECT p.query, p.item, p.score, list_cosine_similarity(q.v[1:32], i.v[1:32]) AS second
            FROM pairs p JOIN items q ON q.vec_id = p.query JOIN items i ON i.vec_id = p.item WHERE p.ql = p.il),
        stats AS (SELECT query, avg(score) AS m1, stddev_pop(score) AS s1, avg(second) AS m2, stddev_pop(second) AS s2 FROM two GROUP BY query),
        f AS (SELECT t.query, item, round((score - m1) / (s1 + 1e-9) + 0.5 * (second - m2) / (s2 + 1e-9), 6) AS fused FROM two t JOIN stats USING (query))
        SELECT query, item, fused, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, item) AS rank FROM f) WHERE rank <= 8""",
    "vec_hub_bias_top30": _SQL_PAIRS + """SELECT item, round(avg(score), 6) AS bias FROM (SELECT item, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, query) AS r
        FROM pairs WHERE ql = il) WHERE r <= 30 GROUP BY item""",
    "vec_knn_vote": _SQL_PAIRS + f""", near AS (SELECT *, exp(50 * (score - max(score) OVER (PARTITION BY query))) AS w FROM (SELECT *, {_RANK} AS r FROM pairs) WHERE r <= 10),
        t AS (SELECT query, sum(w) AS t FROM near GROUP BY query) SELECT query, il AS label, round(sum(w) / any_value(t), 6) AS p FROM near JOIN t USING (query) GROUP BY query, il""",
    "vec_neighbour_attr": _SQL_PAIRS + f""", near AS (SELECT *, exp(50 * (score - max(score) OVER (PARTITION BY query))) AS w FROM (SELECT *, {_RANK} AS r FROM pairs) WHERE r <= 10)
        SELECT query, round(sum(w * (item % 10) / 10) / sum(w), 6) AS value FROM near WHERE item % 4 <> 0 GROUP BY query""",
    "vec_percentile_rank": _SQL_PAIRS + f"""SELECT query, item, round(percentile, 6) AS percentile FROM (SELECT query, item,
        (rank() OVER (PARTITION BY query ORDER BY score) - 1) / count(*) OVER (PARTITION BY query) AS percentile, {_RANK} AS r FROM pairs) WHERE r <= 10""",
    "vec_centred_scores": _SQL_PAIRS + """, c AS (SELECT query, item, round(score - avg(score) OVER (PARTITION BY item), 6) AS centred FROM pairs)
        SELECT query, item, centred, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY centred DESC, item) AS rank FROM c) WHERE rank <= 2""",
    "vec_lead_next_family": _SQL_PAIRS + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, family ORDER BY score DESC, item) AS r FROM pairs) WHERE r = 1)
        SELECT query, item, round(score, 6) AS score, round(score - nxt, 6) AS lead FROM (SELECT *, lead(score) OVER (PARTITION BY query ORDER BY score DESC, item) AS nxt, {_RANK} AS n FROM one) WHERE n = 1""",
    "vec_mean_by_label": """WITH d AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2)
        SELECT label, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM d""",
    "vec_taste_vector": """WITH l AS (SELECT user_id, pow(0.5, date_diff('second', ts, TIMESTAMP '2024-01-31') / 86400.0 / 14) AS w, CAST(embedding AS DOUBLE[]) AS v
            FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE user_id IS NOT NULL),
        d AS (SELECT user_id, pos, sum(w * x) / sum(w) AS x FROM (SELECT user_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM l) GROUP BY 1, 2),
        n AS (SELECT user_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM d)
        SELECT user_id, round(max(x) FILTER (pos = 1), 6) AS x0, round(max(x) FILTER (pos = 2), 6) AS x1, round(sqrt(sum(x * x)), 6) AS size FROM n GROUP BY user_id""",
    "vec_best_view": _SQL_PAIRS + """, views AS (SELECT query, family, max(score) AS vs FROM pairs WHERE item % 3 > 0 GROUP BY 1, 2),
        s AS (SELECT p.query, p.family, round(coalesce(vs, score), 6) AS sim FROM pairs p LEFT JOIN views v ON v.query = p.query AND v.family = p.family WHERE item % 3 = 0)
        SELECT query, family, sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, family) AS r FROM s) WHERE r <= 5""",
    "vec_duplicate_families": """WITH RECURSIVE ok AS (SELECT photo_id AS id, CAST(vec AS DOUBLE[]) AS v FROM photo_query WHERE vec IS NOT NULL AND len(vec) = 96
            AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
        u AS (SELECT id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 7)) AS v FROM ok),
        rep AS (SELECT id, min(id) OVER (PARTITION BY v) AS rep, v FROM u),
        r AS (SELECT id, v FROM rep WHERE id = rep),
        e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.995),
        reach AS (SELECT id, id AS other FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
        cls AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id), links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT rep.id, class_id, coalesce(n, 0) AS n_links FROM rep JOIN cls ON cls.id = rep.rep LEFT JOIN links ON links.a = rep.rep""",
    "vec_zero_shot_softmax": _SQL_CLASSES + """, s AS (SELECT vec_id, class, exp(20 * (list_cosine_similarity(v, m) - max(list_cosine_similarity(v, m)) OVER (PARTITION BY vec_id))) AS x FROM e, c)
        SELECT vec_id // 3 AS family, class, round(avg(p), 6) AS p FROM (SELECT vec_id, class, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s) GROUP BY 1, 2""",
    "vec_linear_probe": _SQL_CLASSES + """, s AS (SELECT vec_id, class, exp(8 * list_dot_product(v, m) / n) AS x FROM e, c)
        SELECT vec_id // 3 AS family, class, round(avg(p), 6) AS p FROM (SELECT vec_id, class, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s) GROUP BY 1, 2""",
    "vec_distribution_overlap": """WITH p AS (SELECT photo_id, list_transform(map_values(attrs), lambda x: greatest(coalesce(x, 0.0), 0.0)) AS a FROM photo_query WHERE attrs IS NOT NULL AND cardinality(attrs) > 0)
        SELECT photo_id, round(list_sum(list_transform(a, lambda x: sqrt(x / list_sum(a) / len(a)))), 6) AS overlap FROM p WHERE list_sum(a) <> 0""",
    "vec_picture_score": _SQL_CLASSES + """, g AS (SELECT label, max(list_cosine_similarity(v, m)) AS g FROM e JOIN c ON c.class = e.label GROUP BY label)
        SELECT q.vec_id AS query, round(100 * (max(list_cosine_similarity(q.v, i.v)) - any_value(g)), 6) AS lead FROM e q JOIN e i ON i.label = q.label AND i.vec_id <> q.vec_id JOIN g ON g.label = q.label WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id""",
    "win_novelty": """WITH s AS (SELECT id, any_value(user_id) AS user_id, any_value(created_at) AS t FROM search_history WHERE user_id IS NOT NULL AND created_at IS NOT NULL GROUP BY id),
        v AS (SELECT s.*, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS r FROM s JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings))
        SELECT a.id, round(-10 * greatest(0.0, coalesce(max(list_cosine_similarity(a.v, b.v)), 0.0) - 0.9), 6) AS novelty FROM v a LEFT JOIN v b ON b.user_id = a.user_id AND b.r BETWEEN a.r - 5 AND a.r - 1 GROUP BY a.id""",
}
