"""Search queries over several signals: by words, by photo, by design, by product. Query set: every id divisible by 50.

There is no text encoder among the tables: a search's vector is the mean vector of the pieces of its type, and parts of
the embeddings stand for the signals of two picture models and of a title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemflow.functions import vectors as V
from gemflow.operators import probes, rerank, scoring
from gemflow.operators.search import for_all, fused_search, search_classes
from gemflow.session import materialise, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TRAITS = {"solitaire": "stones:solitaire", "plain": "band:plain", "floral": "form:floral"}
GENERIC = ["ring", "rings", "earring", "earrings", "necklace", "necklaces", "pendant", "pendants", "bracelet", "bracelets", "gold", "diamond", "diamonds", "with"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _best(pairs: str, signals: dict[str, float], bonus: str = "0", k: int = 8) -> str:
    """SQL: the best of pairs(query, item, strict, tagged, <signals>): z-scores over the rows seen, summed."""
    seen = f"""{pairs}, counted AS (SELECT *, count(*) FILTER (strict) OVER (PARTITION BY query) AS n_strict FROM pairs),
        seen AS (SELECT * FROM counted WHERE strict OR n_strict < {k})"""
    z = " + ".join(f"{w} * ({s} - avg({s}) OVER q) / (stddev_pop({s}) OVER q + 1e-9)" for s, w in signals.items())
    return f"""{seen}, scored AS (SELECT query, item, n_strict < {k} AND tagged AS relaxed, count(*) OVER q AS n, round({z} + {bonus}, 6) AS score FROM seen WINDOW q AS (PARTITION BY query))
        SELECT query, item, score, CAST(r AS INTEGER) AS rank, n, relaxed FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS r FROM scored) WHERE r <= {k}"""


# --- by words, over photos


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable photos, once per id, with what wishes gain them; written once, vectors as they are."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    gains = F.array(*[F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit(0.0)) for a in TRAITS.values()])
    p = read_table(spark, sf_dir, "photo_query").where("vec IS NOT NULL AND size(vec) = 96").where(fine)
    return materialise(p.select(F.col("photo_id").alias("item"), "category", "metal", gains.alias("gains"), "vec").dropDuplicates(["item"]), "photos")


_PHOTOS = """ok AS (SELECT photo_id AS item, any_value(category) AS category, any_value(metal) AS metal, any_value(attrs) AS attrs, any_value(CAST(vec AS DOUBLE[])) AS w FROM photo_query WHERE vec IS NOT NULL AND len(vec) = 96
        AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY photo_id),
    photo AS (SELECT item, category, metal, attrs, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM ok),
    dims AS (SELECT category, i, avg(x) AS x FROM (SELECT category, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM photo WHERE category IS NOT NULL) GROUP BY 1, 2),
    kind AS (SELECT category, list(x / s ORDER BY i) AS q FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY category)) AS s FROM dims) GROUP BY category),
    hub AS (SELECT item, avg(list_dot_product(v, q)) AS h FROM photo, kind GROUP BY item),
    asked AS (SELECT id AS query, any_value(understood) AS u FROM search_history WHERE id % 50 = 0 GROUP BY id)"""

_TXT = f"""WITH {_PHOTOS}, pairs AS (SELECT a.query, p.item, coalesce(a.u.metal = p.metal, a.u.metal IS NULL) AS strict, a.u.metal IS NOT NULL AS tagged, list_dot_product(p.v, k.q) - h.h AS sim,
        CASE WHEN list_contains(a.u.intents, 'solitaire') THEN 1.5 * coalesce(p.attrs['stones:solitaire'], 0) ELSE 0 END + CASE WHEN list_contains(a.u.intents, 'plain') THEN 1.5 * coalesce(p.attrs['band:plain'], 0) ELSE 0 END
        + CASE WHEN list_contains(a.u.intents, 'floral') THEN 1.5 * coalesce(p.attrs['form:floral'], 0) ELSE 0 END AS wish
        FROM asked a JOIN kind k ON k.category = a.u.category JOIN photo p ON p.category = a.u.category JOIN hub h ON h.item = p.item)"""


def _text_search(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items found by classes of searches, the classes' searches, and the photos: z(similarity - hub) + wishes, within type and metal.

    The hub of a photo is its mean similarity to the types, so similarity less hub is that to the type less the mean of types.
    """
    p = _photos(spark, sf_dir)
    unit = p.withColumn("v", V.normalise("vec"))
    kinds = materialise(scoring.mean_vectors(unit.where("category IS NOT NULL"), "category", "v").withColumnRenamed("vec", "q"), "kinds")
    middle = scoring.mean_vectors(kinds.withColumn("all", F.lit(0)), "all", "q", renormalise=False).select(F.col("vec").alias("middle"))
    items = unit.select("item", F.col("category").alias("kind"), F.array_compact(F.array("metal")).alias("tags"), F.col("gains").alias("bonus"), F.col("v").alias("sim"))
    s = read_table(spark, sf_dir, "search_history").where("id % 50 = 0").select(F.col("id").alias("query"), "understood").dropDuplicates(["query"])
    wishes = F.array(*[F.when(F.array_contains("understood.intents", i), 1.5).otherwise(0.0) for i in TRAITS])
    shifted = kinds.crossJoin(F.broadcast(middle)).select("category", V.scale_sum("q", 1.0, "middle", -1.0).alias("sim"))  # one row
    asked = s.join(F.broadcast(shifted), F.col("understood.category") == F.col("category"))  # one row per type
    asked = asked.select("query", F.array("category").alias("kinds"), F.col("understood.metal").alias("tag"), wishes.alias("weights"), "sim")
    return *search_classes(items, asked, {"sim": 1.0}, k=k, unit=False, stored=True), p


@query("txt_search", _best(_TXT, {"sim": 1.0}, "wish"))
def text_search(spark, sf_dir):
    """VEC-01, VEC-04, FLT-11: parse, filter (metal given up where fewer than a page have it), similarity less hub, standardised, plus wishes."""
    found, members, _ = _text_search(spark, sf_dir, 8)
    return for_all(found, members)


@query("txt_search_page")
def text_search_page(spark, sf_dir):
    """VEC-01, VEC-05: the same with a diversified first page, out of the eighty best."""
    found, members, photos = _text_search(spark, sf_dir, 80)
    pool = found.withColumnRenamed("class", "query").join(photos.select("item", F.col("item").alias("family"), "vec"), "item")
    page = rerank.diversify(pool.withColumn("vec", V.normalise("vec")), k=8, relevance=0.8)
    return for_all(page.withColumnRenamed("query", "class"), members)


# --- over products of the web


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: a page with the vectors of its picture, colours read from it, and whether it is for men."""
    w = read_table(spark, sf_dir, "web_designs").groupBy(F.col("id").alias("item")).agg(F.min("title").alias("title"), F.min("site").alias("site"))
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("kind"))
    men = F.coalesce(F.col("title").rlike(r"(?i)\b(men|mens|gents?|kada)\b"), F.lit(False)).cast("double")
    p = w.join(e, "item")
    return p.select("item", "site", "kind", "v", F.concat(V.softmax(F.slice("v", 1, 3), 10.0), F.array(men)).alias("bonus"), _words("title").alias("words"), *_signals("v"))


def _words(text: str):
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{4,})"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~x.isin(GENERIC)), lambda x: F.regexp_replace(x, "s+$", "")))


PARTS = {"sig": (1, 32), "dino": (33, 32), "title": (17, 32), "cut": (1, 8), "layout": (9, 8), "motif": (17, 8)}


def _signals(v: str) -> list:
    return [F.slice(v, a, n).alias(s) for s, (a, n) in PARTS.items()]


_LIST = "[" + ", ".join(f"'{w}'" for w in GENERIC) + "]"
_WORDS_SQL = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({{}}), '([a-z]{{{{4,}}}})', 1), lambda x: NOT list_contains({_LIST}, x)), lambda x: regexp_replace(x, 's+$', '')))"
_WEB = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    web AS (SELECT id, min(title) AS title, min(site) AS site FROM web_designs GROUP BY id),
    product AS (SELECT id AS item, site, CAST(label AS VARCHAR) AS kind, v, {_WORDS_SQL.format("title")} AS words, CASE WHEN regexp_matches(title, '(?i)\\b(men|mens|gents?|kada)\\b') THEN 1.0 ELSE 0.0 END AS men,
                list_transform(v[1:3], lambda x: exp(10 * x) / (exp(10 * v[1]) + exp(10 * v[2]) + exp(10 * v[3]))) AS colour FROM web JOIN e ON vec_id = id)"""


def _sims(*names: str) -> str:
    return ", ".join(f"list_cosine_similarity(p.v[{PARTS[s][0]}:{PARTS[s][0] + PARTS[s][1] - 1}], q.v[{PARTS[s][0]}:{PARTS[s][0] + PARTS[s][1] - 1}]) AS {s}" for s in names)


_COLOURS = ["yellow_gold", "white_gold", "rose_gold"]


def _weights(metal, colour: float):
    return F.array(*[F.when(metal == m, colour).otherwise(0.0) for m in _COLOURS], F.lit(-1.5))


def _wish(metal: str, colour: float) -> str:
    return f"{colour} * CASE {metal} WHEN 'yellow_gold' THEN p.colour[1] WHEN 'white_gold' THEN p.colour[2] WHEN 'rose_gold' THEN p.colour[3] ELSE 0 END - 1.5 * p.men"


@query(
    "web_for_words",
    _best(
        f"""{_WEB}, n AS (SELECT count(*) AS n FROM e), asked AS (SELECT id AS query, any_value(query) AS text, any_value(understood) AS u FROM search_history WHERE id % 50 = 0 GROUP BY id),
        q AS (SELECT query, v, {_WORDS_SQL.format("text")} AS words, u.metal AS metal FROM asked, n JOIN e ON vec_id = query % n),
        pairs AS (SELECT q.query, p.item, true AS strict, false AS tagged, {_sims("sig", "title")}, 1.5 * least(2, len(list_intersect(coalesce(p.words, []), coalesce(q.words, [])))) + {_wish("q.metal", 3.0)} AS wish FROM q, product p)""",
        {"sig": 1.0, "title": 0.4},
        "wish",
    ),
)
def web_for_words(spark, sf_dir):
    """VEC-21: products for words: picture and title, words shared with the title, the asked colour, pieces for men last."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    s = read_table(spark, sf_dir, "search_history").where("id % 50 = 0").select(F.col("id").alias("query"), F.col("query").alias("text"), "understood").dropDuplicates(["query"])
    asked = s.crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).join(e, F.col("vec_id") == F.col("query") % F.col("n"))  # one row
    asked = asked.select("query", _words("text").alias("words"), _weights(F.coalesce("understood.metal", F.lit("")), 3.0).alias("weights"), *_signals("v"))
    return fused_search(_products(spark, sf_dir), asked, {"sig": 1.0, "title": 0.4}, words=1.5)


@query(
    "web_for_photo",
    _best(f"""{_WEB}, pairs AS (SELECT q.vec_id AS query, p.item, true AS strict, false AS tagged, {_sims("sig", "dino")} FROM e q, product p WHERE q.vec_id % 50 = 0 AND q.vec_id <> p.item)""", {"sig": 1.0, "dino": 1.0}),
)
def web_for_photo(spark, sf_dir):
    """VEC-22, VEC-08: products like a photo, by two picture models."""
    e = read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("v"))
    return fused_search(_products(spark, sf_dir), e.select("query", *_signals("v")), {"sig": 1.0, "dino": 1.0}, own=True)


_LIKE = {"sig": 1.0, "cut": 1.5, "layout": 1.0, "motif": 1.0, "dino": 0.5}


@query(
    "web_like_design",
    _best(
        f"""{_WEB}, n AS (SELECT count(*) AS n FROM e), q AS (SELECT uid AS query, v, embed_metal AS metal FROM designs, n JOIN e ON vec_id = uid % n WHERE uid % 50 = 0),
        pairs AS (SELECT q.query, p.item, true AS strict, false AS tagged, {_sims(*_LIKE)}, {_wish("q.metal", 0.5)} AS wish FROM q, product p)""",
        _LIKE,
        "wish",
    ),
)
def web_like_design(spark, sf_dir):
    """VEC-23: products like a design: picture, cut, layout, motif, a little of the second model; colour breaks near-ties."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    d = read_table(spark, sf_dir, "designs").where("uid % 50 = 0").select(F.col("uid").alias("query"), "embed_metal")
    asked = d.crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).join(e, F.col("vec_id") == F.col("query") % F.col("n"))  # one row
    return fused_search(_products(spark, sf_dir), asked.select("query", _weights(F.coalesce("embed_metal", F.lit("")), 0.5).alias("weights"), *_signals("v")), _LIKE)


@query(
    "web_like_product",
    _best(f"""{_WEB}, pairs AS (SELECT q.item AS query, p.item, true AS strict, false AS tagged, {_sims("sig", "dino")} FROM product q JOIN product p ON p.kind = q.kind AND p.item <> q.item WHERE q.item % 50 = 0)""", {"sig": 1.0, "dino": 1.0}),
)
def web_like_product(spark, sf_dir):
    """VEC-24: related products of the same type, the product itself left out."""
    p = _products(spark, sf_dir)
    asked = p.where("item % 50 = 0").select(F.col("item").alias("query"), F.array("kind").alias("kinds"), *PARTS)
    return fused_search(p, asked, {"sig": 1.0, "dino": 1.0}, own=True)


@query("web_page")
def web_page(spark, sf_dir):
    """VEC-22, WIN-11: a page of products like a photo with a mix of shops and no picture twice."""
    e = read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("v"))
    p = _products(spark, sf_dir)
    pool = fused_search(p, e.select("query", *_signals("v")), {"sig": 1.0, "dino": 1.0}, k=48, own=True)
    return rerank.spread(pool.join(p.select("item", F.xxhash64("site").alias("shop"), F.col("sig").alias("vec")), "item"), k=8)


# --- reading photos


@query(
    "vec_read_photo",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       d AS (SELECT label AS class, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2), c AS (SELECT class, list(x ORDER BY pos) AS m FROM d GROUP BY class),
       z AS (SELECT vec_id, class, exp(20 * list_cosine_similarity(v, m)) AS x FROM e, c WHERE vec_id % 50 = 0), zero AS (SELECT vec_id, class, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM z),
       n AS (SELECT q.vec_id, i.label, list_cosine_similarity(q.v, i.v) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.vec_id) AS r FROM e q JOIN e i ON i.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
       w AS (SELECT vec_id, label, exp(50 * (s - max(s) OVER (PARTITION BY vec_id))) AS w FROM n WHERE r <= 10), vote AS (SELECT vec_id, label, sum(w) / any_value(t) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM w) GROUP BY 1, 2),
       b AS (SELECT zero.vec_id, class, 0.3 * zero.p + 0.7 * coalesce(vote.p, 0) AS p FROM zero LEFT JOIN vote ON vote.vec_id = zero.vec_id AND vote.label = class)
       SELECT vec_id, arg_max(class, (p, -class)) AS kind, round(max(p), 6) AS p, max(p) >= 0.6 AS sure FROM b GROUP BY vec_id""",
)
def read_photo(spark, sf_dir):
    """VEC-09: the type of a photo: three tenths zero-shot reading, seven tenths votes of its nearest; sure from 0.6 on."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    asked = e.where("vec_id % 50 = 0")
    classes = scoring.mean_vectors(e, "label", "v").select(F.col("label").alias("class"), "vec")
    z = asked.crossJoin(F.broadcast(classes)).select("vec_id", "class", F.exp(20 * V.cosine("v", "vec")).alias("x"))  # one row per class
    zero = z.withColumn("zero", F.col("x") / F.sum("x").over(Window.partitionBy("vec_id")))
    near = scoring.best(scoring.pair_scores(e, asked, "vec_id", "v", top=10), 10).join(e.select(F.col("vec_id").alias("item"), "label"), "item")
    vote = scoring.vote(near, "label").select(F.col("query").alias("vec_id"), F.col("label").alias("class"), "p")
    both = zero.join(vote, ["vec_id", "class"], "left").select("vec_id", "class", (0.3 * F.col("zero") + 0.7 * F.coalesce("p", F.lit(0.0))).alias("p"))
    return both.groupBy("vec_id").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("kind"), F.round(F.max("p"), 6).alias("p"), (F.max("p") >= 0.6).alias("sure"))


@query(
    "vec_trait_shown",
    f"""WITH t AS (SELECT photo_id, unnest(map_entries(attrs)) AS e FROM (SELECT DISTINCT ON (photo_id) * FROM photo_query) WHERE attrs IS NOT NULL), n AS (SELECT photo_id, e.key AS trait, e.value AS p, percent_rank() OVER (PARTITION BY e.key ORDER BY e.value) AS pr FROM t WHERE e.value IS NOT NULL),
        m AS (SELECT *, p - avg(p) OVER (PARTITION BY trait) AS c FROM n), r AS (SELECT *, (rank() OVER (PARTITION BY trait ORDER BY c) - 1) / count(*) OVER (PARTITION BY trait) AS pct FROM m)
        SELECT photo_id, trait, round(c, 6) AS centred, round(pct, 6) AS percentile FROM r WHERE pct >= 0.95 QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY round(c, 6) DESC, trait) <= 2""",
)
def trait_shown(spark, sf_dir):
    """VEC-14: traits that outscore nearly all other pieces on them, centred, two at most."""
    t = read_table(spark, sf_dir, "photo_query").where("attrs IS NOT NULL").dropDuplicates(["photo_id"]).select("photo_id", F.explode("attrs").alias("trait", "p")).where("p IS NOT NULL")
    mean = t.groupBy("trait").agg(F.avg("p").alias("m"))
    c = t.join(F.broadcast(mean), "trait").select("photo_id", "trait", (F.col("p") - F.col("m")).alias("c"))  # one row per trait
    w = Window.partitionBy("trait")
    r = c.withColumn("pct", (F.rank().over(w.orderBy("c")) - 1) / F.count("*").over(w)).where("pct >= 0.95")
    first = Window.partitionBy("photo_id").orderBy(F.round("c", 6).desc(), "trait")
    return r.withColumn("_n", F.row_number().over(first)).where("_n <= 2").select("photo_id", "trait", F.round("c", 6).alias("centred"), F.round("pct", 6).alias("percentile"))


@query("vec_train_probe")
def train_probe(spark, sf_dir):
    """VEC-27: a linear reader trained by folds of families; how often it is right per fold."""
    e = read_table(spark, sf_dir, "embeddings").withColumn("family", (F.col("vec_id") / 3).cast("long"))
    read = probes.train_by_folds(e, "vec_id", "embedding", "label", "family")
    return read.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("read") == F.col("label")).cast("double")), 4).alias("right"))


@query("vec_train_finder")
def train_finder(spark, sf_dir):
    """VEC-28: a reader of patches, piece or background, over the tables' vectors read as patches; the patches found."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("piece"))
    model = probes.train_probe(e, "embedding", "piece")
    return probes.read_with(model, e, "embedding").where("read = 1").select("vec_id", F.round(F.col("p")[1], 4).alias("p"))


@query(
    "vec_match_label",
    f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        p AS (SELECT q.vec_id AS query, i.vec_id AS item, i.vec_id // 3 AS family, {_sims("sig", "dino").replace("p.v", "i.v")} FROM e q JOIN e i ON i.label = q.label AND i.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        z AS (SELECT query, item, family, (sig - avg(sig) OVER w) / (stddev_pop(sig) OVER w + 1e-9) AS a, (dino - avg(dino) OVER w) / (stddev_pop(dino) OVER w + 1e-9) AS b FROM p WINDOW w AS (PARTITION BY query)),
        f AS (SELECT *, a + b AS s FROM z), one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query, family ORDER BY s DESC, item) = 1),
        l AS (SELECT *, s - lead(s) OVER (PARTITION BY query ORDER BY s DESC, item) AS lead, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS r FROM one)
        SELECT query, item, round(lead, 6) AS lead, CASE WHEN least(a, b) >= 1.5 AND lead >= 1.3 THEN 'same' WHEN least(a, b) >= 1.5 AND lead >= 0.8 THEN 'very_close' ELSE 'similar' END AS label FROM l WHERE r = 1""",
)
def match_label(spark, sf_dir):
    """VEC-19, WIN-03: what the first find may be called: from its lead over the next family, where both models rate it well."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    both = None
    for s in ("sig", "dino"):
        part = e.select("vec_id", "label", F.slice("v", *PARTS[s]).alias("v"))
        own = scoring.pair_scores(part, part.where("vec_id % 50 = 0"), "vec_id", "v", "label", same_label=True).withColumnRenamed("score", s)
        both = own if both is None else both.join(own, ["query", "item"])
    z = scoring.standardise(both, ["sig", "dino"]).withColumn("family", F.floor(F.col("item") / 3)).withColumn("score", F.col("z_sig") + F.col("z_dino"))
    first = scoring.lead_over_next_family(z, "family").join(z.select("query", "item", "z_sig", "z_dino"), ["query", "item"])
    labelled = scoring.match_label(first, "z_sig", "z_dino")
    same = (F.least("z_sig", "z_dino") >= 1.5) & (F.col("lead") >= 1.3)
    return labelled.select("query", "item", F.round("lead", 6).alias("lead"), F.when(same, "same").otherwise(F.col("label")).alias("label"))


@query(
    "vec_detail_agreement",
    """WITH p AS (SELECT photo_id, user_id, attrs FROM (SELECT DISTINCT ON (photo_id) * FROM photo_query) WHERE user_id IS NOT NULL AND attrs IS NOT NULL), f AS (SELECT user_id, min(photo_id) AS first FROM p GROUP BY user_id),
       e AS (SELECT photo_id, user_id, unnest(map_entries(attrs)) AS e FROM p), j AS (SELECT a.photo_id, a.e.value AS x, b.e.value AS y FROM e a JOIN f USING (user_id) JOIN e b ON b.photo_id = f.first AND b.e.key = a.e.key WHERE a.photo_id <> f.first)
       SELECT photo_id, round(avg(CASE WHEN (x >= 0.8) = (y >= 0.8) THEN 1.0 ELSE 0.0 END) FILTER ((x >= 0.8 OR x <= 0.2) AND (y >= 0.8 OR y <= 0.2)), 6) AS agreement FROM j GROUP BY photo_id""",
)
def detail_agreement(spark, sf_dir):
    """VEC-18: agreement of all readings of two pictures that are clear in both; here with the user's first picture."""
    p = read_table(spark, sf_dir, "photo_query").where("user_id IS NOT NULL AND attrs IS NOT NULL").dropDuplicates(["photo_id"]).select("photo_id", "user_id", "attrs")
    first = p.groupBy("user_id").agg(F.min_by(F.struct("photo_id", "attrs"), "photo_id").alias("f")).select("user_id", F.col("f.photo_id").alias("first"), F.col("f.attrs").alias("other"))
    j = p.join(first, "user_id").where("photo_id <> first").select("photo_id", "other", F.explode("attrs").alias("k", "x")).withColumn("y", F.try_element_at("other", F.col("k"))).where("y IS NOT NULL")
    clear = lambda c: (F.col(c) >= 0.8) | (F.col(c) <= 0.2)
    same = F.when(clear("x") & clear("y"), ((F.col("x") >= 0.8) == (F.col("y") >= 0.8)).cast("double"))
    return j.groupBy("photo_id").agg(F.round(F.avg(same), 6).alias("agreement"))


@query(
    "vec_arbitration",
    """WITH d AS (SELECT uid, category AS rule, lower(regexp_extract(folders[1], '/([A-Z]+)/', 1)) AS folder, CASE WHEN attrs['stones']['solitaire'] >= 0.5 THEN 'ring' WHEN attrs['stones']['plain'] >= 0.5 THEN 'earrings' END AS model FROM designs)
       SELECT uid, CASE WHEN rule = folder OR rule = model THEN rule WHEN folder = model THEN folder ELSE coalesce(rule, nullif(folder, ''), model) END AS category, CASE WHEN rule = folder AND rule = model THEN 'all' WHEN rule = folder OR rule = model OR folder = model THEN 'two' ELSE 'one' END AS agree FROM d""",
)
def arbitration(spark, sf_dir):
    """VEC-29: a type out of a rule, the folder and a model: two that agree win, else the rule."""
    solitaire, plain = F.col("attrs")["stones"]["solitaire"], F.col("attrs")["stones"]["plain"]
    d = read_table(spark, sf_dir, "designs").select("uid", F.col("category").alias("rule"), F.lower(F.regexp_extract(F.get("folders", F.lit(0)), "/([A-Z]+)/", 1)).alias("folder"), F.when(solitaire >= 0.5, "ring").when(plain >= 0.5, "earrings").alias("model"))
    rf, rm, fm = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("rule", "folder"), ("rule", "model"), ("folder", "model")))
    category = F.when(rf | rm, F.col("rule")).when(fm, F.col("folder")).otherwise(F.coalesce("rule", F.nullif("folder", F.lit("")), "model"))
    return d.select("uid", category.alias("category"), F.when(rf & rm, "all").when(rf | rm | fm, "two").otherwise("one").alias("agree"))
