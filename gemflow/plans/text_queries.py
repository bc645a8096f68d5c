"""Queries of scalar functions and of what users do, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemflow.functions import text as T
from gemflow.functions import vectors as V
from gemflow.operators import behaviour, lexicon, scoring
from gemflow.operators.components import connected_components
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


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, once per id."""
    return read_table(spark, sf_dir, "search_history").select("id", "user_id", "query", "created_at", "understood").dropDuplicates(["id"])


_S = "WITH s AS (SELECT id, any_value(user_id) AS user_id, any_value(query) AS query, any_value(created_at) AS created_at, any_value(understood) AS understood FROM search_history GROUP BY id) "


@query(
    "str_normalise",
    _S + r"""SELECT id, trim(regexp_replace(regexp_replace(replace(lower(query), '’', chr(39)), '[+&(),.;:!?"/\\_|*-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s""",
)
def normalise(spark, sf_dir):
    """STR-S01."""
    return searches(spark, sf_dir).select("id", T.normalise("query").alias("text"))


@query(
    "str_script",
    _S + r""", n AS (SELECT id, len(regexp_extract_all(query, '[\x{0A80}-\x{0AFF}]')) AS g, len(regexp_extract_all(query, '[\x{0900}-\x{097F}]')) AS d, len(regexp_extract_all(query, '[A-Za-z]')) AS a FROM s)
    SELECT id, CASE WHEN d > 0 AND d >= g AND d >= a THEN 'hi' WHEN g > 0 AND g > d AND g >= a THEN 'gu' ELSE 'en' END AS script FROM n""",
)
def script(spark, sf_dir):
    """STR-S04."""
    return searches(spark, sf_dir).select("id", T.script("query").alias("script"))


@query(
    "str_free_words",
    _S + r"""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(query), '([a-z]+)', 1), lambda w: len(w) >= 3 AND w NOT IN ('the', 'for', 'and', 'with', 'please')), ' ') AS words FROM s""",
)
def free_words(spark, sf_dir):
    """STR-S05."""
    return searches(spark, sf_dir).select("id", F.array_join(T.words_left("query", ["the", "for", "and", "with", "please"]), " ").alias("words"))


@query(
    "str_series",
    r"""SELECT uid, coalesce(nullif(regexp_extract(design_id, '^(\d+)#', 1), ''), nullif(upper(regexp_extract(design_id, '^([A-Za-z]+)', 1)), '')) AS series,
        CASE WHEN upper(regexp_extract(design_id, '^(.+)-([A-Za-z]{2,3})$', 2)) IN ('OV', 'PR') THEN regexp_extract(design_id, '^(.+)-[A-Za-z]{2,3}$', 1) ELSE design_id END AS base FROM designs""",
)
def series(spark, sf_dir):
    """STR-S06, STR-S07."""
    d = read_table(spark, sf_dir, "designs")
    return d.select("uid", T.series_of("design_id").alias("series"), T.family_of("design_id", {"OV": "oval", "PR": "princess"})["family"].alias("base"))


# What a listing that is none of the types says, and what names a type, earrings before rings.
_NO_PIECE = r"(?i)\b(gift ?cards?|pouch|cleaner|nose ?pins?|nath|anklets?|payal|toe ?rings?|brooch|watch(?:es)?|sets?|combo|cufflinks?)\b"
_PIECES = [("earrings", r"(?i)\b(ear ?rings?|studs?|hoops?|jhumk[aei]s?)\b"), ("ring", r"(?i)\b(rings?|bands?|bague|anguthi)\b"), ("pendant", r"(?i)\b(pendants?|lockets?)\b"), ("bracelet", r"(?i)\b(bracelets?|bangles?|kadas?|kangan|cuffs?)\b"), ("necklace", r"(?i)\b(necklaces?|chokers?|mangalsutras?|chains?|haar|collier)\b")]
_FLAGS = ", ".join(f"regexp_matches({{0}}, '{p}') AS {k}" for k, p in _PIECES)


@query(
    "str_category_rules",
    f"""WITH w AS (SELECT DISTINCT ON (id) id, title, replace(regexp_replace(url, '^.*/', ''), '-', ' ') AS tags FROM web_designs WHERE title IS NOT NULL),
        f AS (SELECT id, title AS t, title, 1 AS turn, {_FLAGS.format("title")} FROM w UNION ALL SELECT id, tags, title, 2, {_FLAGS.format("coalesce(tags, '')")} FROM w),
        g AS (SELECT id, title, turn, list_filter([CASE WHEN earrings THEN 'earrings' END, CASE WHEN ring AND NOT earrings THEN 'ring' END, CASE WHEN pendant THEN 'pendant' END, CASE WHEN bracelet THEN 'bracelet' END,
              CASE WHEN necklace AND NOT pendant AND NOT ((ring AND NOT earrings OR earrings OR bracelet) AND regexp_matches(t, '(?i)\bchains?\b') AND NOT regexp_matches(t, '(?i)necklace|choker|mangalsutra')) THEN 'necklace' END], lambda x: x IS NOT NULL) AS l FROM f),
        o AS (SELECT a.id, a.title, CASE WHEN len(a.l) > 0 THEN a.l ELSE b.l END AS l, CASE WHEN len(a.l) > 0 THEN 'title' ELSE 'link' END AS source FROM g a JOIN g b ON a.id = b.id AND a.turn = 1 AND b.turn = 2)
        SELECT id, CASE WHEN regexp_matches(title, '{_NO_PIECE}') THEN NULL WHEN regexp_matches(title, '(?i)mangalsutra') THEN 'necklace' WHEN len(l) = 1 THEN l[1] END AS category,
               CASE WHEN NOT regexp_matches(title, '{_NO_PIECE}') AND (len(l) = 1 OR regexp_matches(title, '(?i)mangalsutra')) THEN CASE WHEN regexp_matches(title, '(?i)mangalsutra') THEN 'title' ELSE source END END AS source FROM o""",
)
def category_rules(spark, sf_dir):
    """STR-S08, STR-S09: the type that a title names, else its link; none for other goods and where several are named."""
    w = read_table(spark, sf_dir, "web_designs").where("title IS NOT NULL").dropDuplicates(["id"])
    tags = F.coalesce(F.replace(F.regexp_replace("url", "^.*/", ""), F.lit("-"), F.lit(" ")), F.lit(""))

    def named(text):
        hit = {k: text.rlike(p) for k, p in _PIECES}
        hit["ring"] = hit["ring"] & ~hit["earrings"]
        only_chain = text.rlike(r"(?i)\bchains?\b") & ~text.rlike("(?i)necklace|choker|mangalsutra") & (hit["earrings"] | hit["ring"] | hit["bracelet"])
        hit["necklace"] = hit["necklace"] & ~hit["pendant"] & ~only_chain
        return F.array_compact(F.array(*[F.when(h, k) for k, h in hit.items()]))

    w = w.select("id", "title", named(F.col("title")).alias("a"), named(tags).alias("b"))
    own, first = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.size("a") > 0, "title").otherwise("link")
    fine, wed = ~F.col("title").rlike(_NO_PIECE), F.col("title").rlike("(?i)mangalsutra")
    return w.select("id", F.when(fine, F.when(wed, "necklace").when(F.size(own) == 1, own[0])).alias("category"), F.when(fine, F.when(wed, "title").when(F.size(own) == 1, first)).alias("source"))


@query(
    "str_colours",
    r"""WITH w AS (SELECT DISTINCT ON (id) id, lower(title) AS t FROM web_designs), r AS (SELECT id, t, regexp_replace(t, 'rose gold|white gold|rose|platinum|rhodium', ' ', 'g') AS rest FROM w),
        f AS (SELECT id, t, t LIKE '%rose%' AS rose, regexp_matches(t, 'white gold|platinum|rhodium') AS white, regexp_matches(rest, '\b(yellow|gold|golden)\b') AS yellow, regexp_matches(rest, '\b(silver|sterling|925)\b') AS silver,
              regexp_extract(t, '\b(9|10|14|18|22|24) ?(?:k|kt|karat|carat)\b', 1) AS k FROM r)
        SELECT id, array_to_string(list_filter([CASE WHEN rose THEN 'rose_gold' END, CASE WHEN white OR (silver AND NOT yellow AND NOT rose) THEN 'white_gold' END, CASE WHEN yellow THEN 'yellow_gold' END], lambda c: c IS NOT NULL), '+') AS colours,
        concat_ws(' · ', CASE WHEN k <> '' THEN k || 'KT gold' WHEN regexp_matches(t, '\b(925|sterling silver|pure silver)\b') THEN CASE WHEN t LIKE '%plated%' AND t LIKE '%gold%' THEN '925 silver · gold plated' ELSE '925 silver' END
            WHEN regexp_matches(t, 'plated|plating') THEN CASE WHEN t LIKE '%gold%' THEN 'Gold plated' ELSE 'Plated' END WHEN t LIKE '%silver%' THEN 'Silver' WHEN t LIKE '%platinum%' THEN 'Platinum' END,
        CASE WHEN regexp_matches(t, 'lab[- ]?grown|laboratory grown|lgd') THEN 'Lab-grown diamond' WHEN t LIKE '%moissanite%' THEN 'Moissanite' WHEN regexp_matches(t, '\b(zircon|zirconia|cz)\b') THEN 'Zircon' WHEN t LIKE '%diamond%' THEN 'Diamond' WHEN t LIKE '%pearl%' THEN 'Pearl' END) AS material FROM f""",
)
def colours(spark, sf_dir):
    """STR-S10, STR-S11: metal colours a title names (silver, platinum and rhodium look white), and its material as a label."""
    w = read_table(spark, sf_dir, "web_designs").dropDuplicates(["id"]).select("id", F.lower("title").alias("t"))
    rest = F.regexp_replace("t", "rose gold|white gold|rose|platinum|rhodium", " ")
    has = lambda p, c=F.col("t"): c.rlike(p)
    yellow = has(r"\b(yellow|gold|golden)\b", rest)
    white = has("white gold|platinum|rhodium") | (has(r"\b(silver|sterling|925)\b", rest) & ~yellow & ~has("rose"))
    found = F.array_compact(F.array(F.when(has("rose"), "rose_gold"), F.when(white, "white_gold"), F.when(yellow, "yellow_gold")))
    karat = F.nullif(F.regexp_extract("t", r"\b(9|10|14|18|22|24) ?(?:k|kt|karat|carat)\b", 1), F.lit(""))
    gold = has("gold")
    metal = F.when(karat.isNotNull(), F.concat(karat, F.lit("KT gold"))).when(has(r"\b(925|sterling silver|pure silver)\b"), F.when(has("plated") & gold, "925 silver · gold plated").otherwise("925 silver"))
    metal = metal.when(has("plated|plating"), F.when(gold, "Gold plated").otherwise("Plated")).when(has("silver"), "Silver").when(has("platinum"), "Platinum")
    stone = F.when(has("lab[- ]?grown|laboratory grown|lgd"), "Lab-grown diamond").when(has("moissanite"), "Moissanite").when(has(r"\b(zircon|zirconia|cz)\b"), "Zircon").when(has("diamond"), "Diamond").when(has("pearl"), "Pearl")
    return w.select("id", F.array_join(found, "+").alias("colours"), F.concat_ws(" · ", metal, stone).alias("material"))


@query(
    "str_hashtags",
    r"""WITH w AS (SELECT DISTINCT ON (id) id, regexp_extract_all(replace(title, chr(39), ''), '[A-Za-z0-9]+') AS l FROM web_designs WHERE title IS NOT NULL)
        SELECT id, CASE WHEN len(l) > 0 THEN '#' || array_to_string(list_transform(l[1:4], lambda x: upper(left(x, 1)) || substr(x, 2)), '') ELSE '' END AS tag,
        array_to_string(list_transform(l, lambda x: CASE WHEN length(x) > 3 AND ends_with(lower(x), 's') AND NOT ends_with(lower(x), 'ss') THEN left(lower(x), length(x) - 1) ELSE lower(x) END), ' ') AS singular FROM w""",
)
def hashtags(spark, sf_dir):
    """STR-S20: the first four words as one tag, and all words without the plural."""
    words = F.regexp_extract_all(F.replace("title", F.lit("'"), F.lit("")), F.lit("([A-Za-z0-9]+)"), 1)
    w = read_table(spark, sf_dir, "web_designs").where("title IS NOT NULL").dropDuplicates(["id"]).select("id", words.alias("l"))
    tag = F.concat(F.lit("#"), F.array_join(F.transform(F.slice("l", 1, 4), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1000))), ""))
    one = F.transform("l", lambda x: F.when((F.length(x) > 3) & F.lower(x).endswith("s") & ~F.lower(x).endswith("ss"), F.regexp_replace(F.lower(x), "s$", "")).otherwise(F.lower(x)))
    return w.select("id", F.when(F.size("l") > 0, tag).otherwise("").alias("tag"), F.array_join(one, " ").alias("singular"))


@query(
    "str_slug",
    r"""SELECT id, nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '', 'g'), '') AS slug FROM (SELECT DISTINCT id, title FROM web_designs)""",
)
def slug(spark, sf_dir):
    """STR-S12."""
    return read_table(spark, sf_dir, "web_designs").select("id", "title").distinct().select("id", T.slug("title").alias("slug"))


@query(
    "str_clean",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""",
)
def clean_whole(spark, sf_dir):
    """STR-S13: whole cleaned documents, compared by digest."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text("text", None)).alias("digest"))


@query(
    "str_clean_titles",
    r"""SELECT id, left(trim(regexp_replace(regexp_replace(regexp_replace(title, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')), 30) AS title FROM (SELECT DISTINCT id, title FROM web_designs)""",
)
def clean_titles(spark, sf_dir):
    """STR-S13: a short field, cleaned and cut to what its form takes."""
    return read_table(spark, sf_dir, "web_designs").select("id", "title").distinct().select("id", T.clean_text("title", 30).alias("title"))


@query(
    "str_numbers",
    r"""SELECT uid, 'DF-' || CASE WHEN length(CAST(uid * 37 AS VARCHAR)) >= 5 THEN CAST(uid * 37 AS VARCHAR) ELSE lpad(CAST(uid * 37 AS VARCHAR), 5, '0') END AS no,
        CASE WHEN uid % 3 = 0 THEN NULL ELSE '+91' || lpad(CAST(uid AS VARCHAR), 10, '9') END AS phone FROM designs""",
)
def numbers(spark, sf_dir):
    """STR-S14, STR-S15: numbers that keep all digits, phones only with country code."""
    d = read_table(spark, sf_dir, "designs").select("uid", (F.col("uid") * 37).alias("n"))
    raw = F.when(F.col("uid") % 3 == 0, F.lit("98 200")).otherwise(F.concat(F.lit("00 91 ("), F.lpad(F.col("uid").cast("string"), 10, "9"), F.lit(")")))
    return d.select("uid", T.numbered("DF", "n").alias("no"), T.phone(raw).alias("phone"))


@query(
    "str_paths",
    r"""WITH w AS (SELECT DISTINCT id, folder, pictures FROM web_designs WHERE json_valid(pictures) AND json_type(pictures) = 'ARRAY' AND folder IS NOT NULL),
        p AS (SELECT id, folder || '/' || file AS p FROM (SELECT id, folder, unnest(from_json(pictures, '["JSON"]')) ->> 'file' AS file FROM w) WHERE file IS NOT NULL)
        SELECT id, p AS path, regexp_replace(p, '/[^/]*$', '') AS folder, CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS INTEGER) AS depth, lower(list_last(string_split(p, '.'))) AS ext,
        CASE WHEN lower(list_last(string_split(p, '.'))) IN ('png', 'jpg', 'jpeg', 'webp', 'gif') THEN 'picture' WHEN lower(list_last(string_split(p, '.'))) IN ('mp4', 'mov', 'webm') THEN 'video'
             WHEN lower(list_last(string_split(p, '.'))) IN ('glb', '3dm', 'stl') THEN 'model' ELSE 'other' END AS kind FROM p""",
)
def paths(spark, sf_dir):
    """STR-S16, STR-S17: folder, depth, extension and kind of the files of scraped pages."""
    w = read_table(spark, sf_dir, "web_designs").select("id", "folder", "pictures").distinct().where(F.try_parse_json("pictures").isNotNull() & F.ltrim("pictures").startswith("[") & F.col("folder").isNotNull())
    p = w.select("id", "folder", F.explode(F.from_json("pictures", "array<struct<file:string>>")).alias("f")).where("f.file IS NOT NULL").select("id", F.concat("folder", F.lit("/"), "f.file").alias("path"))
    return p.select("id", "path", T.folder_of("path").alias("folder"), T.depth("path").alias("depth"), T.extension("path").alias("ext"), T.kind_of("path").alias("kind"))


@query(
    "str_urls",
    r"""SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/'))), '[^a-z]+'), lambda w: len(w) >= 3), ' ') AS words,
        url || '?width=600' AS sized FROM (SELECT DISTINCT id, url FROM web_designs)""",
)
def urls(spark, sf_dir):
    """STR-S20, STR-S23: words of a link, link with a width."""
    return read_table(spark, sf_dir, "web_designs").select("id", "url").distinct().select("id", F.array_join(T.url_words("url"), " ").alias("words"), T.sized_url("url", 600).alias("sized"))


@query(
    "str_money",
    r"""WITH p AS (SELECT DISTINCT id, CASE WHEN json_valid(original) THEN json_extract_string(original, '$.price_text') END AS t FROM web_designs)
        SELECT id, CASE WHEN TRY_CAST(replace(regexp_extract(t, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DECIMAL(14,2)) > 0 THEN CAST(TRY_CAST(replace(regexp_extract(t, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DECIMAL(14,2)) AS DOUBLE) END AS amount
        FROM p WHERE t IS NOT NULL""",
)
def money(spark, sf_dir):
    """STR-S24, JS-01: first amount of a price text taken out of JSON."""
    p = read_table(spark, sf_dir, "web_designs").select("id", F.get_json_object("original", "$.price_text").alias("t")).distinct().where("t IS NOT NULL")
    return p.select("id", T.money("t").cast("double").alias("amount"))


@query(
    "str_size_label",
    r"""SELECT p_partkey, CAST(p_size AS VARCHAR) || ' × ' || regexp_replace(printf('%.2f', p_size / 4.0), '\.?0+$', '') || ' mm' AS label FROM part""",
)
def size_label(spark, sf_dir):
    """STR-S25: every part."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", T.size_label(F.concat(F.format_string("%.2f", F.col("p_size").cast("double")), F.lit("X"), F.format_string("%.2f", F.col("p_size") / 4))).alias("label"))


@query(
    "str_budget",
    _S + r""", b AS (SELECT id, query, regexp_extract(query, '(?i)\b(?:under|below|upto|up to|within|less than)\s+(?:rs\.?|inr|₹)?\s*(\d[\d,]*)(?:\s*(k|lakh|lakhs|thousand))?\b', ['n', 'u']) AS m FROM s)
    SELECT id, CAST(replace(m.n, ',', '') AS BIGINT) * CASE lower(m.u) WHEN 'k' THEN 1000 WHEN 'thousand' THEN 1000 WHEN 'lakh' THEN 100000 WHEN 'lakhs' THEN 100000 ELSE 1 END AS budget FROM b WHERE m.n <> ''""",
)
def budget(spark, sf_dir):
    """FLT-25: the price limit a text names."""
    return searches(spark, sf_dir).select("id", T.budget("query").alias("budget")).where("budget IS NOT NULL")


CLAIMS = [r"\bfree\b", r"\d+(\.\d+)? (ct|carats?|grams?)\b", r"\blifetime\b", r"\bhand\b"]


@query(
    "str_sentence_scrub",
    r"""WITH d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?।] ')) AS s, lower(coalesce(source, '')) || ' 18 grams, by hand' AS f FROM documents WHERE text IS NOT NULL),
       c(rx) AS (VALUES ('\bfree\b'), ('\d+(\.\d+)? (ct|carats?|grams?)\b'), ('\blifetime\b'), ('\bhand\b')),
       claims AS (SELECT DISTINCT doc_id, s, rx, f FROM d, c WHERE regexp_matches(s, rx)),
       bad AS (SELECT DISTINCT doc_id, s FROM claims WHERE NOT regexp_matches(f, rx)
               OR len(list_filter(regexp_extract_all(array_to_string(regexp_extract_all(s, rx), ' '), '\d+(?:\.\d+)?'), lambda n: NOT list_contains(regexp_extract_all(f, '\d+(?:\.\d+)?'), n))) > 0)
       SELECT d.doc_id, count(*) FILTER (bad.s IS NULL) AS kept, count(*) AS sentences FROM d LEFT JOIN bad ON bad.doc_id = d.doc_id AND bad.s = d.s GROUP BY d.doc_id""",
)
def scrub(spark, sf_dir):
    """FLT-22: sentences that make a claim are dropped, unless the facts make the same one with the same numbers."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    d = d.select("doc_id", F.split(F.lower("text"), r"[.!?।] ").alias("p"), F.concat(F.lower(F.coalesce("source", F.lit(""))), F.lit(" 18 grams, by hand")).alias("f"))
    kept = F.filter("p", lambda s: ~T.unbacked(s, F.col("f"), CLAIMS))
    return d.select("doc_id", F.size(kept).cast("long").alias("kept"), F.size("p").cast("long").alias("sentences"))


@query("str_html_plain")
def html_plain(spark, sf_dir):
    """STR-S18: HTML to text in Arrow batches, over the documents as they are."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.length(T.plain_html(F.col("text"))).alias("n"))


@query("str_osa_spelling")
def osa_spelling(spark, sf_dir):
    """STR-S02, JOIN-19: words of searches to the nearest vocabulary word with the same first letter."""
    words = searches(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("query"), F.lit(r"\b([a-z]{4,})\b"), 1)).alias("word")).distinct()
    vocab = spark.createDataFrame([(t,) for t in sorted({w for t, k, _ in lexicon.SAMPLE for w in t.split() if w.isascii() and len(w) >= 4})], "known string")
    limit = F.when(F.length("word") <= 5, 1).otherwise(2)
    pairs = words.join(vocab.select(F.col("known").alias("word")), "word", "left_anti")
    near = pairs.join(vocab, F.left("word", F.lit(1)) == F.left("known", F.lit(1))).where(F.levenshtein("word", "known") <= 2 * limit)
    scored = near.withColumn("d", T.osa(F.col("word"), F.col("known"), limit)).where(F.col("d") <= limit)
    return scored.groupBy("word").agg(F.min(F.struct("d", "known")).alias("b")).select("word", F.col("b.known").alias("known"), F.col("b.d").alias("distance"))


@query("ql_parse")
def parse(spark, sf_dir):
    """QL-01..QL-04, JOIN-18: searches to structured queries by a small lexicon."""
    p = lexicon.parse(searches(spark, sf_dir), "id", "query")
    joined = {c: F.array_join(c, "+").alias(c) for c in ("categories", "not_categories", "metals", "not_metals", "intents", "not_intents")}
    return p.select("id", "category", *joined.values(), "metal", "shape", "leftover", "free_text")


@query(
    "ql_completions",
    """SELECT DISTINCT query AS term, CAST(1 AS INTEGER) AS tail_words FROM search_history WHERE starts_with(query, 'rose') AND query <> 'rose' ORDER BY tail_words DESC, length(query), query LIMIT 8""",
)
def completions(spark, sf_dir):
    """QL-08: what continues the words typed."""
    v = searches(spark, sf_dir).select(F.col("query").alias("term")).distinct()
    return lexicon.completions(v, "rose")


@query(
    "ql_caption",
    """SELECT uid, concat_ws(' ', array_to_string(list_sort(metals), ' and '), category, CASE WHEN has_cad THEN 'with model' END) AS caption FROM designs""",
)
def caption(spark, sf_dir):
    """QL-05, STR-S21: a caption out of parts that are there."""
    d = read_table(spark, sf_dir, "designs")
    return d.select("uid", F.concat_ws(" ", F.array_join(F.array_sort("metals"), " and "), "category", F.when(F.col("has_cad"), "with model")).alias("caption"))


# --- behaviour

NOW = "2019-01-21"


def _weight(half_life: float):
    return T.decay(T.age_days("created_at", NOW), half_life)


_W = "coalesce(greatest(0.0, (epoch_us(TIMESTAMP '2019-01-21') - epoch_us(created_at)) / 86400e6), 365.0)"


@query("dt_age_decay", _S + f"SELECT id, round({_W}, 6) AS age, round(pow(0.5, {_W} / 14), 6) AS weight FROM s")
def age_decay(spark, sf_dir):
    """DT-01, DT-02."""
    return searches(spark, sf_dir).select("id", F.round(T.age_days("created_at", NOW), 6).alias("age"), F.round(_weight(14), 6).alias("weight"))


@query(
    "dt_buckets",
    _S + "SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (created_at > TIMESTAMPTZ '2019-01-14 00:00:00+00') AS recent FROM s GROUP BY 1",
)
def day_buckets(spark, sf_dir):
    """DT-03, DT-04, DT-06."""
    s = searches(spark, sf_dir)
    return s.groupBy(F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("created_at") > F.lit("2019-01-14 00:00:00").cast("timestamp")).alias("recent"))


@query(
    "agg_profile_share",
    _S + f""", e AS (SELECT user_id, unnest(understood.intents) AS value, pow(0.5, {_W} / 14) / len(understood.intents) AS w FROM s WHERE user_id IS NOT NULL AND len(understood.intents) > 0),
    g AS (SELECT user_id, value, sum(w) AS w FROM e GROUP BY 1, 2) SELECT user_id, value, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS share FROM g""",
)
def profile_share(spark, sf_dir):
    """AGG-19, AGG-20: what a user looks for, as shares of decayed weight."""
    p = behaviour.profile(searches(spark, sf_dir).where("size(understood.intents) > 0"), "user_id", F.col("understood.intents"), _weight(14))
    return p.select("user_id", "value", F.round("share", 6).alias("share"))


@query(
    "agg_by_meaning",
    _S + f""", m AS (SELECT user_id, understood.category AS category, understood.metal AS metal, created_at, query, pow(0.5, {_W} / 14) AS w FROM s)
    SELECT user_id, category, metal, count(*) AS n, round(sum(w), 6) AS weight FROM m GROUP BY 1, 2, 3""",
)
def by_meaning(spark, sf_dir):
    """AGG-21: searches of one meaning as one row."""
    s = searches(spark, sf_dir).withColumn("category", F.col("understood.category")).withColumn("metal", F.col("understood.metal"))
    return behaviour.by_meaning(s, "user_id", ["category", "metal"], _weight(14), "query", "created_at").select("user_id", "category", "metal", "n", F.round("weight", 6).alias("weight"))


@query(
    "agg_popularity_having",
    _S + f""", m AS (SELECT user_id, understood.category AS category, understood.metal AS metal, pow(0.5, {_W} / 7) AS w FROM s WHERE user_id IS NOT NULL AND understood.refused IS NULL),
    g AS (SELECT category, metal, sum(w) AS score, count(DISTINCT user_id) AS users FROM m GROUP BY 1, 2 ORDER BY round(sum(w), 9) DESC, category NULLS FIRST, metal NULLS FIRST LIMIT 30)
    SELECT category, metal, round(score, 6) AS score, users, round(ln(1 + score), 6) AS popularity FROM g WHERE users >= 2""",
)
def popularity(spark, sf_dir):
    """AGG-22: popular meanings of at least two users, the limit before the condition."""
    s = searches(spark, sf_dir).where("understood.refused IS NULL").withColumn("category", F.col("understood.category")).withColumn("metal", F.col("understood.metal"))
    p = behaviour.popular(s, ["category", "metal"], "user_id", _weight(7))
    return p.select("category", "metal", F.round("score", 6).alias("score"), "users", F.round("popularity", 6).alias("popularity"))


@query(
    "agg_repeat_rate",
    _S + "SELECT user_id, round(1 - count(DISTINCT query) / count(*), 6) AS rate FROM s WHERE user_id IS NOT NULL AND query IS NOT NULL GROUP BY user_id HAVING count(*) >= 4",
)
def repeat_rate(spark, sf_dir):
    """AGG-23."""
    r = behaviour.repeat_rate(searches(spark, sf_dir).where("query IS NOT NULL"), "user_id", ["query"])
    return r.select("user_id", F.round("rate", 6).alias("rate"))


# --- arrays, JSON, hashes, grids


@query(
    "arr_map_explode",
    """SELECT uid, g.key || ':' || a.key AS attr, a.value AS p FROM (SELECT uid, g, unnest(map_entries(g.value)) AS a FROM (SELECT uid, unnest(map_entries(attrs)) AS g FROM designs))""",
)
def map_explode(spark, sf_dir):
    """AR-05: nested maps to rows."""
    d = read_table(spark, sf_dir, "designs").select("uid", F.explode("attrs").alias("g", "m"))
    return d.select("uid", "g", F.explode("m").alias("a", "p")).select("uid", F.concat_ws(":", "g", "a").alias("attr"), "p")


@query(
    "arr_argmax_share",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, list_transform(v, lambda x: x - list_min(v)) AS p FROM e)
       SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best, round(list_max(p) / list_sum(p), 6) AS share FROM p""",
)
def argmax_share(spark, sf_dir):
    """AR-01, AR-02, MA-01: the largest element and its share of the sum of all."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.select("vec_id", F.transform("v", lambda x: x - F.array_min("v")).alias("p"))
    return p.select("vec_id", V.argmax(F.col("p")).alias("best"), F.round(F.array_max(V.share("p")), 6).alias("share"))


@query(
    "arr_combine",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY i),
       b AS (SELECT list(x ORDER BY i) AS base FROM m), c AS (SELECT vec_id, list_transform(list_zip(v[1:32], v[33:64], base[1:32]), lambda z: z[1] - 0.5 * z[2] - 0.5 * z[3]) AS c FROM e, b)
       SELECT vec_id, round(list_max(c) / sqrt(list_dot_product(c, c)), 6) AS most, round(1 / (1 + exp(-list_max(c))), 6) AS p FROM c""",
)
def combine(spark, sf_dir):
    """AR-03, MA-03, VEC-02: text less half of what is unwanted less half of the base, brought to unit length; sigmoid."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    base = scoring.mean_vectors(e.withColumn("_all", F.lit(1)), "_all", "v", renormalise=False).select(F.col("vec").alias("base"))
    halves = e.crossJoin(F.broadcast(base)).select("vec_id", V.scale_sum(F.slice("v", 1, 32), 1.0, F.slice("v", 33, 32), -0.5).alias("c"), F.slice("base", 1, 32).alias("base"))  # base: one row
    c = halves.select("vec_id", V.scale_sum("c", 1.0, "base", -0.5).alias("c"))
    return c.select("vec_id", F.round(F.array_max(V.normalise("c")), 6).alias("most"), F.round(V.sigmoid(F.array_max("c")), 6).alias("p"))


@query(
    "arr_stride_pairs",
    """WITH c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS i FROM (SELECT DISTINCT category FROM designs WHERE category IS NOT NULL))
       SELECT a.category AS a, b.category AS b FROM c a JOIN c b ON b.i > a.i AND (b.i - a.i - 1) % 3 = 0""",
)
def stride_pairs(spark, sf_dir):
    """AR-07: pairs with a stride, over a handful of types."""
    c = read_table(spark, sf_dir, "designs").where("category IS NOT NULL").agg(F.array_sort(F.collect_set("category")).alias("l")).select(F.posexplode("l").alias("i", "category"))
    a, b = c.select(F.col("i").alias("ia"), F.col("category").alias("a")), c.select(F.col("i").alias("ib"), F.col("category").alias("b"))
    return a.join(b, (F.col("ib") > F.col("ia")) & ((F.col("ib") - F.col("ia") - 1) % 3 == 0)).select("a", "b")


@query(
    "arr_grid_regions",
    """WITH RECURSIVE cell AS (SELECT p_partkey AS id, p_partkey // 40 AS r, p_partkey % 40 AS c FROM part WHERE p_size > 30),
       edge AS (SELECT a.id AS a, b.id AS b FROM cell a JOIN cell b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
       reach AS (SELECT id, id AS other FROM cell UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
       comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
       SELECT component, count(*) AS n, min(r) AS top, max(r) AS bottom FROM comp JOIN cell USING (id) GROUP BY component HAVING count(*) > 1""",
)
def grid_regions(spark, sf_dir):
    """AR-08, VEC-26, AGG-36: connected regions of a grid with their boxes."""
    cells = read_table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 40).alias("r"), (F.col("p_partkey") % 40).alias("c"))
    around = cells.select(F.col("id").alias("b"), F.explode(F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_n"))
    edges = cells.join(around.select("b", "_n.r", "_n.c"), ["r", "c"]).where("id <> b").select(F.col("id").alias("a"), "b")
    comp = connected_components(edges)
    return comp.join(cells, "id").groupBy("component").agg(F.count("*").alias("n"), F.min("r").alias("top"), F.max("r").alias("bottom"))


@query(
    "arr_quantile_box",
    """SELECT label, round(quantile_cont(embedding[1]::DOUBLE, 0.003), 6) AS x0, round(quantile_cont(embedding[1]::DOUBLE, 0.997), 6) AS x1, round(avg(CASE WHEN embedding[2] > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM embeddings GROUP BY label""",
)
def quantile_box(spark, sf_dir):
    """AR-09, AR-10, AR-11: quantile box and share of a test."""
    x = F.col("embedding")[0].cast("double")
    return read_table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.round(F.percentile(x, 0.003), 6).alias("x0"), F.round(F.percentile(x, 0.997), 6).alias("x1"), F.round(F.avg((F.col("embedding")[1] > 0).cast("double")), 6).alias("share"))


@query(
    "js_first_offer",
    r"""WITH b AS (SELECT DISTINCT id, original FROM brand_designs WHERE json_valid(original) AND json_type(original) = 'OBJECT')
        SELECT id, json_extract_string(original, '$.sku') AS sku, json_extract_string(original, '$.via') AS via FROM b""",
)
def first_offer(spark, sf_dir):
    """JS-01, JS-03: fields of readable JSON objects."""
    v = F.try_parse_json("original")
    b = read_table(spark, sf_dir, "brand_designs").select("id", "original", v.alias("v")).where("v IS NOT NULL").where(F.ltrim("original").startswith("{"))
    return b.select("id", F.get_json_object("original", "$.sku").alias("sku"), F.get_json_object("original", "$.via").alias("via")).distinct()


@query("js_almost_json")
def almost_json(spark, sf_dir):
    """JS-04: titles out of JSON texts that break off, by their pairs."""
    b = read_table(spark, sf_dir, "brand_designs").select("id", "original").where("original IS NOT NULL").distinct()
    whole = F.get_json_object("original", "$.title")
    part = F.regexp_extract("original", r'"title"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return b.select("id", F.coalesce(whole, F.nullif(part, F.lit(""))).alias("title"))


@query(
    "hs_fold",
    """WITH RECURSIVE h AS (SELECT uid, sha1(family) AS h, 0 AS i, CAST(0 AS BIGINT) AS a FROM designs UNION ALL
       SELECT uid, h, i + 1, (a * 16 + (position(substr(h, i + 1, 1) IN '0123456789abcdef') - 1)) % 5 FROM h WHERE i < 40) SELECT uid, a AS fold FROM h WHERE i = 40""",
)
def fold(spark, sf_dir):
    """HS-02: stable fold of a family."""
    return read_table(spark, sf_dir, "designs").select("uid", T.hash_fold("family").alias("fold"))


@query(
    "hs_index_key",
    """WITH l AS (SELECT row_number() OVER (ORDER BY uid, design_id) - 1 AS n, sha1(design_id || '|' || coalesce(folders[1], '')) AS h FROM designs),
       a AS (SELECT n // 1024 AS k, sha1(string_agg(h, chr(10) ORDER BY n)) AS h FROM l GROUP BY 1),
       b AS (SELECT k // 1024 AS k2, sha1(string_agg(h, chr(10) ORDER BY k)) AS h FROM a GROUP BY 1)
       SELECT sha1(string_agg(h, chr(10) ORDER BY k2)) AS index_key FROM b""",
)
def index_key(spark, sf_dir):
    """HS-01: fingerprint of an ordered index, as a tree of digests of 1024 each."""
    d = read_table(spark, sf_dir, "designs")
    line = F.concat("design_id", F.lit("|"), F.coalesce(F.get("folders", F.lit(0)), F.lit("")))
    return T.tree_digest(d.select("uid", "design_id", F.sha1(line).alias("h")), ["uid", "design_id"], "h").select(F.col("h").alias("index_key"))


@query(
    "ma_rounding",
    """WITH c AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, CAST(round(p_retailprice * 1000) AS BIGINT) AS mills FROM part),
       r AS (SELECT p_partkey, cents * 925 // 1000 AS q, cents * 925 % 1000 AS rest, mills FROM c)
       SELECT p_partkey, (q + CASE WHEN rest > 500 OR (rest = 500 AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS half_even, (mills + 500) // 1000 AS whole FROM r""",
)
def rounding(spark, sf_dir):
    """MA-09, MA-10: rate of a purity, half to even; whole amounts, half up."""
    p = read_table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(14,2)")
    return p.select("p_partkey", F.bround(price * F.lit(0.925).cast("decimal(4,3)"), 2).cast("double").alias("half_even"), F.round(F.col("p_retailprice").cast("decimal(14,3)"), 0).cast("long").alias("whole"))


@query(
    "ma_box_overlap",
    """WITH b AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s FROM part)
       SELECT id, round(greatest(0, least(s, 30) - 10) * greatest(0, least(s, 30) - 10) / (s * s + 400 - greatest(0, least(s, 30) - 10) * greatest(0, least(s, 30) - 10)), 6) AS iou FROM b""",
)
def box_overlap(spark, sf_dir):
    """MA-05."""
    z, t, x = F.lit(0.0), F.lit(10.0), F.lit(30.0)
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"))
    return p.select("id", F.round(V.box_overlap(z, z, F.col("s"), F.col("s"), t, t, x, x), 6).alias("iou"))
