import json

import pytest
from pyspark.sql import functions as F

from gemflow.llm import languages, products, quality


@pytest.fixture(scope="module")
def model():
    texts, labels = [], []
    for lang, block in languages.SEEDS.items():
        for phrase in block.split(";"):
            texts.append(phrase.strip())
            labels.append(lang)
    return languages.train(texts, labels, rounds=80)


HELD_OUT = [
    ("something light for my wife please", ["en"]), ("je voudrais une bague avec une pierre pour ma mère", ["fr"]), ("quiero una pulsera para mi hermana", ["es"]), ("ein Ring aus Silber für meine Mutter", ["de"]),
    ("mujhe biwi ke liye sasti payal dikhao", ["hi-latn"]), ("mane dikri mate vinti joiye chhe", ["gu-latn"]), ("मुझे बेटी के लिए हार दिखाओ", ["hi"]), ("मला बायकोसाठी हार पाहिजे", ["mr"]), ("મને લગ્ન માટે વીંટી બતાવો", ["gu"]),
    ("எனக்கு வெள்ளி வளையல் வேண்டும்", ["ta"]), ("please show me a ring for my mother, मुझे हार चाहिए", ["en", "hi"]), ("what is the price of this one / je cherche une chaîne pour ma femme", ["en", "fr"]),
    ("gold ki halki ring dikhao", ["hi-latn"]), ("18kt 2.5 gm", []), ("DJ-50303 #12 ₹95435", []), ("💍💍 ???", []), ("", []), (None, []),
]


def test_held_out_phrases(model):
    right = sum(sorted({p[0] for p in model.segment(t)}) == want for t, want in HELD_OUT)
    assert right >= len(HELD_OUT) - 1
    assert all(0 < p[1] <= 1 for t, _ in HELD_OUT for p in model.segment(t))


def test_codewords_lie_far_apart():
    code = languages.codewords()
    apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= 11 and abs(code.sum(axis=0)).max() < len(code)


def test_long_texts_and_labels(model):
    assert [p[0] for p in model.segment("show me something simple " * 3000)] == ["en"]
    assert [languages.label_of(x) for x in ("EN", "en-IN", "hi-Latn", "", None, "GU_IN", " fr ")] == ["en", "en", "hi-latn", None, None, "gu", "fr"]


def test_rows_with_wrong_or_missing_labels(spark, model):
    rows = [(1, "please show me a ring", "en", "x"), (1, "please show me a ring", "en", "x"), (2, "please show me a ring", None, "x"), (3, "mujhe haar chahiye", "EN", "x"), (4, "₹500", None, "x"), (5, None, "en", "x"), (None, "show me", None, "x"), (6, "मुझे हार चाहिए", "hi-IN", "x")]
    df = spark.createDataFrame(rows, "id long, query string, lang string, label string")
    found = languages.identify(df, model)
    assert sorted(map(tuple, languages.mislabelled(found).collect())) == [(2, "en"), (3, "hi-latn")]
    assert languages.identify(df.limit(0), model).count() == 0


def page(i, title, brand, specs, sku="S-1", site="shop.test", description=""):
    return (i, title, brand, site, json.dumps({"title": title, "sku": sku, "description": description, "specs": [{"label": a, "value": b} for a, b in specs]}), None)


PAGES = [
    page(1, "Rose Gold 18 KT Ring Vunesero", "Kefazur", [("Net Weight", "2.764 g"), ("Diamond Wt.", "0.55 ct"), ("No. of Diamonds", "21")]),
    page(2, "RG Au750 bague The Vuensero New Arrival", "Kefzauar", [("Gold wt", "1.777 dwt"), ("Stone Weight", "55 points")]),
    page(3, "Finger Ring Pink Gold", "KEFAZUR (Official)", [("Karat", "750"), ("Gold Weight", "2.76gms"), ("Stone Wt.", "0.550 cts"), ("Number of stones", "21")]),
    page(4, "White Gold 18 KT Ring Vunesero", "Kefazur", [("Net Weight", "2.764 g"), ("Diamond Wt.", "0.55 ct")]),
    page(5, "Rose Gold 18 KT Ring Vunesero", "Kefazur", [("Net Weight", "3.1 g"), ("Diamond Wt.", "0.95 ct"), ("No. of Diamonds", "40")]),
    page(6, "Ring", "", [("Item code", "KE5154786R14C")]), page(7, "Band", None, [], sku="ke5154786r14c"), page(8, "Band", None, [("Model", "KE5154786R14A")]),
    (9, None, None, None, None, None), (10, "", "", "", "{broken", None), page(11, "Emerald pendant", "Other", []),
]


def test_groups_of_listings(spark):
    schema = "id long, title string, brand string, site string, original string, updated_at timestamp"
    df = spark.createDataFrame([*PAGES, PAGES[0]], schema).withColumn("group_id", F.lit("clash"))
    groups = products.group_listings(df)
    got = {r.id: r.group_id for r in groups.collect()}
    assert {i: got[i] for i in (1, 2, 3)} == {1: 1, 2: 1, 3: 1} and got[6] == got[7] == 6
    assert len({got[i] for i in (1, 4, 5, 6, 8, 9, 10, 11)}) == 8
    assert sorted(map(tuple, products.pairs_of(groups).collect())) == [(1, 2), (1, 3), (2, 3), (6, 7)]
    assert products.group_listings(df.limit(0)).count() == 0


def test_copies_of_one_listing_are_one_group(spark):
    schema = "id long, title string, brand string, site string, original string, updated_at timestamp"
    df = spark.createDataFrame([(100 + i, *PAGES[0][1:]) for i in range(300)] + PAGES, schema)
    got = {r.id: r.group_id for r in products.group_listings(df).collect()}
    assert {got[100 + i] for i in range(300)} == {1}


def test_pivot_rounds_cover_every_vertex(spark):
    edges = [(i, j) for c in range(5) for i in range(c * 10, c * 10 + 10) for j in range(i + 1, c * 10 + 10)]
    v = spark.createDataFrame([(i,) for i in range(52)], "id long")
    got = {r.id: r.pivot for r in products.pivot_rounds(v, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 52 and all(len({got[i] for i in range(c * 10, c * 10 + 10)}) == 1 for c in range(5)) and got[50] == 50


ATTRS = "id long, code string, brand string, names array<string>, colour string, purity int, count int, stone array<double>, gold array<double>, gross array<double>, width array<double>, height array<double>, kind string"


def in_tasks(spark, reps, pairs):
    nodes = reps.join(products.connected_components(pairs), "id")
    return products.settled_in_tasks(nodes, pairs.join(nodes.select(F.col("id").alias("a"), "component"), "a"))


def test_components_are_settled_alike_in_tasks_and_in_spark(spark):
    one = [(i, None, None, ["aurelia"], "yellow", 18, None, [0.5, 0.6], [4 + i / 200, 4.3 + i / 200], None, None, None, "ring") for i in range(30)]
    two = [(i, None, None, ["mirabel"], "white", 14, c, [0.3, 0.4], [3.0 + i / 1e4, 3.2], None, None, None, "ring") for i, c in ((100, 1), (101, None), (102, 2))]
    mixed = [(200 + i, None, ["kefa", "borun", None][i % 3], [["selen"], ["marko"], []][i * 7 % 3], ["rose", None, "white"][i * 5 % 3], 18, [None, 3, 4][i // 3 % 3], [0.2 + i % 7 / 10, 0.25 + i % 7 / 10], [2 + i % 5 / 3, 2.4 + i % 5 / 3], None, None, None, None) for i in range(120)]
    reps = spark.createDataFrame(one + two + mixed, ATTRS)
    pairs = products.materialise(products.neighbours(reps))
    got = {r.id: r.pivot for r in products.star_rounds(reps, pairs).collect()}
    assert {got[i] for i in range(30)} == {0}
    assert got[100] != got[102] and got[101] in (got[100], got[102])
    inside = {r.id: r.pivot for r in in_tasks(spark, reps, pairs).collect()}
    assert len(inside) > 100 and all(got[i] == p for i, p in inside.items()) and all(got[i] == i for i in got.keys() - inside.keys())


def test_one_product_on_three_thousand_pages_is_one_group(spark):
    schema = "id long, title string, brand string, site string, original string, updated_at timestamp"
    words = ["".join(chr(97 + (i // 26**k + k * (i % 5 + 3)) % 26) for k in range(6)) + "o" for i in range(3000)]
    rows = [(i, f"Aurelia {w} ring 18k yellow gold 4.00 g diamond 0.50 ct", None, "a.example", None, None) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, schema)
    for most in (products.IN_TASK, 16):
        got = {r.id: r.group_id for r in products.group_listings(df, in_task=most).collect()}
        assert len(got) == 3000 and set(got.values()) == {0}


def test_pages_that_state_too_little_stay_apart(spark):
    schema = "id long, title string, brand string, site string, original string, updated_at timestamp"
    df = spark.createDataFrame([page(i, "Ring", None, [("Width", "21 mm")]) for i in range(40)], schema)
    assert {r.id: r.group_id for r in products.group_listings(df).collect()} == {i: i for i in range(40)}


PROSE = "We asked the caster to weigh the link again because the opal moved a little under the loupe. It took three weeks to learn how, and the box had a dent."
LIST = "\n".join(f"- {a} {b}" for a in ("silver", "heavy", "plain") for b in ("ring", "clasp", "bangles"))
TABLE = "Code,Metal,Weight\n" + "\n".join(f"K{i}012,rose gold,{i}.5" for i in range(9))
JUNK = ["fzgtmlah. wgltrlvqc, bbn wskbdgc, nghhcmbd dacc vagmtwtsrcvxd rsktabjvtvhktq.", "✦✦!!!!%%%%---===♥♥♥", "<li><a href=\"#1\"><div class=\"c4\">function(e){return e.t9()}&nbsp;&nbsp;</div></li>",
        "m/SiWTHfuV7zA35/DOWs9Pr58UNHWHbKN2/sE9UYM/EYtd/WD4RGakrSP6Sh5A6vHyk9ZO742", "It we!Oh| 6^ll gr ms!O n O4k ros' gold, w^Och i! l1~ht'r t^a1 O0^1heavy^!|deO"]


@pytest.mark.parametrize("text,kind", [(PROSE, "prose"), (LIST, "list"), (TABLE, "table"), *[(j, "junk") for j in JUNK], ("Metal : gold\nPurity : 22K\nStones : 46", "table"), ("A: is it real\nB: yes it is, we have 35 left", "prose"), ("मेरी माँ को यह हार बहुत अच्छा लगा, लेकिन डिब्बा टूटा हुआ था।", "prose")])
def test_what_a_text_reads_as(text, kind):
    r = quality.read_text(text)
    assert max(("prose", "list", "table", "junk"), key=lambda k: r[f"{k}_share"]) == kind


def test_tails_are_exact_shares_and_kinds_follow(spark):
    rows = [(i, PROSE + f" Order {i} came on time.") for i in range(60)] + [(100 + i, LIST) for i in range(8)] + [(200 + i, TABLE) for i in range(6)] + [(300 + i, j) for i, j in enumerate(JUNK)]
    rows += [(400, ""), (401, None), (None, PROSE), (1, rows[1][1]), (402, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    stats = quality.text_statistics(df)
    pdf = stats.toPandas()
    assert pdf["doc_id"].is_unique and 401 not in set(pdf["doc_id"])
    tails = [r for r in quality.tail_probabilities(stats).collect() if r.language == "*"]
    for r in tails:
        assert abs(r.tail - (pdf[r.statistic] >= r.value - 1e-9).mean()) < 1e-12
    kinds = {r.doc_id: r.kind for r in quality.text_kinds(df).collect()}
    assert {kinds[i] for i in range(60)} == {"prose"} and {kinds[100 + i] for i in range(8)} == {"list"} and {kinds[200 + i] for i in range(6)} == {"table"} and {kinds[300 + i] for i in range(5)} == {"junk"}
    assert quality.text_kinds(df.limit(0)).count() == 0


def test_batches_read_as_single_texts_and_tails_decide(spark, monkeypatch):
    texts = [PROSE, LIST, TABLE, *JUNK, "", "  \n ", "Karat", "ये अंगूठी सोने की है और बहुत हल्की है।", "la bague est en or et elle est dans la boîte."]
    assert quality.Reader(kept=5).read(texts) == [quality.read_text(t) for t in texts]
    assert [quality.read_text(t)["language"] for t in texts[-3:]] == ["en", "hi", "fr"] and quality.read_text("12 %% 7")["language"] == "none"
    assert quality.read_text("It was heavy and she sent it back. " * 30)["broken_share"] == 1.0
    df = spark.createDataFrame([(i, PROSE + f" Order {i} came on time.") for i in range(60)] + [(100 + i, LIST) for i in range(20)], "doc_id long, text string")
    assert quality.text_kinds(df).where("kind = 'list'").count() == 20
    monkeypatch.setattr(quality, "outlier_scores", lambda s: s.withColumn("outlier", F.lit(0.0)))
    assert quality.text_kinds(df).where("kind = 'list'").count() == 0  # without tails nothing is an outlier
