import numpy as np
import pytest
from pyspark.sql import functions as F

from gemflow.functions import text as T
from gemflow.functions import vectors as V
from gemflow.operators import behaviour, filters, relational, rerank, scoring
from gemflow.operators.components import connected_components
from gemflow.operators.prefix import running_sum
from gemflow.plans import catalogue_queries


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_running_sum_equals_a_window(spark, monkeypatch, broadcast):
    monkeypatch.setattr("gemflow.operators.prefix.BROADCAST_ROWS", broadcast)
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' ELSE 'b' END AS g", "id % 7 AS v", "'x' AS _inside_not")
    got = {r.id: r.before for r in running_sum(df, ["g"], ["id"], "v", "before").collect()}
    want, sums = {}, {}
    for i in range(500):
        g = None if i % 3 == 0 else i % 3
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + i % 7
    assert got == want
    assert running_sum(df.limit(0), ["g"], ["id"], "v", "before").count() == 0


def test_intersection_sends_no_side_to_the_driver(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,), (None,), (5,)], "design_uid int").write.parquet(f"{tmp_path}/favorites.parquet")
    spark.createDataFrame([([1, 1, 3],), ([None, 5],), ([],), (None,)], "result_uids array<int>").write.parquet(f"{tmp_path}/search_history.parquet")
    got = catalogue_queries.intersection(spark, str(tmp_path))
    assert sorted((r.uid for r in got.collect()), key=str) == [1, 5, None] and got.dtypes == [("uid", "int")]
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5), (None, 3), (201, 200), (200, 201)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(20)) and got[201] == got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(60)] + [(None, [1.0] * 5, 0), (99, None, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, l long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query, r["item"]): r.score for r in scoring.pair_scores(df, df.where("id < 4"), "id", "v", "l", same_label=True).collect()}
    want = {(q, i): float(u[q] @ u[i]) for q in range(4) for i in range(60) if q != i and q % 3 == i % 3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    top = scoring.best(scoring.pair_scores(df, df.where("id < 4"), "id", "v", top=3), 3).collect()
    assert {(r.query, r["item"]) for r in top} == {(q, int(i)) for q in range(4) for i in sorted(set(range(60)) - {q}, key=lambda i: -u[q] @ u[i])[:3]}


@pytest.mark.parametrize("round_", [65_536, 70])
def test_close_pairs_equal_all_pairs_and_shuffle_no_blocks(spark, monkeypatch, round_):
    monkeypatch.setattr(scoring, "ROUND", round_)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    x = np.vstack([base, base[:60] + rng.normal(scale=0.12, size=(60, 24)), base[20:40] + rng.normal(scale=0.08, size=(20, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = scoring.close_pairs(spark.createDataFrame([(i, u[i].tolist()) for i in range(len(u))], "id long, v array<double>"), "id", "v", 0.99, size=16)
    s = u @ u.T
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if s[i, j] >= 0.99}
    rows = pairs.collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want) > 20
    assert all(abs(r.score - s[r.a, r.b]) < 1e-12 for r in rows)
    assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().toString() and "MapInPandas" not in pairs._jdf.queryExecution().toString()


def test_close_pairs_lose_none(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.vstack([base, base[:20] + rng.normal(scale=0.03, size=(20, 8)), base[:3]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [float("nan")] * 8)], "id long, v array<double>")
    got = {r.id: (r.class_id, r.n_links) for r in scoring.duplicate_classes(df, "id", "v", 8, 0.99).collect()}
    assert set(got) == set(range(63))
    s = u @ u.T
    for i in range(20):
        if s[i, 40 + i] >= 0.99:
            assert got[i][0] == got[40 + i][0]
    assert all(got[i] == got[60 + i] for i in range(3))


def test_mmr_takes_one_per_family_and_spreads(spark):
    rows = [(1, 10, 1.0, "a", [1.0, 0.0]), (1, 11, 0.9, "a", [1.0, 0.0]), (1, 12, 0.85, "b", [1.0, 0.01]), (1, 13, 0.6, "c", [0.0, 1.0]), (2, 5, 0.1, "z", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "query long, item long, score double, family string, vec array<double>")
    got = sorted((r.query, r.position, r["item"]) for r in rerank.diversify(df, k=3, relevance=0.5).collect())
    assert got == [(1, 1, 10), (1, 2, 13), (1, 3, 12), (2, 1, 5)]


def test_browse_shows_each_family_once(spark):
    rows = [("r", i, f"f{i // 2}", None if i == 3 else float(i), [float(i % 5), 1.0]) for i in range(20)]
    got = [r["item"] for r in rerank.browse(spark.createDataFrame(rows, "category string, item long, family string, richness double, vec array<double>")).orderBy("position").collect()]
    assert len(got) == 10 and len({i // 2 for i in got}) == 10


def test_slate_and_budget(spark):
    rows = [("u", i, 1.0 - i / 100, "recent" if i < 4 else "popular" if i < 7 else "for_you", f"t{i % 3}", f"m{i % 9}", [float(i), 1.0]) for i in range(30)]
    got = rerank.slate(spark.createDataFrame(rows, "user_id string, item long, score double, kind string, type string, meaning string, vec array<double>")).collect()
    kinds = [r.kind for r in got]
    assert len(got) == 5 and kinds.count("recent") == 2 and kinds.count("popular") <= 1
    files = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1), (5, None)], "id long, size long")
    assert sorted(r.id for r in rerank.budget_fill(files, "size", ["id"], 10, "id").collect()) == [1, 3, 4]


def test_budget_equals_a_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i == 7 else int(v), None if i % 11 == 0 else i % 13) for i, v in enumerate(rng.integers(0, 60, 120))]
    left, want = 500, []
    for i, v, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if v is not None and v <= left:
            left -= v
            want.append(i)
    got = rerank.budget_fill(spark.createDataFrame(rows, "id long, size long, at int"), "size", ["at"], 500, "id")
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_browse_equals_the_rule(spark):
    rng = np.random.default_rng(1)
    rows = [("r", i, f"f{i // 2}", None if i % 9 == 0 else float(rng.integers(0, 6)), [float(v) for v in rng.normal(size=2)]) for i in range(150)] + [(None, 900, "x", 1.0, [1.0, 0.0]), ("r", 901, "x", 1.0, None)]
    df = spark.createDataFrame(rows, "category string, item long, family string, richness double, vec array<double>")
    known = sorted(r[3] for r in rows if r[3] is not None)
    median = spark.createDataFrame([(x,) for x in known], "x double").selectExpr("percentile_approx(x, 0.5, 10000)").first()[0]
    first = {}
    for c, i, f, rich, v in sorted((r for r in rows if r[0] and r[4]), key=lambda r: (-(median if r[3] is None else r[3]), r[1])):
        first.setdefault(f, (i, np.array(v) / np.linalg.norm(v)))
    wait, shown = list(first.values()), []
    while wait:
        fine = [w for w in wait[:50] if all(w[1] @ s[1] < 0.93 for s in shown[-6:])]
        shown.append((fine or wait)[0])
        wait = [w for w in wait if w is not shown[-1]]
    for size in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [r["item"] for r in rerank.browse(df).orderBy("position").collect()]
        assert got == [i for i, _ in shown]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slate_equals_the_rule(spark):
    rng = np.random.default_rng(2)
    rows = [(u, i, float(rng.integers(0, 9)) / 9, ["recent", "popular", "explore", "for_you"][rng.integers(0, 4)], f"t{rng.integers(0, 3)}", f"m{rng.integers(0, 12)}", [float(v) for v in rng.normal(size=3)]) for u in ("a", "b", "c") for i in range(60)]
    rows += [(None, 1, 1.0, "recent", "t", "m", [1.0, 0.0, 0.0]), ("d", 1, None, "recent", "t", "m", [1.0, 0.0, 0.0])]
    want = {}
    for u in ("a", "b", "c"):
        own = [(r, np.array(r[6]) / np.linalg.norm(r[6])) for r in rows if r[0] == u]
        picked = []
        while len(picked) < 5:
            fits = [(r, v) for r, v in own if all(r[1] != p[0][1] and r[5] != p[0][5] for p in picked)
                    and sum(p[0][3] == r[3] for p in picked) < {"recent": 2, "popular": 1, "explore": 1}.get(r[3], 5) and sum(p[0][4] == r[4] for p in picked) < 3]
            if not fits:
                break
            near = lambda v: max((v @ p[1] for p in picked), default=0.0)
            picked.append(max(fits, key=lambda c: (c[0][3] == "recent", c[0][2] if c[0][3] == "recent" else 0.7 * c[0][2] - 0.9 * near(c[1]), c[0][2], -c[0][1])))
        want[u] = [p[0][1] for p in picked]
    got = {}
    for r in rerank.slate(spark.createDataFrame(rows, "user_id string, item long, score double, kind string, type string, meaning string, vec array<double>")).orderBy("position").collect():
        got.setdefault(r.user_id, []).append(r["item"])
    assert got == want


def test_spread_takes_the_rest_of_a_shop_later(spark):
    rows = [(1, 1, 1.0, 7, [1.0, 0.0]), (1, 2, 0.99, 7, [1.0, 0.001]), (1, 3, 0.95, 7, [0.0, 1.0]), (1, 4, 0.9, 8, [0.7, -0.7]), (1, 5, None, 8, [1.0, 1.0]), (1, 6, 0.5, 8, None)]
    got = [r["item"] for r in rerank.spread(spark.createDataFrame(rows, "query long, item long, score double, shop long, vec array<double>"), k=3).orderBy("position").collect()]
    assert got == [1, 4, 3]


def test_filters_relax_with_a_note(spark):
    rows = [("q", i, i < 3, i / 40) for i in range(40)] + [("p", i, True, 0.9) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, id long, flag boolean, p double")
    kept = filters.apply_filters(df, [filters.AtLeast("metal", F.col("flag"), 8), filters.Probable("thin", F.col("p"), 0.8, rows=10)])
    q = kept.where("query_id = 'q'").collect()
    assert len(q) == 12 and set(q[0].relaxed) == {"metal", "thin"} and len(q[0].notes) == 2
    assert kept.where("query_id = 'p'").first().relaxed == []
    assert filters.apply_filters(df, [filters.AtLeast("metal", F.col("flag"), 8)], strict=True).where("query_id = 'q'").count() == 3
    assert filters.apply_filters(df.limit(0), [filters.Unwanted("x", [F.col("p")])]).count() == 0


def test_optimistic_update(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, version long, v string")
    c = spark.createDataFrame([(1, 1, 2, "A"), (2, 0, 2, "B"), (3, 1, 2, "C")], "id long, seen long, version long, v string")
    table, refused = relational.update_if_unchanged(t, c, "id", "version", ["v"])
    assert sorted(map(tuple, table.collect())) == [(1, 2, "A"), (2, 1, "b")] and sorted(r.id for r in refused.collect()) == [2, 3]


@pytest.mark.parametrize("a,b,limit,d", [("rign", "ring", 2, 1), ("ca", "abc", 3, 3), ("neckalce", "necklace", 2, 1), ("ring", "rings", 2, 1), ("abcdef", "uvwxyz", 2, 3), ("", "", 1, 0)])
def test_osa(a, b, limit, d):
    assert T.osa_distance(a, b, limit) == d


def test_text_functions(spark):
    df = spark.createDataFrame([("+91 98200-12345", "12.00X8.50", "a.jpg 320w, b.jpg 1024w, c.jpg 640w", "<p>A &amp; B</p><script>x</script><br>C", "DDLR-092-OV", "ring under 2 lakh 18k")], "ph string, sz string, ss string, h string, code string, q string")
    r = df.select(T.phone("ph").alias("ph"), T.size_label("sz").alias("sz"), T.largest_in_srcset("ss").alias("ss"), T.plain_html(F.col("h")).alias("h"), T.family_of("code", {"OV": "oval"}).alias("f"), T.budget("q").alias("b"), T.strip_budget("q").alias("q")).first()
    assert (r.ph, r.sz, r.ss, r.h, r.f.family, r.f.cut, r.b, r.q) == ("+919820012345", "12 × 8.5 mm", "b.jpg", "A & B\nC", "DDLR-092", "oval", 200_000, "ring 18k")


def test_vector_functions_handle_zero_and_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [(r.c, r.n) for r in df.select(V.cosine("a", "b").alias("c"), V.normalise("a").alias("n")).collect()]
    assert got[0] == (None, [None, None]) and got[1] == (None, None) and abs(got[2][0] - 1) < 1e-12


def test_popularity_limits_before_it_counts_users(spark):
    rows = [("x", "u1", 5.0), ("x", "u1", 5.0), ("y", "u1", 1.0), ("y", "u2", 1.0), ("z", None, 99.0)]
    df = spark.createDataFrame(rows, "m string, u string, w double")
    assert [r.m for r in behaviour.popular(df, ["m"], "u", F.col("w"), top=1).collect()] == []
    assert [r.m for r in behaviour.popular(df, ["m"], "u", F.col("w"), top=2).collect()] == ["y"]


def test_edit_distance_equals_the_full_matrix():
    import random

    def full(a, b):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                d[i, j] = i + j if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert T.osa_distance(a, b, 2) == min(full(a, b), 3)


def test_html_text_keeps_lines_and_drops_scripts():
    assert T.html_text("<p>One &amp; two</p><script>x = '<b>'</script><div>a<br>b  c</div>t<style>p{}</style>") == "One & two\na\nb c\nt"
    assert T.html_text(None) is None and T.html_text("") == ""
