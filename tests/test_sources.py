import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gemflow.operators.sessions import SessionTable
from gemflow.session import scratch_path
from gemflow.sources import readers, writers
from gemflow.streaming import streams


def test_csv_is_all_or_nothing(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("Code, Colour ,Size MM,Qty\nA1,D,1.5,3\nA2,,2,\n")
    df = readers.import_csv(spark, str(good), {"code": "string", "color": "string", "size": "double", "qty": "int"}, {"colour": "color", "size_mm": "size"})
    assert sorted((r.code, r.size, r.qty) for r in df.collect()) == [("A1", 1.5, 3), ("A2", 2.0, None)]
    bad = tmp_path / "bad.csv"
    bad.write_text("code,qty\nA1,3\nA2,many\n")
    with pytest.raises(ValueError, match="1 rows don't fit"):
        readers.import_csv(spark, str(bad), {"code": "string", "qty": "int"})
    with pytest.raises(ValueError, match="missing"):
        readers.import_csv(spark, str(bad), {"size": "double"})


def workbook(cells):
    out = io.BytesIO()
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in row.items()) + "</row>" for r, row in cells.items())
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_sheets_and_label_anchors(spark, tmp_path):
    (tmp_path / "card.xlsx").write_bytes(workbook({1: {"A": "Design No", "B": "KR-1"}, 3: {"A": "Stones"}, 4: {"A": "Round", "B": "12"}, 6: {"A": "Total"}}))
    (tmp_path / "broken.xlsx").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx"))
    cells = readers.read_sheets(files)
    assert [r.value for r in readers.right_of_label(cells, "design no").collect()] == ["KR-1"]
    assert sorted(r.text for r in readers.between_anchors(cells, "stones", "total").collect()) == ["12", "Round"]


def test_listing_and_sections(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.png", "a/.DS_Store", "a/._y.png", "z.TXT"):
        (tmp_path / name).write_text("1")
    assert sorted(r.name for r in readers.list_files(spark, str(tmp_path)).collect()) == ["x.png", "z.TXT"]
    lists = tmp_path / "lists.txt"
    lists.write_text("first\n# --- rings\na\n\n# a comment\nb\n# --- other\nc\n")
    got = [(r.section, r.text) for r in readers.text_sections(spark, str(lists)).orderBy("line_no").collect()]
    assert got == [(None, "first"), ("rings", "a"), ("rings", "b"), ("other", "c")]


def test_pages(spark):
    ld = json.dumps({"@graph": [{"@type": ["Thing", "Product"], "name": "Ring", "offers": [{"price": None}, {"price": "1,099.00", "priceCurrency": "INR"}]}]})
    html = f'<title>T</title><meta property="og:description" content="D"><a href="/x">x</a><img src="i.png"><script type="application/ld+json">{ld}</script><script type="application/ld+json">{{broken</script>'
    rows = spark.createDataFrame([("u1", html), ("u2", None), ("u3", "<<<&")], "url string, html string")
    got = {r.url: r for r in readers.read_pages(rows).collect()}
    assert (got["u1"].title, got["u1"].description, got["u1"].product, got["u1"].price, got["u1"].currency, got["u1"].links) == ("T", "D", "Ring", 1099.0, "INR", ["/x"])
    more = '<meta itemprop="image" content="m.png"><link rel="image_src" href="/l.png"><img src="icon.png" width="20"><img srcset="s.png 320w, b.png 1024w, c.png" itemprop="image"><img src="plain.png"><meta property="og:image" content="//cdn.x/o.png">'
    ranked = readers.read_page("https://a.example/p/1", f'<script type="application/ld+json">{{"@type":"product","image":[{{"url":"z.png"}}]}}</script>{more}')
    assert dict(zip([c.split()[0] for c in readers.PAGE.split(", ")], ranked))["pictures"] == [f"https://{u}" for u in ("a.example/p/z.png", "cdn.x/o.png", "a.example/p/m.png", "a.example/l.png", "a.example/p/b.png", "a.example/p/plain.png")]
    assert got["u2"].title is None and got["u2"].links == [] and got["u3"].price is None


def test_logs_feeds_and_swapped_tables(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text('{"t": 1, "m": "a"}\n{broken\n{"t": 3, "m": "c"}\n{"t": 2, "m": "b"}\n')
    assert [r.m for r in readers.recent_lines(spark, str(log), "t long, m string", "t", 2).collect()] == ["c", "b"]
    feed = tmp_path / "feed.json"
    feed.write_text(json.dumps([[{"id": 1, "title": "a"}, {"id": 2}], [{"id": 2, "title": "b"}], [{"id": 9}]]))
    spark.dataSource.register(readers.PagedFeed)
    assert sorted(r.id for r in spark.read.format("paged_feed").option("path", str(feed)).option("size", 2).load().collect()) == [1, 2, 2]
    table = writers.SwappedTable(spark, scratch_path(spark, "swap"))
    assert table.versions() == []
    table.write(spark.range(3))
    table.write(spark.range(5))
    assert (table.read().count(), table.read(1).count(), table.versions()) == (5, 3, [1, 2])


def run(spark, df, schema, fn, tmp_path, name, mode="append"):
    path = str(tmp_path / name)
    df.coalesce(1).write.mode("append").parquet(path)
    out = fn(spark.readStream.schema(schema).parquet(path))
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_ck")).trigger(once=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name)


def test_rate_limiter_forgets_refused_events(spark, tmp_path):
    rows = [("a", t) for t in (0, 1, 2, 11, 12)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("at"))
    got = run(spark, df, df.schema, lambda s: streams.rate_limiter(s, "k", "at", 10, 2), tmp_path, "limited")
    assert sorted((r.at, r.allowed) for r in got.collect()) == [(0.0, True), (1.0, True), (2.0, False), (11.0, True), (12.0, True)]


def test_chunks_count_only_in_order(spark, tmp_path):
    df = spark.createDataFrame([("u", 0, 4, 10), ("u", 4, 6, 10), ("v", 2, 4, 8)], "upload string, offset long, size long, total long")
    got = run(spark, df, df.schema, streams.assemble_chunks, tmp_path, "chunks")
    assert sorted(map(tuple, got.collect())) == [("u", "complete", 10), ("u", "partial", 4), ("v", "refused", 0)]


def test_popularity_and_session_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 0), ("b", "x", 60), ("a", "y", 10_000)], "u string, w string, t long").select("u", "w", F.timestamp_seconds("t").alias("at"))
    got = run(spark, df, df.schema, lambda s: streams.sliding_popularity(s, "at", "w", "u", "1 hour", "1 hour"), tmp_path, "pop", "complete")
    assert {(r.w, r.n) for r in got.collect()} == {("x", 2), ("y", 1)}
    got = run(spark, df, df.schema, lambda s: streams.session_windows(s, "at", "u"), tmp_path, "sess", "complete")
    assert sorted((r.u, r.n) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_batches_feed_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 600), (3, "b", 0)], "id long, user_id string, t long").select("id", "user_id", F.timestamp_seconds("t").alias("created_at"))
    path = str(tmp_path / "in")
    df.write.parquet(path)
    sessions, latest = SessionTable(spark, scratch_path(spark, "s")), writers.SwappedTable(spark, scratch_path(spark, "l"))
    for sink in (streams.session_batches(sessions), streams.latest_per_key(latest, ["user_id"], "created_at")):
        q = spark.readStream.schema(df.schema).parquet(path).writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "ck")).start()
        assert q.awaitTermination(60)
    assert sorted((r.user_id, r.n_events) for r in sessions.read().collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.id for r in latest.read().collect()) == [2, 3]
