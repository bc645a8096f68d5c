"""Scans of what the engine reads besides Parquet: JSON lines, CSV with checks, sheets, listings, pages, paged feeds."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that are left out of listings.
JUNK = ("Thumbs.db", ".DS_Store", "desktop.ini")


def json_lines(spark: SparkSession, path: str, schema: str, drop_bad: bool = False) -> DataFrame:
    """JSON lines with a declared schema; lines that don't parse become nulls, or go where ``drop_bad`` is set."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document that may span lines; a new read sees a new file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def recent_lines(spark: SparkSession, path: str, schema: str, order: str, n: int) -> DataFrame:
    """The newest n lines of an append-only log, lines that don't parse left out."""
    return json_lines(spark, path, schema, drop_bad=True).where(F.col(order).isNotNull()).orderBy(F.col(order).desc()).limit(n)


def import_csv(spark: SparkSession, path: str, columns: dict[str, str], aliases: dict[str, str] | None = None, most: int = 2000) -> DataFrame:
    """A CSV file with its header normalised (lower case, blanks to underscores) and columns renamed by ``aliases``.

    All or nothing: a missing column, more than ``most`` rows or one value that doesn't fit its type fails the read.
    ``columns`` maps each wanted column to its SQL type; others are ignored.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    named = {}
    for c in raw.columns:
        plain = re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_")
        named[(aliases or {}).get(plain, plain)] = c
    missing = [c for c in columns if c not in named]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    cast = raw.select(*[F.trim(F.col(f"`{named[c]}`")).try_cast(t).alias(c) for c, t in columns.items()], *[F.col(f"`{named[c]}`").alias(f"_raw_{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull() & (F.trim(f"_raw_{c}") != ""))
    n, wrong = cast.agg(F.count("*"), F.count_if(bad)).first()
    if n > most:
        raise ValueError(f"{n} rows; at most {most} are read")
    if wrong:
        raise ValueError(f"{wrong} rows don't fit")
    return cast.select(*columns)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _first_sheet(book: zipfile.ZipFile, names: list[str]) -> str:
    """The part that holds the sheet the workbook lists first; without such a list the sheet of the lowest number."""
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if first is not None and link.get("Id") == first.get(relation):
                target = link.get("Target").lstrip("/")
                return target if target.startswith("xl/") else f"xl/{target}"
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))


def sheet_cells(content: bytes) -> list[tuple[int, int, str]]:
    """(row, column, text) of the first sheet of a workbook, both from 1; empty cells left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        out = []
        for cell in ElementTree.fromstring(book.read(_first_sheet(book, names))).iter(f"{{{_NS['m']}}}c"):
            letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for ch in letters:
                column = column * 26 + ord(ch) - 64
            value = cell.find("m:v", _NS)
            if cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
            elif value is None or value.text is None:
                continue
            else:
                text = shared[int(value.text)] if cell.get("t") == "s" else value.text
            if text.strip():
                out.append((int(number), column, text.strip()))
        return out


def read_sheets(files: DataFrame) -> DataFrame:
    """(path, row, col, text) of the first sheets of workbooks read as binary files; an unreadable one gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, r, c, t) for r, c, t in sheet_cells(bytes(content))]
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, AttributeError):
                    continue
            yield pd.DataFrame(out, columns=["path", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, row int, col int, text string")


def right_of_label(cells: DataFrame, label: str, step: int = 1) -> DataFrame:
    """(path, value): the cell ``step`` columns right of a label, compared without case; the first one per sheet."""
    at = cells.where(F.lower("text").startswith(label.lower())).select("path", "row", (F.col("col") + step).alias("col"))
    found = at.join(cells, ["path", "row", "col"])
    return found.groupBy("path").agg(F.min_by("text", F.struct("row", "col")).alias("value"))


def between_anchors(cells: DataFrame, start: str, end: str) -> DataFrame:
    """Cells of the rows between a row that holds ``start`` and the next that holds ``end``; without the end, to the last row."""
    first = cells.where(F.lower("text").startswith(start.lower())).groupBy("path").agg(F.min("row").alias("_a"))
    last = cells.where(F.lower("text").startswith(end.lower())).select("path", F.col("row").alias("_e"))
    bounds = first.join(last, "path", "left").where("_e IS NULL OR _e > _a").groupBy("path", "_a").agg(F.min("_e").alias("_b"))
    return cells.join(bounds, "path").where((F.col("row") > F.col("_a")) & (F.col("_b").isNull() | (F.col("row") < F.col("_b")))).drop("_a", "_b")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, name, ext, size, mtime) of a folder tree; system files are left out, contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    out = found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    out = out.where(~F.col("name").isin(*JUNK) & ~F.col("name").startswith("._"))
    return out.where(F.col("ext").isin(*extensions)) if extensions else out


def text_sections(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, section, text): lines of one text file under ``# --- name`` headings; blank lines and comments left out.

    Line order is the order in the file, so the file is one split; it is a list written by hand.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
    head = F.nullif(F.regexp_extract("text", r"^#\s*-{3,}\s*(.+?)\s*$", 1), F.lit(""))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    return marked.where((F.trim("text") != "") & ~F.col("text").startswith("#"))


#: How much a page's own word for its picture counts.
_META_PICTURES = {"og:image": 5, "og:image:secure_url": 5, "og:image:url": 5, "twitter:image": 4, "twitter:image:src": 4, "image": 4, "thumbnailurl": 3}


def _largest(srcset: str) -> str:
    """The link of a srcset with the largest width or density."""
    best = (-1.0, "")
    for entry in srcset.split(","):
        parts = entry.split()
        size = re.fullmatch(r"([\d.]+)[wx]", parts[-1]) if len(parts) > 1 else None
        if parts:
            best = max(best, (float(size.group(1)) if size else 0.0, parts[0]), key=lambda b: b[0])
    return best[1]


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.links, self.images, self.blocks, self.title = {}, [], [], [], ""
        self.ranked: list[tuple[float, str]] = []
        self._in, self._text = None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
        if tag == "meta" and name and a.get("content"):
            self.meta.setdefault(name, a["content"])
            if name in _META_PICTURES:
                self.ranked.append((_META_PICTURES[name], a["content"]))
        elif tag == "link" and a.get("href") and "image_src" in a.get("rel", "").lower():
            self.ranked.append((3, a["href"]))
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img" and (a.get("src") or a.get("srcset")):
            link = _largest(a["srcset"]) if a.get("srcset") else a["src"]
            self.images.append(link)
            sides = [int(a[k]) for k in ("width", "height") if a.get(k, "").isdigit() and int(a[k])]
            if not sides or min(sides) >= 100:  # a picture said to be smaller is an icon
                self.ranked.append((2.0 * (a.get("itemprop", "").lower() == "image") + (max(sides, default=0) >= 400), link))
        elif tag == "title" or (tag == "script" and (a.get("type") or "").lower() == "application/ld+json"):
            self._in, self._text = tag, []

    def pictures(self, base: str, first: list[str]) -> list[str]:
        """Links of the page's pictures, those of its products first, then by rank, equal ones in page order."""
        seen: dict[str, None] = {}
        for link in [*first, *(u for _, u in sorted(self.ranked, key=lambda r: -r[0]))]:
            if link and not link.startswith("data:"):
                seen.setdefault(urljoin(base, link.strip()))
        return list(seen)

    def handle_data(self, data):
        if self._in:
            self._text.append(data)

    def handle_endtag(self, tag):
        if tag == self._in:
            text = "".join(self._text).strip()
            if tag == "title":
                self.title = self.title or text
            else:
                self.blocks.append(text)
            self._in = None


def _products(value) -> list[dict]:
    """Product nodes anywhere in a JSON-LD value, in order; the type is read without case, a group of variants counts as a product."""
    found, todo = [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            kinds = node.get("@type")
            if any(isinstance(k, str) and k.lower() in ("product", "productgroup") for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(node)
            todo += list(node.values())[::-1]
        elif isinstance(node, list):
            todo += node[::-1]
    return found


PAGE = "url string, title string, description string, links array<string>, images array<string>, pictures array<string>, product string, price double, currency string"


def read_page(url: str, text: str | None) -> tuple:
    """Title, description, links, images and the first product of a page; JSON-LD comes before meta tags."""
    page = _Page()
    try:
        page.feed(text or "")
    except (AssertionError, ValueError):
        pass
    products = []
    for block in page.blocks:
        try:
            products += _products(json.loads(block))
        except (ValueError, RecursionError):
            continue
    first = products[0] if products else {}
    offers = first.get("offers") or []
    offers = offers if isinstance(offers, list) else [offers]
    offer = next((o for o in offers if isinstance(o, dict) and o.get("price")), {})
    price = offer.get("price") or page.meta.get("product:price:amount") or page.meta.get("og:price:amount")
    try:
        price = float(str(price).replace(",", "")) if price else None
    except ValueError:
        price = None
    currency = offer.get("priceCurrency") or page.meta.get("product:price:currency") or page.meta.get("og:price:currency")
    name = first.get("name") if isinstance(first.get("name"), str) else None
    own = [v for p in products for v in (p.get("image") if isinstance(p.get("image"), list) else [p.get("image")])]
    own = [v.get("contentUrl") or v.get("url") if isinstance(v, dict) else v for v in own]
    return (url, page.meta.get("og:title") or page.title or None, page.meta.get("og:description") or page.meta.get("description"), page.links, page.images, page.pictures(url or "", [v for v in own if isinstance(v, str)]), name, price, currency)


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """What pages state, one row per page; null or broken HTML gives nulls and empty lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([read_page(u, h) for u, h in zip(pdf["_u"], pdf["_h"])], columns=[c.split()[0] for c in PAGE.split(", ")])

    return pages.select(F.col(url).alias("_u"), F.col(html).alias("_h")).mapInPandas(run, PAGE)


class PagedFeed(DataSource):
    """A feed read page by page until a short page: ``format("paged_feed")`` with options path, size, cap.

    path is a JSON file of pages, or several separated by commas; each feed is one task, since whether a next page exists is
    known only from the last. ``cap`` pages at most are read of a feed: one that goes on beyond is an error, not a short
    result. Products repeat across pages; ``feed_products`` reduces them by id.
    """

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "feed string, id long, title string, page int"

    def reader(self, schema):
        return _FeedReader(self.options["path"].split(","), int(self.options.get("size", 50)), int(self.options.get("cap", 200)))


class _FeedReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, cap: int):
        self.paths, self.size, self.cap = paths, size, cap

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.paths))]

    def read(self, partition):
        path = self.paths[partition.value]
        with open(path, encoding="utf-8") as f:
            pages = json.load(f)
        for number, page in enumerate(pages, 1):
            if number > self.cap:
                raise ValueError(f"{path} has more than {self.cap} pages")
            for product in page:
                yield (path, int(product["id"]), product.get("title"), number)
            if len(page) < self.size:
                break


def feed_products(feed: DataFrame) -> DataFrame:
    """One row per product of a feed, as its last page states it."""
    return feed.groupBy("feed", "id").agg(F.max_by("title", "page").alias("title"), F.max("page").alias("page"))
