"""Deeply nested records into related flat tables, by shared inlining.

Two passes over the JSON texts. The first reads the schema graph off the data: which fields hold
objects, lists or scalars, at which path. From the graph follow the tables: the root, every
repeated element (a field that holds lists somewhere, or the entries of a map-like field), every
element reached by more than one path with the same fields (shared), and every recursive one.
All other descendants occur once per parent and are inlined into their parent's row as columns.
The second pass walks each record along that graph and writes one row per table element with its
own key (the path from the root) and the foreign key of its parent row.

Reading rules. A field that holds lists in one record is a list in all: a lone object is a list of
one. A JSON text inside a value is read as the JSON it holds, repeatedly. Positions count every
element, nulls included. A text that is null or no complete JSON gives no rows, and neither does
one nested deeper than the parser allows. A byte order mark before the text is no part of it. Rows of one
id count once, the newest by ``version``.

Recursion. A field below a field of its own name (``parts.parts.parts``) is the same element once more: its
schema path stays that of the outermost one, so recursive elements of any depth share one table, whose rows
refer to rows of that table, and the schema graph stays finite however deep the records go.

Only the schema graph comes to the driver; its size depends on the number of distinct field paths
and is checked against ``max_paths``.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SHRED_SCHEMA = "src string, row_id long, tbl string, node string, parent string, pos long, kind string, fields map<string,string>"


def read_json(text):
    """The value a text holds, with JSON texts inside it left as they are; None where it isn't JSON."""
    try:
        value = json.loads(text.removeprefix("\ufeff"))
        while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
            value = json.loads(value)
        return value
    except (ValueError, RecursionError, TypeError, AttributeError):
        return None


def unwrap(value):
    """A value, or what the JSON text in it holds."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


@dataclass
class SchemaGraph:
    """Paths of one source: field path (list steps and map keys dropped) to the kinds seen there."""

    kinds: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    maps: frozenset[str] = frozenset()

    @property
    def lists(self) -> set[str]:
        return {p for p, k in self.kinds.items() if "list" in k}

    def children(self, path: str) -> list[str]:
        head = f"{path}." if path else ""
        return [p for p in self.kinds if p and p.startswith(head) and "." not in p[len(head) :]]

    def tables(self) -> dict[str, str]:
        """Path to table name for every element that gets a table of its own."""
        objects = {p: k for p, k in self.kinds.items() if k & {"object", "list"}}
        shape = {p: frozenset(c.rsplit(".", 1)[-1] for c in self.children(p)) for p in objects}
        same = defaultdict(list)
        for p in objects:
            if p and shape[p]:
                same[p.rsplit(".", 1)[-1], shape[p]].append(p)
        named = {"": "root"}
        for p in sorted(objects, key=lambda x: (x.count("."), x)):
            if not p:
                continue
            repeated = p in self.lists or p in self.maps or "recursive" in self.kinds[p] or p.rsplit(".", 1)[-1] == "*"
            twins = same.get((p.rsplit(".", 1)[-1], shape[p]), [p])
            if repeated or len(twins) > 1:
                named[p] = min(twins, key=lambda x: (x.count("."), x)).replace(".*", "_entry").replace(".", "_")
        return named


def _step(path: str, key: str) -> str:
    """The path of a node, one key deeper."""
    return f"{path}.{key}" if path else key


def _schema_step(path: str, key: str) -> str:
    """The schema path one key deeper; a key that is on the path already leads back to where it was."""
    key = key.replace(".", "\u2024")  # a dot inside a key is no step
    parts = path.split(".") if path else []
    return ".".join([*parts[: parts.index(key)], key]) if key != "*" and key in parts else _step(path, key)


def latest(df: DataFrame, key: str, version: str | None) -> DataFrame:
    """One row per key, the newest by version; ties fall to one row by content. Null keys take no part."""
    order = [F.col(version).desc_nulls_last()] if version else []
    rest = [F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])]
    w = Window.partitionBy(key).orderBy(*order, *rest)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def schema_graph(texts: DataFrame, maps: dict[str, set[str]] | None = None, max_paths: int = 20_000) -> dict[str, SchemaGraph]:
    """The schema graph of every source in texts (src, row_id, text)."""
    maps = maps or {}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for pdf in batches:
            for src, text in zip(pdf["src"], pdf["text"]):
                own = maps.get(src, frozenset())
                stack = [("", read_json(text))] if text is not None else []
                while stack:
                    path, value = stack.pop()
                    value = unwrap(value)
                    if isinstance(value, dict):
                        seen.add((src, path, "object"))
                        for k, v in value.items():
                            at = _schema_step(path, "*" if path in own else k)
                            if len(at) <= len(path) and isinstance(unwrap(v), (dict, list)):
                                seen.add((src, at, "recursive"))
                            stack.append((at, v))
                    elif isinstance(value, list):
                        seen.add((src, path, "list"))
                        stack.extend((path, v) for v in value)
                    elif value is not None:
                        seen.add((src, path, "scalar"))
        yield pd.DataFrame(sorted(seen), columns=["src", "path", "kind"])

    found = texts.select("src", "text").mapInPandas(scan, "src string, path string, kind string").distinct()
    rows = found.limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} field paths: name the map-like fields in maps")
    graphs: dict[str, SchemaGraph] = {}
    for src, path, kind in rows:
        graphs.setdefault(src, SchemaGraph(maps=frozenset(maps.get(src, ())))).kinds[path].add(kind)
    return graphs


def shred(texts: DataFrame, graphs: dict[str, SchemaGraph]) -> DataFrame:
    """One row per element that has a table: its table, node path, parent node, position and inlined fields.

    ``kind`` says what the element is: root, item (of a list), entry (of a map). ``fields`` has the scalars of
    the element and of its inlined descendants, by dotted name; lists of plain values are kept as JSON text.
    """
    plans = {s: (g.lists, g.tables(), g.maps) for s, g in graphs.items()}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for src, row_id, text in zip(pdf["src"], pdf["row_id"], pdf["text"]):
                value = read_json(text) if text is not None else None
                if value is None or src not in plans:
                    continue
                lists, tables, mapped = plans[src]
                # (value, schema path, node path, parent node, position, kind)
                todo = [(value, "", "", None, None, "root")]
                while todo:
                    value, path, node, parent, pos, kind = todo.pop()
                    value = unwrap(value)
                    own: dict[str, str | None] = {}
                    # what belongs to this row: (name in the row, schema path, node path, value)
                    flat = [("", path, node, value)]
                    first = True
                    while flat:
                        name, p, n, v = flat.pop()
                        v = unwrap(v)
                        here, first = first, False
                        if p in lists and not (here and kind in ("item",)):
                            if v is None:
                                continue
                            items = v if isinstance(v, list) else [v]
                            plain = []
                            for i, x in enumerate(items):
                                x = unwrap(x)
                                if isinstance(x, (dict, list)):
                                    todo.append((x, p, f"{n}[{i}]", node if kind != "root" or not here else None, i, "item"))
                                elif x is not None:
                                    plain.append(x)
                            if plain:
                                own[name or "value"] = json.dumps(plain, ensure_ascii=False)
                        elif isinstance(v, list):  # a list right inside a list
                            plain = []
                            for i, x in enumerate(v):
                                x = unwrap(x)
                                if isinstance(x, (dict, list)):
                                    todo.append((x, p, f"{n}[{i}]", node, i, "item"))
                                else:
                                    plain.append(x)
                            if plain:
                                own[name or "value"] = json.dumps(plain, ensure_ascii=False)
                        elif isinstance(v, dict) and p in mapped:
                            for i, (k, x) in enumerate(v.items()):
                                todo.append((x, _schema_step(p, "*"), _step(n, k), node, i, "entry"))
                        elif isinstance(v, dict):
                            for k, x in v.items():
                                q = _schema_step(p, k)
                                x = unwrap(x)
                                if q in tables and q not in lists and q not in mapped and isinstance(x, dict):
                                    todo.append((x, q, _step(n, k), node, None, "shared"))
                                else:
                                    flat.append((_step(name, k), q, _step(n, k), x))
                        else:
                            own[name or "value"] = None if v is None else v if isinstance(v, str) else json.dumps(v)
                    if kind == "root" and path in lists:
                        continue  # a root list: its elements are the rows
                    out.append((src, row_id, tables.get(path, path or "root"), node, parent, pos, kind, own))
            yield pd.DataFrame(out, columns=["src", "row_id", "tbl", "node", "parent", "pos", "kind", "fields"])

    return texts.mapInPandas(walk, SHRED_SCHEMA)


def flat_tables(shredded: DataFrame, graphs: dict[str, SchemaGraph]) -> dict[tuple[str, str], DataFrame]:
    """(source, table) to a DataFrame: row_id, node (key), parent (foreign key), pos, one column per inlined field."""
    out = {}
    for src, graph in graphs.items():
        named = graph.tables()
        for table in sorted(set(named.values())):
            columns: set[str] = set()
            for path, name in named.items():
                if name != table:
                    continue
                for p in graph.kinds:
                    inside = p == path or (p.startswith(f"{path}." if path else "") and p != "")
                    owner = max((t for t in named if p == t or p.startswith(f"{t}." if t else "")), key=len)
                    if inside and owner == path and "scalar" in graph.kinds[p]:
                        columns.add(p[len(path) :].lstrip(".") or "value")
            one = shredded.where((F.col("src") == src) & (F.col("tbl") == table))
            out[src, table] = one.select("row_id", "node", "parent", "pos", *[F.col("fields")[c].alias(c.replace(".", "_")) for c in sorted(columns)])
    return out


def shred_sources(sources: dict[str, tuple[DataFrame, str]], maps: dict[str, set[str]] | None = None, key: str = "id", version: str | None = "updated_at"):
    """Shred JSON columns of several tables: source name to (table, column). Gives (rows, schema graphs)."""
    texts = None
    for src, (df, column) in sources.items():
        keep = latest(df.select(key, column, *([version] if version else [])), key, version)
        one = keep.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_id"), F.col(column).alias("text")).where("text IS NOT NULL")
        texts = one if texts is None else texts.unionByName(one)
    raw = None
    for src, (df, column) in sources.items():
        one = df.select(F.lit(src).alias("src"), F.col(column).alias("text")).where("text IS NOT NULL")
        raw = one if raw is None else raw.unionByName(one)
    graphs = schema_graph(raw, maps)
    return shred(texts, graphs), graphs
