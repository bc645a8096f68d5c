import json

from gemflow.operators import nested

SCHEMA = "id long, doc string, updated_at timestamp, src string"


def found(spark, docs, maps=None):
    df = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d), None, "clash") for i, d in docs], SCHEMA)
    rows, graphs = nested.shred_sources({"s": (df, "doc")}, {"s": set(maps or ())})
    return rows, graphs


def nodes(rows):
    return sorted((r.row_id, r.node) for r in rows.where("kind IN ('item', 'entry')").collect())


def brute(value, lists, maps, path="", node=""):
    """Reference walk: list elements that are objects or lists, and entries of maps."""
    value = nested.unwrap(value)
    out = []
    if path in lists and not isinstance(value, list) and value is not None:
        value = [value]
    if isinstance(value, list):
        for i, x in enumerate(value):
            x = nested.unwrap(x)
            if isinstance(x, (dict, list)):
                out.append(f"{node}[{i}]")
                inner = x.items() if isinstance(x, dict) else ()
                if isinstance(x, list):
                    out += brute(x, set(), maps, path + "!", f"{node}[{i}]")
                for k, v in inner:
                    out += brute(v, lists, maps, f"{path}.{k}".lstrip("."), f"{node}[{i}].{k}".lstrip("."))
    elif isinstance(value, dict):
        for k, v in value.items():
            key = "*" if path in maps else k
            at = f"{node}.{k}".lstrip(".")
            if path in maps:
                out.append(at)
            out += brute(v, lists, maps, f"{path}.{key}".lstrip("."), at)
    return out


def test_paths_of_mixed_shapes_equal_the_reference_walk(spark):
    docs = [
        (1, {"a": [{"b": [1, {"c": 2}]}, None, {"b": {"c": 3}}], "p": {"x": {"l": [{"y": 1}]}, "z": {"l": {"y": 2}}}}),
        (2, {"a": {"b": '[{"c": 1}]'}, "t": {"rows": [["1", "2"], ["3"]]}, "p": {"x": None}}),
        (3, json.dumps(json.dumps({"a": "[]", "t": [{"rows": [[1]]}]}))),
        (4, '{"a": [{"b"'),
        (5, None),
    ]
    rows, graphs = found(spark, docs, {"p"})
    expected = []
    for i, d in docs:
        v = nested.read_json(d if isinstance(d, str) else json.dumps(d))
        if v is not None:
            expected += [(i, n) for n in brute(v, graphs["s"].lists, {"p"})]
    assert nodes(rows) == sorted(expected)
    assert (2, "a[0].b[0]") in expected and (2, "t[0].rows[1]") in expected and (1, "p.z.l[0]") in expected and (1, "a[2]") in expected


def test_foreign_keys_lead_to_parents_and_fields_are_inlined(spark):
    rows, graphs = found(spark, [(1, {"v": [{"sku": "s", "size": {"w": 1, "h": 2}, "o": [{"p": 5}, {"p": 6}]}], "brand": "b"})])
    tables = nested.flat_tables(rows, graphs)
    v = tables["s", "v"].collect()
    assert [(r.node, r.parent, r.sku, r.size_w, r.size_h) for r in v] == [("v[0]", "", "s", "1", "2")]
    o = sorted((r.node, r.parent, r.pos, r.p) for r in tables["s", "v_o"].collect())
    assert o == [("v[0].o[0]", "v[0]", 0, "5"), ("v[0].o[1]", "v[0]", 1, "6")]
    assert [r.brand for r in tables["s", "root"].collect()] == ["b"]


def test_a_root_list_and_a_lone_root_object(spark):
    rows, _ = found(spark, [(1, [{"f": 1}, None, {"s": [{"w": 1}]}]), (2, {"s": {"w": 1}})])
    assert nodes(rows) == [(1, "[0]"), (1, "[2]"), (1, "[2].s[0]"), (2, "[0]"), (2, "[0].s[0]")]


def test_repeated_ids_count_once_and_empty_tables_work(spark):
    rows, _ = found(spark, [(1, {"a": [{}]}), (1, {"a": [{}]}), (None, {"a": [{}]})])
    assert nodes(rows) == [(1, "a[0]")]
    rows, graphs = found(spark, [])
    assert nodes(rows) == [] and graphs == {}


def test_very_deep_texts_do_not_crash(spark):
    rows, _ = found(spark, [(1, '{"a":' * 50_000 + "1" + "}" * 50_000), (2, {"a": [{}]})])
    assert nodes(rows) == [(2, "a[0]")]


def test_recursive_elements_share_one_table(spark):
    deep = {"name": "a0"}
    for i in range(60):
        deep = {"name": f"a{i + 1}", "part": {"id": i, "inner": [{"part": deep}]}} if i % 7 == 0 else {"name": f"a{i + 1}", "part": deep}
    df = spark.createDataFrame([(1, json.dumps({"part": deep, "x": 1})), (2, None), (3, "\ufeff" + json.dumps({"part": {"name": "b"}}))], "id long, text string")
    rows, graphs = nested.shred_sources({"s": (df, "text")}, version=None)
    got = [r for r in rows.collect() if r.row_id == 1]
    assert len(graphs["s"].kinds) < 12 and {r.tbl for r in got} == {"root", "part", "part_inner"}
    keys = {r.node for r in got}
    assert all(r.parent in keys for r in got if r.parent is not None) and sum("name" in r.fields for r in got) == 61
    assert [r.fields for r in rows.where("row_id = 3 AND tbl = 'part'").collect()] == [{"name": "b"}]
    assert nested.flat_tables(rows, graphs)["s", "part"].where("row_id = 1").count() == sum(r.tbl == "part" for r in got)
