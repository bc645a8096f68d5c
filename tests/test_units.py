import json
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gemflow.operators import units as U


@pytest.mark.parametrize(
    "text,number,unit",
    [("3.840 dwt", "3.840", "dwt"), ("~3,17grams", "3.17", "g"), ("1,120 milligrams", "1120", "mg"), ("½ tola", "0.5", "tola"), ("1 3/8 tola", "1.375", "tola"), ("1.5CT TW", "1.5", "ct"),
     ("about 116 pts", "116", "pt"), ('0.12″', "0.12", "in"), ("22.5 मिमी", "22.5", "mm"), ("0.3865 तोला", "0.3865", "tola"), ("4.5", "4.5", None)],
)
def test_measures(text, number, unit):
    got = U.measure(text, U.MASS_UNITS | U.LENGTH_UNITS)
    assert got == (Decimal(number), unit)


@pytest.mark.parametrize("text", ["", "on request", "NA", "-", "varies", "gold"])
def test_no_measure(text):
    assert U.measure(text, U.MASS_UNITS) is None


@pytest.mark.parametrize(
    "text,value",
    [("₹1,10,070", "110070"), ("1.323,00 €", "1323.00"), ("Rs 0.56 L only", "56000"), ("US$ 443", "443"), ("79,456 rupees", "79456"), ("MRP ₹ 1,21,843 (incl. of all taxes)", "121843"), ("Price on request", None)],
)
def test_price_texts(text, value):
    got = U.price_in_text(text)
    assert (got is None) if value is None else got[0] == Decimal(value)


@pytest.mark.parametrize("text,code,factor", [("INR lakh", "INR", 100_000), ("US cents", "USD", "0.01"), ("$", "USD", 1), ("S$", "SGD", 1), ("AED '000", "AED", 1000), ("GBX", "GBP", "0.01"), ("रु", "INR", 1), ("", None, 1), (None, None, 1)])
def test_currencies(text, code, factor):
    assert U.currency_of(text) == (code, Decimal(str(factor)))


def test_notes():
    want = {"gold_weight": "tola", "gross_weight": "tola", "stone_weight": "pt", "width": "in", "height": "in"}
    assert U.noted_units("Ships soon. All weights in tola, stones in cents, sizes in inches.") == want
    assert U.noted_units("Note: gold and gross weights are given in tola, stone weights in points and measures in inches.") == want
    assert U.noted_units("Set in gold, made in India.") == {}


def brute(x, penalty):
    n = len(x)
    best = [(-penalty, ())]
    for t in range(1, n + 1):
        best.append(min((best[s][0] + penalty + float(((x[s:t] - x[s:t].mean()) ** 2).sum()), best[s][1] + (s,)) for s in range(t)))
    return best[n][1]


def test_changepoints_are_the_optimum():
    rng = np.random.default_rng(0)
    for k in range(8):
        x = np.concatenate([rng.normal(0, 1, 12), rng.normal(8, 1, rng.integers(1, 6)), rng.normal(0, 1, 9)])
        assert tuple(U.changepoints(x, 6.0)) == brute(x, 6.0)
    assert list(U.changepoints(np.array([1.0]), 3.0)) == [0]


def test_a_stretch_in_minor_units_is_reversed(spark):
    rows = [(i, f"2019-01-{1 + i // 10:02d} 00:00:{i % 10:02d}", 1000.0 * (1 + 0.1 * math.sin(i)) * (100 if 40 <= i < 50 else 1)) for i in range(100)]
    df = spark.createDataFrame([(i, "{}", "shop", str(round(p, 2)), "INR", t, "clash") for i, t, p in rows], "id long, original string, site string, p string, currency string, t string, code string")
    pages = df.selectExpr("id", "original", "site", "CAST(p AS DECIMAL(14,2)) AS price", "currency", "CAST(t AS TIMESTAMP) AS created_at", "CAST(NULL AS TIMESTAMP) AS updated_at", "code")
    rates = spark.createDataFrame([("INR", 1.0)], "currency string, inr double").selectExpr("currency", "CAST(inr AS DECIMAL(12,2)) AS inr")
    empty = pages.limit(0).select("id", "original", "site", "created_at", "updated_at")
    got = {r.row_id: (r.amount, r.unit_via) for r in U.common_units(empty, pages, rates).collect()}
    assert len(got) == 100
    assert all((got[i][1] == "history") == (40 <= i < 50) for i in got)
    assert all(abs(got[i][0] - 100_000 * (1 + 0.1 * math.sin(i))) < 2 for i in got)


def test_blocks_and_partitions_do_not_change_stretches(spark):
    rows = [("web", "shop", i, None, "price", str(round(1000 * (1 + 0.1 * math.sin(i)) * (100 if 55 <= i < 75 or i == 200 else 1), 2)), "1", "value", "INR", 0) for i in range(400)]
    rows += [("web", None, 1000 + i, None, "price", "0" if i == 3 else "12.5", "1", "value", None, 0) for i in range(5)]
    raw = spark.createDataFrame(rows, U.RAW).withColumn("at", F.timestamp_seconds("row_id"))
    want = {i for i in range(55, 75)} | {200}
    for block, around, parts in ((4096, 512, 1), (64, 48, 3), (32, 32, 9)):
        got = U.segment_histories(raw.repartition(parts), block=block, around=around).collect()
        assert len(got) == 405 and {r.row_id for r in got if r.shift == "minor"} == want


def test_specs_to_common_units(spark):
    doc = {"description": "All weights in tola, stones in cents, sizes in inches.", "specs": [None, {"label": "Net Wt.", "value": "0.2"}, {"label": "Diamond Weight", "value": "0.5 ct"}, {"label": "Size (W x H)", "value": "1.5 x 2 cm"}, {"label": "Gross Wt. (dwt)", "value": "2"}]}
    rows = [(1, json.dumps(doc)), (1, json.dumps(doc)), (2, "{broken"), (3, None), (None, json.dumps(doc)), (4, json.dumps({"specs": {"label": "Weight", "value": "1,234 mg"}})), (5, json.dumps({"specs": [{"label": "Weight", "value": "12"}]}))]
    df = spark.createDataFrame([(i, o, "s") for i, o in rows], "id long, original string, site string").selectExpr("*", "CAST(NULL AS TIMESTAMP) AS created_at", "CAST(NULL AS TIMESTAMP) AS updated_at")
    pages = df.limit(0).selectExpr("*", "CAST(NULL AS DECIMAL(14,2)) AS price", "CAST(NULL AS STRING) AS currency")
    rates = spark.createDataFrame([("INR", "1.00")], "currency string, inr string")
    got = sorted((r.row_id, r.quantity, r.amount, r.unit_via) for r in U.common_units(df, pages, rates).collect())
    assert got == sorted([(1, "gold_weight", 2333, "note"), (1, "stone_weight", 500, "value"), (1, "width", 1500, "value"), (1, "height", 2000, "value"), (1, "gross_weight", 3110, "label"), (4, "gross_weight", 1234, "value"), (5, "gross_weight", None, None)])
