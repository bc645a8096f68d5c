"""Quantities written in different units, converted to one unit each.

Three steps:

1. Reading (Arrow batches): labelled values and prices become measurements with the unit that the
   value, its label or a note of the record states.
2. History: every source's values of one quantity are put in time order and cut by exact penalised
   changepoint search on their logarithms. A segment whose level lies off the source's usual level by
   the ratio of two known units is a stretch written in another unit, and is reversed.
3. Conversion in exact decimals, rounded half up.

A source that holds a third of all rows is no hot task: the values of a history are ranked by range-partitioned
running sums, and blocks of ranks, with the values around them, are searched apart, while the usual level of a
source comes from a pre-aggregated quantile sketch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemflow.operators.nested import latest, read_json, unwrap
from gemflow.operators.prefix import running_sum
from gemflow.session import materialise

# Unit writings (lower case, without dots and blanks at the ends) and their size in the
# base of their kind: milligrams for mass, hundredths of a millimetre for length.
_MASS = {
    "mg": ["mg", "mgs", "milligram", "milligrams", "milligramme", "मिग्रा", "मिलीग्राम", "મિગ્રા"],
    "g": ["g", "gm", "gms", "gr", "gram", "grams", "gramme", "grammes", "ग्राम", "ग्रा", "ગ્રામ"],
    "kg": ["kg", "kilogram", "kilograms"],
    "tola": ["tola", "tolas", "तोला", "તોલા", "tolah"],
    "dwt": ["dwt", "pennyweight", "pennyweights"],
    "ozt": ["ozt", "oz t", "t oz", "troy oz", "troy ounce", "troy ounces", "oz tr"],
    "grain": ["grain", "grains"],
    "ct": ["ct", "cts", "carat", "carats", "ctw", "ct tw", "cttw", "tcw", "ct t w", "ct wt", "कैरेट", "કેરેટ"],
    "pt": ["pt", "pts", "point", "points", "cent", "cents"],
}
_LENGTH = {
    "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters", "मिमी", "मि मी", "મીમી", "મિમી"],
    "cm": ["cm", "cms", "centimetre", "centimetres", "centimeter", "centimeters", "सेमी", "से मी", "સેમી"],
    "in": ["in", "inch", "inches", '"', "″", "”", "''", "इंच", "ઇંચ"],
}
_BASE = {
    "mg": Decimal(1), "g": Decimal(1000), "kg": Decimal(1_000_000), "tola": Decimal("11663.8038"), "dwt": Decimal("1555.17384"),
    "ozt": Decimal("31103.4768"), "grain": Decimal("64.79891"), "ct": Decimal(200), "pt": Decimal(2),
    "mm": Decimal(100), "cm": Decimal(1000), "in": Decimal(2540),
}
UNIT_OF = {w: u for table in (_MASS, _LENGTH) for u, words in table.items() for w in words}
MASS_UNITS, LENGTH_UNITS = frozenset(_MASS), frozenset(_LENGTH)

#: Units a quantity may be written in, the unit taken for a bare number while its history says nothing
#: else, and what one base unit of the kind is in the unit reported.
QUANTITIES = {
    "gold_weight": (MASS_UNITS, "g", Decimal(1)),
    "gross_weight": (MASS_UNITS, "g", Decimal(1)),
    "stone_weight": (MASS_UNITS, "ct", Decimal(5)),
    "width": (LENGTH_UNITS, "mm", Decimal(1)),
    "height": (LENGTH_UNITS, "mm", Decimal(1)),
}

# Writings of currencies (lower case) to code.
_CURRENCY = {
    "INR": ["inr", "rs", "rs.", "₹", "रु", "रु.", "rupee", "rupees", "re", "રૂ", "mrp"],
    "USD": ["usd", "us$", "$", "us dollar", "us dollars", "dollar", "dollars", "us"],
    "AED": ["aed", "dhs", "dh", "dirham", "dirhams"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pound", "pounds", "pound sterling"],
    "SGD": ["sgd", "s$", "sg$", "singapore dollar", "singapore dollars"],
}
CURRENCY_OF = {w: c for c, words in _CURRENCY.items() for w in words}
# Minor units, each a hundredth of its currency (None: the currency stands beside it).
_MINOR = {"paise": "INR", "paisa": "INR", "fils": "AED", "pence": "GBP", "penny": "GBP", "gbx": "GBP", "p": "GBP", "cents": None, "cent": None}
# Multiples.
_MULTIPLE = {"lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "l": 100_000, "crore": 10_000_000, "cr": 10_000_000,
             "k": 1000, "thousand": 1000, "'000": 1000, "000": 1000, "million": 1_000_000, "mn": 1_000_000}

_FRACTIONS = {"½": (1, 2), "¼": (1, 4), "¾": (3, 4), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8), "⅓": (1, 3), "⅔": (2, 3)}
_FRACTION_CHARS = "".join(_FRACTIONS)
_NUMBER = re.compile(rf"(?P<whole>\d[\d.,]*)?\s*(?:(?P<vulgar>[{_FRACTION_CHARS}])|(?<![\d.,])(?P<num>\d+)\s*/\s*(?P<den>\d+))|(?P<dec>\d[\d.,  ]*\d|\d)")
_LEAD = re.compile(r"^(?:~|≈|about|approx(?:imately)?\.?|approx|circa|ca\.?|c\.|nearly|around|लगभग|આશરે)\s*", re.I)


def decimal_of(text: str, thousands: bool = False) -> Decimal | None:
    """A written number. The last of two different separators is the decimal sign; a lone comma before
    exactly three digits counts as a thousands sign where ``thousands`` is set (units too small for decimals)."""
    text = text.strip().replace(" ", "").replace(" ", "").rstrip(".,")
    if not text or not text[0].isdigit():
        return None
    comma, dot = text.rfind(","), text.rfind(".")
    if comma >= 0 and dot >= 0:
        text = text.replace(",", "") if dot > comma else text.replace(".", "").replace(",", ".")
    elif comma >= 0:
        groups = text.split(",")
        grouped = len(groups[-1]) == 3 and all(len(x) in (2, 3) for x in groups[1:])
        if grouped and (thousands or len(groups) > 2):
            text = text.replace(",", "")
        elif len(groups) == 2:
            text = text.replace(",", ".")
        else:
            return None
    elif text.count(".") > 1:
        if not all(len(x) == 3 for x in text.split(".")[1:]):
            return None
        text = text.replace(".", "")
    try:
        return Decimal(text)
    except ArithmeticError:
        return None


def _amount(text: str, thousands: bool) -> tuple[Decimal, str] | None:
    """The number at the head of a text, fractions included, and what follows it."""
    text = _LEAD.sub("", text.strip())
    m = re.match(rf"(?:(\d+)\s*[ +-]?\s*)?([{_FRACTION_CHARS}])|(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)(?![\d.,])", text)
    if m:
        if m.group(2):
            num, den = _FRACTIONS[m.group(2)]
            whole = m.group(1)
        else:
            num, den, whole = int(m.group(4)), int(m.group(5)), m.group(3)
        if not den:
            return None
        return Decimal(whole or 0) + Decimal(num) / Decimal(den), text[m.end() :].strip()
    m = re.match(r"\d(?:[\d., ]*\d)?", text)
    if not m:
        return None
    value = decimal_of(m.group(), thousands)
    return None if value is None else (value, text[m.end() :].strip())


def unit_of(text: str, kind: frozenset[str]) -> str | None:
    """The unit a writing names, if it is of the kind wanted."""
    word = re.sub(r"[\s.]+", " ", text.lower()).strip(" .,:;()")
    unit = UNIT_OF.get(word) or UNIT_OF.get(word.replace(" ", ""))
    return unit if unit in kind else None


def measure(text: str, kind: frozenset[str], hint: str | None = None) -> tuple[Decimal, str | None] | None:
    """(number, unit or None) of a value like ``~3,17grams``; ``hint`` is the unit the label names."""
    got = _amount(text, False)
    if got is None:
        return None
    unit = unit_of(got[1], kind) if got[1] else None
    if got[1] and unit is None and not re.fullmatch(r"(?:/-|only|max\.?|min\.?|each|total|\(?approx\.?\)?)?", got[1], re.I):
        return None
    if (unit or hint) in ("mg", "pt"):
        got = _amount(text, True)
        if got is None:
            return None
    return got[0], unit


_LABEL_UNIT = re.compile(r"(?:\(\s*([^()]+?)\s*\)|,?\s+in\s+([^\s,]+(?:\s[^\s,]+)?))\s*:?\s*$", re.I)
_NOTE = {
    "weight": re.compile(r"\b(?:weights?)\b[^.;]*?\b(?:are\s+|is\s+)?(?:given\s+)?in\s+([a-z]+)", re.I),
}


def label_quantity(label: str) -> tuple[str | None, str | None]:
    """(quantity, unit named by the label) of a spec label; pairs like ``Size (W x H)`` give ``pair``."""
    unit_text = None
    body = label.strip()
    m = _LABEL_UNIT.search(body)
    if m:
        inner = m.group(1) or m.group(2)
        if unit_of(inner, MASS_UNITS | LENGTH_UNITS):
            unit_text, body = unit_of(inner, MASS_UNITS | LENGTH_UNITS), body[: m.start()]
    low = re.sub(r"[\s.:]+", " ", body.lower()).strip()
    if re.search(r"\bw(?:idth)?\s*[x×*]\s*h(?:eight)?\b", low) or re.fullmatch(r"(?:top )?(?:size|dimensions?)", low):
        return "pair", unit_text
    if re.search(r"\bh(?:eight)?\s*[x×*]\s*w(?:idth)?\b", low):
        return "pair_hw", unit_text
    if re.search(r"\b(?:no|number|count|pieces|pcs|rate|price|value|charges?)\b", low):
        return None, unit_text
    if re.search(r"\b(?:wt|weight)\b", low):
        if re.search(r"\b(?:stone|stones|diamond|diamonds|gem|gems)\b", low):
            return "stone_weight", unit_text
        if re.search(r"\b(?:gold|metal|nett?)\b", low):
            return "gold_weight", unit_text
        if re.search(r"\b(?:gross|product|total)\b", low) or re.fullmatch(r"(?:approx )?(?:weight|wt)(?: approx)?", low):
            return "gross_weight", unit_text
        return None, unit_text
    if re.fullmatch(r"(?:w|width|breadth|width of top|top width|breadth of top)", low):
        return "width", unit_text
    if re.fullmatch(r"(?:h|height|top height|height with bail|height of top)", low):
        return "height", unit_text
    return None, unit_text


def noted_units(text: str | None) -> dict[str, str]:
    """Units that a record's running text states for its bare numbers: quantity to unit.

    A clause is read as ``<things> ... in <unit>``; a clause without the verb inherits it, as in
    ``all weights in tola, stones in cents, sizes in inches``.
    """
    found: dict[str, str] = {}
    if not text or " in " not in text:
        return found
    for clause in re.split(r"[,;.]|\band\b(?=[^,;.]*\bin\b)", text):
        m = re.search(r"(.*)\bin\s+([^\s.,;]+)\s*$", clause.strip(), re.I)
        if not m:
            continue
        about, unit = m.group(1).lower(), unit_of(m.group(2), MASS_UNITS | LENGTH_UNITS)
        if unit is None:
            continue
        if re.search(r"\b(?:stones?|diamonds?|gems?)\b", about):
            if unit in MASS_UNITS:
                found.setdefault("stone_weight", unit)
        elif re.search(r"\b(?:weights?|gold|gross|metal)\b", about):
            if unit in MASS_UNITS:
                found.setdefault("gold_weight", unit)
                found.setdefault("gross_weight", unit)
        elif re.search(r"\b(?:sizes?|measures?|measurements?|dimensions?|lengths?|widths?)\b", about) and unit in LENGTH_UNITS:
            found.setdefault("width", unit)
            found.setdefault("height", unit)
    return found


def currency_of(text: str | None) -> tuple[str | None, Decimal]:
    """(code, factor) of a free currency text: ``INR lakh`` is (INR, 100000), ``US cents`` (USD, 0.01)."""
    if not text or not text.strip():
        return None, Decimal(1)
    low = text.lower().strip()
    if low in CURRENCY_OF:
        return CURRENCY_OF[low], Decimal(1)
    factor, code = Decimal(1), None
    for word in re.findall(r"us\$|s\$|sg\$|[₹$€£]|'?000\b|[^\W\d_]+(?:्?[ऀ-ॿ]*)*\.?", low):
        word = word if word in CURRENCY_OF else word.rstrip(".")
        if word in CURRENCY_OF:
            code = code or CURRENCY_OF[word]
        elif word in _MINOR:
            factor *= Decimal("0.01")
            code = code or _MINOR[word]
        elif word in _MULTIPLE:
            factor *= _MULTIPLE[word]
    return code, factor


def price_in_text(text: str | None) -> tuple[Decimal, str | None] | None:
    """(amount, code) that a price text states; None where it states no amount."""
    if not text:
        return None
    m = re.search(r"\d(?:[\d., ]*\d)?", text)
    if not m:
        return None
    digits = m.group()
    value = decimal_of(digits, True)
    if value is None:
        return None
    around = re.sub(r"\(.*?\)|/-|\bonly\b|\bmrp\b", " ", (text[: m.start()] + " " + text[m.end() :]), flags=re.I).strip()
    code, factor = currency_of(around)
    return value * factor, code


RAW = "src string, source string, row_id long, at timestamp, quantity string, value string, unit string, via string, code string, seq long"


def read_specs(designs: DataFrame, key: str = "id", column: str = "original", site: str = "site", at: str = "created_at") -> DataFrame:
    """Measurements stated by the ``specs`` of JSON texts, with what names their unit (value, label, note or nothing).

    Null or incomplete JSON, values without a number and labels of other things give no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row_id, text, source, when in zip(pdf["_id"], pdf["_text"], pdf["_site"], pdf["_at"]):
                record = read_json(text)
                if not isinstance(record, dict):
                    continue
                specs = unwrap(record.get("specs"))
                specs = [specs] if isinstance(specs, dict) else specs
                if not isinstance(specs, list):
                    continue
                description = record.get("description")
                notes = noted_units(description if isinstance(description, str) else None)
                for seq, spec in enumerate(specs):
                    spec = unwrap(spec)
                    if not isinstance(spec, dict) or not isinstance(spec.get("label"), str) or spec.get("value") is None:
                        continue
                    quantity, hint = label_quantity(spec["label"])
                    if quantity is None:
                        continue
                    value = str(spec["value"])
                    if quantity in ("pair", "pair_hw"):
                        sides = re.split(r"\s*[x×*X]\s*", value.strip())
                        if len(sides) != 2:
                            continue
                        tail = measure(sides[1], LENGTH_UNITS, hint)
                        names = ("width", "height") if quantity == "pair" else ("height", "width")
                        found = [(n, measure(s, LENGTH_UNITS, hint), tail) for n, s in zip(names, sides)]
                    else:
                        found = [(quantity, measure(value, QUANTITIES[quantity][0], hint), None)]
                    for name, got, tail in found:
                        if got is None:
                            continue
                        number, unit = got
                        via = "value"
                        if unit is None and tail is not None:
                            unit = tail[1]
                        if unit is None and hint in QUANTITIES[name][0]:
                            unit, via = hint, "label"
                        if unit is None and name in notes:
                            unit, via = notes[name], "note"
                        out.append(("brand", source, row_id, when, name, str(number), unit, via if unit else None, None, seq))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RAW.split(", ")])

    names = {key: "_id", column: "_text", site: "_site", at: "_at"}
    picked = designs.select(*[F.col(c).alias(n) for c, n in names.items()]).where("_id IS NOT NULL AND _text IS NOT NULL")
    return picked.mapInPandas(read, RAW)


def read_prices(pages: DataFrame, key: str = "id", site: str = "site", at: str = "created_at") -> DataFrame:
    """Prices of pages: the amount of ``price_text`` in ``original`` where it states one, else ``price`` in ``currency``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row_id, text, source, when, price, currency in zip(pdf["_id"], pdf["_text"], pdf["_site"], pdf["_at"], pdf["_price"], pdf["_cur"]):
                record = read_json(text) if isinstance(text, str) else None
                stated = record.get("price_text") if isinstance(record, dict) else None
                got = price_in_text(stated) if isinstance(stated, str) else None
                code, factor = currency_of(currency if isinstance(currency, str) else None)
                if got is not None:
                    amount, own = got
                    out.append(("web", source, row_id, when, "price", str(amount), "1", "text", own or code, 0))
                elif price is not None and price == price:
                    via = "value" if code else None
                    out.append(("web", source, row_id, when, "price", str(Decimal(price) * factor), "1" if factor == 1 else str(factor), via, code, 0))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RAW.split(", ")])

    picked = pages.select(
        F.col(key).alias("_id"), F.col("original").alias("_text"), F.col(site).alias("_site"), F.col(at).alias("_at"),
        F.col("price").cast("string").alias("_price"), F.col("currency").alias("_cur"),
    ).where("_id IS NOT NULL")
    return picked.mapInPandas(read, RAW)


def changepoints(x: np.ndarray, penalty: float) -> np.ndarray:
    """Starts of the segments of x that minimise squared error plus ``penalty`` per segment; exact, with pruning.

    Every candidate start whose cost exceeds the best by the penalty can never win again and is dropped,
    so the optimum is the one of the full dynamic programme.
    """
    n = len(x)
    s1, s2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    best = np.empty(n + 1)
    best[0] = -penalty
    origin = np.zeros(n + 1, dtype=np.int64)
    starts = np.array([0])
    for t in range(1, n + 1):
        m = s1[t] - s1[starts]
        cost = best[starts] + (s2[t] - s2[starts]) - m * m / (t - starts)
        k = int(np.argmin(cost))
        best[t], origin[t] = cost[k] + penalty, starts[k]
        starts = np.append(starts[cost <= best[t]], t)
    cuts, t = [], n
    while t > 0:
        t = int(origin[t])
        cuts.append(t)
    return np.array(cuts[::-1])


def _log_factors(quantity: str) -> dict[str, float]:
    """How far a unit lies above the usual one, in logs: what a stretch written in it must be divided by."""
    if quantity == "price":
        return {"minor": math.log(100.0)}
    kind, usual, _ = QUANTITIES[quantity]
    return {u: math.log(float(_BASE[usual] / _BASE[u])) for u in kind if u != usual}


HISTORY = RAW + ", shift string"
#: Values that one search reads as its own, and those around them that it reads along.
BLOCK, AROUND = 4096, 512


def segment_histories(raw: DataFrame, strength: float = 3.0, tolerance: float = 0.9, block: int = BLOCK, around: int = AROUND, prior: int = 12) -> DataFrame:
    """Mark the values that lie in a stretch written in another unit: adds ``shift``, the unit found.

    Values enter by the logarithm of their stated size (bare numbers as if in the usual unit). The usual level and
    spread of a (source, quantity, currency) are its quartiles, drawn towards those of all sources as if ``prior`` values
    of these belonged to it; the fewer values there are in all, the wider the spread, so that few values tell no unit. A segment counts as shifted when its mean lies within ``tolerance`` spreads (at least
    0.25) of exactly one known factor and nearer to that than to no shift. ``strength`` times log n, with n the
    length of the history, is the penalty, in spreads squared.

    A history is searched in blocks of ``block`` values by rank, each together with ``around`` values on either side, so that a
    stretch across an edge is seen whole from both sides if it reaches no further than that. Ranks are exact, so the
    result depends neither on partitions nor on cores. Values that are zero, negative or no numbers are not marked.
    """
    size = F.col("value").cast("double")
    factor = F.create_map(*[x for u, b in _BASE.items() for x in (F.lit(u), F.lit(float(b)))])
    usual = F.create_map(*[x for q, (_, u, _) in QUANTITIES.items() for x in (F.lit(q), F.lit(float(_BASE[u])))])
    logv = F.when(F.col("quantity") == "price", F.log(size)).otherwise(F.log(size * F.coalesce(F.try_element_at(factor, F.col("unit")), usual[F.col("quantity")])))
    stored = materialise(raw.withColumn("_log", F.when(size > 0, logv)).withColumn("_code", F.coalesce("code", F.lit(""))).withColumn("_source", F.coalesce("source", F.lit(""))), "history")
    valued = stored.where("_log IS NOT NULL")
    stated = F.when(F.col("unit").isNotNull(), F.col("_log"))
    quart = F.percentile_approx(stated, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000)
    levels = valued.groupBy("_source", "quantity", "_code").agg(quart.alias("_q"), F.count(stated).alias("_n"), F.count("*").alias("_length"))
    everywhere = valued.groupBy("quantity", "_code").agg(quart.alias("_g"), F.count(stated).alias("_m"))
    levels = levels.join(everywhere, ["quantity", "_code"])

    def drawn(i: int) -> Column:
        return F.when(F.col("_n") > 0, (F.col("_n") * F.col("_q")[i] + prior * F.col("_g")[i]) / (F.col("_n") + prior)).otherwise(F.col("_g")[i])

    levels = levels.select("_source", "quantity", "_code", drawn(1).alias("_level"), (F.greatest((drawn(2) - drawn(0)) / 1.349, F.lit(0.2)) * F.sqrt(1 + prior / F.col("_m"))).alias("_spread"), "_length")
    history = ["quantity", "_code", "_source"]
    keys = valued.select(*history, "at", "row_id", "seq", "src", "_log").withColumn("_one", F.lit(1))
    ranked = running_sum(keys, history, ["at", "row_id", "seq", "src"], "_one", "_rank")
    own, place = F.floor(F.col("_rank") / block), F.col("_rank") % block
    seen = F.array_compact(F.array(own, F.when((place < around) & (own > 0), own - 1), F.when(place >= block - around, own + 1)))
    placed = ranked.select("*", own.alias("_own"), F.explode(seen).alias("_block")).join(levels.where("_level IS NOT NULL"), history)

    def cut(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("_rank")
        level, spread, known = run["_level"].iloc[0], run["_spread"].iloc[0], _log_factors(run["quantity"].iloc[0])
        x = (run["_log"].to_numpy() - level) / spread
        shift = np.array([None] * len(run), dtype=object)
        starts = changepoints(x, strength * math.log(max(int(run["_length"].iloc[0]), 3)))
        near = max(0.25, tolerance * spread)
        for a, b in zip(starts, [*starts[1:], len(x)]):
            mean = float(x[a:b].mean()) * spread
            # a value written in a smaller unit reads larger
            fits = [u for u, f in known.items() if abs(mean - f) < near and abs(mean - f) < abs(mean) / 2]
            if len(fits) == 1:
                shift[a:b] = fits[0]
        out = run.assign(shift=shift)
        return out.loc[(out["_own"] == out["_block"]) & out["shift"].notna(), [*history, "row_id", "seq", "src", "shift"]]

    marks = placed.groupBy(*history, "_block").applyInPandas(cut, "quantity string, _code string, _source string, row_id long, seq long, src string, shift string")
    return stored.join(marks, [*history, "row_id", "seq", "src"], "left").select(*raw.columns, "shift")


def convert(marked: DataFrame, rates: DataFrame) -> DataFrame:
    """Amounts in the common unit: milligrams, thousandths of a carat, hundredths of a millimetre, paise.

    ``unit_via`` says how the unit is known: value, label, note or text (stated), history (a level shift
    alone), or null (unknown; the amount is null then). Prices of a currency without a rate have none either.
    """
    rate = F.broadcast(rates.select(F.col("currency").alias("code"), F.col("inr").cast("string").alias("_rate")))  # a fixed table of currencies
    joined = marked.join(rate, "code", "left")
    base, per = {u: b for u, b in _BASE.items()}, {q: p for q, (_, _, p) in QUANTITIES.items()}

    @F.pandas_udf("struct<amount:long,unit_via:string>")
    def exact(quantity: pd.Series, value: pd.Series, unit: pd.Series, via: pd.Series, shift: pd.Series, fx: pd.Series) -> pd.DataFrame:
        out = []
        for q, v, u, how, s, r in zip(quantity, value, unit, via, shift, fx):
            number = Decimal(v)
            if q == "price":
                if how is None or r is None or how != how or r != r:
                    out.append((None, None))
                    continue
                amount = number * Decimal(r) * 100
                if how == "value" and u == "1" and s == "minor":
                    amount, how = amount / 100, "history"
            elif u in base:
                amount = number * base[u] * per[q]
            elif s in base:
                amount, how = number * base[s] * per[q], "history"
            else:
                out.append((None, None))
                continue
            out.append((int(amount.to_integral_value(ROUND_HALF_UP)), how))
        return pd.DataFrame(out, columns=["amount", "unit_via"]).astype({"amount": "Int64"})

    done = joined.withColumn("_x", exact("quantity", "value", "unit", "via", "shift", "_rate"))
    return done.select("src", "row_id", "source", "at", "quantity", "value", "unit", "shift", "code", F.col("_x.amount").alias("amount"), F.col("_x.unit_via").alias("unit_via"))


def common_units(brand_designs: DataFrame, web_designs: DataFrame, rates: DataFrame) -> DataFrame:
    """All quantities of both tables in common units. Repeated ids count once, the newest row by ``updated_at``."""
    specs = read_specs(latest(brand_designs.select("id", "original", "site", "created_at", "updated_at"), "id", "updated_at"))
    prices = read_prices(latest(web_designs.select("id", "original", "site", "created_at", "updated_at", "price", "currency"), "id", "updated_at"))
    return convert(segment_histories(specs.unionByName(prices)), rates)
