"""Per-document text statistics, and outlier scores that tell prose from lists, tables and junk.

Every statistic is a share between 0 and 1 (three decimals), larger where a text is less like prose. Its exact
rank among all documents of the same language comes from a sort by value: documents are counted per value,
values are range-partitioned and sorted, and the counts of earlier partitions are added as offsets. That gives
the empirical tail probability of every value. The weighted mean of minus the logarithms of a document's tail
probabilities is its outlier score, and the score alone decides whether a text is prose: the border is where
the scores of all documents part best into two groups. What most of an outlier reads as names its kind.

The language is that of most function words in the script of most letters. A text without letters has no
language and is ranked among all documents. The tails of a language are drawn towards those of all documents as
if ``PRIOR`` of these belonged to it, so that a language of few documents has tails too; no size changes the rule.

A value occurs once in the sort however many documents share it, so ties are no hot group, and the number of
values is bounded by languages x statistics x 1001, which is what the lookup holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemflow.operators.prefix import running_sum
from gemflow.session import materialise

#: Statistic to its weight in the outlier score. What the lines read as weighs as much as all others together.
STATISTICS = {"symbol_ratio": 1, "digit_ratio": 1, "odd_word_share": 1, "open_line_share": 1, "short_line_share": 1, "rare_word_share": 1, "word_length_gap": 1, "repeat_share": 1, "broken_share": 8}
PRIOR = 100

# Words that make a sentence of a line, by language; words that item names use too (in, of, the) are not among them.
_SENTENCE = set(
    """i you it is are was were be been we they he she what would can could will shall should do does did how much many when why who then my your our me us
    her his their him them this that these those have has had yes no not ok okay thanks please so but because if as after before there here let at by to from and
    which than while where since although may also only just very too for on about""".split()
)
# The commonest words of prose, by language.
_FUNCTION_WORDS = {
    "en": "the a an in of with or each its all more most one two ten",
    "fr": "le la les un une des du de et est en pour dans que qui pas ne sur avec ce cette il elle nous votre mais être",
    "es": "el los las una y es en por con para que no del se su lo como más pero esta este la un de",
    "de": "der die das und ist ein eine einen im mit für auf nicht zu den dem von wir sie aber auch es",
    "hi-latn": "hai ki ka ke ko se mein aur ye hua tha thi kya nahi bhi liye jo par unki iska isko isliye lekin",
    "gu-latn": "che chhe ni no na ne mate ane pan",
    "hi": "है की का के को से में और यह वह हुआ था थी क्या नहीं भी लिए जो पर इस इसका लेकिन ने तो हैं",
    "mr": "आहे ही तो ते आणि पण च्या ला मध्ये साठी",
    "gu": "છે ની નો ના ને માટે અને પણ આ તે તેનું",
    "ta": "இந்த அது ஒரு மற்றும் என்று",
}
_LANGUAGE_WORDS = {lang: set(words.split()) | (_SENTENCE if lang == "en" else set()) for lang, words in _FUNCTION_WORDS.items()}
_COMMON = set().union(*_LANGUAGE_WORDS.values())
# The languages written in each script, and the one that a text without function words is taken for.
_WRITTEN = {"latn": ["en", "fr", "es", "de", "hi-latn", "gu-latn"], "deva": ["hi", "mr"], "gu": ["gu"], "ta": ["ta"], "other": ["other"]}
# Common words that search phrases use too.
_KEYWORDS = set("a an the of in me my for by with and no on".split())
_BULLET = re.compile(r"^\s*(?:[•*\-–—·▪◦‣>+✓✔☐☑]|\[[ xX✓]?\]|\(?\d{1,3}[.)\]:]|\(?[a-zA-Z][.)]|[ivx]{1,4}[.)])\s+\S")
_CODE = re.compile(r"</?[a-zA-Z!][^<>]{0,200}>|function\s*\([^)]*\)\s*\{[^}]*\}|&[a-z]{2,8};|\bvar \w+\s*=[^;]*;|[.#@]?[\w-]+\s*\{[^{}]*\}|\b(?:href|class|style|src|id)\s*=")
_LABELLED = re.compile(r"^\s*[^\W\d_][\w .'/&()-]{0,30}?\s*(?::|=|→|\.{3,}|\s-|\s–)\s*(\S.*)$")
_UNIT = re.compile(r"(?<=[^\W\d_][.!?।॥])\s+")
_EDGE = "\"'“”‘’«»()[]{}<>.,;:!?।॥…*_~#-–—/|"
_SENTENCE_END = re.compile(r"[.!?…।॥]['\"”’»)\]]*\s*(?:[#@🙏💍❤!?]|\W)*$")
_VOWELS = set("aeiouyàâäéèêëíîïóôöúùûüœæáñ")
_MEASURE = re.compile(r"[#₹$€£~+-]?\d[\d.,/:x×%-]*[a-zA-Z]{0,4}")
_COMBINED = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-෿‌‍]|['’.\-/&](?=[^\W_]))*\d{0,4}")


def _wordlike(token: str) -> bool:
    """Whether a token is a word, a number or a measure, and not letters with signs among them."""
    core = token.strip(_EDGE)
    if not core:
        return len(token) <= 2
    return bool(_COMBINED.fullmatch(core) or _MEASURE.fullmatch(core)) or bool(re.fullmatch(r"[#@]\w+", token.strip(".,;:!?")))


def _vowelless(core: str) -> bool:
    return len(core) >= 3 and core.isascii() and core.isalpha() and core.islower() and sum(c in _VOWELS for c in core) < 0.18 * len(core)


_SCRIPTS, _LANGUAGES = list(_WRITTEN), list(_FUNCTION_WORDS)
#: What is counted of a token, and summed over lines and texts.
_COUNTED = ["solid", "alnum", "digits", "mojibake", "mojibake_sure", "blob", "pieces", "odd", "words", "letters", "said", "common", "prosaic", "plain", "plain_words", "vowelless", "stray", "mark",
            *[f"script_{x}" for x in _SCRIPTS], *[f"in_{x}" for x in _LANGUAGES]]
_AT = {name: i for i, name in enumerate(_COUNTED)}
_MARKS = {"|", "/", ">", "»", "›", "·"}


def _script(c: str) -> str:
    return "latn" if c < "ɐ" else "deva" if "ऀ" <= c <= "ॿ" else "gu" if "઀" <= c <= "૿" else "ta" if "஀" <= c <= "௿" else "other"


def count_token(token: str) -> list[int]:
    """The counts of one token, in the order of _COUNTED."""
    n = dict.fromkeys(_COUNTED, 0)
    n["solid"], n["mark"] = len(token), int(token in _MARKS)
    for c in token:
        n["alnum"] += c.isalnum() or "ऀ" <= c <= "෿"
        n["digits"] += c.isdigit()
        n["mojibake"] += "\u0080" <= c <= "¿" or c in "ÃÂ�ÐÑàâ"
        n["mojibake_sure"] += "¡" <= c <= "¿" or c == "�" or "\u0080" <= c < " "
        if c.isalpha():
            n["script_" + _script(c)] += 1
    if len(token) >= 40 and token.isascii() and re.search(r"[a-z]", token) and re.search(r"[A-Z0-9]", token) and not token.startswith("http") and token.count(",") < 3 and token.count(";") < 3:
        n["blob"] = len(token)
    for piece in re.split(r"[,;|]+", token):
        if any(c.isalnum() for c in piece):
            n["pieces"] += 1
            n["odd"] += not _wordlike(piece)
    core = token.strip(_EDGE)
    if any(c.isalpha() for c in core):
        w = core.lower()
        n["words"], n["letters"], n["said"], n["common"], n["prosaic"] = 1, len(w), w in _SENTENCE, w in _COMMON, w in _COMMON and w not in _KEYWORDS
        n["plain"], n["plain_words"] = w.isascii(), len(w) >= 3 and w.isascii() and w.isalpha()
        n["vowelless"], n["stray"] = _vowelless(w), len(w) == 1 and w.isascii() and w not in "aieoyxgkn"
        for lang, words in _LANGUAGE_WORDS.items():
            n["in_" + lang] = w in words
    return [int(x) for x in n.values()]


def line_kind(text: str, tokens: list[str], n: list[int]) -> str:
    """What one line reads as, by its text, its tokens and the sums of their counts: prose, list, table or junk."""
    solid, alnum, words, said, plain = (n[_AT[k]] for k in ("solid", "alnum", "words", "said", "plain"))
    bars = text.count("|")
    if not alnum and bars + text.count("+") >= 2 and re.fullmatch(r"[|+\-=:\s]+", text):
        return "table"
    if alnum < 0.35 * solid:
        return "junk" if solid > 2 else "prose"
    if n[_AT["blob"]] > 0.5 * solid:
        return "junk"
    if any(c in text for c in "<{&=") and sum(len(m.group()) for m in _CODE.finditer(text)) > 0.3 * len(text):
        return "junk"
    if n[_AT["mojibake"]] > 0.2 * solid and n[_AT["mojibake_sure"]] > 0.05 * solid:
        return "junk"
    if n[_AT["odd"]] > 0.25 * max(1, n[_AT["pieces"]]) and len(tokens) >= 3:
        return "junk"  # words with signs in them
    # rows of cells
    if n[_AT["mark"]] >= 4 and said <= 0.15 * words and len(_MARKS.intersection(tokens)) >= 2:
        return "junk"  # a menu
    if (bars >= 2 and text.startswith("|")) or bars >= 3 or "\t" in text:
        return "table"
    for sign in (";", ","):
        if text.count(sign) >= 2 and f"{sign} " not in text and not text.endswith("."):
            return "table"
    if "  " in text and len(text) < 400:
        gaps = re.split(r"\s{2,}", text)
        if len(gaps) >= 3 and all(len(g.split()) <= 4 for g in gaps):
            return "table"
    bullet = bool(_BULLET.match(text))
    m = None if bullet else _LABELLED.match(text)
    if m:
        value = m.group(1).split()
        if len(value) <= 4 and not any(v.strip(_EDGE).lower() in _SENTENCE for v in value) and not _SENTENCE_END.search(text):
            return "table"
    if plain >= 3 and n[_AT["vowelless"]] > 0.3 * plain:
        return "junk"
    if words >= 12 and n[_AT["stray"]] >= 3 and n[_AT["stray"]] > 0.06 * words:
        return "junk"
    if bullet and words <= 12 and said <= 0.3 * max(words, 1):
        return "list"
    if said <= 0.06 * words and sum(map(text.count, ",;•·|")) >= 5:
        items = re.split(r"[,;•·|]\s*", text)
        if sum(len(i.split()) for i in items) <= 4.2 * len(items):
            return "list"
    if words >= 10 and plain > 0.9 * words and n[_AT["prosaic"]] < 0.04 * words and not re.search(r"[.,;!?]\s", text):
        return "junk"  # keywords without a sentence
    if words <= (6 if plain else 4) and not said and not re.search(r"[.!?।…]['\"”’»)]*$", text):
        return "list"
    return "prose"


class Reader:
    """Reads texts in batches: every distinct token is counted once, and lines and texts are sums over tokens."""

    def __init__(self, kept: int = 300_000):
        self.kept, self.place, self.rows = kept, {}, []
        self.table = np.zeros((0, len(_COUNTED)), dtype=np.int64)

    def _sums(self, units: list[list[str]]) -> np.ndarray:
        """Sums per unit (a unit has at least one token)."""
        if len(self.place) > self.kept:
            self.place, self.table = {}, self.table[:0]
        new = list(dict.fromkeys(t for tokens in units for t in tokens if t not in self.place))
        if new:
            self.place |= {t: len(self.place) + i for i, t in enumerate(new)}
            self.table = np.concatenate([self.table, np.array([count_token(t) for t in new], dtype=np.int64)])
        flat = np.fromiter((self.place[t] for tokens in units for t in tokens), dtype=np.int64)
        starts = np.cumsum([0, *[len(tokens) for tokens in units[:-1]]])
        # one column at a time, so that no copy of the whole table is made
        return np.stack([np.add.reduceat(column[flat], starts) for column in np.ascontiguousarray(self.table.T)], axis=1)

    def read(self, texts: list[str]) -> list[dict]:
        """The statistics of the texts; an empty one has all shares zero."""
        lines = [[x.strip() for line in t.splitlines() for x in _UNIT.split(line) if x.strip()] for t in texts]
        tokens = [x.split() for own in lines for x in own]
        sums = self._sums(tokens) if tokens else np.zeros((0, len(_COUNTED)), dtype=np.int64)
        rows, out, at = sums.tolist(), [], 0
        for own in lines:
            to = at + len(own)
            out.append(_statistics(own, tokens[at:to], rows[at:to], sums[at:to].sum(axis=0).tolist()))
            at = to
        return out


def language_of(n: list[int]) -> str:
    """The language whose statistics a text is compared with: the script of most letters, then the most function words.

    ``none`` without letters; the first language of the script without function words.
    """
    letters = [n[_AT["script_" + x]] for x in _SCRIPTS]
    if not any(letters):
        return "none"
    written = _WRITTEN[_SCRIPTS[letters.index(max(letters))]]
    return max(written, key=lambda x: n[_AT["in_" + x]] if "in_" + x in _AT else 0)


def _statistics(lines: list[str], tokens: list[list[str]], rows: list[list[int]], n: list[int]) -> dict:
    shares = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    kinds = [line_kind(x, t, r) for x, t, r in zip(lines, tokens, rows)]
    spoilt, plain = n[_AT["odd"]] / max(1, n[_AT["pieces"]]), n[_AT["plain_words"]]
    if spoilt > 0.15 or (plain >= 5 and n[_AT["vowelless"]] > 0.4 * plain):
        kinds = ["junk" if k == "prose" else k for k in kinds]
    ended = short = 0
    said: set[str] = set()
    for i, (x, k) in enumerate(zip(lines, kinds)):
        # a sentence said over and over is no prose after the first time
        if k == "prose" and x in said:
            k = "junk"
        said.add(x)
        # a lone short line between lines of prose is a heading, not a list
        if k == "list" and len(tokens[i]) <= 8 and not _BULLET.match(x):
            near = {kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)}
            if near == {"prose"}:
                k = "prose"
        shares[k] += len(x)
        ended += bool(_SENTENCE_END.search(x))
        short += len(tokens[i]) <= 5
    total, solid, words, count = max(1, sum(shares.values())), max(1, n[_AT["solid"]]), n[_AT["words"]], max(1, len(lines))
    mean = n[_AT["letters"]] / words if words else 0.0
    common = n[_AT["common"]] / max(1, words)
    return {
        "language": language_of(n),
        "n_words": words,
        "n_lines": len(lines),
        "mean_word_length": round(mean, 3),
        "common_word_share": round(common, 3),
        "ended_line_share": round(ended / count, 3),
        "prose_share": round(shares["prose"] / total, 3),
        "list_share": round(shares["list"] / total, 3),
        "table_share": round(shares["table"] / total, 3),
        "junk_share": round(shares["junk"] / total, 3),
        "symbol_ratio": round((n[_AT["solid"]] - n[_AT["alnum"]]) / solid, 3),
        "digit_ratio": round(n[_AT["digits"]] / solid, 3),
        "odd_word_share": round(spoilt, 3),
        "open_line_share": round(1 - ended / count, 3) if lines else 0.0,
        "short_line_share": round(short / count, 3),
        "rare_word_share": round(1 - common, 3) if words else 0.0,
        "word_length_gap": round(min(1.0, abs(mean - 4.3) / 10), 3),
        "repeat_share": round(1 - len(said) / count, 3) if lines else 0.0,
        "broken_share": round(2 * (1 - shares["prose"] / total)) / 2 if lines else 0.0,  # in halves: a smaller part says nothing of most of the text
    }


def read_text(text: str) -> dict:
    """The statistics of one text."""
    return Reader().read([text])[0]


_COLUMNS = ["language string", "n_words long", "n_lines long", "mean_word_length double", "common_word_share double", "ended_line_share double", "prose_share double", "list_share double", "table_share double", "junk_share double", *[f"{s} double" for s in STATISTICS]]


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of statistics per document. Null ids and texts take no part; repeated ids count once (the largest text)."""
    once = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(text).alias("_t"))
    names = [c.split()[0] for c in _COLUMNS]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                out = pd.DataFrame(reader.read(part["_t"].tolist()), columns=names)
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return once.mapInPandas(read, ", ".join(["doc_id long", *_COLUMNS]))


def tail_probabilities(statistics: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(language, statistic, value, tail): the share of a language's documents with at least that value.

    Language ``*`` is all documents, whose shares are exact; those of a language are its exact counts with ``prior`` documents
    added that are spread as all documents are.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS])).alias("_e")
    counts = materialise(statistics.select("language", entries).groupBy("language", "_e.statistic", "_e.value").agg(F.count("*").alias("n")), "counts")
    every = counts.groupBy("statistic", "value").agg(F.sum("n").alias("n")).select(F.lit("*").alias("language"), "statistic", "value", "n")
    ranked = running_sum(counts.unionByName(every).withColumn("down", -F.col("value")), ["language", "statistic"], ["down"], "n", "above")
    totals = counts.where(F.col("statistic") == next(iter(STATISTICS))).groupBy("language").agg(F.sum("n").alias("total"))
    totals = totals.unionByName(totals.agg(F.sum("total").alias("total")).select(F.lit("*").alias("language"), "total"))
    upto = materialise(ranked.join(F.broadcast(totals), "language").withColumn("reached", F.col("above") + F.col("n")), "tails")  # totals: one row per language
    pooled = upto.where("language = '*'").select("statistic", "value", (F.col("reached") / F.col("total")).alias("_all"))
    own = F.when(F.col("language") == "*", F.col("_all")).otherwise((F.col("reached") + prior * F.col("_all")) / (F.col("total") + prior))
    return upto.join(pooled, ["statistic", "value"]).select("language", "statistic", "value", own.alias("tail"))


def outlier_scores(statistics: DataFrame) -> DataFrame:
    """The statistics with ``outlier``: the weighted mean of minus log tail probability, zero for the most ordinary text."""
    tails = tail_probabilities(statistics).collect()  # bounded: languages x statistics x 1001 values
    lists: dict[tuple[str, str], tuple[list, list]] = {}
    for language, statistic, value, tail in tails:
        values, found = lists.setdefault((language, statistic), ([], []))
        values.append(value)
        found.append(tail)
    table = {k: tuple(np.array(x)[np.argsort(v[0])] for x in v) for k, v in lists.items()}
    shared = statistics.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def score(language: pd.Series, *values: pd.Series) -> pd.Series:
        known = shared.value
        out = np.zeros(len(language))
        for name in language.unique():
            at = (language == name).to_numpy()
            for (statistic, weight), series in zip(STATISTICS.items(), values):
                xs, tails_ = known[name if name != "none" else "*", statistic]
                place = np.searchsorted(xs, series.to_numpy()[at] - 1e-9)
                out[at] -= weight * np.log(tails_[np.minimum(place, len(xs) - 1)])
        return pd.Series(np.round(out / sum(STATISTICS.values()), 6))

    return statistics.withColumn("outlier", score("language", *STATISTICS))


def border(scored: DataFrame, least: float = 0.5) -> float:
    """The outlier score that parts all documents best into two groups (the largest variance between them, in steps of a hundredth).

    At least ``least``, since scores below that are ordinary whatever the others are.
    """
    bins = scored.groupBy(F.floor(F.col("outlier") * 100).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # bounded by the range of scores
    if len(bins) < 2:
        return least
    n, x = (np.array([r[c] for r in bins], dtype=float) for c in ("n", "bin"))
    below, mass = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
    above = n.sum() - below
    between = below * above * (mass / below - ((n * x).sum() - mass) / above) ** 2
    best = int(np.argmax(between))
    return max(least, float(x[best] + 1 + x[best + 1]) / 200)


def text_kinds(documents: DataFrame) -> DataFrame:
    """Statistics, outlier score and ``kind``: prose, or what most of a text is instead (list, table, junk).

    An empty text is prose, and so is every text in a collection of texts that are all alike.
    """
    scored = materialise(outlier_scores(materialise(text_statistics(documents), "quality")), "outliers")
    largest = F.greatest("list_share", "table_share", "junk_share")
    kind = F.when(F.col("junk_share") == largest, "junk").when(F.col("table_share") == largest, "table").otherwise("list")
    return scored.withColumn("kind", F.when((F.col("outlier") >= border(scored)) & (largest > 0), kind).otherwise("prose"))
