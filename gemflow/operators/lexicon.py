"""Free-text queries to filters: spelling repair, longest-match terms, negation, resolution.

The lexicon is a parameter. A small one written for this package serves tests and queries; real ones are
content. Matching consumes spans, longest term first, which is sequential within a text, so it runs row by row
inside Arrow batches; the lexicon is a fixed table and travels with the function.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemflow.functions.text import osa_distance

# A small sample: kind, then value to its terms. A metal value after ``~`` is one that is shown as another, with a note.
_SAMPLE = {
    "category": {
        "ring": "ring, rings, anguthi, vinti, अंगूठी, વીંટી, વીટી", "earrings": "earring, earrings, ear rings, studs, stud, hoops, jhumka, butti, बाली, કાનની બુટ્ટી, બુટ્ટી",
        "pendant": "pendant, pendants, locket, पेंडेंट, પેન્ડન્ટ", "necklace": "necklace, necklaces, haar, choker, rani haar, chain, हार, હાર", "bracelet": "bracelet, bracelets, bangle, bangles, cuff, kada, chain bracelet, कंगन, બંગડી",
        "anklet": "anklet, anklets, payal",
    },
    "metal": {
        "rose_gold": "rose gold, pink gold, रोज़ गोल्ड, રોઝ ગોલ્ડ", "white_gold": "white gold, सफेद सोना, સફેદ સોનું", "white_gold~silver": "silver, platinum, chandi, चांदी, ચાંદી", "yellow_gold": "yellow gold, पीला सोना",
    },
    "shape": {
        "oval": "oval", "pear": "pear, drop shaped, teardrop, बूंद, ટીપા જેવો", "princess": "princess, princess cut", "emerald": "emerald cut", "marquise": "marquise", "cushion": "cushion, cushion cut", "round": "round, गोल, ગોળ",
    },
    "intent": {
        "solitaire": "solitaire, single diamond, single stone, one diamond, centre diamond, center diamond, center stone, diamond on center, single round diamond, एक हीरा, सॉलिटेयर, એક હીરો", "halo": "halo, surrounded by diamonds",
        "side_stones": "side stones, side diamonds, pave, stones on the sides", "big_stone": "bigstone", "three_stone": "three stone, three stones, trilogy, on each side", "prong": "prong, prongs", "bezel": "bezel",
        "single_row": "single row, one row", "rows": "rows, multiple layers, layers", "tennis": "tennis, eternity", "cluster": "cluster, lots of diamonds", "diamond": "diamond, diamonds, stone, stones, heera, sparkling, हीरा, हीरे, હીરા, ચમકદાર, चमकदार",
        "coloured_stone": "ruby, emerald, sapphire, gemstone", "pearl": "pearl, pearls, moti", "plain": "plain gold, plain band, plain", "drop": "drop, dangling, hanging", "thin": "thin, slim, thin width, thin band, patli, पतली, પાતળી",
        "wide": "wide, broad, wide band", "minimal": "simple, minimal, light, small, halki, નાની, સાદી, सादी", "statement": "heavy, big, bold, bhari, ભારે, भारी", "everyday": "everyday, daily, daily use, office wear, રોજ, रोज़",
        "bridal": "bridal, wedding, bride, dulhan, લગ્ન, शादी", "engagement": "engagement, sagai", "party": "party, festive, पार्टी", "floral": "floral, flower, flowers, phool", "heart": "heart, hearts, હાર્ટ", "leaf": "leaf, leaves",
        "twisted": "twisted", "open_design": "open design, gap, two ends", "men": "men, mens, men's, gents, husband, father", "women": "women, mother, wife, sister, મમ્મી, माँ", "gift": "gift, birthday",
    },
}
#: term, kind, value.
SAMPLE = [(term, kind, value) for kind, values in _SAMPLE.items() for value, terms in values.items() for term in terms.split(", ")]
#: Forms of a piece that a type word names besides the type.
FORMS = {"hoops": "hoop", "stud": "stud", "studs": "stud", "jhumka": "jhumka", "bangle": "bangle", "bangles": "bangle", "kada": "bangle", "cuff": "cuff", "chain bracelet": "flexible", "choker": "choker", "rani haar": "rani_haar"}

# Cues of negation, and where the negated term is looked for first (> ahead, < behind).
CUES = {
    "no more": ">", "not any": ">", "do not want": ">", "don't want": ">", "dont want": ">", "no": ">", "not": ">", "without": ">", "avoid": ">", "except": ">", "never": ">", "zero": ">", "free of": ">",
    "bina": "><", "bagair": "><", "nahi": "<>", "nahin": "<>", "nai": "<", "free": "<", "vagar": "<", "na joie": "<", "na ho": "<", "nahi ho": "<", "na hoy": "<",
    "વગર": "<", "વગરની": "<", "વગરનું": "<", "નહીં": "<", "ના હોય": "<", "के बिना": "<", "बिना": "><", "नहीं": "<", "नहीं चाहिए": "<", "मत": "<", "न हो": "<",
}
# Words that carry a negation on, intents about stones, words that only name a type where nothing else does.
CONNECTORS = {"or", "and", "nor", "ya", "aur", "ane", "ke", "અને", "કે", "या", "और", "any"}
STONES = {"diamond", "solitaire", "halo", "side_stones", "cluster", "tennis", "three_stone", "coloured_stone", "big_stone", "single_row", "rows", "channel", "prong", "bezel"}
WEAK = {"chain", "ચેન", "चेन"}
LAYOUTS = {"halo", "three_stone", "side_stones", "cluster", "rows", "tennis"}
_BIG = set("big bigger biggest large larger huge bada bade badi mota moto મોટો મોટા મોટી बड़ा बड़े बड़ी".split())
_STONE_NAMES = set("diamond diamonds stone stones hira heera solitaire round oval pear princess cushion emerald marquise હીરો હીરા ગોળ हीरा हीरे गोल".split())
# Words that say nothing to a picture model.
STOP = set(
    """i a an the for my me want need that is which can be of to in on at with and or design designs show some please any only chahiye ke ka ki liye mein koi type wala wali jewellery jewelry looking like
    would it should joie joiye mate also very more less something piece her his their him our wear she he gold sona metal get give find from as so too all set center centre middle single shape shaped style""".split()
)
_SIGNS = str.maketrans(dict.fromkeys("+&(),.;:!?\"/\\-_|*", " ") | {"’": "'"})


def is_real(word: str, real: set[str]) -> bool:
    """Whether a word, or a word it is a plain inflection of, is in a dictionary of base forms."""
    if word in real:
        return True
    endings = {"ies": ["y"], "es": [""], "s": [""], "ed": ["", "e"], "ing": ["", "e"], "ly": [""], "er": [""], "est": [""]}
    return any(word.endswith(end) and len(word) >= len(end) + 3 and word[: -len(end)] + back in real for end, backs in endings.items() for back in backs)


def closest(word: str, vocabulary: list[str], real: set[str]) -> str:
    """A misspelt word's nearest vocabulary word: Latin words of four letters or more that are neither known nor real.

    One edit is allowed up to five letters, else two; only words with the same first letter and at least four letters count; the
    smallest distance wins, then the alphabet. Without one the word stays. ``vocabulary`` is sorted.
    """
    if not re.fullmatch(r"[a-z]{4,}", word) or is_real(word, real):
        return word
    limit = 1 if len(word) <= 5 else 2
    best = (limit + 1, word)
    for at in range(bisect_left(vocabulary, word[0]), len(vocabulary)):
        known = vocabulary[at]
        if known[0] != word[0]:
            break
        if len(known) >= 4:
            best = min(best, (osa_distance(word, known, limit), known), key=lambda b: b[0])
    return best[1] if best[0] <= limit else word


@dataclass
class Hit:
    """A term where it stands in the text."""

    start: int
    end: int
    term: str
    kind: str
    value: str
    negated: bool = False


class _Text:
    """A text and which of its characters are taken."""

    def __init__(self, text: str):
        self.text, self.taken = text, bytearray(len(text))

    def places(self, terms: dict[str, object], longest: int) -> list[tuple[int, int, str]]:
        """Where terms stand: Latin ones as whole words, others anywhere; the longest first, each taking its characters."""
        words = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9']+", self.text)]
        found = []
        for i, (start, _) in enumerate(words):
            for _, end in words[i : i + longest]:
                if self.text[start:end] in terms:
                    found.append((start, end, self.text[start:end]))
        for term in () if self.text.isascii() else terms:
            if not term.isascii() and term in self.text:
                found += [(m.start(), m.end(), term) for m in re.finditer(re.escape(term), self.text)]
        kept = []
        for start, end, term in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if not any(self.taken[start:end]):
                self.take(start, end)
                kept.append((start, end, term))
        return kept

    def take(self, start: int, end: int) -> None:
        self.taken[start:end] = b"\x01" * (end - start)

    def left(self, start: int = 0, end: int | None = None) -> list[str]:
        """The words in a stretch that nothing took."""
        end = len(self.text) if end is None else end
        return "".join(" " if t else c for c, t in zip(self.text[start:end], self.taken[start:end])).split()


class Lexicon:
    """Terms and their meanings, ready to read texts with."""

    def __init__(self, table: list[tuple[str, str, str]], forms: dict[str, str] | None = None, real: set[str] | None = None):
        self.terms = {t.lower(): (kind, value) for t, kind, value in table}
        self.forms, self.real = forms or {}, real or set()
        self.longest = max((len(t.split()) for t in self.terms), default=1)
        self.vocabulary = sorted({w for t in [*self.terms, *CUES] for w in t.split() if w.isascii()} | STOP)
        self.known = {w: w for w in self.vocabulary}  # and every word that was looked up

    def repair(self, words: list[str]) -> tuple[list[str], dict[str, str]]:
        """Words with misspelt ones replaced, and what was."""
        if len(self.known) > 200_000:
            self.known = {w: w for w in self.vocabulary}
        for w in words:
            if w not in self.known:
                self.known[w] = closest(w, self.vocabulary, self.real)
        out = [self.known[w] for w in words]
        return out, {w: c for w, c in zip(words, out) if w != c}

    def find(self, words: list[str]) -> tuple[_Text, list[Hit]]:
        """The text, with a size word before a stone as one term, and its terms in order, negated ones marked."""
        for i, w in enumerate(words):
            if w in _BIG and _STONE_NAMES.intersection(words[i + 1 : i + 3]):
                words = [*words[:i], "bigstone", *words[i + 1 :]]
        text = _Text(" ".join(words))
        hits = sorted((Hit(a, b, t, *self.terms[t]) for a, b, t in text.places(self.terms, self.longest)), key=lambda h: h.start)
        self._negate(text, hits)
        return text, hits

    def _negate(self, text: _Text, hits: list[Hit], gap: int = 3) -> None:
        """Mark what cues negate: ahead the next term within three words and what goes on from it, behind the last one within one.

        Terms go on over connecting words only, or side by side where both are about stones.
        """
        free = _Text(text.text)
        free.taken[:] = text.taken
        cues = free.places(CUES, max(len(c.split()) for c in CUES))
        for start, end, cue in cues:
            for way in CUES[cue]:
                if way == "<":
                    near = [h for h in hits if h.end <= start and len(text.left(h.end, start)) <= 1][-1:]
                else:
                    after = [h for h in hits if h.start >= end]
                    near = [h for h in after if len(text.left(end, h.start)) <= gap][:1]
                    for h in after[after.index(near[0]) + 1 :] if near else ():
                        between = text.left(near[-1].end, h.start)
                        if not (set(between) <= CONNECTORS if between else {h.value, near[-1].value} <= STONES):
                            break
                        near.append(h)
                for h in near:
                    h.negated = True
                if near:
                    break
            text.take(start, end)

    def read(self, text: str | None) -> dict:
        """The structured reading of one text; a null one reads as empty."""
        words, corrections = self.repair((text or "").lower().translate(_SIGNS).split())
        rest, hits = self.find(words)
        leftover = rest.left()
        free = " ".join(w for w in re.findall(r"[a-z]+", " ".join(leftover)) if w not in STOP and len(w) > 2)
        return {"corrections": corrections, **self._resolve(hits, words), "leftover": " ".join(leftover), "free_text": free or None}

    def _resolve(self, hits: list[Hit], words: list[str]) -> dict:
        def of(kind: str, negated: bool) -> list[Hit]:
            return [h for h in hits if h.kind == kind and h.negated == negated]

        types = [h for h in of("category", False) if h.term not in WEAK]
        wanted = dict.fromkeys(h.value for h in of("intent", False)) | dict.fromkeys(self.forms[h.term] for h in types if h.term in self.forms)
        unwanted = dict.fromkeys(h.value for h in of("intent", True))
        categories = [h.value for h in types]
        if not categories and of("category", False):  # a chain names a necklace only where nothing else is named
            categories = [h.value for h in of("category", False)]
            wanted["pendant_chain"] = None
        if not categories and {"band", "bands"}.intersection(words):
            categories = ["ring"]
        often = Counter(categories)
        categories = sorted(often, key=lambda c: -often[c])  # the most named first, then in order
        metals = Counter(h.value.split("~")[0] for h in of("metal", False))
        metal = max(metals, key=metals.__getitem__) if metals else None
        shapes = [h.value for h in of("shape", False)]
        # how stones are laid out
        if "three_stone" in wanted:
            wanted.pop("solitaire", None)
        if "big_stone" in wanted and not LAYOUTS.intersection(wanted):
            wanted["solitaire"] = None
        stones = bool(shapes or STONES.intersection(wanted))
        if "diamond" in unwanted:  # no stones at all, or none but the one described
            del unwanted["diamond"]
            (unwanted if stones else wanted).setdefault("side_stones" if stones else "plain")
        if stones:
            wanted.pop("plain", None)  # plain describes a part then
        if "solitaire" in wanted or "plain" in wanted:
            wanted.pop("diamond", None)
        if "plain" in wanted:
            unwanted.setdefault("diamond")
        if "thin" in wanted:
            wanted.pop("wide", None)
        return {
            "category": categories[0] if categories else None, "categories": categories, "not_categories": sorted({h.value for h in of("category", True)} - set(categories)),
            "metal": metal, "metals": list(metals), "not_metals": sorted({h.value.split("~")[0] for h in of("metal", True)} - {metal}), "metal_note": any("~" in h.value for h in of("metal", False)),
            "shape": shapes[0] if shapes else None, "intents": list(wanted), "not_intents": list(unwanted),
        }


PARSED = """id long, corrections map<string,string>, category string, categories array<string>, not_categories array<string>, metal string, metals array<string>, not_metals array<string>, metal_note boolean,
    shape string, intents array<string>, not_intents array<string>, leftover string, free_text string"""


def parse(rows: DataFrame, key: str, text: str, lexicon: list[tuple[str, str, str]] | None = None, real: set[str] | None = None) -> DataFrame:
    """Structured queries for every row; a null text reads as an empty one. Repeated rows are read each."""
    table, known = lexicon or SAMPLE, real or set()
    names = [c.split()[0] for c in re.split(r",\s+(?=\w+ )", PARSED)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Lexicon(table, FORMS, known), {}
        for pdf in batches:
            out = []
            for i, t in zip(pdf["_id"], pdf["_t"]):
                if t not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[t] = reader.read(t)
                out.append({"id": i, **seen[t]})
            yield pd.DataFrame(out, columns=names)

    return rows.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t")).mapInPandas(run, PARSED)


def completions(vocabulary: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """(term, tail_words): terms that continue the last one, two or three words typed; the longest tail first."""
    words = typed.lower().split()
    test, tail = F.lit(False), F.lit(0)
    for n in range(1, min(3, len(words)) + 1):
        hit = F.col("term").startswith(" ".join(words[-n:])) & (F.col("term") != " ".join(words[-n:]))
        test, tail = test | hit, F.when(hit, n).otherwise(tail)
    return vocabulary.where(test).select("term", tail.alias("tail_words")).orderBy(F.col("tail_words").desc(), F.length("term"), "term").limit(most)
