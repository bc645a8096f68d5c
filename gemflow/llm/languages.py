"""The language of every query and of every segment of a mixed one, by error-correcting output codes.

Each language has a codeword; for each bit of it a binary classifier over character n-grams is trained.
A text's bit margins are compared with all codewords, each bit's logistic loss weighted by how well that bit
was learnt; the codeword with the least loss wins, the others' losses give the confidence, and a small lead
flags the answer as ambiguous. The classifiers are linear and work word by word, so the loss of any span is
cheap, and a mixed text is cut by dynamic programming over its words: changing language costs a fixed amount,
less at punctuation, so a single borrowed word never pays for a change.

Training uses a few phrases per language written here and a bounded sample of labelled texts
(``sample_texts``); the labels are partly wrong, so the words of the sample vote on each text's language, and
texts that a first fit splits are dropped before the last one. Everything else reads all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemflow.functions.text import osa_distance

LANGUAGES = ["en", "hi", "gu", "mr", "ta", "fr", "es", "de", "hi-latn", "gu-latn"]
BITS, DIM = 31, 1 << 15

# Phrases in each language, written for this module; enough to start the fit where labels are wrong.
SEEDS = {
    "en": """i am looking for a light necklace for my mother; show me rings with small stones please; do you have earrings under this price; what is the
        price of this one; it should not be too heavy; something simple for daily office wear; with a round centre stone; not too big or too small; please find
        a thin chain for the wedding; but without diamonds; the smaller size is better; can you make it in another size; for her birthday and anniversary;
        bracelets for women; rings for men; earrings without halo; i want a bold bangle; wedding bands; pair of studs; nose pin""",
    "hi": """मुझे अपनी माँ के लिए हार चाहिए; सोने की अंगूठी दिखाओ; क्या हल्के झुमके मिलेंगे; शादी के लिए चूड़ी कितने की है; जिसमें हीरे न हो; पत्नी को देने के लिए
        सस्ती पायल; पांच ग्राम की अंगूठी; दाम क्या है बताइए; बहुत भारी नहीं होना चाहिए; पन्ने वाली नथ; त्योहार पर पहनने के लिए; यह कैसा है और कब मिलेगा; मोती की माला""",
    "gu": """મને મારી મમ્મી માટે હાર જોઈએ છે; સોનાની વીંટી બતાવો; હલકી બુટ્ટી મળશે; લગ્ન માટે બંગડી કેટલાની છે; દસ ગ્રામની ચેન જોઈએ; ભાવ શું છે; બહુ ભારે નહીં; ચાંદીની ઝાંઝર""",
    "mr": """मला आईसाठी हार हवा आहे; सोन्याची अंगठी दाखवा; हलके कानातले मिळतील का; लग्नासाठी बांगडी पाहिजे; पाच ग्रॅमची अंगठी पाहिजे; किंमत किती आहे; फार जड नको; बायकोसाठी
        चांदीचे पैंजण; वाढदिवसासाठी मोत्याची माळ; हिऱ्याची नथ; ही खूप आवडते आणि ती; सोन्याची ठुशी मिळेल का; साखरपुड्यासाठी दाखवा""",
    "ta": """எனக்கு தங்க மோதிரம் வேண்டும்; வெள்ளி சங்கிலி காட்டுங்கள்; விலை என்ன; திருமணத்திற்கு வளையல்; அம்மாவுக்கு தோடு; வைர மூக்குத்தி""",
    "fr": """je cherche une bague pour ma femme; montrez-moi des boucles d'oreilles en argent; une chaîne fine sans diamant; quel est le prix de ce collier; pas trop
        lourd; pour le mariage de ma sœur; un bracelet avec une petite pierre; en or jaune; elle est trop grande; avez-vous la même plus légère; broche""",
    "es": """busco un anillo para mi esposa; quiero ver pendientes de plata; una cadena fina sin diamante; cuánto cuesta este collar; no muy pesado; para la boda de mi
        hermana; una pulsera con piedra pequeña; de oro amarillo; la más ligera con rubí; sortija sencilla; tiene otra talla""",
    "de": """ich suche einen Ring für meine Frau; zeig mir Ohrringe aus Silber; eine schmale Kette ohne Diamant; was kostet diese Halskette; nicht zu schwer; für die
        Hochzeit meiner Schwester; ein Armband mit kleinem Stein; aus Gelbgold mit Gravur; leichte Brosche zum Geburtstag; haben Sie eine andere Größe""",
    "hi-latn": """mujhe apni maa ke liye haar chahiye; sone ki anguthi dikhao; kya halki jhumke milegi; shaadi ke liye chudi kitne ki hai; jisme heere na ho; biwi ko gift
        dena hai koi sasti payal; paanch gram tak ki ring batao; daam kya hai; bahut bhari nahi honi chahiye; diwali pe pehenne ke liye; ye mujhe acchi lagi aur wali; hai kya; beti ko""",
    "gu-latn": """mane mari mummy mate haar joie chhe; sona ni vinti batavo; halki butti malshe ke nahi; lagan mate bangdi ketla ni chhe; das gram ni chain joiye; bhav shu
        chhe; bahu bhare nahi; chandi ni jhanjhar; tamari pase moti ni; dikri mate; ben mate joiye chhe; patni mate hira ni""",
}

# Other writings of the labels (lower case, country dropped).
LABELS = {"eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "guj": "gu", "gujarati": "gu", "mar": "mr", "tam": "ta", "fra": "fr", "fre": "fr", "spa": "es", "deu": "de", "ger": "de"}

_TOKEN = re.compile(r"[^\W\d_]+(?:[ऀ-ൿ‌‍]+[^\W\d_]*)*(?:['’][^\W\d_]+)*|[ऀ-ൿ]+|\d+|[^\w\s]+|_")
# Units, purities and currency marks, which belong to no language.
_NEUTRAL = set("k kt ct cts ctw g gm gms kg mg mm cm in x rs inr usd aed eur gbp no pc pcs qty sku id mrp us".split())
# Words for metals, stones, pieces and measures that other languages borrow as they are.
BORROWED = set(
    """gold silver platinum rose white yellow diamond diamonds ruby rubies pearl pearls emerald emeralds sapphire opal polki kundan tanzanite moissanite halo
    ring rings necklace necklaces bracelet bracelets pendant pendants choker bangle bangles anklet earring earrings studs hoops chain mangalsutra mangalsutras inch inches gram grams jhumka set""".split()
)
_BORROWED_LETTERS: dict[str, list[str]] = {}
for _w in sorted(BORROWED):
    _BORROWED_LETTERS.setdefault("".join(sorted(_w)), []).append(_w)
_BLOCKS = {"gu": ("઀", "૿"), "ta": ("஀", "௿"), "deva": ("ऀ", "ॿ")}


def label_of(label: str | None) -> str | None:
    """A label without case and country; None where there is none."""
    if not isinstance(label, str) or not label.strip():
        return None
    low = label.strip().lower().replace("_", "-")
    parts = low.split("-")
    base = LABELS.get(parts[0], parts[0])
    return f"{base}-latn" if "latn" in parts[1:] else base


def script_of(word: str) -> str | None:
    """The script block of a word's letters: gu, ta, deva, latn, or other; None without letters."""
    for c in word:
        if not (c.isalpha() or "ऀ" <= c <= "ൿ"):
            continue
        for name, (low, high) in _BLOCKS.items():
            if low <= c <= high:
                return name
        return "latn" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "other"
    return None


SCRIPT_LANGUAGES = {"gu": ["gu"], "ta": ["ta"], "deva": ["hi", "mr"], "latn": ["en", "fr", "es", "de", "hi-latn", "gu-latn"]}


def _piece(piece: str) -> tuple[list[tuple[str, bool]], bool]:
    """Words of one blank-separated piece with the punctuation flag before each, and the flag after the last."""
    if any(c.isdigit() for c in piece) and script_of(piece) in ("latn", None) and re.fullmatch(r"[^\w]*[\w#./%+-]*\d[\w#./%+-]*[^\w]*", piece):
        return [], bool(re.search(r"[,.;:!?/]$", piece))  # a number, a purity, a measure or a code
    out, cut = [], False
    for m in _TOKEN.finditer(piece):
        token = m.group()
        script = script_of(token)
        if script is None:
            cut = cut or bool(re.search(r"[,.;:!?/|–—-]", token)) and not (0 < m.start() and m.end() < len(piece) and token in ("-", "'", "’"))
            continue
        low = token.lower()
        if script == "latn" and low in _NEUTRAL:
            continue
        out.append((low, cut))
        cut = False
    return out, cut


#: Scripts from the last in the alphabet, so that the first of equals is the last by name.
_SCRIPTS = ["ta", "other", "latn", "gu", "deva"]
_WRITTEN = np.array([[name in SCRIPT_LANGUAGES.get(s, LANGUAGES) for name in LANGUAGES] for s in _SCRIPTS])


def _borrowed(word: str) -> bool:
    """Whether a word is a trade word, or one with letters that changed places."""
    return any(osa_distance(word, known, 2) <= 2 for known in _BORROWED_LETTERS.get("".join(sorted(word)), ()))


def words_of(text: str, known: dict | None = None) -> list[tuple[str, bool]]:
    """(word, punctuation before it) for the words of a text; numbers, units, codes and signs are left out.

    ``known`` keeps pieces that were read before.
    """
    out, cut = [], False
    for piece in text.split():
        got = known.get(piece) if known is not None else None
        if got is None:
            got = _piece(piece)
            if known is not None:
                known[piece] = got
        for word, flag in got[0]:
            out.append((word, cut or flag))
            cut = False
        cut = cut or got[1]
    return out


def features(word: str) -> np.ndarray:
    """Hashed character n-grams of a word, one to four long with its edges, and the word itself."""
    w = f"<{word}>"
    grams = {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} | {"=" + word}
    return np.array(sorted({zlib.crc32(g.encode()) % DIM for g in grams}), dtype=np.int64)


@lru_cache
def codewords(classes: int = len(LANGUAGES), bits: int = BITS, tries: int = 3000, seed: int = 2) -> np.ndarray:
    """Codewords of +1 and -1, the set with the largest least distance among seeded random ones; no bit is constant."""
    rng = np.random.default_rng(seed)
    best, most = None, (-1, -1)
    for _ in range(tries):
        code = rng.choice([-1, 1], (classes, bits))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        apart = ((bits - code @ code.T) // 2)[np.triu_indices(classes, 1)]
        rank = (int(apart.min()), int(apart.sum()))
        if rank > most:
            best, most = code, rank
    return best.astype(np.float64)


class Identifier:
    """The fitted bit classifiers and the decoder."""

    #: Cost of changing language between words, and at punctuation; the most that one word may cost, and a borrowed one.
    CHANGE, AT_CUT, REACH, BORROWED_COST = 7.0, 3.5, 6.0, 1.2
    #: Words and pieces kept between batches.
    KEPT = 200_000

    def __init__(self, weights: np.ndarray, bit_weight: np.ndarray, code: np.ndarray):
        self.weights, self.bit_weight, self.code = weights, bit_weight, code
        self._pieces: dict[str, tuple] = {}
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._margin, self._cost, self._letters = np.zeros((0, BITS)), np.zeros((0, len(LANGUAGES))), np.zeros((0, len(_SCRIPTS)))

    def margins(self, word: str) -> np.ndarray:
        """Bit margins of one word."""
        f = features(word)
        return self.weights[f].sum(axis=0) / np.sqrt(len(f))

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every language's codeword under the margins (rows of them too).

        The loss of a bit is that of agreement plus the margin where the codeword has the other sign.
        """
        agree = np.logaddexp(0, -margin) @ self.bit_weight
        return agree[..., None] + (margin * self.bit_weight) @ ((1 - self.code.T) / 2)

    def _learn(self, words: list[str]) -> None:
        """Read words into the tables: margins, cost per language, letters per script."""
        margin = np.array([self.margins(w) for w in words])
        cost = self.losses(margin)
        most = np.array([self.BORROWED_COST if _borrowed(w) else self.REACH for w in words])
        cost = np.minimum(cost - cost.min(axis=1, keepdims=True), most[:, None])
        letters = np.zeros((len(words), len(_SCRIPTS)))
        for i, w in enumerate(words):
            script = script_of(w)
            letters[i, _SCRIPTS.index(script)] = len(w)
            if script in SCRIPT_LANGUAGES:
                fits = _WRITTEN[_SCRIPTS.index(script)]
                cost[i] = np.where(fits, cost[i] - cost[i][fits].min(), self.REACH + 6)
        self._place |= {w: len(self._place) + i for i, w in enumerate(words)}
        self._margin, self._cost, self._letters = (np.concatenate([x, y]) for x, y in ((self._margin, margin), (self._cost, cost), (self._letters, letters)))

    def _path(self, cost: np.ndarray, cuts: list[bool]) -> list[int]:
        """The language of every word by dynamic programming."""
        n, c = cost.shape
        best, back = cost[0].copy(), np.zeros((n, c), dtype=np.int64)
        for i in range(1, n):
            low = int(np.argmin(best))
            changed = best[low] + (self.AT_CUT if cuts[i] else self.CHANGE)
            back[i] = np.where(changed < best, low, np.arange(c))
            best = np.minimum(changed, best) + cost[i]
        path = [int(np.argmin(best))]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]

    def segment(self, text: str | None) -> list[tuple[str, float, bool, str]]:
        """(language, confidence, ambiguous, words) per segment of a text, in order; none without words."""
        return self.segment_all([text])[0]

    def segment_all(self, texts: list[str | None]) -> list[list[tuple[str, float, bool, str]]]:
        """The segments of many texts at once.

        A word's cost under a language is its excess loss, at most ``REACH`` so that no single word decides, and at
        most ``BORROWED_COST`` for the names of metals, stones and pieces, letters out of place or not; changing
        language costs ``CHANGE``, at punctuation ``AT_CUT``. Every word costs nothing in some language, so a text that
        costs less than a change in one language is in that language, and only other texts need the programme.
        """
        if len(self._pieces) > self.KEPT:
            self._pieces.clear()
        if len(self._place) > self.KEPT:
            self._forget()
        tokens = [words_of(t, self._pieces) if t else [] for t in texts]
        new = dict.fromkeys(w for row in tokens for w, _ in row if w not in self._place)
        if new:
            self._learn(list(new))
        out: list[list] = [[] for _ in texts]
        full = [i for i, row in enumerate(tokens) if row]
        if not full:
            return out
        flat = np.array([self._place[w] for i in full for w, _ in tokens[i]])
        starts = np.cumsum([0, *[len(tokens[i]) for i in full]])
        total = np.add.reduceat(self._cost[flat], starts[:-1], axis=0)
        single, low = np.argmin(total, axis=1), total.min(axis=1)
        spans = []  # (text, first word, end, language), words counted over all texts
        for k, i in enumerate(full):
            a, b = int(starts[k]), int(starts[k + 1])
            cuts = [cut for _, cut in tokens[i]]
            if low[k] < (self.AT_CUT if any(cuts[1:]) else self.CHANGE):
                spans.append((i, a, b, int(single[k])))
                continue
            path = self._path(self._cost[flat[a:b]], cuts)
            edges = [0, *[j for j in range(1, b - a) if path[j] != path[j - 1]], b - a]
            spans += [(i, a + x, a + y, path[x]) for x, y in zip(edges, edges[1:])]
        firsts = np.array([a for _, a, _, _ in spans])  # spans lie end to end
        loss = self.losses(np.add.reduceat(self._margin[flat], firsts, axis=0))
        main = np.argmax(np.add.reduceat(self._letters[flat], firsts, axis=0), axis=1)
        loss = np.where(_WRITTEN[main], loss, np.inf)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(p, axis=1)[:, -2:]
        words = [w for i in full for w, _ in tokens[i]]
        for (i, a, b, lang), (second, first) in zip(spans, two.tolist()):
            out[i].append((LANGUAGES[lang], first, first < 2 * second, " ".join(words[a:b])))
        return out


def _sums(values: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[index], starts, axis=0)


def train(texts: list[str], labels: list[str], seed: int = 4, rounds: int = 220, decay: float = 2e-4, settled: float = 1e-4) -> Identifier:
    """Fit the bit classifiers on (text, language), full batch, on whole texts and on random spans of them.

    The fit ends after ``rounds``, or as soon as no more than a share ``settled`` of the decisions on the training spans
    changed in ten rounds.
    """
    rng = np.random.default_rng(seed)
    code = codewords()
    spans, target, pieces = [], [], {}
    for text, label in zip(texts, labels):
        words = [w for w, _ in words_of(text, pieces)]
        if not words:
            continue
        y = LANGUAGES.index(label)
        spans.append(words)
        target.append(y)
        for size in (1, 2, 3):
            if len(words) > size:
                at = int(rng.integers(0, len(words) - size + 1))
                spans.append(words[at : at + size])
                target.append(y)
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in spans for w in s}))}
    feats = [features(w) for w in vocabulary]
    f_index, f_start = np.concatenate(feats), np.cumsum([0, *[len(f) for f in feats[:-1]]])
    f_scale = np.repeat([1 / np.sqrt(len(f)) for f in feats], [len(f) for f in feats])[:, None].astype(np.float32)
    f_word = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    by_feature = np.argsort(f_index, kind="stable")
    used, u_start = np.unique(f_index[by_feature], return_index=True)
    s_index = np.array([vocabulary[w] for s in spans for w in s])
    lengths = np.array([len(s) for s in spans])
    s_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    s_row = np.repeat(np.arange(len(spans)), lengths)
    by_word = np.argsort(s_index, kind="stable")
    _, w_start = np.unique(s_index[by_word], return_index=True)
    y = code[np.array(target)].astype(np.float32)
    count = np.bincount(target, minlength=len(LANGUAGES))
    row_weight = (1 / np.maximum(count, 1))[np.array(target)][:, None]
    row_weight = (row_weight / row_weight.mean()).astype(np.float32)
    f_used = np.searchsorted(used, f_index)
    w, m, v = (np.zeros((len(used), BITS), dtype=np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        word_margin = np.add.reduceat(w[f_used] * f_scale, f_start, axis=0)
        margin = _sums(word_margin, s_index, s_start)
        if t % 10 == 0:
            decided = margin > 0
            if t > 20 and (decided != before).mean() <= settled:
                break
            before = decided
        grad = -y * row_weight / (1 + np.exp(y * margin))
        word_grad = _sums(grad, s_row[by_word], w_start)
        g = np.add.reduceat((word_grad[f_word] * f_scale)[by_feature], u_start, axis=0) / np.float32(len(spans)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((margin * y > 0) * row_weight).mean(axis=0)
    share = np.clip(right, 0.5 + 1e-3, 1 - 1e-3)
    bit_weight = np.log(share / (1 - share))
    weights = np.zeros((DIM, BITS), dtype=np.float32)
    weights[used] = w
    return Identifier(weights, bit_weight / bit_weight.mean(), code)


def voted(texts: list[str], counts: list[dict[str, int]]) -> list[tuple[str, str]]:
    """(text, language) for texts on whose language their words' labels agree.

    Every word votes with the labels of all texts that hold it, so a wrong label is outvoted by the right ones
    of texts with the same words; scripts that a language isn't written in are out.
    """
    votes: dict[str, np.ndarray] = {}
    pieces: dict = {}
    split = [[w for w, _ in words_of(t, pieces)] for t in texts]
    for words, labels in zip(split, counts):
        row = np.array([labels.get(name, 0) for name in LANGUAGES], dtype=float)
        for w in set(words):
            votes[w] = votes.get(w, 0) + row
    out = []
    for t, words in zip(texts, split):
        scripts = {script_of(w) for w in words}
        allowed = np.array([bool(scripts) and all(name in SCRIPT_LANGUAGES.get(x, []) for x in scripts) for name in LANGUAGES])
        if not allowed.any():
            continue
        share = np.mean([votes[w] / max(votes[w].sum(), 1) for w in words], axis=0)
        share = np.where(allowed, share, 0)
        order = np.argsort(-share)
        if share[order[0]] >= 1.5 * share[order[1]] and share[order[0]] > 0:
            out.append((t, LANGUAGES[order[0]]))
    return out


def fit(rows: DataFrame, text: str, label: str, sample_texts: int = 12_000, per_language: int = 700) -> Identifier:
    """Fit on the seeds and on at most ``sample_texts`` distinct labelled texts, taken by hash order.

    Labels are noisy: words vote on the language of a text over all labels in the sample; at most ``per_language``
    texts of a language enter the fit, and those that a first fit splits into several languages are dropped.
    """
    base = F.lower(F.regexp_replace(F.col(label), "_", "-"))
    plain = F.when(base.contains("latn"), F.concat(F.split(base, "-")[0], F.lit("-latn"))).otherwise(F.split(base, "-")[0])
    known = rows.select(F.col(text).alias("t"), plain.alias("l")).where(F.col("l").isin(LANGUAGES) & F.col("t").isNotNull())
    counted = known.groupBy("t", "l").agg(F.count("*").alias("n")).groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("labels"))
    sample = counted.orderBy(F.xxhash64("t"), "t").limit(sample_texts).toPandas().sort_values("t")  # the documented bound
    clean = voted(sample["t"].tolist(), [dict(x) for x in sample["labels"]])
    seeds = [(x.strip(), lang) for lang, block in SEEDS.items() for x in block.split(";") if x.strip()] * 4

    def some(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
        taken: dict[str, int] = {}
        out = []
        for t, lang in sorted(pairs, key=lambda p: zlib.crc32(p[0].encode())):
            taken[lang] = taken.get(lang, 0) + 1
            if taken[lang] <= per_language:
                out.append((t, lang))
        return out

    kept = some(clean)
    model = train(*zip(*[*seeds, *kept]), rounds=120)
    clean = [(t, lang) for (t, lang), parts in zip(kept, model.segment_all([t for t, _ in kept])) if {p[0] for p in parts} == {lang}]
    return train(*zip(*[*seeds, *clean]))


SEGMENTS = "id long, label string, languages array<string>, segments array<struct<lang:string,confidence:double,ambiguous:boolean,words:string>>"


def identify(rows: DataFrame, model: Identifier, key: str = "id", text: str = "query", label: str = "lang", detail: bool = True) -> DataFrame:
    """Languages and segments per row: (id, label, languages, segments), without the segments where no ``detail`` is wanted.

    A null or wordless text has no languages. Repeated keys count once (the row with the largest text); null
    keys take no part. ``label`` comes out without case and country.
    """
    once = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.struct(F.col(text).alias("t"), F.col(label).alias("l"))).alias("_r")).select("id", "_r.t", "_r.l")
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bit_weight, model.code))  # a fixed size: DIM x BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Identifier(*shared.value)
        for pdf in batches:
            places: dict = {}
            for t in pdf["t"]:
                places.setdefault(t, len(places))
            found = own.segment_all([t if isinstance(t, str) else None for t in places])
            parts = [found[places[t]] for t in pdf["t"]]
            out = pd.DataFrame({"id": pdf["id"], "label": [label_of(x) for x in pdf["l"]], "languages": [sorted({p[0] for p in x}) for x in parts]})
            if detail:
                out["segments"] = [[dict(zip(("lang", "confidence", "ambiguous", "words"), p)) for p in x] for x in parts]
            yield out

    return once.mapInPandas(run, SEGMENTS if detail else SEGMENTS.split(", segments")[0])


def mislabelled(found: DataFrame) -> DataFrame:
    """(id, lang): rows whose languages are not exactly the label, one row per language."""
    right = (F.size("languages") == 1) & F.col("label").eqNullSafe(F.get("languages", F.lit(0)))
    return found.where((F.size("languages") > 0) & ~right).select("id", F.explode("languages").alias("lang"))
