"""Phrases put into prompts, prompts made of pages, labels paired with values. Each text is sequential in itself, so texts are read in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gemflow.operators.lexicon import FORMS, SAMPLE, Lexicon

# Words before which nothing is put, and words that join a describing phrase to the piece.
FILLER = set("i want need a an the some show me please find looking for my".split())
JOINERS = set("with in of and for on".split())
_LABEL = re.compile(r"(?:(?:gross|net|nett|gold|metal|stone|diamond|product)\s+)*(?:weight|wt|purity|metal|setting|shape|size|width|height|breadth|dimensions?|colou?r|karat|material|no\. of diamonds|stone count)\b[\w .()×,-]{0,24}", re.I)
_SKIPPED = {":", "-", "|", "·"}
_BUTTON = re.compile(r"\b(?:shop by|add to cart|buy now|view all|click)\b", re.I)


def with_phrase(text: str | None, words: str, nouns: set[str]) -> str | None:
    """A prompt with words put in front of what describes its piece; at the start where it names none.

    Fillers at the head stay in front. A joining word before the piece puts the words right before the piece's name. An
    article before them follows their first letter.
    """
    if text is None:
        return None
    tokens = text.split()
    plain = [re.sub(r"[^\w'-]", "", t).lower() for t in tokens]
    noun = next((i for i, w in enumerate(plain) if w in nouns), None)
    at = 0
    if noun is None:
        at = 1 if plain[:1] and plain[0] in ("a", "an", "the") else 0
    else:
        for i, w in enumerate(plain[:noun]):
            at = noun if w in JOINERS and w not in FILLER else i + 1 if w in FILLER else at
            if at == noun:
                break
    if at and plain[at - 1] in ("a", "an"):
        article = "an" if words[:1].lower() in "aeiou" else "a"
        tokens[at - 1] = article.capitalize() if tokens[at - 1][0].isupper() else article
    return " ".join([*tokens[:at], words, *tokens[at:]])


def insert_before(text, words: Column) -> Column:
    """``with_phrase`` over a column, for the pieces of the sample lexicon; null stays null."""
    nouns = {t for t, kind, _ in SAMPLE if kind == "category"}

    @F.pandas_udf(StringType())
    def place(texts: pd.Series, phrase: pd.Series) -> pd.Series:
        return pd.Series([with_phrase(t if isinstance(t, str) else None, p, nouns) for t, p in zip(texts, phrase)], dtype=object)

    return place(F.col(text) if isinstance(text, str) else text, words)


def page_prompts(pages: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, prompt): the terms that texts in order of trust name, each meaning once; null where they name none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Lexicon(SAMPLE, FORMS)
        for pdf in batches:
            out = []
            for listed in pdf["_t"]:
                seen: dict[tuple, str] = {}
                for text in listed if listed is not None else ():
                    words, _ = reader.repair((text or "").lower().split())
                    for hit in reader.find(words)[1]:
                        if not hit.negated and hit.term != "bigstone":
                            # a type may be named twice in other words
                            meaning = (hit.kind, hit.value, hit.term.rstrip("s")) if hit.kind == "category" else (hit.kind, hit.value)
                            seen.setdefault(meaning, hit.term)
                out.append(" ".join(seen.values()) or None)
            yield pd.DataFrame({key: pdf["_k"], "prompt": out})

    return pages.select(F.col(key).alias("_k"), F.col(texts).alias("_t")).mapInPandas(run, f"{key} long, prompt string")


def is_label(text: str) -> bool:
    return 0 < len(text.strip()) <= 40 and bool(_LABEL.fullmatch(text.strip().rstrip(":").strip()))


def is_value(text: str) -> bool:
    t = text.strip()
    return 0 < len(t) <= 80 and len(t.split()) <= 12 and not t.endswith("?") and bool(re.search(r"\w", t)) and not is_label(t) and not _BUTTON.search(t)


def node_pairs(nodes: list[str]) -> list[tuple[str, str]]:
    """Labels and values out of text nodes: a label and the value after it, signs between them skipped, or both in one node."""
    out, waiting = [], None
    for node in nodes:
        if waiting is not None:
            if node.strip() in _SKIPPED:
                continue
            label, waiting = waiting, None
            if is_value(node):
                out.append((label.strip().rstrip(": "), node.strip().lstrip(": ")))
                continue
        if is_label(node):
            waiting = node
        elif ":" in node:
            label, value = node.split(":", 1)
            if is_label(label) and is_value(value):
                out.append((label.strip(), value.strip()))
    return out


def pair_nodes(rows: DataFrame, key: str, nodes: str) -> DataFrame:
    """(key, pos, label, value) for arrays of text nodes; null nodes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, a, b) for k, listed in zip(pdf["_k"], pdf["_n"]) for i, (a, b) in enumerate(node_pairs([n for n in (listed if listed is not None else ()) if n is not None]))]
            yield pd.DataFrame(out, columns=[key, "pos", "label", "value"])

    return rows.select(F.col(key).alias("_k"), F.col(nodes).alias("_n")).mapInPandas(run, f"{key} long, pos int, label string, value string")
