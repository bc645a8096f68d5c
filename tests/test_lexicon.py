import pytest

from gemflow.operators.lexicon import FORMS, SAMPLE, Lexicon, closest, is_real, parse

READER = Lexicon(SAMPLE, FORMS, {"make", "half", "cover"})

# text; fields that must equal; intents it has, lacks, and rules out
CASES = [
    ("silver ring + single dimond on center (no more dimonds on ring)and simple without dimond thin width", {"category": "ring", "metal": "white_gold", "metal_note": True, "not_categories": []}, "solitaire thin minimal", "diamond plain", "side_stones"),
    ("rign for my wife", {"category": "ring", "corrections": {"rign": "ring"}}, "women", "", ""),
    ("gents ring bina stone", {"category": "ring"}, "plain men", "diamond", "diamond"),
    ("ring with no stones or diamonds", {"category": "ring"}, "plain", "diamond", ""),
    ("ring, not yellow gold", {"category": "ring", "metal": None, "not_metals": ["yellow_gold"]}, "", "", ""),
    ("wide men's band with diamonds for my husband", {"category": "ring"}, "wide men diamond", "", ""),
    ("oval diamond engagement ring", {"category": "ring", "shape": "oval"}, "engagement diamond", "", ""),
    ("Plain gold band for daily use", {"category": "ring"}, "plain everyday", "", "diamond"),
    ("a single diamond held by prongs on a thin plain band with no stones on the sides", {"category": "ring"}, "solitaire prong thin", "plain", "side_stones"),
    ("Long drop earrings with a stud at the top and a pear diamond on a thin chain", {"categories": ["earrings"], "shape": "pear"}, "drop stud", "pendant_chain", ""),
    ("a thin chain", {"category": "necklace"}, "pendant_chain thin", "", ""),
    ("three stone ring, one bigger diamond in the middle", {"category": "ring"}, "three_stone big_stone", "solitaire", ""),
    ("A leaf ring, no big center stone", {"category": "ring"}, "leaf", "big_stone", "big_stone"),
    ("gift for my sister, pendant or earrings", {"categories": ["pendant", "earrings"]}, "gift women", "", ""),
    ("thin or wide ring", {"category": "ring"}, "thin", "wide", ""),
    ("હીરા વગરની પાતળી વીંટી", {"category": "ring"}, "plain thin", "diamond", ""),
    ("हीरे के बिना पतली अंगूठी", {"category": "ring"}, "plain thin", "diamond", ""),
    ("હાર્ટ વાળું પેન્ડન્ટ", {"categories": ["pendant"]}, "heart", "", ""),
    ("પાતળી વીંટી જોઈએ છે જેમાં વચ્ચે એક મોટો ગોળ હીરો હોય", {"category": "ring"}, "thin big_stone solitaire", "statement", ""),
    ("ring me diamond nahi chahiye", {"category": "ring"}, "plain", "diamond", ""),
    ("necklace without pearl or ruby", {"category": "necklace"}, "", "pearl coloured_stone", "pearl coloured_stone"),
    ("plain solitaire pendant", {"category": "pendant"}, "solitaire", "plain", ""),
    (None, {"category": None, "categories": [], "intents": [], "leftover": "", "free_text": None}, "", "", ""), ("", {"metal": None}, "", "", ""), ("?!,", {"leftover": ""}, "", "", ""),
    ("some velvet ring like starlight", {"free_text": "velvet starlight"}, "", "", ""),
]


@pytest.mark.parametrize("text,equal,has,lacks,out", CASES, ids=[str(c[0])[:40] for c in CASES])
def test_reading(text, equal, has, lacks, out):
    got = READER.read(text)
    assert {k: got[k] for k in equal} == equal
    assert set(has.split()) <= set(got["intents"]) and not set(lacks.split()) & set(got["intents"]) and set(out.split()) <= set(got["not_intents"])


def test_spelling_leaves_real_words_and_their_forms():
    assert [closest(w, READER.vocabulary, set()) for w in ("dimonds", "pendnat", "neklace", "engagment", "zzzz", "rin")] == ["diamonds", "pendant", "necklace", "engagement", "zzzz", "rin"]
    assert all(is_real(w, READER.real) for w in ("make", "making", "halfs", "covered", "covers")) and not is_real("bed", {"b"})
    assert closest("covered", READER.vocabulary, READER.real) == "covered"


def test_rows_in_batches(spark):
    df = spark.createDataFrame([(1, "rose gold ring"), (2, None), (2, "long text " * 5000), (None, "halo")], "id long, query string")
    got = sorted(((r.id, r.metal, r.categories) for r in parse(df, "id", "query").collect()), key=str)
    assert got == sorted([(1, "rose_gold", ["ring"]), (2, None, []), (2, None, []), (None, None, [])], key=str)
