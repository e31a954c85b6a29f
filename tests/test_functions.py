import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from clauseweave.functions import numeric, sections, text
from clauseweave.functions.fuzzy import matching_ratio


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


WORDS = [
    "Straße 5G-GUTI in 5.5.1.2",
    "ΑΣ Σίσυφος ΐ ﬁne ſ K İstanbul",
    "ᏸ Ꮰ µ ẞ ǰ",
    "",
    "  Plain ASCII\x1f ",
    "a😀b C",
]


def test_tokens_follow_the_pattern(spark):
    got = apply(spark, WORDS, text.tokenize)
    assert got == [[t.lower() for t in re.findall(text.TOKEN_PATTERN, w)] for w in WORDS]
    assert text.tokenize_literal("5G-GUTI in 5.5.1.2 in") == ["5g-guti", "in", "5.5.1.2"]


def test_folding_normalising_and_slugs_match_python(spark):
    assert apply(spark, WORDS, text.casefold) == [w.casefold() for w in WORDS]
    normal = [re.sub("[^a-z0-9]+", " ", w.casefold()).strip() for w in WORDS]
    assert apply(spark, WORDS, text.normalize_entity) == normal
    assert apply(spark, WORDS, text.slug) == [n.replace(" ", "-") or "item" for n in normal]
    assert apply(spark, WORDS, text.strip) == [w.strip() for w in WORDS]
    assert apply(spark, WORDS, text.collapse_space) == [" ".join(w.split()) for w in WORDS]
    assert apply(spark, ["", "  \x1c", "x"], text.is_blank) == [True, True, False]


def test_spans(spark):
    cases = [("Straße und WEG", "weg"), ("abc", "zzz"), ("abc", "zzzzz"), ("", "x"), ("abc", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, v string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(text.span(F.col("t"), F.col("v"))).collect()]

    def expected(t, v):
        at = t.casefold().find(v.casefold()) if v and t else -1
        return (at, at + len(v)) if at >= 0 else (0, min(len(t), max(len(v), 1)))

    assert got == [expected(*c) for c in cases]


def test_reference_offsets_are_exact(spark):
    pattern = re.compile(r"\b3GPP\s+TS\s+\d{2}\.\d{3}\b", re.I)
    texts = [
        "😀 x3GPP TS 24.501 then 3gpp ts 33.501, 3GPP TS 24.5012 and 3GPP  TS 23.502",
        "3GPP TS 24.501",
        "none",
    ]
    got = apply(spark, texts, lambda c: text.find_spans(c, text.REFERENCE_PATTERN))
    assert [[tuple(m) for m in row] for row in got] == [
        [(m.start(), m.end(), m.group()) for m in pattern.finditer(t)] for t in texts
    ]


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [i / u * 0.5 for u in (64, 128, 320, 7) for i in range(u)]
    values += [min(i / u / 0.3, 1.0) * 0.15 for u in (64, 320, 640) for i in range(u)]
    values += [rng.random() * 100 for _ in range(500)] + [0.1234565, 0.1234575, 0.0]
    got = apply(spark, values, lambda c: numeric.py_round(c, 6), "double")
    assert got == [round(v, 6) for v in values]


def test_section_functions(spark):
    names = ["5", "50", "5.1", "4.2A.1", "10", "9", "5.10", "5.9", "Annex"]
    assert apply(spark, names, lambda c: sections.under_prefix(c, "5")) == [
        n == "5" or n.startswith("5.") for n in names
    ]
    assert apply(spark, names, sections.parent)[2:4] == ["5", "4.2A"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    ordered = [r[0] for r in df.orderBy(sections.numeric_sort_key(F.col("v"))).collect()]

    def key(s):
        return tuple((int(p), "") if p.isdigit() else (10**9, p) for p in s.split("."))

    assert ordered == sorted(names, key=key)
    paths = ["a/24501-j20.md5.5.1.2.<SEP>b/24501-J20.MD4.1", "x"]
    assert apply(spark, paths, sections.provenance_sections) == [["4.1", "5.5.1.2"], []]
    assert apply(spark, paths, sections.marked_sections) == [["5.5.1.2."], []]


def test_citations(spark):
    answers = ["chunk_id: `a-1` and **chunk_id**: b. chunk_id=a-1", 'no "chunk_id": "x"']
    expected = [list(dict.fromkeys(re.findall(text.CITATION_PATTERN, a))) for a in answers]
    assert apply(spark, answers, text.cited_chunk_ids) == expected
    assert expected[0] == ["a-1"]


def test_fuzzy_ratio(spark):
    labels = ["registration procedure", "registration area", "zzz", None, "regist"]
    got = apply(spark, labels, lambda c: matching_ratio("registration", c, 0.45))
    want = [
        None if v is None else SequenceMatcher(None, "registration", v).ratio() for v in labels
    ]
    assert got == [w if w is not None and w >= 0.45 else None for w in want]
