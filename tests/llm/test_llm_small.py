"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

import gc
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import weakref
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseweave.llm import ann, bpe, components, langid, mixing, near_dedup, passages, quality, secrets, shards, text_hash, topk, vectors
from clauseweave.llm.components import connected

LETTERS = "abcdefghijklmnopqrstuvwxyz"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(draw, n, words=4000):
    return " ".join("".join(LETTERS[(w * k + k * k) % 26] for k in range(1, 6)) + str(w) for w in (draw.randrange(words) for _ in range(n)))


def documents(spark, texts, source=lambda i: "s1", lang=lambda i: "en", extra=False):
    rows = [(i, t, lang(i), source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("kept", "component_id", "shard", "slot", "row", "cell", "key", "value", "size", "_rated", "ids", "secrets", "rank"):
            df = df.withColumn(name, F.lit("clash"))
    return df


EDGES = [None, "", " \t\n", "one", "One  two\tTHREE four", "x" * 200_000, "  é\u0000", " ".join(["again"] * 3000)]


# --- sharding


def test_matrix_lines_fill_every_cell():
    counts, places = np.array([5, 0, 17, 3, 8]), shards.cell_sizes(33, 4, 3)
    lines = np.array([shards.matrix_line(counts, places, p, 3) for p in range(5)])
    assert (lines.sum(1) == counts).all() and (lines.sum(0) == places).all() and (lines >= 0).all()


def test_large_hypergeometric_draws_have_the_right_mean():
    draw = np.random.default_rng(1)
    got = [shards._hypergeometric(3_000_000_000, 1_000_000_000, 10_000, draw) for _ in range(300)]
    assert abs(np.mean(got) - 7500) < 4 * 43.3 / 300**0.5
    assert shards._hypergeometric(3_000_000_000, 5, 3_000_000_003, draw) >= 2_999_999_998


def test_shards_are_exact_and_reruns_agree(spark):
    docs = documents(spark, EDGES * 5, extra=True).repartition(3, "doc_id")
    out = shards.shuffled(docs, shards=4, cell_rows=3)
    rows = out.select("doc_id", "shard", "slot", "text").collect()
    assert sorted(r.doc_id for r in rows) == list(range(40))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(10))
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    assert all(r.text == (EDGES * 5)[r.doc_id] for r in rows)
    assert set(docs.columns) == set(out.columns)


def test_shuffle_is_uniform():
    """Every row is as likely in every cell: chi-square over many seeds."""
    hits = np.zeros(6)
    for seed in range(600):
        line = shards.matrix_line(np.array([1, 5, 6]), np.array([2] * 6), 0, seed)
        hits += line
    assert ((hits - 100) ** 2 / 100).sum() < 25


def test_shards_of_an_empty_table(spark):
    assert shards.shuffled(documents(spark, []), shards=8).count() == 0


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, target = share * sum(sizes.values()), {}
    while len(target) < len(names):
        open_ = [s for s in names if s not in target]
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
    return target


def test_mix_meets_its_targets(spark):
    draw = random.Random(5)
    texts = [sentence(draw, draw.randrange(0, 60)) for _ in range(400)] + EDGES
    source = lambda i: None if i % 50 == 7 else "hot" if i % 3 else f"s{i % 7}"
    docs = documents(spark, texts, source=source, extra=True)
    out = {r.doc_id: r for r in mixing.mix_counts(docs).collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    totals = {}
    for i, n in enumerate(size):
        totals[source(i)] = totals.get(source(i), 0) + n
    target = brute_targets(totals)
    got = dict.fromkeys(totals, 0)
    for i, n in enumerate(size):
        r = out[i]
        assert r.size == n and 0 <= r.taken <= 2 * n and r.source_size == totals[source(i)]
        assert abs(r.target - target[source(i)]) < 1e-6 * (1 + r.target)
        got[source(i)] += r.taken
    assert len(out) == len(texts)
    assert all(abs(got[s] - target[s]) <= 4 * mixing.LEAST_BLOCK for s in got)
    assert {(r.doc_id, r.taken) for r in mixing.mix_counts(docs.repartition(5)).collect()} == {(i, r.taken) for i, r in out.items()}
    rows = mixing.mixed(docs).select("doc_id", "text", "kept").collect()
    words = dict.fromkeys(range(len(texts)), 0)
    for r in rows:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert texts[r.doc_id].lstrip(" \t\n").startswith(r.text.lstrip(" \t\n")) and r.kept == "clash"
    assert words == {i: out[i].taken for i in words}


def test_mix_gives_small_sources_their_target(spark):
    draw = random.Random(8)
    # with 2**7 slots the first block size is above all that the small sources hold
    texts = [sentence(draw, 400) for _ in range(80)] + [sentence(draw, 5) for _ in range(8)] + ["one"]
    source = lambda i: "z" if i == 88 else "big" if i < 40 else "hot" if i < 80 else f"small{i % 2}"
    docs = documents(spark, texts, source=source)
    got, target = {}, {}
    for i, r in enumerate(mixing.mix_counts(docs, slots=1 << 7).orderBy("doc_id").collect()):
        assert 0 <= r.taken <= 2 * r.size
        got[source(i)] = got.get(source(i), 0) + r.taken
        target[source(i)] = r.target
    assert mixing.block_sizes(32_000 * 1.5, 1 << 7) == [375, 1]
    assert target["small0"] > 20 and target["z"] > 1
    assert all(abs(got[s] - target[s]) <= max(3, 0.01 * target[s]) for s in got), (got, target)


def test_mix_keeps_repeated_rows_apart_and_takes_empty_tables(spark):
    docs = documents(spark, ["a b c d e"] * 3).withColumn("doc_id", F.lit(1).cast("long"))
    rows = mixing.mix_counts(docs).collect()
    assert len(rows) == 3 and all(r.source_size == 15 for r in rows)
    assert mixing.mix_counts(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [None, ""])).count() == 0


# --- near duplicates


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(x) for x in range(len(sets))]


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(2)
    texts = list(EDGES)
    common = sentence(draw, 60)
    for _ in range(12):
        base = sentence(draw, draw.choice([8, 40, 120, 400])).split()
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(1, len(base) // 25))):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [sentence(draw, draw.randrange(5, 90)) + " " + common for _ in range(25)]
    texts += [texts[20].upper(), texts[20], texts[20]]
    sets = word_sets(texts)
    expected = brute_components(sets)
    rows = near_dedup.near_duplicates(documents(spark, texts, extra=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), c, c == i) for i, c in enumerate(expected)
    }


@pytest.mark.parametrize("rounds, small", [(4, 1 << 16), (1, 1 << 16), (1, 500), (4, 500)])
def test_near_duplicates_of_chains_of_edits(spark, monkeypatch, rounds, small):
    """Members far from any leader are linked through each other, in rounds or in blocks."""
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 1200)
    draw = random.Random(8)
    words = sentence(draw, 300).split()
    texts = []
    for step in range(30):
        texts.append(" ".join(words))
        for k in range(6):
            words[(step * 40 + k) % 300] = f"edit{step}k{k}"
    sets = word_sets(texts)
    rows = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(brute_components(sets)))


def test_near_duplicates_of_an_empty_table_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    twice = documents(spark, ["a b c d e f"] * 2).withColumn("doc_id", F.lit(3).cast("long"))
    assert {(r.component_id, r.kept) for r in near_dedup.near_duplicates(twice).collect()} == {(3, True)}
    nameless = documents(spark, ["a b c d e f", "a b c d e f", "other words here", ""]).withColumn(
        "doc_id", F.when(F.col("doc_id") == 0, F.col("doc_id"))
    )
    rows = near_dedup.near_duplicates(nameless).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id is None, r.kept) for r in rows) == [
        (False, 2, False, True), (True, 0, True, True), (True, 1, True, True), (True, 2, False, False)
    ]


def test_components_of_paths_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}


def test_components_of_links_of_several_blocks_and_of_places(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 16)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.node: r.component for r in connected(frame).collect()} == expected
    monkeypatch.setattr(components, "BLOCK", 1 << 18)
    places = frame.select(*[F.struct(F.col(c).alias("doc"), F.lit(1).alias("w")).alias(c) for c in "ab"])
    assert {r.node[0]: r.component[0] for r in connected(places).collect()} == expected


def test_near_duplicates_need_one_round_where_little_is_left(spark, monkeypatch):
    draw = random.Random(4)
    texts = []
    for _ in range(6):  # each text shares half of its words with the next, which is no link, and has a near copy
        texts += [t := sentence(draw, 60), t + " " + sentence(draw, 60), t + " " + sentence(draw, 63), t + " end"]
    calls = []
    monkeypatch.setattr(near_dedup, "connected", lambda links: calls.append(1) or connected(links))
    rows = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == brute_components(word_sets(texts))
    assert len(calls) <= 2


# --- passages


def test_texts_without_a_passage_are_not_compared(monkeypatch):
    draw = np.random.default_rng(5)
    line, rows = draw.integers(1, 1 << 31, 36).astype(np.uint32), []
    for doc in range(30):  # a line too short for a passage, a few repeats of one word, and for some a passage
        tail = draw.integers(1, 1 << 31, 60).astype(np.uint32) if doc % 10 else np.arange(1, 61, dtype=np.uint32)
        junk = np.where(draw.random(50) < 0.7, np.uint32(9), draw.integers(1, 1 << 31, 50).astype(np.uint32))
        rows.append((7, 0, doc, 40 << 32, doc, 0, 0, np.concatenate([junk, line, tail] if doc % 2 else [line, tail, junk]).astype(np.uint32).tobytes()))
    group = pd.DataFrame(rows, columns=["key", "fn", "doc", "at", "own_id", "own_word", "from", "hashes"]).assign(asks=True, holds=True)
    compared, whole = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *x: compared.append(1) or whole(*x))
    found = passages._connecting(group, 50)
    few = len(compared)
    monkeypatch.setattr(passages, "_possible", lambda common, *x: np.ones(len(common), dtype=bool))
    assert passages._connecting(group, 50) == found and found
    assert few * 2 < len(compared) - few


def test_repeating_texts_that_differ_are_not_compared(monkeypatch):
    draw = np.random.default_rng(6)
    line, rows = draw.integers(1, 1 << 31, 20).astype(np.uint32), []
    for doc in range(12):  # 31 shingles over and over, 20 of them in all texts; two texts are alike
        own = np.concatenate([line, np.random.default_rng(doc // 2 if doc < 2 else doc).integers(1, 1 << 31, 11).astype(np.uint32)])
        rows.append((7, 0, doc, 60 << 32, doc, 0, 0, np.tile(own, 6)[:169].tobytes()))
    group = pd.DataFrame(rows, columns=["key", "fn", "doc", "at", "own_id", "own_word", "from", "hashes"]).assign(asks=True, holds=True)
    compared, whole = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *x: compared.append(1) or whole(*x))
    assert [x[:2] for x in passages._connecting(group, 50)] == [(0, 1)]
    assert len(compared) == 1


def test_equal_texts_of_several_lists_are_compared_once(monkeypatch):
    rng = np.random.default_rng(9)
    shared, fresh = rng.integers(1, 1 << 32, 64, dtype=np.uint32), lambda: rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    texts = [np.concatenate([fresh(), shared, fresh()]) for _ in range(3)]
    rows = [(key, 0, doc, 90 << 32, doc, -91, 0, text.tobytes()) for key in (5, 6, 7, 8) for doc, text in enumerate(texts)]
    group = pd.DataFrame(rows, columns=["key", "fn", "doc", "at", "own_id", "own_word", "from", "hashes"]).assign(asks=True, holds=True)
    compared, whole = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *x: compared.append(1) or whole(*x))
    found = passages._connecting(group, 50)
    assert len(found) == 8 and len(compared) == 2


def test_passages_leave_no_superseded_checkpoints(spark, monkeypatch):
    draw = random.Random(8)
    passage = sentence(draw, 60)
    texts = [f"{sentence(draw, 70)} {passage} {sentence(draw, 70)}" for _ in range(6)] + [sentence(draw, 90)] * 2
    made, gone, whole = [], [], passages.reliable
    monkeypatch.setattr(passages, "reliable", lambda df: made.append(1) or whole(df))
    monkeypatch.setattr(passages, "discard", lambda *dfs, free=passages.discard: gone.extend(dfs) or free(*dfs))
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r.doc_id for r in rows} == set(range(8))
    assert len(made) - len(gone) <= 3  # copies of texts, and the classes


def test_windows_match_the_definition():
    draw = np.random.default_rng(0)
    for trial in range(200):
        n = draw.integers(1, 50)
        g = draw.integers(1, 9 if trial % 2 else 10**6, n).astype(np.uint64)
        g[draw.random(n) < 0.05] = 0
        width = int(draw.integers(2, 8))
        expected = set()
        for c in np.flatnonzero(g):
            low = high = int(c)
            while low > 0 and g[low - 1] > g[c]:
                low -= 1
            while high < n - 1 and g[high + 1] >= g[c]:
                high += 1
            if high - low + 1 >= width:
                expected.add((low, int(c), high))
        assert {tuple(map(int, x)) for x in zip(*passages.compact_windows(g, width), strict=True)} == expected


def test_repeated_passages_are_found_and_others_left_alone(spark):
    draw = random.Random(4)
    passage = sentence(draw, 60)
    edited = passage.split()
    edited[30] = "changed"
    texts = [sentence(draw, 200) for _ in range(12)]
    texts[2] += " " + passage + " " + sentence(draw, 30)
    texts[5] = sentence(draw, 10) + " " + passage + " " + texts[5]
    texts[7] = passage.upper() + " " + texts[7]
    texts[9] += " " + " ".join(edited)
    short = sentence(draw, 30)
    texts[0] += " " + short
    texts[1] += " " + short
    texts += [texts[3], texts[3]] + EDGES + EDGES
    rows = passages.repeated_passages(documents(spark, texts, extra=True)).collect()
    clean = {0, 1, 4, 6, 8, 10, 11}
    assert not clean & {r.doc_id for r in rows}
    spans = {r.doc_id: r for r in rows if r.class_id == 2}
    assert set(spans) == {2, 5, 7, 9}
    assert (spans[5].start_word, spans[5].end_word) == (10, 70) and (spans[7].start_word, spans[7].end_word) == (0, 60)
    assert spans[2].kept and not spans[5].kept
    assert {(r.doc_id, r.start_word, r.end_word, r.kept) for r in rows if r.class_id == 3} == {
        (3, 0, 200, True), (12, 0, 200, False), (13, 0, 200, False)
    }
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_passages_with_an_insertion_or_a_line_that_came_before():
    draw = np.random.default_rng(5)
    fresh = lambda n: draw.integers(1, 2**62, n).astype(np.uint64)
    for n in (70, 80, 99):  # words; 12 more in the middle of one copy
        x = fresh(n - 4)
        half = len(x) // 2
        y = np.concatenate([x[:half], fresh(16), x[half + 4 :]])
        assert passages.common_passages(x, y) == [(0, len(x) - 1, 0, len(y) - 1)]
        around = np.concatenate([fresh(30), y, fresh(40)])
        assert passages.common_passages(x, around) == [(0, len(x) - 1, 30, 29 + len(y))]
    x = fresh(56)
    for at in (0, 20, 45):  # a line of the passage stands before it, too
        y = np.concatenate([fresh(9), x[at : at + 11], fresh(25), x, fresh(9)])
        assert passages.common_passages(x, y) == [(0, 55, 45, 100)]
        assert passages.common_passages(y, x) == [(45, 100, 0, 55)]
    assert passages.common_passages(fresh(80), fresh(80)) == []


def test_every_occurrence_of_a_passage_is_found(spark):
    draw = random.Random(6)
    lines = [sentence(draw, 15, 10**6) for _ in range(4)]
    passage = sentence(draw, 60, 10**6)
    framed = " ".join(lines)
    noise = lambda n: sentence(draw, n, 10**6)
    texts = [
        " ".join([noise(1000), passage, noise(4000), passage, noise(20)]),
        " ".join([noise(50), passage, noise(50)]),
        # every line of the passage stands alone earlier on
        " ".join([noise(30), framed, noise(30)]),
        " ".join([x for line in lines for x in (noise(300), line)] + [noise(5000), framed, noise(40)]),
    ]
    for order in ((0, 1, 2, 3), (1, 0, 3, 2)):
        rows = passages.repeated_passages(documents(spark, [texts[i] for i in order])).collect()
        got = {(order[r.doc_id], r.start_word, r.end_word) for r in rows}
        assert got == {(0, 1000, 1060), (0, 5060, 5120), (1, 50, 110), (2, 30, 90), (3, 6260, 6320)}


def test_passages_of_frequent_lines_in_shuffled_orders(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 8)
    monkeypatch.setattr(passages, "SMALL", 4)
    draw = random.Random(8)
    lines = [sentence(draw, 15, 10**6) for _ in range(12)]
    # each pair has four lines in an order of its own; earlier documents have lines only, each between words of its own
    texts = [" ".join(x for line in draw.sample(lines, 8) for x in (line, sentence(draw, 20, 10**6))) for _ in range(60)]
    orders = [draw.sample(range(12), 4) for _ in range(15)]
    texts += [f"{sentence(draw, 40, 10**6)} {' '.join(lines[n] for n in order)} {sentence(draw, 40, 10**6)}" for order in orders * 2]
    brute, sets = {}, [t.split() for t in texts]
    for d, words in enumerate(sets):
        for at in range(len(words) - 49):
            brute.setdefault(tuple(words[at : at + 50]), set()).add(d)
    expected = {d for held in brute.values() if len(held) > 1 for d in held}
    assert expected == set(range(60, 90))
    got = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r.doc_id for r in got} == expected
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} >= {(d, 40, 100) for d in expected}
    of = {r.doc_id: (r.class_id, r.class_word) for r in got}
    assert all(of[d] == of[d + 15] for d in range(60, 75))


# --- vectors


def vector_table(spark, n=700, dim=8):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.normal(size=dim).astype(np.float32)]) for i in range(n)]
    rows += [(int(n + i), rows[0][1]) for i in range(300)]  # a hot vector
    rows += [(2000, None), (2001, [float("nan")] * dim), (2002, [1.0] * 7 + [None]), (2003, [float("inf")] * dim), (2004, [0.0] * dim)]
    rows += [(2005, [1.0]), (None, rows[1][1]), (5, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


def test_top_inner_products_match_brute_force(spark):
    table = vector_table(spark)
    rows = topk.quantized(table)
    got = topk.top_inner_products(rows, rows.filter("vec_id % 20 = 0"), k=20, pivots=5).collect()
    data = [(r.vec_id, np.array(r.v).astype(np.int64)) for r in rows.collect()]
    ids = [i for i, _ in data]
    assert {2004, 2005} <= set(ids) and ids.count(5) == 2 and not {2000, 2001, 2002, 2003} & set(ids)
    expected = []
    for at, (q, v) in enumerate(data):
        if q % 20 == 0:
            best = sorted((-int(v @ x), i) for n, (i, x) in enumerate(data) if n != at and len(x) == len(v))[:20]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)
    few = rows.filter("vec_id < 4")
    assert topk.top_inner_products(few, few.filter("vec_id = 0")).count() == 3
    none = rows.filter("vec_id < 0")
    assert topk.top_inner_products(none, none).count() == 0


@pytest.mark.parametrize("size", [300_000.0, 2.0**22, 2.0**23])
def test_top_inner_products_of_large_components_are_exact(spark, size):
    draw = np.random.default_rng(4)
    rows = [(int(i // 2), [float(x) for x in draw.normal(size=3) * size]) for i in range(120)]  # each id twice
    rows += [(i, [rows[0][1][0]] * 2) for i in range(20, 24)] + [(24, [])]  # a rarer length
    held = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_inner_products(held, held.filter("vec_id % 20 = 0"), k=4, pivots=3).collect()
    data = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v]
    expected = []
    for at, (q, v) in enumerate(data):
        if q % 20 == 0:
            scores = ((-sum(x * y for x, y in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(data) if n != at and len(w) == len(v))
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:4], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)


def test_forest_finds_most_neighbours(spark):
    rows = vectors.usable(vector_table(spark, n=1500))
    every = [(r.vec_id, np.array(r.v)) for r in rows.collect()]
    assert {i for i, v in every if len(v) == 1} == {2005} and not {2000, 2001, 2002, 2003, 2004} & {i for i, _ in every}
    got = ann.nearest(rows, rows.filter("vec_id % 50 = 0"), k=5, candidates=1500, share=0.3).collect()
    data = [(i, v) for i, v in every if len(v) > 1]
    ids = np.array([i for i, _ in data])
    assert (ids == 5).sum() == 2
    unit = np.array([v / np.sqrt((v**2).sum()) for _, v in data])
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        order = [i for _, i in sorted((-round(s, 12), i) for n, (s, i) in enumerate(zip(score, ids, strict=True)) if n != at)][:5]
        mine = [r for r in got if r.query_id == ids[at]]
        assert [r.rank for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]
        assert all(np.abs(score[ids == r.vec_id] - r.score).min() < 1e-12 for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(order)), total + 5
    assert hits / total >= 0.9
    few = rows.filter("vec_id < 4")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 3
    none = rows.filter("vec_id < 0")
    assert ann.nearest(none, none).count() == 0
    # both rows of an id ask, and each is the other's nearest
    twins = rows.filter("vec_id in (5, 6, 2005)")
    got = ann.nearest(twins, twins.filter("vec_id = 5"), k=1).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got] == [(5, 1, 5, 1.0)] * 2


def test_forest_search_writes_less_than_the_vectors(spark, monkeypatch):
    draw = np.random.default_rng(6)
    data = [(i, draw.normal(size=16).tolist()) for i in range(3000)] + [(3000 + i, [1.0] * 16) for i in range(1500)]
    rows = vectors.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
    asked = rows.filter("vec_id % 3 = 0")
    asked.count()
    spark.range(1).checkpoint() if spark.sparkContext.getCheckpointDir() else ann.reliable(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = lambda: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    before = held()
    got = ann.nearest(rows, asked, k=4)
    assert got.count() == 4 * 1500
    # what is left is the result, no copy of the vectors for each tree or piece of the queries
    assert held() - before < 4500 * 16 * 8
    equal = got.filter("query_id >= 3000").groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("near")).collect()
    assert {r.query_id: r.near for r in equal} == {
        i: [j for j in range(3000, 3006) if j != i][:4] for i in range(3000, 4500, 3)
    }
    # the result does not depend on how many queries are sent and rows are compared at once
    whole = sorted(map(tuple, got.collect()))
    for name, size in (("GROUP", 400), ("PIECE", 7), ("QUERY_PIECE", 90), ("COMPONENTS", 100), ("BROADCAST_IDS", 10)):
        monkeypatch.setattr(ann, name, size)
    assert sorted(map(tuple, ann.nearest(rows, asked, k=4).collect())) == whole


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.read_tokenizer(path), Tokenizer.from_file(path)


def test_stream_equals_the_library(tokenizer, monkeypatch):
    content, library = tokenizer
    own, draw = bpe.Bpe(content), random.Random(1)
    pieces = ["'", "s", "'ll", "re", " ", "  ", "\n", "a", "é", "日", "1", "!!", "<|endoftext|>", "<|end", "|>", " ", "it", " the", "z" * 20, "\x85"]

    def check(text):
        ids = bpe.encode(own, text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(own, ids) == library.decode(ids, skip_special_tokens=False)

    for text in [t or "" for t in EDGES] + ["\n" * 140_000 + " x", "q" * 150_000 + "<|endoftext|>", " " * 99_999 + "b"]:
        check(text)
    for stretch in (5, 23):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        own.window = own.lookahead + 5
        for _ in range(700):
            check("".join(draw.choice(pieces) * draw.choice([1, 1, 1, 40]) for _ in range(draw.randrange(12))))


def test_lookahead_bounds_what_later_bytes_change(tokenizer):
    own, draw = bpe.Bpe(tokenizer[0]), random.Random(3)
    for _ in range(300):
        head = bytes(draw.choice(b"eiontrsa") for _ in range(own.lookahead + 40))
        kept = set()
        for _ in range(3):
            tokens = own.merged(head + bytes(draw.choice(b"eiontrsa") for _ in range(draw.randrange(30))))
            ends = np.cumsum([len(own.bytes_of[t]) for t in tokens])
            kept.add(tuple(t for t, e in zip(tokens, ends, strict=True) if e <= len(head) - own.lookahead))
        assert len(kept) == 1


def test_bpe_columns(spark, tokenizer):
    content, library = tokenizer
    docs = documents(spark, EDGES, extra=True)
    out = bpe.encoded(docs, content, decoded=True)
    assert set(out.columns) == {*docs.columns, "decoded"}
    for r in out.withColumn("back", bpe.decoded(docs, content)).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == r.decoded == (r.text or "")
    assert bpe.encoded(documents(spark, []), content).count() == 0


# --- secrets


def brute_base(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_secrets(spark):
    draw = random.Random(6)
    cased = lambda t: " ".join(draw.choice([w, w, w.title(), w.upper()]) for w in t.split())
    plain = [cased(sentence(draw, 400, 300)) for _ in range(40)]
    loud = ["PASSWORD: 'hunter2xyz' and api_key=abc", "é token = secret=abcdefgh", "AKIA" + "Q7" * 9 + " AKIAAKIA", "f" * 23 + " " + "0a" * 15]
    loud += ["ſecret=abcdefg", "tokKen=zzzzzzz", "secret=token:abcdefgh"]
    free = "Zq8Lw2xV9pTk4RbN7sYd3GhJ"
    texts = plain + loud + [f"{plain[0]} {free} {plain[1]}"] + EDGES
    rows = {r.doc_id: r.secrets for r in secrets.scan(documents(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        spans = [(s["kind"], s["start"], s["end"]) for s in rows[i]]
        assert [s for s in spans if s[0] != "random"] == brute_base(t or "")
        if i < 40:
            assert spans == []
    at = texts[47].index(free)
    assert [(s["kind"], s["start"], s["end"]) for s in rows[47]] == [("random", at, at + len(free))]
    clean = {r.doc_id: r.text for r in secrets.redacted(documents(spark, texts)).collect()}
    assert clean[0] == texts[0] and clean[len(texts) - len(EDGES)] is None
    assert free not in clean[47] and "hunter2xyz" not in clean[40] and not brute_base(clean[43])
    assert secrets.scan(documents(spark, [])).count() == 0


# --- language


def test_language_mixtures(spark):
    draw = random.Random(9)
    stock = {k: ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(300)] for k, letters in
             {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqéüß"}.items()}
    line = lambda k, n: " ".join(draw.choice(stock[k]) for _ in range(n))
    texts = [line(k, 60) for k in ("aa", "bb", "cc") for _ in range(30)]
    labels = [k for k in ("aa", "bb", "cc") for _ in range(30)]
    train = documents(spark, texts, lang=lambda i: labels[i] if i % 10 else None)
    names, logs = langid.train(train)
    assert names == ["aa", "bb", "cc"]
    mixed = line("aa", 60) + " " + line("bb", 30)
    asked = [line("cc", 40), line("bb", 5), mixed, line("aa", 9).upper()] + EDGES + ["123 !!", "4.5"]
    out = documents(spark, asked, extra=True)
    got = [r.p for r in out.select("doc_id", langid.predicted(out, names, logs).alias("p")).orderBy("doc_id").collect()]
    assert [g["lang"] for g in got[:4]] == ["cc", "bb", "aa", "aa"]
    assert {x["lang"] for x in got[2]["languages"]} == {"aa", "bb"} and 0.5 < got[2]["score"] < 0.8
    assert [g["lang"] for g in got[4:7]] == ["und"] * 3 and [g["lang"] for g in got[-2:]] == ["und"] * 2
    assert all(0 <= g["score"] <= 1 for g in got)
    none, empty = langid.train(documents(spark, []))
    assert none == [] and out.select(langid.predicted(out, none, empty).alias("p")).first().p["lang"] == "und"


def test_mixture_recovers_proportions():
    draw = np.random.default_rng(2)
    logs = np.log(draw.dirichlet(np.ones(400) * 0.3, 4).T + 1e-9)
    logs -= np.log(np.exp(logs).sum(0))
    weights = draw.multinomial(4000, np.exp(logs) @ np.array([0.7, 0.0, 0.3, 0.0])).astype(float)
    share = langid.mixture(weights, logs)
    assert abs(share[0] - 0.7) < 0.05 and abs(share[2] - 0.3) < 0.05 and share[1] == share[3] == 0


# --- quality


def test_quality_grades(spark):
    draw = random.Random(12)
    texts, grades = [], []
    for i in range(300):
        words = sentence(draw, 40, 500).split()
        grade = i % 3
        if grade == 0:
            words[draw.randrange(40)] = draw.choice(["vilest", "rotten"])
        if grade == 1:
            words = [w + "!!" for w in words]
        texts.append(" ".join(words))
        grades.append(grade)
    docs = documents(spark, texts + EDGES, extra=True)
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 200] + [(None, 1), (5000, None)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    rows = docs.select("doc_id", quality.graded(docs, model).alias("g")).orderBy("doc_id").collect()
    right = sum((r.g["tail"] >= 0.5) == (grades[r.doc_id] == 2) for r in rows[200:300])
    assert right >= 90 and len(rows) == len(texts) + len(EDGES)
    assert all(0 <= r.g["tail"] <= 1 and 0 <= r.g["expected"] <= 2 for r in rows)
    assert quality.fit(docs, ratings.filter("doc_id < 0")) is None
    assert docs.filter(quality.selected(quality.graded(docs, None))).count() == docs.count()
    assert documents(spark, []).select(quality.graded(docs, model)).count() == 0


def test_features_need_no_more_than_a_slice(monkeypatch):
    monkeypatch.setattr(text_hash, "_powers", [])
    texts = pa.array([sentence(random.Random(i), 2000) for i in range(200)], pa.large_string())
    assert texts.nbytes > 2 << 20
    tracemalloc.start()
    try:
        for _ in quality.features(texts):
            pass
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_a_dropped_tokenizer_goes_at_once():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        loaded = bpe.Bpe(f.read())
    assert bpe.encode(loaded, "some words " + "x" * 100)
    seen = weakref.ref(loaded)
    gc.disable()
    try:
        del loaded
        assert seen() is None
    finally:
        gc.enable()


def test_digest_of_no_spans_is_that_of_an_empty_string(spark):
    empty = spark.createDataFrame([("",)], "x string").select(F.sha2("x", 256).alias("h")).first().h
    assert empty == hashlib.sha256(b"").hexdigest()


def test_cosines_of_very_small_and_very_large_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-200, 1e-200]), (2, [1e300, 0.0]), (3, [5e-324, 0.0]), (4, [0.0, 0.0])]
    held = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(held, held.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3, 1]
    assert np.allclose([r.score for r in got], [1.0, 1.0, 0.5**0.5])


def test_digits_of_other_scripts_are_no_letters(spark):
    docs = documents(spark, ["\u00bd \u00b2 \u00b3", "\u2167", "plain words here"]).withColumn("lang", F.lit("en"))
    names, logs = langid.train(docs)
    got = {r.doc_id: r.lang for r in docs.select("doc_id", langid.predicted(docs, names, logs)["lang"].alias("lang")).collect()}
    assert got == {0: "und", 1: "und", 2: "en"}
