import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import chunk, frame
from pyspark.sql import functions as F

from clauseweave.operators.bm25 import Bm25Index
from clauseweave.operators.evaluate import evaluate_bm25
from clauseweave.operators.fusion import reciprocal_rank_fusion
from clauseweave.operators.vector import embed_chunks, vector_search

ROWS = [
    chunk("pump", "2.3", "Starting the pump", "Open the inlet, then press start; the pump primes itself."),
    chunk("frost", "7.4", "Frost watch", "Below 3 degrees the pump runs on, whatever the timer says."),
    chunk("parts", "20", "Spares", "Order seals and rotors by number. See drawing A-12/b.", kind="table"),
    chunk("notes", "2", "Spares", "Order seals and rotors by number. See drawing A-12/b."),
    chunk("timer", "7.4.1", "Timer", "Set the timer for each bed; the timer keeps its hours in a power cut."),
]
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*")


def brute_force(rows, query, k):
    """Scores straight from the definition."""
    bags = [
        Counter(
            [t.lower() for t in TOKEN.findall(r["text"])]
            + 4 * [t.lower() for t in TOKEN.findall(r["section_title"])]
            + [r["section"].lower()]
        )
        for r in rows
    ]
    lengths = [sum(b.values()) for b in bags]
    mean = sum(lengths) / len(lengths)
    hits = []
    for row, bag, length in zip(rows, bags, lengths):
        score, used = 0.0, []
        for term in dict.fromkeys(t.lower() for t in TOKEN.findall(query)):
            if bag[term]:
                df = sum(term in b for b in bags)
                idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
                score += idf * bag[term] * 2.5 / (bag[term] + 1.5 * (0.25 + 0.75 * length / mean))
                used.append(term)
        if score:
            hits.append((-score, row["section"], row["chunk_id"], used))
    return sorted(hits)[:k]


@pytest.mark.parametrize("query", ["the pump timer the PUMP", "spares order 2", "drawing a-12/b"])
def test_search_matches_brute_force(spark, query):
    index = Bm25Index(frame(spark, ROWS))
    want = brute_force(ROWS, query, 4)
    got = index.search(query, top_k=4).orderBy("rank").collect()
    assert [(r["chunk_id"], r["matched_terms"]) for r in got] == [(w[2], w[3]) for w in want]
    assert [r["score"] for r in got] == pytest.approx([-w[0] for w in want], abs=1e-9)
    queries = spark.createDataFrame([(7, query), (8, "zzz")], "query_id int, query string")
    many = index.search_many(queries, top_k=4).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["matched_terms"]) for r in many] == [
        (7, w[2], w[3]) for w in want
    ]
    assert [r["score"] for r in many] == pytest.approx([-w[0] for w in want], abs=1e-9)


def random_corpus(seed, n):
    import random

    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    heavy = [1 / (i + 1) for i in range(300)]  # a few words are everywhere
    texts = [" ".join(draw.choices(words, heavy, k=draw.randrange(1, 80))) for _ in range(n)]
    texts[n // 2 :: 7] = [texts[0]] * len(texts[n // 2 :: 7])  # ties
    rows = [chunk(f"c{i:04d}", str(i % 5), "t" if i % 3 else texts[i - 1][:20], t) for i, t in enumerate(texts)]
    queries = [" ".join(draw.choices(words, heavy, k=draw.randrange(1, 25))) for _ in range(40)]
    return rows, queries + queries[:2] + ["zzz", "", "w0", "w299"]


@pytest.mark.parametrize("stored", [False, True])
def test_batch_search_equals_brute_force_and_scores_few_pairs(spark, tmp_path, monkeypatch, stored):
    import clauseweave.operators.block_max as block_max

    monkeypatch.setattr(block_max, "BLOCK_CHUNKS", 64)
    monkeypatch.setattr(block_max, "PART_CHUNKS", 16)
    monkeypatch.setattr(block_max, "SEARCHES", 16)
    pairs = spark.sparkContext.accumulator(0)
    rows, texts = random_corpus(3, 400)
    index = Bm25Index(frame(spark, rows))
    if stored:
        index = Bm25Index.stored(frame(spark, rows), str(tmp_path / "index"))
    scores = Bm25Index._scores

    def counted(self, documents, near, *rest):
        pairs.add(near.count())
        return scores(self, documents, near, *rest)

    monkeypatch.setattr(Bm25Index, "_scores", counted)
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = {}
    for r in index.search_many(queries, top_k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["matched_terms"]))
    every = 0
    for number, text in enumerate(texts):
        want = brute_force(rows, text, 10**6)
        every += len(want)
        assert sorted(got.get(number, [])) == [(k + 1, w[2], w[3]) for k, w in enumerate(want[:5])]
    assert pairs.value < 0.1 * every, (pairs.value, every)
    one = index.search(texts[0], top_k=5).orderBy("rank").collect()
    many = [r for r in index.search_many(queries.filter("query_id = 0"), top_k=5).orderBy("rank").collect()]
    assert [(r["chunk_id"], r["score"]) for r in one] == [(r["chunk_id"], r["score"]) for r in many]


def test_many_searches_meet_blocks_without_a_shuffle_of_them(spark, monkeypatch):
    """Beyond the bound of a broadcast no block is copied for every batch of searches, nor all blocks held for one."""
    from clauseweave.operators import block_max, bm25

    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    for name, value in (("BLOCK_CHUNKS", 64), ("PART_CHUNKS", 32), ("SEARCHES", 8), ("GROUP_BATCHES", 2), ("_DENSE", 4)):
        monkeypatch.setattr(block_max, name, value, raising=False)
    plans, found = [], block_max.found

    def seen(*given):
        out = found(*given)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(block_max, "found", seen)
    rows, texts = random_corpus(5, 300)
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = {}
    for r in Bm25Index(frame(spark, rows)).search_many(queries, top_k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["matched_terms"]))
    for number, text in enumerate(texts):
        want = brute_force(rows, text, 4)
        assert sorted(got.get(number, [])) == [(k + 1, w[2], w[3]) for k, w in enumerate(want)]
    assert plans and not [p for p in plans if "SortMergeJoin" in p or "ShuffledHashJoin" in p or "Exchange" in p]


def test_parts_of_a_search_are_skipped_by_their_bounds():
    """Chunks whose terms cannot reach the known k-th score are not multiplied out."""
    import pyarrow as pa

    import clauseweave.operators.block_max as block_max

    searches = [{"search_no": 0, "parts": [{"term": "rare", "weight": 6.0}, {"term": "often", "weight": 1.0}]}]
    batch = block_max._Searches(pa.array(searches), pa.array([{"search_no": 0, "least": 5.0}]), 1)
    often = np.array([batch.vocabulary.to_pylist().index("often")])
    assert list(block_max._part_hits(batch, np.ones((4, 1)), often, np.arange(4))) == []
    rare = np.array([batch.vocabulary.to_pylist().index("rare")])
    (numbers, rows, scores), = block_max._part_hits(batch, np.array([[1.0], [0.0], [0.5]]), rare, np.arange(3))
    assert (numbers.tolist(), rows.tolist(), scores.tolist()) == ([0], [0], [6.0])
    empty = {c: pa.array([], t) for c, t in (("rows", pa.int64()), ("lengths", pa.int32()), ("sizes", pa.int32()), ("terms", pa.string()), ("tfs", pa.int32()))}
    assert list(block_max._block_hits(batch, empty, lambda tf, n: tf)) == []


def test_pairs_are_scored_in_their_row_and_blocks_prepared_once(spark):
    """No term of a pair is a row of its own; a block prepared once serves every batch of searches."""
    import pyarrow as pa

    import clauseweave.operators.block_max as block_max

    index = Bm25Index(frame(spark, [chunk("a", "1", "t", "red red pump"), chunk("b", "2", "t", "pump"), chunk("c", "3", "t", "cold")]))
    weights = spark.createDataFrame([(0, 0, "pump", 0.5), (0, 1, "red", 2.0), (0, 2, "none", 9.0)], "search_no long, pos int, term string, idf double")
    documents = spark.createDataFrame(
        [(5, "a", "1", 3, ["pump", "red", "pump"], [1, 2, 3]), (6, None, None, 1, ["cold"], [1])],
        "row_no long, chunk_id string, section string, doc_len int, terms array<string>, tfs array<int>",
    )
    pairs = spark.createDataFrame([(0, 5), (0, 6)], "search_no long, row_no long")
    scored = index._scores(documents, pairs, weights, 2.0)
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    norm = 1.5 * (0.25 + 0.75 * 3 / 2.0)
    part = lambda idf, tf: idf * tf * 2.5 / (tf + norm)
    total = part(0.5, 1.0) + part(0.5, 3.0) + part(2.0, 2.0)  # rows that were merged may hold a term twice
    assert [tuple(r) for r in scored.collect()] == [(0, 5, "a", "1", total, ["pump", "pump", "red"])]
    draw, words = np.random.default_rng(4), np.array([f"w{i}" for i in range(60)])
    texts = [np.unique(draw.choice(words, 12)) for _ in range(90)]
    block = {
        "rows": pa.array(range(90), pa.int64()), "lengths": pa.array([int(draw.integers(5, 60)) for _ in texts], pa.int32()),
        "sizes": pa.array([len(t) for t in texts], pa.int32()), "terms": pa.array(np.concatenate(texts).tolist()),
        "tfs": pa.array([int(draw.integers(1, 4)) for t in texts for _ in t], pa.int32()),
    }
    factor = lambda tf, length: tf / (tf + length / 20)
    once = block_max._Block(block, factor)
    for first in (0, 30):
        searches = [{"search_no": n, "parts": [{"term": f"w{n + k}", "weight": 1.0 + k} for k in range(0, 40, 7)]} for n in range(first, first + 20)]
        every = {}
        for (a, size), length in zip([(sum(map(len, texts[:i])), len(t)) for i, t in enumerate(texts)], block["lengths"].to_pylist(), strict=True):
            for search in searches:
                held = {t: factor(f, length) for t, f in zip(block["terms"][a : a + size].to_pylist(), block["tfs"][a : a + size].to_pylist(), strict=True)}
                every.setdefault(search["search_no"], []).append(sum(p["weight"] * held.get(p["term"], 0.0) for p in search["parts"]))
        batch = block_max._Searches(pa.array(searches), None, 3)
        hits = list(block_max._hits_in(batch, once))
        met = {(int(n), int(r)) for numbers, rows, _ in hits for n, r in zip(numbers, rows, strict=True)}
        for number, scores in every.items():
            best = sorted(scores)[-3]
            assert {r for r, score in enumerate(scores) if score >= best} <= {r for n, r in met if n == number}


def test_long_queries_report_every_matched_term(spark):
    words = [f"w{i}" for i in range(150)]
    index = Bm25Index(frame(spark, [chunk("a", "1", "t", " ".join(words)), chunk("b", "2", "t", "w3 w149")]))
    queries = spark.createDataFrame([(1, " ".join(words))], "query_id int, query string")
    got = {r["chunk_id"]: r["matched_terms"] for r in index.search_many(queries).collect()}
    assert got == {"a": words, "b": ["w3", "w149"]}


def test_filters_keep_corpus_statistics(spark):
    index = Bm25Index(frame(spark, ROWS))
    every = {r["chunk_id"]: r["score"] for r in index.search("the pump spares").collect()}
    under = index.search("the pump spares", section_prefix="2").collect()
    assert {r["chunk_id"] for r in under} == {"pump", "notes"}
    assert all(r["score"] == every[r["chunk_id"]] for r in under)
    tables = index.search("the pump spares", content_types=["table"]).collect()
    assert [r["chunk_id"] for r in tables] == ["parts"]
    assert index.search("?!").collect() == []
    with pytest.raises(ValueError):
        index.search("x", top_k=0)
    with pytest.raises(ValueError):
        Bm25Index(frame(spark, []), check_empty=True)


def test_exact_ties_break_by_section_then_id(spark):
    rows = [chunk(i, s, "T", "same words here") for i, s in (("z", "10"), ("y", "4"), ("x", "4"))]
    # The section token itself never matches the query, lengths are equal.
    got = Bm25Index(frame(spark, rows)).search("same words").orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["z", "x", "y"]


def test_saved_index_gives_the_same_hits(spark, tmp_path):
    index = Bm25Index(frame(spark, ROWS))
    index.save(str(tmp_path / "index"))
    stored = Bm25Index.load(spark, str(tmp_path / "index"))
    for query in ("frost timer", "the spares drawing"):
        assert stored.search(query).collect() == index.search(query).collect()
    assert stored.idf().count() == index.idf().count()
    queries = spark.createDataFrame([(1, "frost timer")], "query_id int, query string")
    assert stored.search_many(queries).collect() == index.search_many(queries).collect()


def test_terms_are_counted_once_when_an_index_is_saved(spark, tmp_path, monkeypatch):
    from clauseweave.operators import bm25

    kept, materialize = [], bm25.materialize

    def seen(df):
        kept.append(materialize(df))
        return kept[-1]

    monkeypatch.setattr(bm25, "materialize", seen)
    index = Bm25Index(frame(spark, random_corpus(7, 40)[0]))
    index.save(str(tmp_path / "index"))
    assert "counts" in kept[0].columns and "terms" not in kept[0].columns
    saved = Bm25Index.load(spark, str(tmp_path / "index"))
    assert sorted(saved.postings().collect()) == sorted(index.postings().collect())


def test_an_index_grows_by_parts(spark, tmp_path, monkeypatch):
    import clauseweave.operators.bm25 as module

    monkeypatch.setattr(module, "BUCKET_POSTINGS", 5)
    path = str(tmp_path / "index")
    for part in (ROWS[:2], ROWS[2:4], ROWS[4:]):
        Bm25Index(frame(spark, part)).save(path)
    stored, whole = Bm25Index.load(spark, path), Bm25Index(frame(spark, ROWS))
    assert stored._buckets > 1
    assert stored.stats().collect() == whole.stats().collect()
    assert sorted(stored.idf().collect()) == sorted(whole.idf().collect())
    for query in ("frost timer", "the spares drawing", "zzz", "?!"):
        assert stored.search(query).collect() == whole.search(query).collect()
    assert stored.search("the pump spares", section_prefix="2").collect() == whole.search("the pump spares", section_prefix="2").collect()
    queries = spark.createDataFrame([(1, "frost timer"), (2, "order")], "query_id int, query string")
    assert stored.search_many(queries).collect() == whole.search_many(queries).collect()
    plan = stored.postings()._jdf.queryExecution().toString()
    assert "term_bucket" in plan


def make_embedder():
    """A local function, so that it is pickled by value."""

    def indicator(texts):
        return np.array([[w in t.lower() for w in ("pump", "seal", "glass")] for t in texts], float)

    return lambda: indicator


def test_vectors_and_fusion(spark):
    rows = [chunk("a", "2.3", "Pump", "x"), chunk("b", "8", "Seal", "y")]
    vectors = embed_chunks(frame(spark, rows), make_embedder())
    hits = vector_search(vectors, [1.0, 0.0, 0.0], top_k=2)
    assert [(r["chunk_id"], r["rank"]) for r in hits.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    lexical = Bm25Index(frame(spark, rows)).search("pump")
    first = reciprocal_rank_fusion(lexical, hits).orderBy("rank").first()
    assert (first["chunk_id"], first["lexical_rank"], first["vector_rank"]) == ("a", 1, 1)
    assert first["score"] == pytest.approx(2 / 61)
    with pytest.raises(Exception, match="dimension"):
        vector_search(vectors, [1.0]).collect()


def test_fusion_per_query(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "q int, chunk_id string, rank int")
    right = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "q int, chunk_id string, rank int")
    got = reciprocal_rank_fusion(left, right, query_column="q").orderBy("q", "rank").collect()
    assert [(r["q"], r["chunk_id"], r["lexical_rank"], r["vector_rank"]) for r in got] == [
        (1, "b", 2, 1),
        (1, "a", 1, None),
        (2, "b", 1, None),
        (2, "c", None, 1),
    ]


def test_evaluation(spark):
    questions = spark.createDataFrame(
        [("q1", "frost watch", ["7"]), ("q2", "spares order", ["9.9", "7.4"]), ("q3", "zzz", ["1"])],
        "id string, question string, required_sections array<string>",
    )
    summary, results = evaluate_bm25(Bm25Index(frame(spark, ROWS)), questions, top_k=1)
    row = summary.first()
    assert (row["questions"], row["recall_at_k"], row["mean_reciprocal_rank"]) == (3, 0.333333, 0.333333)
    by_id = {r["id"]: r for r in results.collect()}
    assert by_id["q1"]["first_relevant_rank"] == 1 and not by_id["q2"]["passed"]
    assert by_id["q3"]["retrieved_sections"] == []
    with pytest.raises(ValueError):
        evaluate_bm25(Bm25Index(frame(spark, ROWS)), questions.filter(F.lit(False)))
