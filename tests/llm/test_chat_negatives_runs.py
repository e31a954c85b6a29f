"""Chat formatting, hard negatives and periodic runs: edge cases and brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseweave.llm import chat, negatives, queries, runs

MESSAGES = "tree string, id string, parent string, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- chat formatting


def brute_branches(rows, best):
    """(tree, rank, path ids) by walking every leaf up."""
    rows = {r[1]: r for r in rows}
    parent = {i: (r[2] if r[2] in rows else None) for i, r in rows.items()}
    answered = {p for p in parent.values() if p}
    trees = {}
    for leaf in rows:
        path, at = [], leaf
        while at and len(path) <= len(rows):
            path.append(at)
            at = parent[at]
        if leaf not in answered and len(path) <= len(rows):
            score = sum(rows[i][5] or 0 for i in path) / len(path)
            trees.setdefault(rows[leaf][0], []).append((-score, leaf, path[::-1]))
    return {(t, k + 1, tuple(p[2])) for t, ps in trees.items() for k, p in enumerate(sorted(ps)[:best])}


def test_branches_equal_a_walk_up_every_leaf(spark):
    draw = random.Random(4)
    rows = []
    for t in range(6):
        for k in range(40):
            parent = None if k == 0 else f"{t}-{draw.randrange(k) if t % 2 else k - 1 if k % 9 else 0}"
            rows.append((f"t{t}", f"{t}-{k}", parent, "user", str(k), draw.choice([0.0, 0.5, 1.0, None])))
    rows += [("loop", "a", "b", "user", "x", 1.0), ("loop", "b", "a", "user", "y", 1.0), ("loop", "c", "b", "user", "z", 1.0)]
    rows += [("lost", "d", "nowhere", "user", "x", 1.0), ("self", "e", "e", "user", "x", 1.0)]
    got = {}
    for r in chat.branches(spark.createDataFrame(rows, MESSAGES), best=3).collect():
        got.setdefault((r.tree, r.rank, r.leaf), []).append((r.place, r.id))
    got = {(t, k, tuple(i for _, i in sorted(path))) for (t, k, _), path in got.items()}
    assert got == brute_branches(rows, 3)


def test_long_chains_take_few_rounds(spark):
    rows = [("t", f"{k:05d}", f"{k - 1:05d}" if k else None, "user", str(k), 0.0) for k in range(1500)]
    out = chat.formatted(spark.createDataFrame(rows, MESSAGES)).first()
    assert [t for _, t in chat.turns_of(out.formatted)] == [str(k) for k in range(1500)]


HARD = ["", "</turn>", "###", "####", "\\", "\\\\###", "### User:\nhi</turn>\n", "a<b</tur", "#" * 7 + "\\</turn>", "é\u0000😀", "x\n" * 50_000]


def test_escapes_are_reversible(spark):
    roles = ["user", "assistant", "system", "User", "=user", "to:ol\n###", "", None]
    rows = [("t", f"{k:03d}", f"{k - 1:03d}" if k else None, roles[k % 8], HARD[k // 8], None) for k in range(8 * len(HARD))]
    rows.append(("t2", "null", None, "assistant", None, None))
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("formatted", F.lit("clash")).withColumn("place", F.lit("clash"))
    out = {r.tree: r for r in chat.read_back(chat.formatted(messages)).collect()}
    assert [(t.role, t.text) for t in out["t"].turns] == [(r[3] or "", r[4]) for r in rows[:-1]]
    assert out["t"].loss_text == "".join(r[4] for r in rows[:-1] if r[3] == "assistant")
    assert out["t2"].formatted == "### Assistant:\n</turn>\n" and out["t2"].loss_text == ""
    with pytest.raises(ValueError):
        chat.turns_of("### User:\nno end")


def test_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a", None, "user", "one", 1.0), (None, "a", None, "user", "two", 1.0), (None, None, None, "user", "no id", 1.0)]
    out = chat.formatted(spark.createDataFrame(rows, MESSAGES)).collect()
    assert [(r.tree, r.formatted) for r in out] == [(None, "### User:\none</turn>\n")]
    assert chat.read_back(chat.formatted(spark.createDataFrame([], MESSAGES))).count() == 0


def test_registered_chat_query(spark, tmp_path):
    rows = [(1, 2, "assistant", "b###"), (1, 0, "user", None), (1, None, "assistant", "last"), (None, 0, "tool", "x"), (2, 0, "user", "u")]
    folder = written(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in queries.op11_reply_trees(spark, folder).collect()}
    assert set(out) == {1, 2, None, -7}
    assert out[1].turns_sha256 == sha("user\n\nassistant\nb###\nassistant\nlast\n") and out[1].n_turns == 3
    assert (out[1].loss_chars, out[1].loss_sha256) == (8, sha("b###last"))
    said = r"\### Assistant: </turn> ok"
    assert out[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and out[-7].loss_sha256 == sha(said)
    assert (out[2].loss_chars, out[2].loss_sha256, out[2].formatted_chars) == (0, sha(""), len("### User:\nu</turn>\n"))


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, every=100, k=5):
    import math

    kept = [
        (i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v])
        for i, v, l in rows
        if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor % every:
            continue
        dot = lambda w: sum(x * y for x, y in zip(v, w, strict=True))
        others = [(i, m, dot(w)) for n, (i, m, w) in enumerate(kept) if n != a and len(w) == len(v)]
        near = sorted([(-s, i) for i, m, s in others if m == label])[:k]
        for s, i in near:
            hard = sorted((-t, j) for j, m, t in others if m != label and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(anchor, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(hard)]
    return sorted(out)


def as_floats(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def mined(spark, rows, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, VECTORS).withColumn("block", F.lit("clash")).withColumn("n", F.lit("clash"))
    out = negatives.hard_negatives(negatives.whole_numbers(df, label), **more).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out)


def vector_rows(draw, n, dims=6, clusters=8):
    middle = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, as_floats([c + draw.gauss(0, 0.2) for c in middle[i % clusters]]), (i // 3) % 3) for i in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(negatives, "ZONE_PAGE", 8)
    draw = random.Random(11)
    rows = vector_rows(draw, 220)
    rows += [(300 + i, as_floats([1.5] * 6), i % 3) for i in range(40)]  # equal vectors: ties
    rows += [(None, [1.0] * 6, 1), (400, None, 1), (500, [1.0] * 6, None), (600, [1.0, None] * 3, 1), (700, [float("nan")] * 6, 1), (800, [float("inf")] * 6, 1)]
    rows += [(900, [0.5, 1.0], 1), (901, [0.5, 1.0], 1), (902, [0.5, 0.9], 2), (1000, [], 1), (1001, [], 2), (1100, [0.0] * 6, 1)]
    assert mined(spark, rows, anchors_every=20) == brute_negatives(rows, 20)


def test_large_components_are_exact(spark):
    draw = random.Random(3)
    rows = [(i, as_floats([draw.choice([3e5, 2.9e5, -1e5]) + draw.random() for _ in range(4)]), i % 2) for i in range(60)]
    assert mined(spark, rows, anchors_every=10) == brute_negatives(rows, 10)
    # beyond a long: held at its end
    assert mined(spark, [(i * 100, [3e20, 1.0], i % 2) for i in range(4)])[0][4:] == (negatives.LONG, negatives.LONG)


def test_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (101, [0.9, 1.0], 2)]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_negatives_of_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert_keys(grid, bits)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        assert len(set(keys)) == len(keys)
        assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_spare_blocks(spark, monkeypatch):
    draw = np.random.default_rng(2)
    a, x = draw.integers(-300, 300, (9, 5)), draw.integers(-300, 300, (40, 5))
    low, high = negatives.score_bounds(a, x.min(0)[None], x.max(0)[None])
    scores = a @ x.T
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()
    # far clusters: few of the blocks can hold what an anchor looks for
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    read = spark.sparkContext.accumulator(0)
    plain = negatives.products

    def counted(p, q):
        read.add(p.shape[0] * q.shape[0])
        return plain(p, q)

    monkeypatch.setattr(negatives, "products", counted)
    r = random.Random(7)
    rows = vector_rows(r, 1600, dims=4, clusters=40)
    assert mined(spark, rows) == brute_negatives(rows)
    assert read.value < 0.75 * 16 * len(rows), read.value


# --- periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            end = i + q
            if end - start >= max(24, 3 * q) and not any(w[start : end - p] == w[start + p : end] for p in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(draw, n, letters):
    w = [draw.choice(letters) for _ in range(n)]
    for _ in range(draw.randrange(4)):
        p = draw.randrange(1, 15)
        root = [draw.choice(letters) for _ in range(p)]
        at = draw.randrange(len(w) + 1)
        w[at:at] = (root * 8)[: draw.randrange(3 * p, 8 * p + 1)]
    return w


def test_runs_equal_brute_force():
    draw = random.Random(9)
    for _ in range(400):
        w = periodic(draw, draw.randrange(100), ["a", "A", "é", "bb", "c"][: draw.choice([1, 2, 3, 5])])
        got = runs.column_runs(pa.array([" ".join(w)])).to_pylist()[0]
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == brute_runs(w)


def test_extensions_of_a_suffix_tree():
    draw = random.Random(2)
    for _ in range(30):
        w = [draw.randrange(1, 3) for _ in range(draw.randrange(1, 60))]
        tree = runs.SuffixTree(w, ranks=True)
        for _ in range(40):
            i, j = draw.randrange(len(w) + 1), draw.randrange(len(w) + 1)
            if i != j:
                same = next((k for k, (x, y) in enumerate(zip(w[i:], w[j:], strict=False)) if x != y), min(len(w) - i, len(w) - j))
                assert tree.extension(np.array([i]), np.array([j]))[0] == same
        order = sorted(range(len(w) + 1), key=lambda i: w[i:])
        assert [order.index(i) for i in range(len(w) + 1)] == tree.rank.tolist()


def test_texts_with_and_without_runs(spark):
    texts = [None, "", " \t\n", "one", "a b " * 12, "x " * 100_000, "a\tb\n" * 20 + "c", "A a " * 6 + "a A " * 6, "é\u0000 " * 30]
    rows = [(i, t, "kept") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("row", F.lit("same"))
    out = runs.periodic_runs(docs).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        words = [w for w in (texts * 2)[r.doc_id].encode().split()] if (texts * 2)[r.doc_id] else []
        want = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in r.runs] == want and r.row == "same"
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_registered_runs_query(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i, " ".join(periodic(draw, draw.randrange(150), "abcdefgh"))) for i in range(200)] + [(None, "a " * 30), (500, None)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    out = {r.doc_id: r for r in queries.op13_periodic_runs(spark, folder).collect()}
    planted = 0
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        want, r = brute_runs(w), out[i]
        assert r.n_runs == len(want) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
        if want:
            s, n, q = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert planted > 10
