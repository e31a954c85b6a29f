"""The pipeline, stage by stage, against plain versions on a small corpus."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clauseweave.llm import mixing

from test_llm_small import DOCS, brute_base, brute_components, sentence, word_sets


def corpus(spark, folder):
    draw = random.Random(21)
    texts, grades = [], []
    for i in range(240):
        words = sentence(draw, 60, 400).split()
        if i % 4 == 0:
            words[draw.randrange(60)] = "vilest"
        if i % 4 == 1:
            words = [w + "!!" for w in words]
        if i % 24 == 2:
            words[10:10] = ["password:", f"Zx{i}kQ9w7Lp"]
        texts.append(" ".join(words))
        grades.append((int(i % 4 != 1), int(i % 4 == 0)))
    texts += [texts[2], texts[3].upper(), texts[6] + " more words", None, ""]
    source = lambda i: None if i % 40 == 3 else f"s{i % 5}"
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, *g) for i, g in enumerate(grades) if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    texts = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    outputs = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
        outputs.append(docs)
    assert all(o.columns == columns for o in outputs[:-1])
    kept, single, clean, mixed, encoded = ([r.asDict() for r in o.orderBy("doc_id").collect()] for o in outputs)

    good = {i for i in range(240) if i % 4 in (2, 3)}
    ids = {r["doc_id"] for r in kept}
    assert len(ids & good) >= 114 and len(ids & (set(range(240)) - good)) <= 6
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)

    group = brute_components(word_sets([r["text"] for r in kept]))
    assert [r["doc_id"] for r in single] == [r["doc_id"] for i, r in enumerate(kept) if group[i] == i]

    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r in single]
    for before, after in zip(single, clean, strict=True):
        assert not brute_base(after["text"] or "")
        assert after["n_chars"] == (None if after["text"] is None else len(after["text"]))
        if not brute_base(before["text"] or ""):
            assert after["text"] == before["text"]

    taken = {r.doc_id: r.taken for r in mixing.mix_counts(outputs[2]).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixed:
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == taken

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in encoded)
    wanted = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded) == wanted

    whole = corpus_pipeline.run(spark, folder).select("doc_id", F.col("ids")).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == wanted


def test_near_dedup_stage_drops_rows_not_ids(spark):
    draw = random.Random(3)
    a, b, c, d = (sentence(draw, 60) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, c), (None, d), (None, d), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 9), r.text) for r in out.collect()) == sorted([(1, a), (2, b), (3, c), (9, d)])
