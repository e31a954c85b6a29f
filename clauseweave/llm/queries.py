"""Registered queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, mixing, near_dedup, negatives, passages, quality, runs, secrets, shards, topk, vectors
from .common import WORD, table


def op1_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shuffled(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.filter("vec_id % 50 = 0"), k=5)


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, bpe.read_tokenizer(tokenizer_path()), decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings: 0 for toxic, 1 for poor, 2 for good."""
    grade = F.when(F.col("toxic") == 1, F.lit(0)).otherwise(F.col("quality") + 1)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, ratings(spark, sf_dir))
    out = docs.select("doc_id", quality.graded(docs, model).alias("g"))
    return out.select(
        "doc_id", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail"), quality.selected(F.col("g")).alias("kept")
    )


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op9_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    names, logs = langid.train(docs.filter(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), langid.predicted(docs, names, logs).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_inner_products(rows, rows.filter("vec_id % 20 = 0"), k=20)


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees without branches: each row answers the one before (by turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    place = F.row_number().over(order)
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    numbered = conversations.select("conv_id", "role", "text", place.alias("n"))
    return numbered.select(
        F.col("conv_id").alias("tree"), name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"),
    )
    out = chat.read_back(chat.formatted(chains(told.unionByName(probe))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_numbers(table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, anchors_every=100, positives=5, negatives=5)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents in which one of ten ids repeats a part of its words up to the end, at least three times.

    With h the crc32 of the id and g = floor(h / 10), words from a = g % n on take the period
    1 + floor((n - a) / (3 + g % 8)).  Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = docs.withColumn("_h", h).withColumn("_words", F.when((h % 10 == 0) & (F.length("text") > 0), words))
    n = F.size("_words")
    g = F.floor(F.col("_h") / 10)
    planted = planted.withColumn("_n", n).withColumn("_a", F.when(n > 0, g % n))
    planted = planted.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    taken = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", taken(i).cast("int")))
    text = F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


REGISTRY = {
    "op1_compact_window_passages": op1_compact_window_passages,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_bottom_k_near_dedup": op3_bottom_k_near_dedup,
    "op4_golden_mix": op4_golden_mix,
    "op5_projection_forest": op5_projection_forest,
    "op6_streaming_bpe": op6_streaming_bpe,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_mixture_language": op9_mixture_language,
    "op10_voronoi_topk": op10_voronoi_topk,
    "op11_reply_trees": op11_reply_trees,
    "op12_hilbert_negatives": op12_hilbert_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {
    "op3_bottom_k_near_dedup": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 4], ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents
  UNION
  SELECT e.b, r.reached FROM r JOIN e ON e.a = r.node WHERE r.reached < e.b
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.component_id, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.component_id, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""",
    "op4_golden_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM s0
), s2 AS (
  SELECT *, [3, 1, 2][nr % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s1
), s3 AS (
  SELECT *, source_size / weight AS ratio,
    coalesce(sum(cap) OVER before, 0) AS capped,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS heavy,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM s2 WINDOW before AS (ORDER BY source_size / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (SELECT *, (budget - capped) / heavy AS level FROM s3),
f AS (SELECT ratio, nr, level FROM s4 WHERE level * weight <= cap ORDER BY ratio, nr LIMIT 1),
t AS (
  SELECT s4.source, s4.nr, s4.source_size,
    CASE WHEN f.nr IS NULL OR (s4.ratio, s4.nr) < (f.ratio, f.nr) THEN s4.cap ELSE f.level * s4.weight END AS target
  FROM s4 LEFT JOIN f ON true
), b AS (
  SELECT greatest(16, ceil(coalesce(sum(size), 0)::DOUBLE * 1.5::DOUBLE / 1048576))::BIGINT AS top FROM d
), u AS (
  SELECT t.*, CASE WHEN target >= 1024 * top THEN top WHEN target >= 1024 * ceil(top / 1024) THEN ceil(top / 1024)
    WHEN target >= 1024 * ceil(top / 1048576) THEN ceil(top / 1048576) ELSE 1 END::BIGINT AS block
  FROM t CROSS JOIN b
), r AS (
  SELECT nr, block, (sum(target) OVER upto - target) / sum(target) OVER same AS low, sum(target) OVER upto / sum(target) OVER same AS high,
    nr = max(nr) OVER same AS last
  FROM u WHERE target > 0
  WINDOW same AS (PARTITION BY block), upto AS (PARTITION BY block ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), p AS (
  SELECT block, (i + 1) * 0.6180339887498949::DOUBLE - floor((i + 1) * 0.6180339887498949::DOUBLE) AS point
  FROM (SELECT block, unnest(range(ceil(round(sum(target), 3) / block)::BIGINT)) AS i FROM u WHERE target > 0 GROUP BY block)
), n AS (
  SELECT r.nr, count(*) AS slots FROM p JOIN r ON p.block = r.block AND point >= low AND (point < high OR last) GROUP BY r.nr
), l AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, coalesce(n.slots, 0) * u.block AS upto,
    coalesce(sum(d.size) OVER (PARTITION BY u.nr ORDER BY md5('7:' || d.doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN n ON n.nr = u.nr
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (greatest(0, least(size, upto - start)) + greatest(0, least(size, upto - start - source_size)))::BIGINT AS taken
FROM l""",
    "op10_voronoi_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_reply_trees": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL
  SELECT -7, x, role, said, role, said
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(x, role), (SELECT '\### Assistant: </turn> ok' AS said)
), e AS (
  SELECT *, length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) AS body,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
      ELSE 1 + length(regexp_replace(role, '\\|###|</turn>|:|\n', '\\\0', 'g')) END AS name
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + name + 2 + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_hilbert_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_dot_product(a.v, d.v)::BIGINT AS score
  FROM v a JOIN v d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5""",
}
