"""BM25 lexical index and search.

Term counts are made inside each chunk's row (sort the tokens, measure the
runs), so building postings needs no shuffle; only the per-term document
frequencies do, after map-side aggregation.  Corpus statistics always come from
the unfiltered corpus: filters restrict candidates, never N, df or the average
length.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sections import under_prefix
from ..functions.text import tokenize, tokenize_literal
from ..session import broadcast_within, materialize, number_ordered, top_k_per_group
from . import block_max

# A stored index has one bucket of terms for so many postings.
BUCKET_POSTINGS = 4_000_000
# One of so many blocks of chunks is scored first, for a score that later blocks must reach.
SEED_BLOCKS = 16
# Searches of up to so many terms in all are sent to every task; more are joined by shuffle.
BROADCAST_TERMS = 1_000_000

_DOCUMENT = ("chunk_id", "section", "content_type", "doc_len")


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    title_boost: int = 4


def document_tokens(chunks: DataFrame, title_boost: int = 4) -> DataFrame:
    """One row per chunk with its indexed tokens and their number."""
    tokens = F.concat(
        tokenize(F.col("text")),
        F.flatten(F.array_repeat(tokenize(F.col("section_title")), title_boost)),
        F.array(F.lower(F.col("section"))),
    )
    return chunks.select("chunk_id", "section", "content_type", tokens.alias("terms")).withColumn("doc_len", F.size("terms"))


def document_terms(chunks: DataFrame, title_boost: int = 4) -> DataFrame:
    """The same with the tokens sorted."""
    return document_tokens(chunks, title_boost).withColumn("terms", F.sort_array("terms"))


def _with_term_counts(documents: DataFrame, terms: str, out: str) -> DataFrame:
    """Adds the counts of a sorted array of tokens, as array<struct<term,tf>>.

    The tokens are joined with a mark that none of them holds, and one pass of a regular
    expression finds the runs of equal ones.
    """
    joined = F.concat(F.array_join(terms, "\n"), F.lit("\n"))
    runs = F.when(F.size(terms) > 0, F.regexp_extract_all(joined, F.lit(r"([^\n]*+\n)\1*+"), F.lit(0)))
    counts = F.zip_with(
        F.array_distinct(terms),
        F.coalesce("_runs", F.array().cast("array<string>")),
        lambda term, run: F.struct(term.alias("term"), (F.octet_length(run) / (F.octet_length(term) + 1)).cast("int").alias("tf")),
    )
    return documents.withColumn("_runs", runs).withColumn(out, counts).drop("_runs")


def explode_postings(documents: DataFrame) -> DataFrame:
    """(document columns, term, tf) from rows holding sorted ``terms``; no shuffle."""
    return _explode_counts(_with_term_counts(documents, "terms", "counts"))


def _explode_counts(counted: DataFrame) -> DataFrame:
    """One row per counted term.

    The outer form matters: a plain explode makes the optimizer infer a
    "not empty" filter, push it to the scan and tokenize every text twice.
    """
    rest = [c for c in counted.columns if c not in {"counts", "terms"}]
    exploded = counted.select(*rest, F.explode_outer("counts").alias("p"))
    return exploded.select(*rest, "p.term", "p.tf").filter(F.col("term").isNotNull())


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of chunks and average length over the whole corpus."""
    return documents.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("doc_len").cast("long")).cast("double") / F.count(F.lit(1))).alias("avg_len"),
    )


def idf_column(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): map-side combined, so a term in every chunk is no hot key."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _partial_score(idf: Column, tf: Column, doc_len: Column, avg_len: Column, p: Bm25Params) -> Column:
    """Of columns or of arrays, with the same operations in the same order."""
    norm = (1 - p.b) + p.b * doc_len / avg_len
    return idf * tf * (p.k1 + 1) / (tf + p.k1 * norm)


def _candidate_filter(section_prefix: str | None, content_types: Iterable[str] | None) -> Column:
    keep = F.lit(True)
    if section_prefix:
        keep = keep & under_prefix(F.col("section"), section_prefix)
    types = list(content_types or ())
    if types:
        keep = keep & F.col("content_type").isin(types)
    return keep


_RANKING = ("score", "section", "chunk_id")


def _ranking() -> list[Column]:
    return [F.col("score").desc(), F.col("section"), F.col("chunk_id")]


class Bm25Index:
    """BM25 over a chunk DataFrame, or over tables written by :meth:`save`."""

    def __init__(
        self,
        chunks: DataFrame,
        *,
        k1: float = 1.5,
        b: float = 0.75,
        title_boost: int = 4,
        check_empty: bool = False,
    ) -> None:
        if check_empty and chunks.isEmpty():
            raise ValueError("a BM25 index needs at least one chunk")
        self.chunks = chunks
        self.params = Bm25Params(k1, b, title_boost)
        self._stored: dict[str, DataFrame] | None = None

    # -- index tables -----------------------------------------------------

    def documents(self) -> DataFrame:
        return document_terms(self.chunks, self.params.title_boost)

    def doc_lengths(self) -> DataFrame:
        if self._stored:
            return self._stored["documents"]
        return self.documents().select(*_DOCUMENT)

    def postings(self) -> DataFrame:
        if self._stored:
            return self._stored["postings"].select(*_DOCUMENT, "term", "tf")
        return explode_postings(self.documents())

    def stats(self) -> DataFrame:
        """One row (n, avg_len); of a stored index by adding what each part of it counted."""
        if self._stored:
            parts = self._stored["stats"].agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
            return parts.select("n", (F.col("total") / F.col("n")).alias("avg_len"))
        return corpus_stats(self.doc_lengths())

    def frequencies(self) -> DataFrame:
        """(term, df) for the whole vocabulary."""
        if self._stored:
            return self._stored["terms"].groupBy("term").agg(F.sum("df").alias("df"))
        return document_frequencies(self.postings())

    def idf(self) -> DataFrame:
        """(term, df, idf) for the whole vocabulary."""
        n = self.stats().select(F.col("n").cast("double")) if self._stored else self.chunks.agg(F.count(F.lit(1)).cast("double").alias("n"))
        return self.frequencies().withColumn("idf", idf_column(n.scalar(), F.col("df")))

    def save(self, path: str) -> None:
        """Write the index as Parquet, or add the chunks to one that is there.

        Postings lie in buckets of terms, sorted by term inside, so a search opens the buckets
        of its terms and, in them, the row groups whose range of terms holds one.  A term in a
        third of all chunks is spread over salted partitions instead of one task.  Statistics
        are kept as counts (chunks, total length, chunks of a term), which add up over parts,
        so an index grows by appending; the number of buckets is set by the first part.
        """
        spark = self.chunks.sparkSession
        # counted once: the number of postings, the postings and their frequencies are all read from the counts
        documents = materialize(_with_term_counts(self.documents(), "terms", "counts").select(*_DOCUMENT, "counts"))
        postings = _explode_counts(documents)
        there = _written(spark, f"{path}/stats")
        if there:
            buckets = spark.read.parquet(f"{path}/stats").agg(F.max("buckets")).first()[0]
        else:
            held = documents.agg(F.sum(F.size("counts").cast("long"))).first()[0] or 0
            buckets = max(1, -(-held // BUCKET_POSTINGS))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(16))
        (
            postings.withColumn("term_bucket", bucket)
            .repartition("term_bucket", salt)
            .sortWithinPartitions("term_bucket", "term")
            .write.mode("append")
            .partitionBy("term_bucket")
            .parquet(f"{path}/postings")
        )
        documents.select(*_DOCUMENT).write.mode("append").parquet(f"{path}/documents")
        frequencies = document_frequencies(postings).withColumn("term_bucket", bucket)
        (
            frequencies.repartition("term_bucket").sortWithinPartitions("term").write.mode("append")
            .partitionBy("term_bucket").parquet(f"{path}/terms")
        )
        p = self.params
        counted = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("total"))
        settings = {"buckets": F.lit(buckets).cast("long"), "k1": F.lit(float(p.k1)), "b": F.lit(float(p.b)), "title_boost": F.lit(p.title_boost)}
        # last, so that a part without its counts is one that failed
        counted.select("*", *[v.alias(c) for c, v in settings.items()]).write.mode("append").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Bm25Index":
        index = cls.__new__(cls)
        index.chunks = None
        index._stored = {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "terms", "stats")}
        first = index._stored["stats"].first()
        index.params = Bm25Params(first["k1"], first["b"], first["title_boost"])
        index._buckets = first["buckets"]
        return index

    @classmethod
    def stored(cls, chunks: DataFrame, path: str) -> "Bm25Index":
        """The index at ``path``, written from ``chunks`` if there is none."""
        spark = chunks.sparkSession
        if not _written(spark, f"{path}/stats"):
            cls(chunks).save(path)
        return cls.load(spark, path)

    def _bucket_of(self, terms: Sequence[str]) -> Column:
        """Whether a stored row is in a bucket of ``terms``: a filter on the partition column, known to the planner."""
        spark = self._stored["stats"].sparkSession
        named = spark.createDataFrame([(t,) for t in terms], "term string")
        ids = named.select(F.pmod(F.xxhash64("term"), F.lit(self._buckets)).cast("int")).distinct().collect()  # at most len(terms)
        return F.col("term_bucket").isin([r[0] for r in ids]) & F.col("term").isin(list(terms))

    # -- single query -----------------------------------------------------

    def search(
        self,
        query: str,
        *,
        top_k: int = 10,
        section_prefix: str | None = None,
        content_types: Iterable[str] | None = None,
    ) -> DataFrame:
        """Ranked hits (rank, chunk_id, section, content_type, score, matched_terms)."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        terms = tokenize_literal(query)
        if self._stored:
            counts, idf, avg_len = self._stored_counts(terms)
        else:
            counts, idf, avg_len = self._scanned_counts(terms)

        score = F.lit(0.0)
        for i in range(len(terms)):
            tf = F.get("tf", F.lit(i))
            part = _partial_score(F.lit(idf[i]), tf, F.col("doc_len"), F.lit(avg_len), self.params)
            score = score + F.when(tf > 0, part).otherwise(F.lit(0.0))
        matched = F.array_compact(
            F.array(
                *[F.when(F.get("tf", F.lit(i)) > 0, F.lit(t)) for i, t in enumerate(terms)]
            ).cast("array<string>")
        )
        hits = (
            counts.filter(_candidate_filter(section_prefix, content_types))
            .filter(F.exists("tf", lambda tf: tf > 0))  # every match scores above zero
            .withColumn("score", score)
            .select("chunk_id", "section", "content_type", "score", matched.alias("matched_terms"))
            .orderBy(*_ranking())
            .limit(top_k)
        )
        return _number(hits)

    def _stored_counts(self, terms: Sequence[str]) -> tuple[DataFrame, list[float], float]:
        """Per chunk that has one of ``terms`` their counts; the idf of each term, the mean length."""
        if not terms:
            empty = self._stored["documents"].limit(0)
            return empty.withColumn("tf", F.array().cast("array<int>")), [], 1.0
        stats = self.stats().first()
        mine = self._bucket_of(terms)
        found = self._stored["terms"].filter(mine).groupBy("term").agg(F.sum("df").alias("df"))
        idf = dict(found.select("term", idf_column(F.lit(float(stats["n"])), F.col("df"))).collect())  # at most len(terms)
        hits = self._stored["postings"].filter(mine)
        counted = hits.groupBy(*_DOCUMENT).agg(
            F.array(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in terms]).cast("array<int>").alias("tf")
        )
        return counted, [idf.get(t, 0.0) for t in terms], stats["avg_len"] or 1.0

    def _scanned_counts(self, terms: Sequence[str]) -> tuple[DataFrame, list[float], float]:
        """The same from a corpus that is not indexed: one pass over its texts."""
        documents = document_tokens(self.chunks, self.params.title_boost)
        if not terms:
            return documents.select(*_DOCUMENT, F.array().cast("array<int>").alias("tf")).limit(0), [], 1.0
        hits = documents.select(*_DOCUMENT, F.filter("terms", lambda t: t.isin(list(terms))).alias("hits"))
        # one expression a term: as the body of one lambda the filter would be evaluated once for each
        occurring = lambda term: F.size(F.filter("hits", lambda hit: hit == term))
        tf = F.array(*[occurring(t) for t in terms])
        counts = materialize(hits.select(*_DOCUMENT, tf.alias("tf")))
        measured = counts.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("doc_len").cast("long")).alias("total"),
            *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))],
        )
        n = F.col("n").cast("double")
        row = measured.select(
            (F.col("total").cast("double") / F.col("n")).alias("avg_len"),
            F.array(*[idf_column(n, F.col(f"df{i}")) for i in range(len(terms))]).alias("idf"),
        ).first()
        return counts, row["idf"], row["avg_len"] or 1.0

    # -- many queries -----------------------------------------------------

    def search_many(
        self,
        queries: DataFrame,
        *,
        top_k: int = 10,
        section_prefix: str | None = None,
        content_types: Iterable[str] | None = None,
    ) -> DataFrame:
        """Rank every query of ``queries(query_id, query)`` together, with the scores of :meth:`search`.

        Chunks are cut down to the query vocabulary before anything moves.  Of all
        (query, chunk) pairs that share a term only those are scored that can be
        among the first ``top_k`` (see :mod:`block_max`).
        """
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        # Queries with the same terms are one search; its hits are joined back.
        worded = queries.select(
            "query_id", F.array_distinct(tokenize(F.col("query"))).alias("terms")
        )
        worded = materialize(worded.filter(F.size("terms") > 0))
        searches = materialize(
            number_ordered(worded.select("terms").distinct().orderBy("terms"), "search_no")
        )
        terms = searches.select("search_no", F.posexplode("terms").alias("pos", "term"))
        documents, stats, frequencies = self._vocabulary_documents(
            terms.select("term").distinct(), _candidate_filter(section_prefix, content_types)
        )
        n, avg_len = float(stats["n"] or 0), float(stats["avg_len"] or 1.0)
        idf = frequencies.select("term", idf_column(F.lit(n), F.col("df")).alias("idf"))
        weights = materialize(terms.join(idf, "term").select("search_no", "pos", "term", "idf"))
        near = self._near(documents.filter("keep"), weights, avg_len, top_k)
        scored = self._scores(documents, near, weights, avg_len)
        ranked = top_k_per_group(scored, ["search_no"], [*_ranking(), F.col("row_no")], top_k)
        return worded.join(ranked.join(searches, "search_no"), "terms").select(
            "query_id", "rank", "chunk_id", "section", "score", "matched_terms"
        )

    def _vocabulary_documents(self, vocabulary: DataFrame, keep: Column) -> tuple[DataFrame, Row, DataFrame]:
        """Chunks with the counts of their terms (row_no, keep, terms, tfs), corpus statistics, and (term, df)."""
        bare = ("row_no", "chunk_id", "section", "doc_len", "keep")
        if self._stored:
            bucket = F.pmod(F.xxhash64("term"), F.lit(self._buckets)).cast("int")
            wanted = broadcast_within(vocabulary.withColumn("term_bucket", bucket))
            read = self._stored["postings"].join(wanted, ["term_bucket", "term"], "left_semi")
            counted = read.groupBy(*_DOCUMENT).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
            numbered = counted.withColumn("row_no", F.monotonically_increasing_id()).withColumn("keep", keep)
            known = self._stored["terms"].join(wanted, ["term_bucket", "term"], "left_semi")
            return materialize(numbered.select(*bare, "terms", "tfs")), self.stats().first(), known.groupBy("term").agg(F.sum("df").alias("df"))
        counted = _with_term_counts(self.documents(), "terms", "counts")
        numbered = counted.withColumn("row_no", F.monotonically_increasing_id()).withColumn("keep", keep)
        documents = materialize(numbered.select(*bare, F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs")))
        postings = documents.select(F.explode_outer("terms").alias("term")).join(broadcast_within(vocabulary), "term", "left_semi")
        return documents, corpus_stats(documents).first(), document_frequencies(postings)

    def _near(self, documents: DataFrame, weights: DataFrame, avg_len: float, top_k: int) -> DataFrame:
        """(search_no, row_no): all chunks that can be among the first ``top_k`` of a search, and few others."""
        p = self.params

        def factor(tf, length):
            return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / avg_len))

        weighted = weights.select("search_no", "pos", "term", F.col("idf").alias("weight"))
        blocks = block_max.packed(documents)

        batches = materialize(block_max.batched(weighted))
        size = weighted.agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")).first()
        few = size["n"] <= BROADCAST_TERMS
        slack = block_max.slack((size["last"] or 0) + 1)
        groups = -(-batches.count() // block_max.GROUP_BATCHES) or 1

        def best(blocks: DataFrame, least: DataFrame | None) -> DataFrame:
            nothing = F.lit(None).cast("array<struct<search_no:long,least:double>>")
            known = batches.withColumn("known", nothing) if least is None else batches.join(block_max.known(least), "batch", "left")
            known = known.withColumn("known", F.coalesce("known", F.array().cast("array<struct<search_no:long,least:double>>")))
            meeting = F.broadcast(known) if few else materialize(known.repartitionByRange(groups, "batch"))
            return materialize(block_max.found(blocks, meeting, factor, top_k))

        seeds = best(blocks.filter(F.pmod(F.xxhash64(F.get("rows", F.lit(0))), F.lit(SEED_BLOCKS)) == 0), None)
        near = best(blocks, _kth(seeds, top_k, slack))
        least = _kth(near, top_k, slack)
        return near.join(broadcast_within(least), "search_no", "left").filter(
            F.col("about") * (1 + slack) >= F.coalesce("least", F.lit(0.0))
        ).select("search_no", "row_no")

    def _scores(self, documents: DataFrame, pairs: DataFrame, weights: DataFrame, avg_len: float) -> DataFrame:
        """Scores of (search_no, row_no) pairs, parts added in the order of the query's terms, as :meth:`search` adds them."""
        p = self.params

        def part(idf, tf, length):
            return _partial_score(idf, tf, length, avg_len, p)

        asked = weights.groupBy("search_no").agg(F.array_sort(F.collect_list(F.struct("pos", "idf", "term"))).alias("asked"))
        rows = documents.join(broadcast_within(pairs), "row_no").join(asked, "search_no")
        return block_max.scored(rows.select("search_no", "row_no", "chunk_id", "section", "doc_len", "terms", "tfs", "asked"), part)


def _kth(found: DataFrame, k: int, slack: float) -> DataFrame:
    """(search_no, least): what the k-th best score of a search reaches, for those with k found."""
    ranked = top_k_per_group(found, ["search_no"], [F.desc("about"), F.col("row_no")], k)
    kth = ranked.filter(F.col("rank") == k)
    return kth.select("search_no", (F.col("about") * (1 - slack)).alias("least"))


def _written(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _number(hits: DataFrame) -> DataFrame:
    """Number an already ranked and limited result from 1."""
    window = Window.orderBy(*_ranking())
    return hits.withColumn("rank", F.row_number().over(window))


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the chunk columns of ranked hits last, once ranking is done.

    The limit of a single search bounds the hits in the plan, so Spark
    broadcasts them; hits of very many queries are joined by shuffle.
    """
    return chunks.drop("section", "content_type").join(hits, "chunk_id")
