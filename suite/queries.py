"""Registered queries: operators applied to the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import rules, text
from sourceloom.limits import BOUNDED, DEFAULTS, Limits
from sourceloom.operators import chunks, files, quality, repos, retrieve, search, traces, vectors
from sourceloom.plans import ask, ingest
from sourceloom.sources.staging import staged
from suite import corpus, fixed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SMALL_WINDOWS = Limits(window=8, stride=6, max_tokens=60)   # many windows per document
CAP = 10                                                    # files per repository


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# Files ---------------------------------------------------------------------------------------

@query
def detect_language(spark, sf_dir):
    return corpus.files(spark, sf_dir).select(
        "doc_id", "path", rules.detect_language("path").alias("language"))


@query
def skip_dirs(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(~files.in_skipped_dir("path")).select("doc_id", "path")


@query
def skip_files(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(~files.is_skipped_name("path")).select("doc_id", "path")


@query
def eligible_files(spark, sf_dir):
    return files.eligible_files(corpus.files(spark, sf_dir)).select(
        "repo_id", "path", "size", "language", F.length("content").alias("n_chars"))


@query
def eligible_files_capped(spark, sf_dir):
    return files.eligible_files(corpus.files(spark, sf_dir), max_files=CAP, max_bytes=BOUNDED.max_bytes,
                                glob_skip=False).select(
        "repo_id", "path", "language")


@query
def file_outcomes(spark, sf_dir):
    """Documents of 100 to 127 bytes have lost their content."""
    lost = F.when(~F.col("size").between(100, 127), F.col("content"))
    return files.file_outcomes(corpus.files(spark, sf_dir).withColumn("content", lost), max_files=CAP,
                               max_bytes=BOUNDED.max_bytes)


@query
def chunk_outcomes(spark, sf_dir):
    """Documents of a language in eleven have lost their content; all others are chunked."""
    lost = F.when(F.col("doc_id") % 11 != 0, F.col("content"))
    chunked = chunks.with_chunks(corpus.code_files(spark, sf_dir).withColumn("content", lost))
    return chunks.chunk_outcomes(chunked)


@query
def language_counts(spark, sf_dir):
    return files.language_counts(files.eligible_files(corpus.files(spark, sf_dir)))


# Text and chunks -----------------------------------------------------------------------------

@query
def token_counts(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.token_count("text").alias("token_count"))


@query
def chunk_ids(spark, sf_dir):
    return corpus.files(spark, sf_dir).select(
        "doc_id", text.chunk_id("repo_id", "path", F.col("size") % 97 + 1).alias("id"))


@query
def classify_nodes(spark, sf_dir):
    units = chunks.code_blocks(corpus.code_files(spark, sf_dir))
    return units.select("repo_id", "path", "start_line", "boundary_type",
                        rules.classify("boundary_type").alias("node_type"))


@query
def line_windows(spark, sf_dir):
    return chunks.fallback_chunks(corpus.plain_files(spark, sf_dir), SMALL_WINDOWS)


@query
def fallback_chunks(spark, sf_dir):
    return chunks.fallback_chunks(corpus.plain_files(spark, sf_dir))


@query
def code_blocks(spark, sf_dir):
    return chunks.code_blocks(corpus.code_files(spark, sf_dir))


@query
def context_headers(spark, sf_dir):
    return chunks.context_headers(corpus.code_files(spark, sf_dir))


@query
def code_chunks(spark, sf_dir):
    return chunks.chunk_files(corpus.code_files(spark, sf_dir))


@query
def embedding_text(spark, sf_dir):
    rows = chunks.chunk_files(corpus.code_files(spark, sf_dir))
    return rows.select("id", vectors.chunk_text().alias("embedding_text"),
                       text.location("file_path", "start_line", "end_line").alias("location"))


@query
def vector_metadata(spark, sf_dir):
    return vectors.vector_metadata(chunks.fallback_chunks(corpus.plain_files(spark, sf_dir)), BOUNDED)


@query
def chunk_sample(spark, sf_dir):
    return chunks.chunk_sample(chunks.chunk_files(corpus.code_files(spark, sf_dir)))


# Vectors and search --------------------------------------------------------------------------

def _chunks(spark, sf_dir, limits=DEFAULTS):
    return chunks.fallback_chunks(corpus.plain_files(spark, sf_dir), limits)


def _store(spark, sf_dir, limits=DEFAULTS):
    """Chunks with their vectors, written once: a search reads them for counts, scores and metadata."""
    return staged(ingest.vector_rows(_chunks(spark, sf_dir, limits)))


@query
def sparse_features(spark, sf_dir):
    return vectors.sparse_features(vectors.chunk_vectors(_chunks(spark, sf_dir)))


@query
def index_stats(spark, sf_dir):
    return vectors.index_stats(_chunks(spark, sf_dir))


@query
def search_sparse(spark, sf_dir):
    return ask.find_hits(_store(spark, sf_dir), corpus.questions(spark, sf_dir))


def _dense_hits(spark, sf_dir, search_fn, **options):
    questions = corpus.centroids(spark, sf_dir).select("question_id", "repo_id", "vector", "fetch_k")
    rows = corpus.vectors(spark, sf_dir).select("id", "repo_id", "vector")
    return staged(search_fn(rows, questions, **options), small_batches=True)


@query
def search_dense(spark, sf_dir):
    return _dense_hits(spark, sf_dir, search.search_dense)


@query
def search_lsh(spark, sf_dir):
    """Everything that shares one of eight buckets of three bits with a question is scored, however many rows there are."""
    return _dense_hits(spark, sf_dir, search.search_lsh, dims=64, bits=3, tables=8, flips=0)


@query
def overlap_dedup(spark, sf_dir):
    rows, questions = _store(spark, sf_dir, SMALL_WINDOWS), corpus.questions(spark, sf_dir)
    hits = ask.find_hits(rows, questions)
    kept = retrieve.overlap_dedup(
        retrieve.hits_with_metadata(hits, vectors.vector_metadata(rows), questions))
    return kept.select("question_id", "rank", "id", "score", "file_path", "start_line", "end_line")


@query
def rag_sources(spark, sf_dir):
    return ask.answer_sources(_store(spark, sf_dir), corpus.questions(spark, sf_dir))


@query
def rag_dense(spark, sf_dir):
    """The same with a dense encoder, in a store that holds vectors of two encoders."""
    rows = _chunks(spark, sf_dir)
    stored = staged(ingest.vector_rows(rows, vectors.FOLDED_COUNTS).unionByName(
        ingest.vector_rows(rows).select(*rows.columns, "encoder"), allowMissingColumns=True))
    return ask.answer_sources(stored, corpus.questions(spark, sf_dir), encoder=vectors.FOLDED_COUNTS)


@query
def prompts(spark, sf_dir):
    repo_rows = repos.repo_latest(corpus.repo_events(spark, sf_dir, 25))
    rows = ask.question_prompts(_store(spark, sf_dir), corpus.questions(spark, sf_dir), repo_rows, ready_only=False)
    return rows.select("question_id", "repo_id", "source_count",
                       F.get("messages", F.lit(0))["content"].alias("system"),
                       F.get("messages", F.lit(1))["content"].alias("message"))


@query
def query_gate(spark, sf_dir):
    repo_rows = repos.repo_latest(corpus.repo_events(spark, sf_dir, 25))
    return ask.question_outcomes(_store(spark, sf_dir), corpus.gate_questions(spark, sf_dir), repo_rows, ready_only=False)


# Repositories --------------------------------------------------------------------------------

@query
def repo_urls(spark, sf_dir):
    return repos.repo_urls(corpus.addresses(spark, sf_dir)).select(
        "page_id", "clean_url", "repo_name", "outcome")


@query
def job_payloads(spark, sf_dir):
    return repos.job_payloads(corpus.messages(spark, sf_dir))


@query
def dead_letters(spark, sf_dir):
    decoded = repos.decode_jobs(corpus.messages(spark, sf_dir))
    return decoded.where(F.col("outcome") == "dead_letter").select("page_id", "value")


@query
def repo_latest(spark, sf_dir):
    return repos.repo_latest(corpus.repo_events(spark, sf_dir))


@query
def job_durations(spark, sf_dir):
    return repos.job_durations(corpus.repo_events(spark, sf_dir))


@query
def repo_list(spark, sf_dir):
    return repos.repo_list(repos.repo_latest(corpus.repo_events(spark, sf_dir))).select(
        "repo_id", "status", "created_at", "returned", "total")


@query
def upsert_chunks(spark, sf_dir):
    """Labelled documents are revised and chunked again; toxic ones are delivered twice."""
    def rows(df, seq):
        return chunks.fallback_chunks(df).select(
            "id", "repo_id", "file_path", "content", seq.cast("bigint").alias("seq"))

    base = corpus.plain_files(spark, sf_dir)
    labels = corpus.table(spark, sf_dir, "labels")
    revised = base.withColumn("content", F.concat("content", F.lit(" revised")))
    again = revised.join(labels, "doc_id", "left_semi")
    twice = base.join(labels.where(F.col("toxic") == 1), "doc_id", "left_semi")
    incoming = rows(again, F.lit(1)).unionByName(rows(twice, F.lit(2)))
    return repos.upsert(rows(base, F.lit(0)), incoming)


@query
def delete_repo(spark, sf_dir):
    latest = repos.repo_latest(corpus.repo_events(spark, sf_dir, 25))
    failed = latest.where(F.col("status") == "failed")
    return repos.delete_repos(_chunks(spark, sf_dir), failed).select("id", "repo_id", "file_path")


def _no_address(chunk):
    return ~chunk["content"].contains("@")


@query
def upsert_batches(spark, sf_dir):
    chunked = ingest.chunk_repositories(corpus.files(spark, sf_dir), SMALL_WINDOWS)
    return repos.upsert_batches(chunked, _no_address)


def _summary(spark, sf_dir):
    jobs = repos.repo_latest(corpus.repo_events(spark, sf_dir, 25)).select(
        "repo_id", F.col("url").alias("github_url"), "branch")
    chunked = ingest.chunk_repositories(corpus.files(spark, sf_dir))
    return repos.ingest_summary(jobs, chunked, _no_address)


@query
def ingest_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def ingest_traces(spark, sf_dir):
    timed = _summary(spark, sf_dir).withColumn("duration_seconds", F.col("chunk_count") * 0.125)
    return traces.ingest_traces(timed).withColumn("tags", F.array_join("tags", ","))


# Traces and usage ----------------------------------------------------------------------------

@query
def query_traces(spark, sf_dir):
    turn = F.col("question_id")
    answers = corpus.turns(spark, sf_dir).select(
        F.concat(F.lit("t"), turn.cast("string")).alias("trace_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("repo_id"), "question",
        F.split("answer", "\n", -1).alias("contents"), "answer",
        F.when(turn % 2 == 0, "alpha/small").otherwise("beta/large").alias("model"),
        (turn % 20 + 1).cast("int").alias("top_k"), F.length("answer").cast("bigint").alias("latency_ms"),
        F.when(turn % 3 != 0, text.token_count("question")).alias("prompt_tokens"),
        text.token_count("answer").alias("completion_tokens"),
        (text.token_count("question") + text.token_count("answer")).alias("total_tokens"))
    rows = traces.query_traces(answers)
    return rows.select("trace_id", "name", "repo_id", "model", "provider", "top_k", "latency_ms",
                       "chunks_retrieved", "generation_input", "usage.*",
                       F.array_join("tags", ",").alias("tags"))


@query
def usage_by_model(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    output = F.col("event_id") % 97
    rows = corpus.table(spark, sf_dir, "events").select(
        corpus.lookup(fixed.MODEL_OF, "event_type").alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.struct(k.alias("input"), output.alias("output"), (k + output).alias("total")).alias("usage"))
    return traces.usage_by_model(rows, exact=True)


def _scores_of(rows, trace_id):
    values = F.create_map(F.lit("quality"), F.col("quality").cast("double"),
                          F.lit("toxic"), F.col("toxic").cast("double"))
    return traces.score_rows(rows.select(trace_id.alias("trace_id"), values.alias("scores")))


@query
def score_rows(spark, sf_dir):
    labels = corpus.table(spark, sf_dir, "labels")
    return _scores_of(labels, F.concat(F.lit("t"), F.col("doc_id").cast("string")))


@query
def trace_scores(spark, sf_dir):
    """The turns of a conversation are scored with the labels of the document of the same number."""
    trace_id = F.concat(F.lit("t"), F.col("question_id").cast("string"))
    asked = corpus.turns(spark, sf_dir)
    labels = corpus.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "conv_id")
    scores = _scores_of(asked.select("conv_id", "question_id").join(labels, "conv_id"), trace_id)
    return traces.scored_traces(asked.select(trace_id.alias("trace_id"), "conv_id", "turn"), scores)


# Quality -------------------------------------------------------------------------------------

@query
def context_precision(spark, sf_dir):
    hits = _dense_hits(spark, sf_dir, search.search_dense)
    wanted = corpus.centroids(spark, sf_dir).select("question_id", F.col("label").alias("wanted"))
    labels = corpus.vectors(spark, sf_dir).select("id", "label")
    judged = hits.join(labels, "id").join(wanted, "question_id").withColumn(
        "relevant", F.col("label") == F.col("wanted"))
    return quality.context_precision(judged)


@query
def context_recall(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question_id"))
    statements = docs.join(corpus.table(spark, sf_dir, "labels"), "doc_id").withColumn(
        "supported", F.col("quality") == 1)
    return quality.context_recall(statements)


@query
def faithfulness(spark, sf_dir):
    rows = corpus.turns(spark, sf_dir).withColumnRenamed("question", "context")
    return quality.faithfulness(quality.claims(rows))


@query
def answer_relevancy(spark, sf_dir):
    """The user turn after an answer serves as the question that the answer would answer."""
    asked = corpus.turns(spark, sf_dir)
    later = corpus.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("probe_question"))
    return quality.answer_relevancy(asked.join(later, ["conv_id", "turn"]))


def _scores(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(corpus.table(spark, sf_dir, "labels"), "doc_id").select(
        F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"),
        F.col("quality"), F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("length"))


@query
def eval_means(spark, sf_dir):
    return quality.eval_means(_scores(spark, sf_dir), ["quality", "toxic", "length"], ["provider"])


@query
def provider_compare(spark, sf_dir):
    rows = quality.long_scores(_scores(spark, sf_dir), ["quality", "toxic", "length"], ["provider"])
    return quality.provider_compare(rows, "alpha", "beta")


@query
def eval_join(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"),
                        F.col("lang").alias("ground_truth"))
    results = corpus.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("question_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"),
        F.array(F.lit("a"), F.col("toxic").cast("string")).alias("contexts"),
        F.lit("alpha/small").alias("model"))
    joined = quality.eval_join(pairs, results, F.lit("alpha"))
    return joined.withColumn("contexts", F.array_join("contexts", ","))
