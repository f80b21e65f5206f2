"""Driver tables as inputs of the operators (the SQL twins are in ``suite.oracles``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.text import let
from sourceloom.sources.spread import spread
from suite import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, over all cores even when it is a single file."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs, "doc_id")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def lookup(values: dict[str, str], key: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def _path(doc_id: Column) -> Column:
    number = doc_id.cast("string")
    name = (F.when(doc_id % 29 == 0, F.concat(F.lit("d"), number, F.lit("/yarn.lock")))
            .when(doc_id % 31 == 0, F.concat(F.lit("f"), number, F.lit(".min.js")))
            .otherwise(F.concat(F.lit("f"), number, pick(fixed.SUFFIXES, doc_id))))
    return F.concat_ws("/", pick(fixed.DIRS, doc_id), F.col("lang"), name)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the repository ``source``."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return docs.select(
        "doc_id", F.col("source").alias("repo_id"), _path(F.col("doc_id")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with their language, whether eligible or not."""
    return files(spark, sf_dir).withColumn("language", rules.detect_language("path"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as source code: its lines fill the line templates of a language."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    languages = list(rules.LANGUAGES.items())
    suffixes, names = [k for k, _ in languages], [v for _, v in languages]
    templates = F.create_map(*[x for k, v in fixed.TEMPLATES.items()
                               for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])

    def render(tpl: Column) -> Column:
        return F.transform(F.split("text", "\n", -1), lambda t, i: F.replace(
            F.replace(F.get(tpl, i % F.size(tpl)), F.lit("{n}"), (i + 1).cast("string")),
            F.lit("{t}"), t))

    language = pick(names, F.col("doc_id"))
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), pick(suffixes, F.col("doc_id")))
    content = F.array_join(let(F.element_at(templates, language), render), "\n")
    return docs.select("doc_id", F.col("source").alias("repo_id"), path.alias("path"),
                       language.alias("language"), content.alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asks one repository."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("question_id"), F.concat(F.lit("src"), (item % 20).cast("string")).alias("repo_id"),
        F.col("text").alias("question"), (item % 20 + 1).cast("int").alias("top_k"))


def gate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with unknown repositories, missing and out-of-range ``top_k``."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("question_id"), F.concat(F.lit("src"), (item % 30).cast("string")).alias("repo_id"),
        F.col("text").alias("question"),
        F.when(item % 7 != 0, item % 23).cast("int").alias("top_k"))


def repo_events(spark: SparkSession, sf_dir: str, repos: int | None = None) -> DataFrame:
    """Every event as a life-cycle event of the repository of its user.

    With ``repos``, users are folded into that many repositories named like document sources.
    """
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    repo = (F.col("user_id").cast("string") if repos is None
            else F.concat(F.lit("src"), (F.col("user_id") % repos).cast("string")))
    return table(spark, sf_dir, "events").select(
        repo.alias("repo_id"), F.col("event_id").alias("seq"), "ts",
        lookup(fixed.STATUS_OF, "event_type").alias("status"),
        F.when(kind == "click", F.concat(F.lit("https://github.com/org/"), repo)).alias("url"),
        F.when(kind == "click", F.concat(F.lit("b"), (k % 3).cast("string"))).alias("branch"),
        F.when(kind == "signup", k).alias("file_count"),
        F.when(kind == "purchase", k * 3).alias("chunk_count"),
        F.when(kind == "error", F.concat(F.lit("error "), k.cast("string"))).alias("error"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address as a job message; some lack fields, some are no JSON, many repeat."""
    page = F.col("page_id")
    number = F.floor(page / 2).cast("string")
    owner = F.regexp_extract("url", r"example\.([a-z]+)", 1)
    repo = F.concat(F.lit('"repo_id": "r'), number, F.lit('"'))
    url = F.concat(F.lit('"github_url": "https://github.com/'), owner, F.lit("/p"), number, F.lit('"'))
    body = (F.when(page % 11 == 0, F.concat(F.lit("{"), repo, F.lit(', "github_url": ""}')))
            .when(page % 11 == 1, F.concat(F.lit("{"), url, F.lit("}")))
            .when(page % 11 == 2, F.concat(F.lit("not json "), number))
            .when(page % 11 == 3, F.concat(F.lit("{"), repo, F.lit(', "branch": null, '), url, F.lit("}")))
            .when(page % 11 < 7, F.concat(F.lit("{"), repo, F.lit(", "), url, F.lit("}")))
            .otherwise(F.concat(F.lit("{"), repo, F.lit(', "branch": "dev", '), url, F.lit("}"))))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("value"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses in repository form, with the variants that cleaning must handle."""
    page = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    base = F.concat(F.lit("https://github.com/"), host, F.lit("/p"), page.cast("string"))
    url = (F.when(page % 7 == 0, base).when(page % 7 == 1, F.concat(base, F.lit("/")))
           .when(page % 7 == 2, F.concat(base, F.lit(".git")))
           .when(page % 7 == 3, F.concat(F.lit(" \t"), base, F.lit(".git//\n")))
           .when(page % 7 == 4, F.concat(base, F.lit("/tree/main")))
           .when(page % 7 == 5, F.replace(base, F.lit("https"), F.lit("http")))
           .otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in four repositories."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("set"), (F.col("vec_id") % 4).cast("string"))
        .alias("repo_id"), F.col("embedding").alias("vector"), "label")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per repository and label: the mean vector of its members."""
    values = vectors(spark, sf_dir).select("repo_id", "label", F.posexplode("vector").alias("d", "x"))
    means = values.groupBy("repo_id", "label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = F.sort_array(F.collect_list(F.struct("d", "x")))    # one entry per dimension
    return means.groupBy("repo_id", "label").agg(F.transform(whole, lambda s: s["x"]).alias("vector")
    ).select(F.concat("repo_id", F.lit("/"), F.col("label").cast("string")).alias("question_id"),
             "repo_id", "label", "vector", F.lit(20).alias("fetch_k"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before them as question and context."""
    t = table(spark, sf_dir, "conversations")
    answer = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    # Joined on both columns: a very long conversation is spread over all tasks.
    return t.where(F.col("role") == "user").join(answer, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn",
        F.col("text").alias("question"), "answer")
