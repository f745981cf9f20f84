"""The tables that queries read: documents as chunks, user turns as questions, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.config import KeywordConfig

#: Search queries are the rows whose id is divisible by this.
QUERY_EVERY = 50
#: Words of the longest list of stopwords.
STOPWORDS = 10_000


#: Words that occur in the tables, so that synonyms and priority words are met.
CONFIG = KeywordConfig(synonyms={"disco": ("unidad", "drive"), "tion": ("ment", "heit"), "ando": ("iendo",), "quement": ("mente", "lich")}, priority=("clon", "src0", "src7"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of ten sources for each language and site."""
    source = F.concat("lang", F.lit("/"), "source", F.lit("/doc"), (F.col("doc_id") % 10).cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", source.alias("source"), F.sha1("text").alias("source_hash"))


def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with w, their first words of four letters or more, filled up to five. No more of a text is cut into words than holds them."""
    head = F.regexp_extract(F.lower("text"), "(?s)^(?:.*?[a-z]{4,}){1,5}", 0)
    found = F.slice(F.concat(F.regexp_extract_all(head, F.lit("[a-z]{4,}"), F.lit(0)), F.array_repeat(F.lit("texto"), 5)), 1, 5)
    return read(spark, sf_dir, "documents").withColumn("w", F.coalesce(found, F.array_repeat(F.lit("texto"), 5)))


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks whose paths are made of their first words, with a code at the end."""
    head = lambda i: F.concat(F.upper(F.col("w")[i].substr(1, 1)), F.col("w")[i].substr(2, 1000))
    source = F.concat("lang", F.lit("/"), "source", F.lit("/"), head(0), head(1), F.lit("-"), F.col("w")[2], F.lit(".md"))
    text = F.concat("text", F.lit("\n"), F.col("w")[3], F.lit("-"), F.col("w")[4])
    return first_words(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), text.alias("text"), source.alias("source"), F.sha1(text).alias("source_hash"))


def named_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question for the documents of the query set: words of its path, one in the plural, its site and its code."""
    w = F.col("w")
    question = F.concat(w[0], F.lit(" "), w[1], F.lit(" "), w[2], F.lit("s "), "source", F.lit(" "), w[3], F.lit("-"), w[4])
    return first_words(spark, sf_dir).filter(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("qid"), question.alias("question"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of their own, with their lines as chunks."""
    docs = read(spark, sf_dir, "documents").select(document_source().alias("source"), F.sha1("text").alias("source_hash"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return docs.select(F.sha1(F.concat_ws("|", "source", F.col("chunk_index").cast("string"), "source_hash").cast("binary")).alias("chunk_id"), "source", "source_hash", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def document_source() -> F.Column:
    return F.concat("lang", F.lit("/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source of the documents of the query set."""
    return read(spark, sf_dir, "documents").filter(F.col("doc_id") % QUERY_EVERY == 0).select(document_source().alias("source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: user turns of the query set."""
    rows = read(spark, sf_dir, "conversations").filter((F.col("role") == "user") & (F.col("conv_id") % QUERY_EVERY == 0))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, qvec: a question's vector is the embedding of its conversation's number."""
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("qvec"))
    return questions(spark, sf_dir).withColumn("conv_id", F.expr("qid div 1000")).join(vec, "conv_id").select("qid", "question", "qvec")
