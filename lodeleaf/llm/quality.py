"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured in one row-local expression. Failures are counted by
host (the domain of the source), host rates are shrunk with a beta prior
fitted to all hosts, and hosts whose shrunk rate is too high reject all their
documents.

The base rule counts for hosts too: one whose documents are mostly short or
repetitive loses its good ones with them. Repeated windows are told by 64-bit
hashes, which are not verified.

Edge cases: a null or empty text has no words and fails; a null host is a host
of its own; repeated rows are judged alike; columns of other names are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.llm.common import WORD, let, small, stored, table, total, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if the shrunk share of its documents that fail a rule is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents; the lower one also serves where the hosts don't vary.
PRIOR_WEIGHT = (2.0, 1000.0)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by hash with their position; equal neighbours are
    repeats. Over sorted positions each window covers min(3, gap) new words.
    """

    def covered(places: Column) -> Column:
        return total(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))).cast("long")))

    def repeats(ordered: Column) -> Column:
        hit = F.filter(ordered, lambda x, i: (x["t"] == F.get(ordered, i - 1)["t"]) | (x["t"] == F.get(ordered, i + 1)["t"]))
        return let(F.array_sort(F.transform(hit, lambda x: x["p"])), covered)

    def windows(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0)))

    def sorted_repeats(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda t, i: F.struct(t.alias("t"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, repeats))

    return let(let(hashes, windows), sorted_repeats)


def measures(text: Column) -> Column:
    """Struct of MEASURES for a text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    symbols = F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))
    return let(
        words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
        ),
    )


def host_of(source: Column) -> Column:
    """The domain of a URL in lower case; any other source is its own host."""
    name = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(name != "", F.lower(name)).otherwise(source)


def rules(m: Column) -> dict[str, Column]:
    """Failures of a measured document, by rule."""
    return {
        "base": (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
        "symbols": 5 * m["n_symbols"] > m["word_chars"],
        "lines": 3 * m["n_dup_lines"] > m["n_words"],
    }


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns __host and __m (struct of MEASURES)."""
    return docs.select("*", host_of(F.col("source")).alias("__host"), measures(F.col("text")).alias("__m"))


def rejected_hosts(scored: DataFrame) -> DataFrame:
    """Hosts to reject, from measured documents: one row for each, column __bad_host, null-safe to join.

    Shrunk rate of a rule: (failures + a) / (documents + a + b), where a and b
    are fitted by moments to the rates of all hosts.
    """
    names = list(rules(F.col("__m")))
    fails = [F.sum(c.cast("long")).alias(n) for n, c in rules(F.col("__m")).items()]
    hosts = stored(scored.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), *fails))
    moments = hosts.agg(*(f(F.col(n) / F.col("n")).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    bad = F.lit(False)
    for n in names:
        mean, var = moments[f"mean_{n}"] or 0.0, moments[f"var_{n}"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if var else PRIOR_WEIGHT[0]
        bad |= (F.col(n) + mean * weight) / (F.col("n") + weight) > MAX_HOST_RATE
    return hosts.filter(bad).select(F.col("__host").alias("__bad_host"), F.lit(True).alias("__bad"))


def judged(scored: DataFrame, hosts: DataFrame) -> DataFrame:
    """Measured documents with base_failed and kept."""
    joined = scored.join(small(hosts), F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    failed = rules(F.col("__m"))["base"]
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("__bad").isNull()).drop("__bad_host", "__bad")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scored = stored(measured(docs).drop("text", "source"))
    return judged(scored, rejected_hosts(scored)).select("doc_id", *(F.col("__m")[m].alias(m) for m in MEASURES), "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The texts are measured once and stored with their measures for the second pass, after the host counts.
    """
    scored = stored(measured(docs))
    return judged(scored, rejected_hosts(scored)).filter("kept").select(*docs.columns)
