"""Deletion neighbourhoods against comparison with each stopword."""

import random

from pyspark.sql import functions as F

from lodeleaf.config import KeywordConfig
from lodeleaf.functions import keywords as kw
from lodeleaf.operators import stopwords as sw


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abñ") for _ in range(r.randrange(1, 7))) for _ in range(n)]


def test_misspelled_equals_all_comparisons(spark):
    own, stop = sorted({*words(150, 1), "", "abba", "baba", "𝄞abb"}), sorted({*words(12, 2), "abab", "abb", ""})
    found = sw.misspelled(spark.createDataFrame([(w,) for w in [*own, None]], "word string"), spark.createDataFrame([(w,) for w in stop], "word string"))
    pairs = spark.createDataFrame([(w, s) for w in own for s in stop if len(w) >= 4], "w string, s string")
    want = pairs.filter(kw.one_edit_apart(F.col("w"), F.col("s"))).select("w").distinct()
    assert sorted(found.collect()) == sorted(want.collect()) and "abba" in {r["word"] for r in found.collect()}


def test_keywords_with_a_listed_table_equal_those_with_a_configured_list(spark):
    config = KeywordConfig(stopwords=("factura", "para", "ab-12", "cliente"))
    texts = ["La factrua del cliente AB-12 para facturas y cleinte", "Ñandú AB-13 paar", "", None, "factura"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "id long, text string, word string")
    listed = sw.stopped(rows, "text", spark.createDataFrame([(w,) for w in config.stopwords], "word string"))
    got = listed.select("id", kw.keywords(F.col("text"), config, stopped=(F.col("stop_exact"), F.col("stop_near"))).alias("k"))
    want = rows.select("id", kw.keywords(F.col("text"), config).alias("k"))
    assert sorted(got.collect()) == sorted(want.collect())
