"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodeleaf.config import KeywordConfig, Settings, effective
from lodeleaf.functions import keywords as kw
from lodeleaf.functions import paths as ps
from lodeleaf.functions import tables as tb
from lodeleaf.functions import text as tx

CONFIG = KeywordConfig(("que", "como", "el", "la", "del", "cada", "para"), {"disco": ("unidad", "drive")}, ("clon",))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("¿Qué es el PNM-P01?", ["pnm-p01"]),
        ("Cómo limpiar el disco", ["limpiar", "disco"]),
        ("la caja del cajero", ["cajero"]),
        ("ocmo limpiar", ["limpiar"]),
        ("instala instalacion", ["instalacion"]),
        ("alfa bravo charlie delta echo foxtrot golf disco", ["disco", "charlie", "foxtrot", "bravo", "delta", "alfa", "echo"]),
        ("", []),
    ],
)
def test_keywords(spark, question, expected):
    assert value(spark, kw.keywords(F.lit(question), CONFIG)) == expected


def test_keywords_in_order(spark):
    found = value(spark, kw.keywords(F.lit("alfa bravo charlie delta echo foxtrot golf disco"), CONFIG, by_length=False))
    assert found == ["alfa", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]


@pytest.mark.parametrize(
    ("f", "word", "expected"),
    [
        (kw.core_forms, "claves", {"claves", "clave", "clav"}),
        (kw.core_forms, "sas", {"sas"}),
        (lambda c: kw.all_forms(c, CONFIG), "discos", {"discos", "disco", "disc", "unidad", "drive"}),
        (lambda c: kw.all_forms(c, CONFIG), "pnm-p01", {"pnm-p01", "pnm-p0", "pnm", "p01"}),
        (kw.infinitives, "configuramos", {"configurar"}),
        (kw.infinitives, "configuro", {"configurar", "configurer", "configurir"}),
        (kw.infinitives, "abre", set()),
        (kw.nominalisations, "borrar", {"borracion", "borraciones", "borrador", "borradora", "borradoras", "borradores", "borramiento", "borramientos"}),
        (ps.path_tokens, "tec/SmartPayout-instalación.pdf", {"tec", "smartpayout", "smart", "payout", "instalacion", "instalaci", "pdf"}),
    ],
)
def test_forms(spark, f, word, expected):
    assert set(value(spark, f(F.lit(word)))) == expected


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (tx.strip_accents(F.lit("Configuración ñÑ ü")), "Configuracion nN u"),
        (tx.without_images(F.lit("a [DESCRIPCIÓN DE IMAGEN (img 1)]: panel.] b")), "a  b"),
        (tx.without_images(F.lit("a [IMAGEN (img 2)]: sin descripción disponible. b")), "a  b"),
        (tx.clean_chunk(F.lit("x" * 60 + ".]\n\nreal")), "real"),
        (tx.greeting(F.lit("Hola!")), "saludo"),
        (tx.greeting(F.lit("muchas gracias, genial")), "gracias"),
        (tx.greeting(F.lit("Hasta luego.")), "despedida"),
        (tx.greeting(F.lit("Hola, qué color tiene el cielo?")), None),
        (tx.asks_for_documents(F.lit("¿Tenemos manuales para la ruleta?")), True),
        (tx.asks_for_documents(F.lit("¿Cómo se instala la ruleta?")), False),
        (tx.answer_found(F.lit("No tengo información sobre eso.")), False),
        (tx.answer_found(F.lit("No tengo información. Sin embargo, puedo indicar el manual.")), True),
        (tx.clarification(F.lit("[ACLARACIÓN] Precisa más.")), (True, "Precisa más.")),
        (tx.case_variants(F.lit("pnm-p01")), ["pnm-p01", "Pnm-P01", "PNM-P01"]),
        (tx.useful_ratio(F.lit("")), 1.0),
        (tx.caption_is_empty(F.lit("corto")), True),
        (ps.clean_path(F.lit("/a//b/./c/../d/")), "/a/b/d"),
        (ps.source_key(F.lit("/srv/docs/docs-x/a.md"), ("docs",)), "docs-x/a.md"),
        (ps.query_paths(F.lit(" a/b , ,c ")), ["a/b", "c"]),
        (tb.table_markdown(F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("1"), F.lit(None)), F.array(F.lit(""), F.lit("")))), "A | B\n--- | ---\n1 | "),
        (tb.table_markdown(F.array(F.array(F.lit(""), F.lit("")), F.array(F.lit("x"), F.lit("y")))), "Columna 1 | Columna 2\n--- | ---\nx | y"),
    ],
)
def test_values(spark, column, expected):
    assert value(spark, column) == expected


def test_settings():
    assert Settings().overlay({"k": 5, "unknown": 1}, {"k": 7}).k == 7
    assert effective([{"A": "1", "API_KEY": "x"}, {"A": "2"}]) == {"A": "2"}
