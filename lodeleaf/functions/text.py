"""Column functions on text: normalisation, tokens, markers, classifiers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folding() -> tuple[str, str]:
    """Precomposed lower-case and upper-case letters and what is left of them without marks, where that is one character."""
    pairs = [(chr(i), "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def strip_accents(text: Column) -> Column:
    """Accents off precomposed Latin letters."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, ACCENTED, PLAIN))


def normalised(text: Column) -> Column:
    return strip_accents(F.lower(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends, which are looked at first."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct words of three letters or more in lower case, accents kept: the unit of duplicate detection."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{3,}"), F.lit(0)))


def compound_codes(text: Column) -> Column:
    """Codes with hyphens such as AB-12."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)\b[a-z0-9]{2,}(?:-[a-z0-9]{1,})+\b"), F.lit(0))


# Patterns of image markers in chunks.
IMAGE_BLOCK = r"(?isu)\[DESCRIPCI[ÓO]N DE IMAGEN[^\]]*\]:?\s*.*?\.\]"
IMAGE_BARE = r"(?iu)\[IMAGEN[^\]]*\]:?\s*sin descripción disponible\."
IMAGE_ORPHAN = r"(?s)(?:(?<=\n\n)|(?<=\A))[^\n](?:(?!\n\n).){49,}?\.\](?=\s*\n|\s*\z)"


def without_images(text: Column) -> Column:
    """Without descriptions of images: whole blocks, bare markers, and bodies cut off from their marker. All of them hold a closing bracket."""
    return F.when(F.contains(text, F.lit("]")), reduce(lambda t, p: F.regexp_replace(t, p, ""), (IMAGE_BLOCK, IMAGE_BARE, IMAGE_ORPHAN), text)).otherwise(text)


def clean_chunk(text: Column) -> Column:
    """What of a chunk goes into a context."""
    return strip(F.regexp_replace(without_images(text), r"\n{3,}", "\n\n"))


def useful_ratio(text: Column) -> Column:
    """Share of a chunk that is no image description; 1 for an empty one."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.length(strip(without_images(text))) / F.length(text))


# Patterns of short social messages; the first that matches names the class.
GREETINGS = (
    (r"^\s*(hola|hey|buenas?|buenos?\s*(dias?|tardes?|noches?)|buenas?\s*(dias?|tardes?|noches?)|hola[,;]?\s*(buenas?\s*(tardes?|noches?|dias?)?)?|que\s*tal|saludos?|hi|hello|buenas?\s*tardes?|buenas?\s*noches?|buenas?\s*dias?)\s*[,;]?\s*(NAME)?\s*[.!?]*\s*$", "saludo"),
    (r"^\s*(gracias|muchas\s*gracias|te\s*agradezco|thanks|thank\s*you)[\s,;!.?]*(genial|perfecto|excelente|estupendo|fenomenal|muy\s*bien|ok|guay|chevere|de\s*acuerdo|entendido|fantástico|fantastico|super|buenisimo|buenísimo|maravilloso)?\s*(NAME)?\s*[!.?]*\s*$", "gracias"),
    (r"^\s*(adios|chao|chau|hasta\s*luego|nos\s*vemos|bye|hasta\s*pronto)\s*[,;]?\s*(NAME)?\s*[.!?]*\s*$", "despedida"),
)
# Patterns of questions for lists of documents.
DOCUMENT_SEARCHES = (
    r"\b(tenemos?|hay|existen?|disponemos\s+de|tienes?|tienen)\b.{0,50}\b(manual|manuales|documento|documentos|nota[s]?\s*t[eé]cnica[s]?|ficha[s]?|gu[íi]a[s]?|informacion|info|documentacion)\b",
    r"\b(qu[eé]|cu[aá]les?)\s+(manuales?|documentos?|notas?\s+t[eé]cnicas?|fichas?|gu[íi]as?|informacion|info|documentacion)\s+(tenemos|hay|existen?|disponemos)\b",
    r"\b(busca[r]?|lista[r]?|muestra[r]?|dame|d[aá]me)\s+(los?\s+|la[s]?\s+)?(manuales?|documentos?|notas?\s+t[eé]cnicas?|gu[íi]as?|informacion|info|documentacion)\b",
    r"^.{0,30}\b(manuales?|documentos?|notas?\s+t[eé]cnicas?|informacion|info|documentacion)\s+(para|de|sobre|del?)\b",
    r"\b(tenemos?|hay|existen?)\b.{0,40}\b(documentaci[oó]n|informacion|info)\b",
)
# Patterns of answers that say there is no information, and of offers that make such an answer useful.
NO_INFORMATION = (
    r"no\s+(se\s+)?(encuentra|encontr[ée]|encuentro|hall[aoó])\s+informaci[oó]n",
    r"no\s+(tengo|tenemos|tiene|tienen)\s+(la\s+)?informaci[oó]n",
    r"no\s+(dispongo|disponemos|dispone)\s+de\s+informaci[oó]n",
    r"no\s+(dispongo|disponemos|dispone)\b.{0,80}\b(nota|documento|manual|informaci[oó]n|datos|contexto)",
    r"no\s+(hay|existe)\s+informaci[oó]n",
    r"no\s+(tengo|tenemos|tiene)\s+(los\s+)?datos",
    r"no\s+(cuento|contamos|cuenta)\s+con\s+informaci[oó]n",
    r"no\s+tengo\s+ningun[ao]",
    r"no\s+(se\s+)?(encuentra|encontr[ée]|encuentro)\b.*\binformaci[oó]n",
    r"no\s+(poseo|poseemos)\s+informaci[oó]n",
    r"no\s+figura\b.*\binformaci[oó]n",
    r"la\s+informaci[oó]n\s+(no\s+)?(est[aá]|se\s+encuentra)\s+disponible",
    r"no\s+(incluye|incluyen|contiene|contienen)\b.{0,60}\b(nota|documento|manual|informaci[oó]n)",
)
ALTERNATIVES = (
    r"la\s+informaci[oó]n\s+(disponible|que\s+tengo|que\s+tenemos)\s+se\s+(centra|enfoca|refiere)",
    r"(sin\s+embargo|no\s+obstante|ahora\s+bien)[,;]?\s+.{5,}",
    r"lo\s+que\s+s[ií]\s+(tengo|tenemos|hay|encuentro|est[aá]\s+disponible)",
    r"(puedo|podemos)\s+(indicar|ofrecer|mencionar|sugerir)",
    r"s[ií]\s+(tengo|tenemos|hay|existe[n]?|encuentro)\s+.{3,60}\b(relacionad[oa]s?|disponibles?)",
    r"se\s+(centra|enfoca|refiere)\s+(en|a)\b",
)
# Fixed value: the mark of answers that ask back.
CLARIFICATION = r"^\s*\[ACLARACI[OÓ]N\]\s*"
# Patterns of captions without content, and of phrases put before a caption.
EMPTY_CAPTIONS = (
    r"requiere?\s+m[aá]s\s+contexto",
    r"interpretaci[oó]n\s+precisa",
    r"no\s+(es\s+)?posible\s+determinar",
    r"no\s+se\s+puede\s+(determinar|identificar|interpretar)",
    r"no\s+puedo\s+(describir|determinar|identificar)",
    r"sin\s+contexto\s+adicional",
    r"no\s+tengo\s+suficiente",
    r"no\s+es\s+posible\s+proporcionar",
    r"imagen\s+decorativa",
    r"no\s+aporta\s+informaci[oó]n",
    r"dif[ií]cil\s+de\s+determinar",
    r"no\s+contiene\s+informaci[oó]n\s+t[eé]cnica",
    r"formas?\s+(irregulares?|abstractas?|simples?)",
    r"simplicidad\s+de\s+las?\s+formas",
    r"\blogo(tipo)?\b",
    r"\bemblem[ae]\b",
    r"\bmarca\s+(corporativa|comercial|registrada)",
    r"\biso(tipo|logotipo)?\b",
    r"imagen\s+(?:muestra\s+)?(?:un|el|una)\s+logo",
    r"(?:letras?|texto)\s+.{0,40}\s+(?:sobre\s+fondo|en\s+blanco|en\s+negro)",
    r"(?:completamente|totalmente|enteramente)\s+(negro|blanca?|oscuro|vac[ií]o)",
    r"sin\s+detalles?\s+(ni\s+objetos?\s+visibles?|visibles?)",
    r"fondo\s+(completamente\s+)?(negro|blanco|oscuro|vac[ií]o)",
    r"recuadro\s+(completamente\s+)?(negro|blanco|vac[ií]o)",
    r"no\s+(hay|se\s+ven?)\s+(detalles?|objetos?|contenido|elementos?)\s+visibles?",
    r"imagen\s+(en\s+)?(blanco|negro)\s+(?:y\s+negro\s+)?sin\s+",
)
CAPTION_PREAMBLE = r"^[\s\"']*(?:claro[,\.]?\s*|por\s+supuesto[,\.]?\s*|aqu[ií]\s+tienes?\s+[^:]{0,60}:\s*|a\s+continuaci[oó]n\s+[^:]{0,60}:\s*|esta\s+es\s+[^:]{0,60}:\s*|descripci[oó]n\s+(?:breve\s+)?(?:de\s+la\s+imagen\s*)?[:\-]\s*)*[\s\"']*"


def any_match(text: Column, patterns: tuple[str, ...], flags: str = "(?iuUd)") -> Column:
    """Whether any pattern occurs; by default case and Unicode as in most engines, a dot matches all but line feeds."""
    return reduce(lambda a, b: a | b, (text.rlike(flags + p) for p in patterns))


def named(pattern: str, name: str) -> str:
    """A pattern with the assistant's name."""
    return pattern.replace("(NAME)", f"({re.escape(name)})")


def greeting(text: Column, longest: int = 60, name: str = "") -> Column:
    """Class of a short social message, which may call the assistant by name, else null."""
    norm = strip(normalised(text))
    return let(norm, lambda t: F.when(F.length(t) <= longest, F.coalesce(*(F.when(t.rlike("(?iuUd)" + named(p, name)), F.lit(kind)) for p, kind in GREETINGS))))


def asks_for_documents(text: Column) -> Column:
    return let(strip(normalised(text)), lambda t: any_match(t, DOCUMENT_SEARCHES))


def answer_found(text: Column) -> Column:
    """False if an answer says it has no information and offers nothing else."""
    return let(F.lower(text), lambda t: ~any_match(t, NO_INFORMATION) | any_match(t, ALTERNATIVES))


def clarification(text: Column) -> Column:
    """Struct of asks (the answer asks back) and text without the mark."""
    pattern = "(?iu)" + CLARIFICATION
    asks = text.rlike(pattern)
    return F.struct(asks.alias("asks"), F.when(asks, strip(F.regexp_replace(text, pattern, ""))).otherwise(text).alias("text"))


def caption_without_preamble(text: Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(text, "(?iu)" + CAPTION_PREAMBLE, "")), r"^:+", ""))


def caption_is_empty(text: Column) -> Column:
    return (F.length(strip(text)) < 40) | any_match(text, EMPTY_CAPTIONS, "(?iu)")


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Every letter run with a capital first, also after digits and hyphens, which initcap doesn't do."""
    return text.str.title()


def case_variants(text: Column) -> Column:
    return F.array_distinct(F.array(text, F.lower(text), title_case(text), F.upper(text)))


def source_label(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit(" (fragmento: "), F.regexp_replace(F.substring(text, 1, 150), "\n", " "), F.lit("...)"))


def prompt(system: str, context: Column, conversation: Column, question: Column) -> Column:
    block = F.when(F.length(conversation) > 0, F.concat(F.lit("Conversación:\n"), conversation, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(system + "\n\n"), block, F.lit("Contexto:\n"), context, F.lit("\n\nPregunta:\n"), question, F.lit("\n\nRespuesta:"))


def page_number(chunk: Column) -> Column:
    """The page of the last page marker in a chunk; null without one."""
    return F.try_element_at(F.regexp_extract_all(chunk, F.lit(r"\[__PÁG(\d+)__\]"), F.lit(1)), F.lit(-1)).try_cast("int")


def usage(counts: Column) -> Column:
    """A map of token counts without those that are unknown."""
    return F.map_filter(counts, lambda _, v: v.isNotNull())
