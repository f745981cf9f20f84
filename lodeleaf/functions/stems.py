"""Snowball's stemmer for Spanish as column expressions.

A suffix is looked for as the longest that the word ends with; a pattern that is tied to the end finds it, since the
leftmost match is the longest. Regions are numbers of characters that come before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeleaf.functions.text import let, normalised, words

# Vowels, endings and what may precede them, as the published algorithm lists them.
VOWELS = "aeiouáéíóúü"
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
BEFORE_PRONOUNS = ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo")
PLAIN = (
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas",
    "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos",
)
AFTER_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias", "acion")
LOGY, UTION, ENCE = ("logía", "logías"), ("ución", "uciones", "ucion"), ("encia", "encias")
IDAD, IVO = ("idad", "idades"), ("iva", "ivo", "ivas", "ivos")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
GU_VERBS = ("en", "es", "éis", "emos")
VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis",
    "eríamos", "eremos", "erá", "eré", "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía",
    "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando",
    "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís", "áis", "abais", "íais", "arais", "ierais", "aseis",
    "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)
RESIDUES = ("os", "a", "o", "á", "í", "ó", "e", "é")
STANDARD = (*PLAIN, *AFTER_IC, *LOGY, *UTION, *ENCE, "amente", "mente", *IDAD, *IVO)
ACUTE, BARE = "áéíóú", "aeiou"

#: Patterns up to the regions R1 (again from there: R2) and RV.
TO_R1 = f"^.*?[{VOWELS}][^{VOWELS}]"
TO_RV = f"^(?:.[^{VOWELS}].*?[{VOWELS}]|[{VOWELS}]{{2}}.*?[^{VOWELS}]|[^{VOWELS}][{VOWELS}].)"


def ending(*suffixes: str) -> str:
    return f"(?:{'|'.join(suffixes)})$"


def suffix(word: Column, *suffixes: str) -> Column:
    """The longest of the suffixes that the word ends with, or an empty string."""
    return F.regexp_extract(word, ending(*suffixes), 0)


def without(word: Column, end: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - F.length(end))


def upto(word: Column, pattern: str) -> Column:
    """Characters up to the end of the pattern, all if it does not occur."""
    return let(F.length(F.regexp_extract(word, pattern, 0)), lambda n: F.when(n == 0, F.length(word)).otherwise(n))


def dropped(word: Column, region: Column, *suffixes: str) -> Column:
    """The word without the longest of the suffixes, if that lies in the region."""
    return let(suffix(word, *suffixes), lambda s: F.when((s != "") & (F.length(word) - F.length(s) >= region), without(word, s)).otherwise(word))


def without_pronoun(w: Column, rv: Column) -> Column:
    """Step 0."""

    def cut(base: Column) -> Column:
        def verb(v: Column) -> Column:
            fits = (v != "") & (F.length(base) - F.length(v) >= rv) & ((v != "yendo") | base.endswith("uyendo"))
            return F.when(fits, F.concat(without(base, v), F.translate(v, ACUTE, BARE))).otherwise(w)

        return let(suffix(base, *BEFORE_PRONOUNS), verb)

    return let(suffix(w, *PRONOUNS), lambda p: F.when(p == "", w).otherwise(let(without(w, p), cut)))


def without_standard(w: Column, r1: Column, r2: Column) -> Column:
    """Step 1; the word as it was if nothing applies."""

    def adverb(c: Column) -> Column:
        iv = let(dropped(c, r2, "iv"), lambda d: F.when(F.length(d) < F.length(c), dropped(d, r2, "at")).otherwise(c))
        return F.when(c.endswith("iv"), iv).otherwise(dropped(c, r2, "os", "ic", "ad"))

    def applied(s: Column) -> Column:
        c, inside = without(w, s), F.length(w) - F.length(s) >= r2
        # One computation of the stem serves all rules.
        by_rule = lambda c: (
            F.when(s == "amente", F.when(F.length(c) >= r1, adverb(c)).otherwise(w))
            .when(~inside, w)
            .when(s.isin(*PLAIN), c)
            .when(s.isin(*AFTER_IC), dropped(c, r2, "ic"))
            .when(s.isin(*LOGY), F.concat(c, F.lit("log")))
            .when(s.isin(*UTION), F.concat(c, F.lit("u")))
            .when(s.isin(*ENCE), F.concat(c, F.lit("ente")))
            .when(s == "mente", dropped(c, r2, "ante", "able", "ible"))
            .when(s.isin(*IDAD), dropped(c, r2, "abil", "ic", "iv"))
            .otherwise(dropped(c, r2, "at"))
        )
        return F.when(s == "", w).otherwise(let(c, by_rule))

    return let(suffix(w, *STANDARD), applied)


def without_verb(w: Column, rv: Column) -> Column:
    """Steps 2a and 2b."""
    region = F.substr(w, rv + 1)

    def y_verb(s: Column) -> Column:
        return F.when((s != "") & without(w, s).endswith("u"), without(w, s)).otherwise(let(suffix(region, *GU_VERBS, *VERBS), verb))

    def verb(s: Column) -> Column:
        bare = lambda c: F.when(s.isin(*GU_VERBS) & c.endswith("gu"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
        return F.when(s == "", w).otherwise(let(without(w, s), bare))

    return let(suffix(region, *Y_VERBS), y_verb)


def without_residue(w: Column, rv: Column) -> Column:
    """Step 3."""

    def cut(s: Column) -> Column:
        bare = lambda c: F.when(s.isin("e", "é") & c.endswith("gu") & (F.length(c) - 1 >= rv), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
        return F.when((s != "") & (F.length(w) - F.length(s) >= rv), let(without(w, s), bare)).otherwise(w)

    return let(suffix(w, *RESIDUES), cut)


def spanish_stem(word: Column) -> Column:
    """The stem of a lower-case word; null for null."""

    def regions(w: Column) -> Column:
        r1 = upto(w, TO_R1)
        return let(F.struct(r1.alias("r1"), (r1 + upto(F.substr(w, r1 + 1), TO_R1)).alias("r2"), upto(w, TO_RV).alias("rv")), lambda r: steps(w, r))

    def steps(w: Column, r: Column) -> Column:
        def standard(a: Column) -> Column:
            return let(without_standard(a, r["r1"], r["r2"]), lambda b: F.when(b != a, b).otherwise(without_verb(a, r["rv"])))

        stem = let(let(without_pronoun(w, r["rv"]), standard), lambda c: without_residue(c, r["rv"]))
        return F.translate(stem, ACUTE, BARE)

    return let(word, regions)


def stems(text: Column, shortest: int = 3) -> Column:
    """Distinct stems of a text's words (lower case, without accents), in their order, of ``shortest`` letters or more."""
    return F.array_distinct(F.filter(F.transform(words(normalised(text)), spanish_stem), lambda s: F.length(s) >= shortest))
