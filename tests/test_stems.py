"""Spanish stems against published examples and a plain version of the algorithm."""

import re

from pyspark.sql import functions as F

from lodeleaf.functions import keywords as kw
from lodeleaf.functions import stems as st

#: From the published sample vocabulary.
SAMPLE = """cheposo chepos chequeo cheque cheyene cheyen chica chic chicago chicag chicharrones chicharron chicas chic chihuahua chihuahu torá tor tórax torax torcer torc toreado tor toreados tor
toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment tormentas torment tornado torn tornar torn tornen torn torneo torne tornillo tornill torno torn""".split()
WORDS = """dándoselo comprándoselas huyendo huyéndole construyendo constituyeron averigüen averigüe paguemos pague llegué seguéis guerra rápidamente activamente nativamente relativamente ansiosamente públicamente
facilidad facilidades habilidad responsabilidad electricidad festividad nativas negativo relativos vendamos amablemente posiblemente elegantemente biología biologías evolución evoluciones contribución presencia presencias
publicadora publicación publicaciones accion aficiones estancias importante abundancia amiento casamiento vencimientos rojizos cantaríamos comeremos viviríais cantábamos fuésemos dijésemos áureo oliva trabajo macho
a y sí oh ñu x9 9 año uu aeiou guau gu gue qué lo sela irselo decírmelo decirselo yendo cayendo argüyendo leyó oyes eché é á os e fe té ß 𝄞é""".split()


def plain(w):
    v = st.VOWELS

    def after(p, w, at=0):
        m = re.compile(p).match(w[at:])
        return at + m.end() if m else len(w)

    r1 = after(f".*?[{v}][^{v}]", w)
    r2 = after(f".*?[{v}][^{v}]", w, r1)
    rv = len(w)
    if len(w) > 1:
        if w[1] not in v:
            rv = after(f"..[^{v}]*[{v}]", w)
        elif w[0] in v:
            rv = after(f"..[{v}]*[^{v}]", w)
        elif len(w) > 2:
            rv = 3
    bare = lambda x: x.translate(str.maketrans("áéíóú", "aeiou"))
    longest = lambda w, ends: next((e for e in sorted(ends, key=len, reverse=True) if w.endswith(e)), "")
    cut = lambda w, e: w[: len(w) - len(e)]

    def drop(w, region, *ends):
        e = longest(w, ends)
        return cut(w, e) if e and len(w) - len(e) >= region else w

    if p := longest(w, st.PRONOUNS):
        base = cut(w, p)
        e = longest(base, st.BEFORE_PRONOUNS)
        if e and len(base) - len(e) >= rv and (e != "yendo" or base.endswith("uyendo")):
            w = cut(base, e) + bare(e)
    before, s = w, longest(w, st.STANDARD)
    c = cut(w, s)
    if s == "amente":
        if len(c) >= r1:
            w = c
            if c.endswith("iv"):
                w = drop(c, r2, "iv")
                w = drop(w, r2, "at") if w != c else w
            else:
                w = drop(c, r2, "os", "ic", "ad")
    elif s and len(c) >= r2:
        if s in st.PLAIN:
            w = c
        elif s in st.AFTER_IC:
            w = drop(c, r2, "ic")
        elif s in (*st.LOGY, *st.UTION, *st.ENCE):
            w = c + ("log" if s in st.LOGY else "u" if s in st.UTION else "ente")
        elif s == "mente":
            w = drop(c, r2, "ante", "able", "ible")
        else:
            w = drop(c, r2, "abil", "ic", "iv") if s in st.IDAD else drop(c, r2, "at")
    if w == before:
        y, e = longest(w[rv:], st.Y_VERBS), longest(w[rv:], (*st.GU_VERBS, *st.VERBS))
        if y and cut(w, y).endswith("u"):
            w = cut(w, y)
        elif e:
            w = cut(w, e)
            w = w[:-1] if e in st.GU_VERBS and w.endswith("gu") else w
    e = longest(w, st.RESIDUES)
    if e and len(w) - len(e) >= rv:
        w = cut(w, e)
        if e in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return bare(w)


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in [*SAMPLE[::2], *WORDS, "", None]], "w string")
    got = {r["w"]: r["s"] for r in rows.select("w", st.spanish_stem(F.col("w")).alias("s")).collect()}
    assert [got[w] for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert {w: s for w, s in got.items() if w is not None} == {w: plain(w) for w in got if w is not None} and got[None] is None


def test_stems_in_expanded_questions(spark):
    text = F.lit("Las facturas de la facturación, ¿están listas?")
    row = spark.range(1).select(st.stems(text).alias("s"), kw.expanded(text, st.stems(text)).alias("e")).first()
    assert row["s"] == ["las", "factur", "estan", "list"] and " las factur estan list" in row["e"]
