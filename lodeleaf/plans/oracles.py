"""DuckDB SQL that says the same as the registered queries."""

from __future__ import annotations

from lodeleaf.functions import keywords as kw
from lodeleaf.functions import paths as ps
from lodeleaf.functions import stems as st
from lodeleaf.functions import text as tx
from lodeleaf.operators.catalog import CONTENT_CHARS
from lodeleaf.plans.tables import CONFIG, STOPWORDS

WORDS = r"[\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return f"[{', '.join(map(text, values))}]::VARCHAR[]"


def in_order(values: str) -> str:
    """Distinct values of a list in their order."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def any_of(value: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, {text(p)}, 'i')" for p in patterns) + ")"


def norm(value: str) -> str:
    return f"strip_accents(lower({value}))"


def one_byte(value: str) -> str:
    """Letters without accents that take two bytes as one, since damerau_levenshtein counts bytes."""
    return f"translate({value}, 'ßæœøłđðþ', '#$%&*+,;')"


def trimmed(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


CODE = text(r"(?i)\b[a-z0-9]{2,}(?:-[a-z0-9]{1,})+\b")
CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text, lang || '/' || source || '/doc' || (doc_id % 10) || '.md' AS source, sha1(text) AS source_hash FROM documents)"
INDEXED = "indexed AS (SELECT *, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS chunk_index FROM (SELECT doc_id, text AS body, lang || '/' || source || '/doc' || doc_id || '.md' AS source, sha1(text) AS source_hash FROM documents))"
DETAILS = f"""{INDEXED}, cut AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {CONTENT_CHARS} AS part FROM indexed),
details AS (SELECT doc_id, source, part, count(*) AS chunks, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) FILTER (text <> ''), '')) AS content_md5 FROM cut GROUP BY doc_id, source, part)"""
ASKED = "asked AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"
FIRST_WORDS = "list_concat(regexp_extract_all(lower(text), '[a-z]{4,}'), ['texto', 'texto', 'texto', 'texto', 'texto'])"
NAMED_CHUNKS = f"""first_words AS (SELECT *, {FIRST_WORDS} AS w FROM documents),
chunks AS (SELECT doc_id AS chunk_id, text || chr(10) || w[4] || '-' || w[5] AS text, lang || '/' || source || '/' || upper(w[1][1]) || w[1][2:] || upper(w[2][1]) || w[2][2:] || '-' || w[3] || '.md' AS source FROM first_words)"""
NAMED_ASKED = "asked AS (SELECT doc_id AS qid, w[1] || ' ' || w[2] || ' ' || w[3] || 's ' || source || ' ' || w[4] || '-' || w[5] AS question FROM first_words WHERE doc_id % 50 = 0)"
TURNS = "asked AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')"


def keywords(keys: str, lists: bool = False) -> str:
    """CTEs from asked(keys, question) to kw(keys, in_order, found). With lists, asked has stopwords and misspelled ones as arrays too."""
    stop = "stops" if lists else array(CONFIG.stopwords)
    near = "list_contains(nears, w)" if lists else f"len(list_filter({stop}, lambda s: damerau_levenshtein(w, s) <= 1)) > 0"
    codes = in_order(f"list_transform(regexp_extract_all(norm, {CODE}), lambda c: lower(c))")
    tokens = f"list_filter(regexp_extract_all(norm, '{WORDS}+'), lambda w: length(w) >= 3)"
    return f"""
k0 AS (SELECT *, {norm('question')} AS norm FROM asked),
k1 AS (SELECT *, list_filter({codes}, lambda c: NOT list_contains({stop}, c)) AS codes, {tokens} AS words FROM k0),
k2 AS (SELECT *, list_concat(codes, flatten(list_transform(codes, lambda c: string_split(c, '-')))) AS seen, {in_order('words')} AS own FROM k1),
k3 AS (SELECT *, list_concat(codes, list_filter(own, lambda w: NOT list_contains(seen, w) AND NOT list_contains({stop}, w)
    AND (length(w) < 4 OR NOT {near}))) AS every FROM k2),
k4 AS (SELECT *, list_filter(every, lambda w: len(list_filter(every, lambda o: length(o) > length(w) AND contains(o, w))) = 0) AS kept FROM k3),
kw AS (SELECT {keys}, kept[1:7] AS in_order, CASE WHEN len(kept) <= 7 THEN kept ELSE list_transform(list_sort(list_transform(kept, lambda w, i:
    {{'k': -(length(w) + CASE WHEN list_contains({array(CONFIG.synonyms)}, w) THEN 3 ELSE 0 END), 'i': i, 'w': w}}))[1:7], lambda x: x.w) END AS found FROM k4)"""


def core(k: str) -> str:
    n = f"length({k})"
    return f"""list_filter([{k}, CASE WHEN {n} >= 5 THEN substr({k}, 1, {n} - 1) END, CASE WHEN suffix({k}, 'es') AND {n} >= 6 THEN substr({k}, 1, {n} - 2) END,
        CASE WHEN (suffix({k}, 'os') OR suffix({k}, 'as')) AND {n} >= 5 THEN substr({k}, 1, {n} - 2) END], lambda f: f IS NOT NULL AND length(f) >= 3)"""


def forms() -> str:
    """CTEs from kw_rows(..., keyword) to forms(..., keyword, core, forms, priority)."""
    cases = " ".join(f"WHEN {text(k)} THEN {array(v)}" for k, v in CONFIG.synonyms.items())
    return f"""
f0 AS (SELECT *, {core('keyword')} AS core FROM kw_rows),
forms AS (SELECT *, list_filter(list_concat(core, flatten(list_transform(list_concat([keyword], core), lambda k: CASE k {cases} ELSE []::VARCHAR[] END)),
    CASE WHEN contains(keyword, '-') THEN string_split(keyword, '-') ELSE []::VARCHAR[] END), lambda f: length(f) >= 2) AS forms, list_contains({array(CONFIG.priority)}, keyword) AS priority FROM f0)"""


ROWS = "kw_rows AS (SELECT qid, unnest(found) AS keyword, generate_subscripts(found, 1) AS pos FROM kw)"
held = lambda value, names: f"(len(list_filter({names}, lambda f: contains({value}, f))) > 0)"
FEATURES = f"{CHUNKS}, {ASKED}, {keywords('qid')}, {ROWS}, {forms()}"
MATCHES = f"""{FEATURES},
low AS (SELECT chunk_id, source, text, {norm('text')} AS low, {norm('source')} AS path, length({trimmed('text')}) AS useful_chars, length({trimmed('text')}) / length(text) AS useful FROM chunks),
n AS (SELECT qid, count(*) AS n FROM kw_rows GROUP BY qid),
matches AS (SELECT qid, chunk_id, any_value(source) AS source, any_value(text) AS text, any_value(useful) AS useful, any_value(useful_chars) AS useful_chars, count(*) FILTER ({held('low', 'forms')}) AS m, count(*) FILTER ({held('path', 'forms')}) AS p,
    sum(CASE WHEN {held('low', 'core')} THEN 1.0 WHEN {held('low', 'forms')} THEN 0.5 ELSE 0 END)::DOUBLE AS quality, count(*) FILTER (priority AND {held('path', 'forms')}) AS priority
    FROM forms, low GROUP BY qid, chunk_id HAVING m + p > 0)"""
TOKEN_PARTS = "list_filter(flatten(list_transform(regexp_split_to_array(source, '[\\\\/]+'), lambda s: regexp_split_to_array(s, '[^a-zA-Z0-9áéíóúüñÁÉÍÓÚÜÑ]+'))), lambda p: p <> '')"
CAMEL = "regexp_extract_all(p, '[A-Z][a-z0-9]*|[a-z][a-z0-9]*|[0-9]+')"
TOKENS = f"""parts AS (SELECT source, {TOKEN_PARTS} AS parts FROM (SELECT DISTINCT source FROM chunks)),
path_tokens AS (SELECT source, list_distinct(list_filter(list_transform(list_concat(parts, flatten(list_transform(parts, lambda p: CASE WHEN len({CAMEL}) > 1 THEN {CAMEL} ELSE []::VARCHAR[] END))), lambda p: {norm('p')}), lambda p: length(p) >= 3)) AS tokens FROM parts),
token_index AS (SELECT source, unnest(tokens) AS token FROM path_tokens)"""
NAMED = f"""{TOKENS}, every_form AS (SELECT DISTINCT qid, pos, unnest(forms) AS form FROM forms), tokens AS (SELECT DISTINCT token FROM token_index),
own AS (SELECT qid, pos, form, token FROM every_form JOIN tokens ON form = token),
single AS (SELECT qid, pos, form, token FROM every_form e JOIN tokens ON token = substr(form, 1, length(form) - 1) WHERE suffix(form, 's') AND NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = e.qid AND o.form = e.form)),
pairs AS (SELECT qid, pos, keyword AS a, lead(keyword) OVER (PARTITION BY qid ORDER BY pos) AS b FROM kw_rows),
both_ways AS (SELECT qid, pos + 1000 AS pos, unnest([a || b, b || a]) AS form FROM pairs WHERE b IS NOT NULL),
exact AS (SELECT qid, token, min(pos * 1000000 + ascii(form)) AS o, min({{'p': pos, 'f': form}}) AS best FROM (FROM own UNION ALL FROM single UNION ALL SELECT qid, pos, form, form FROM both_ways JOIN tokens ON form = token) GROUP BY qid, token),
first12 AS (SELECT qid, token FROM exact QUALIFY row_number() OVER (PARTITION BY qid ORDER BY best, token) <= 12),
named AS (SELECT qid, token FROM first12 UNION SELECT DISTINCT qid, token FROM every_form JOIN tokens ON prefix(token, form) AND length(form) >= 5)"""
by_name = lambda sql: sql.replace(CHUNKS, NAMED_CHUNKS).replace(ASKED, NAMED_ASKED)
DISTINCT_WORDS = f"words AS (SELECT DISTINCT unnest(regexp_extract_all({norm('text')}, '{WORDS}+')) AS word FROM documents)"
VECTORS = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 50 = 0)"


def nearest(rows: str, k: int) -> str:
    return f"near AS (SELECT qid, chunk_id, list_distance(qvec, vec) ** 2 AS dist, row_number() OVER (PARTITION BY qid ORDER BY list_distance(qvec, vec), chunk_id) - 1 AS rank FROM q, ({rows}) QUALIFY rank < {k})"


def nouns() -> str:
    cases = " ".join(f"WHEN suffix(word, '{e}') THEN list_transform({array(s)}, lambda s: substr(word, 1, length(word) - 2) || s)" for e, s in kw.NOUN_ENDINGS.items())
    return f"list_sort(list_distinct(list_filter(CASE WHEN length(word) < 5 THEN [] {cases} ELSE [] END, lambda f: length(f) >= 5 AND f <> word)))"


def verbs() -> str:
    cases = " ".join(f"WHEN suffix(word, '{e}') THEN CASE WHEN length(word) - {len(e)} >= 2 THEN list_transform({array(t)}, lambda s: substr(word, 1, length(word) - {len(e)}) || s) ELSE [] END" for e, t in kw.VERB_ENDINGS)
    known = " OR ".join(f"suffix(word, '{e}')" for e in kw.NOUN_ENDINGS)
    return f"list_sort(list_filter(CASE WHEN length(word) < 5 OR {known} THEN [] {cases} ELSE [] END, lambda f: length(f) >= 4 AND f <> word))"


BLOCK, BARE = r"(?is)\[DESCRIPCI[ÓO]N DE IMAGEN[^\]]*\]:?\s*.*?\.\]", r"(?i)\[IMAGEN[^\]]*\]:?\s*sin descripción disponible\."
unmarked = lambda v: f"regexp_replace(regexp_replace({v}, {text(BLOCK)}, '', 'g'), {text(BARE)}, '', 'g')"
GREETED = " ".join(f"WHEN regexp_matches(t, {text(tx.named(p, ''))}, 'i') THEN '{k}'" for p, k in tx.GREETINGS)
SNAPSHOTS = """docs AS (SELECT d.*, l.quality, l.toxic, d.lang || '/doc' || d.doc_id || '.md' AS path FROM documents d LEFT JOIN labels l USING (doc_id)),
idx AS (SELECT path AS source, sha1(text) AS source_hash FROM docs),
disk AS (SELECT path AS source, sha1(CASE WHEN quality = 1 THEN reverse(text) ELSE text END) AS source_hash FROM docs WHERE coalesce(toxic, 0) = 0 AND NOT (toxic IS NULL AND lang = 'de')
    UNION ALL SELECT 'web/' || page_id || '.html', sha1(html) FROM pages),
hidden AS (SELECT path AS source FROM docs WHERE toxic = 1),
plan AS (SELECT coalesce(d.source, i.source) AS source, CASE WHEN i.source IS NULL THEN 'nuevo' WHEN d.source IS NULL THEN 'eliminado' ELSE 'modificado' END AS state
    FROM disk d FULL JOIN idx i ON d.source = i.source WHERE d.source_hash IS DISTINCT FROM i.source_hash UNION ALL SELECT source, 'oculto' FROM hidden)"""
CLEANED = trimmed(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")

def end_of(value: str, *suffixes: str) -> str:
    return f"regexp_extract({value}, '{st.ending(*suffixes)}')"


def cut(value: str, end: str) -> str:
    return f"left({value}, length({value}) - length({end}))"


def dropped(value: str, region: str, *suffixes: str) -> str:
    end = end_of(value, *suffixes)
    return f"CASE WHEN {end} <> '' AND length({value}) - length({end}) >= {region} THEN {cut(value, end)} ELSE {value} END"


def upto(value: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({value}, '{pattern}') THEN length(regexp_extract({value}, '{pattern}')) ELSE length({value}) END"


#: From words(word) to stems(word, stem).
STEMS = f"""s0 AS (SELECT word, word AS w, {upto('word', st.TO_R1)} AS r1, {upto('word', st.TO_RV)} AS rv FROM words),
s1 AS (SELECT *, r1 + {upto('substr(w, r1 + 1)', st.TO_R1)} AS r2, {end_of('w', *st.PRONOUNS)} AS pron FROM s0), s2 AS (SELECT *, {cut('w', 'pron')} AS base FROM s1), s3 AS (SELECT *, {end_of('base', *st.BEFORE_PRONOUNS)} AS v FROM s2),
s4 AS (SELECT *, CASE WHEN pron <> '' AND v <> '' AND length(base) - length(v) >= rv AND (v <> 'yendo' OR suffix(base, 'uyendo')) THEN {cut('base', 'v')} || translate(v, '{st.ACUTE}', '{st.BARE}') ELSE w END AS a FROM s3),
s5 AS (SELECT *, {end_of('a', *st.STANDARD)} AS s FROM s4), s6 AS (SELECT *, {cut('a', 's')} AS c FROM s5), s7 AS (SELECT *, {dropped('c', 'r2', 'iv')} AS civ, length(c) >= r2 AS inside FROM s6),
s8 AS (SELECT *, CASE WHEN s = '' THEN a WHEN s = 'amente' THEN CASE WHEN length(c) < r1 THEN a WHEN suffix(c, 'iv') THEN CASE WHEN length(civ) < length(c) THEN {dropped('civ', 'r2', 'at')} ELSE c END ELSE {dropped('c', 'r2', 'os', 'ic', 'ad')} END
    WHEN NOT inside THEN a WHEN list_contains({array(st.PLAIN)}, s) THEN c WHEN list_contains({array(st.AFTER_IC)}, s) THEN {dropped('c', 'r2', 'ic')} WHEN list_contains({array(st.LOGY)}, s) THEN c || 'log' WHEN list_contains({array(st.UTION)}, s) THEN c || 'u'
    WHEN list_contains({array(st.ENCE)}, s) THEN c || 'ente' WHEN s = 'mente' THEN {dropped('c', 'r2', 'ante', 'able', 'ible')} WHEN list_contains({array(st.IDAD)}, s) THEN {dropped('c', 'r2', 'abil', 'ic', 'iv')} ELSE {dropped('c', 'r2', 'at')} END AS b FROM s7),
s9 AS (SELECT *, {end_of('substr(a, rv + 1)', *st.Y_VERBS)} AS y, {end_of('substr(a, rv + 1)', *st.GU_VERBS, *st.VERBS)} AS e FROM s8), s10 AS (SELECT *, {cut('a', 'y')} AS cy, {cut('a', 'e')} AS ce FROM s9),
s11 AS (SELECT *, CASE WHEN b <> a THEN b WHEN y <> '' AND suffix(cy, 'u') THEN cy WHEN e = '' THEN a WHEN list_contains({array(st.GU_VERBS)}, e) AND suffix(ce, 'gu') THEN left(ce, length(ce) - 1) ELSE ce END AS d FROM s10),
s12 AS (SELECT *, {end_of('d', *st.RESIDUES)} AS t FROM s11), s13 AS (SELECT *, {cut('d', 't')} AS ct FROM s12),
stems AS (SELECT word, translate(CASE WHEN t = '' OR length(d) - length(t) < rv THEN d WHEN t IN ('e', 'é') AND suffix(ct, 'gu') AND length(ct) - 1 >= rv THEN left(ct, length(ct) - 1) ELSE ct END, '{st.ACUTE}', '{st.BARE}') AS stem FROM s13)"""
EXPANDED = f"""a AS (SELECT conv_id, turn, lower(trim(text)) AS low FROM conversations WHERE role = 'user'),
b AS (SELECT *, {norm('low')} AS base, regexp_extract_all({norm('low')}, '{WORDS}+') AS own FROM a),
c AS (SELECT *, flatten(list_transform(own, lambda word: {verbs()})) AS verbs, flatten(list_transform(own, lambda word: {nouns()})) AS nouns FROM b),
d AS (SELECT *, list_sort(list_distinct(list_filter(verbs, lambda v: NOT list_contains(own, v)))) AS v, list_sort(list_distinct(list_filter(nouns, lambda v: NOT list_contains(own, v)))) AS n FROM c)"""
CELLS = """a AS (SELECT conv_id, turn, list_transform(string_split(text, '. '), lambda r: string_split(r, ' ')) AS cells FROM conversations),
b AS (SELECT *, list_max(list_transform(cells, lambda r: len(r))) AS width FROM a),
c AS (SELECT *, list_transform(cells, lambda r: list_resize(list_transform(r, lambda c: trim(replace(c, chr(10), ' '))), width, '')) AS clean FROM b),
d AS (SELECT *, CASE WHEN array_to_string(clean[1], '') = '' THEN list_transform(range(1, width + 1), lambda i: 'Columna ' || i) ELSE clean[1] END AS head,
    list_filter(clean[2:], lambda r: array_to_string(r, '') <> '') AS body, list_resize(['']::VARCHAR[], width, '') AS nothing, list_resize(['---']::VARCHAR[], width, '---') AS rule FROM c)"""
#: Candidates: every chunk that matches, by id.
EVERY = f"""{MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) - 1 AS rank, CASE WHEN n <= 1 THEN 1 ELSE 2 END AS req FROM matches JOIN n USING (qid))"""
# Chunks in the order of choice, then one step of the recursion for each: taken unless five are, or a taken one is its twin.
#: Candidates: of the 150 nearest chunks of each question those that match.
RANKED = f"""{MATCHES}, q AS (SELECT qid, embedding::DOUBLE[] AS qvec FROM asked JOIN embeddings ON vec_id = qid // 1000), {nearest('SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings', 150)},
r AS (SELECT * EXCLUDE (dist), CASE WHEN n <= 1 THEN 1 ELSE 2 END AS req FROM matches JOIN near USING (qid, chunk_id) JOIN n USING (qid))"""
CHOSEN, EVERY_CHOSEN = (f"""{c.replace("chunks AS (", "RECURSIVE chunks AS (", 1)},
s AS (SELECT *, CASE WHEN m + p < req THEN false WHEN p > 0 THEN true ELSE m >= least(n, 3) END AS strong,
    5000 * p + 1000 * m + 500 * useful + 1500 * quality + 6000 * priority - rank - CASE WHEN p = 0 AND priority = 0 THEN 2000 ELSE 0 END AS score FROM r),
o AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY qid) AS n_strong FROM s QUALIFY strong OR n_strong < 5),
line AS (SELECT qid, chunk_id, list_distinct(regexp_extract_all(lower(text), '{WORDS}{{3,}}')) AS t, row_number() OVER (PARTITION BY qid ORDER BY strong DESC, score DESC, rank, chunk_id) AS i FROM o),
walk AS (SELECT DISTINCT qid, 0::BIGINT AS i, []::STRUCT(c BIGINT, t VARCHAR[])[] AS done FROM line
    UNION ALL SELECT qid, l.i, CASE WHEN len(done) >= 5 OR len(list_filter(done, lambda x: len(x.t) > 0 AND len(l.t) > 0
        AND len(list_intersect(x.t, l.t)) / len(list_distinct(list_concat(x.t, l.t))) > 0.6)) > 0 THEN done ELSE list_append(done, {{'c': l.chunk_id, 't': l.t}}) END
    FROM walk JOIN line l USING (qid) WHERE l.i = walk.i + 1),
ended AS (SELECT qid, arg_max(done, i) AS done FROM walk GROUP BY qid),
chosen AS (SELECT qid, unnest(list_transform(done, lambda x: x.c)) AS chunk_id, generate_subscripts(done, 1) - 1 AS place FROM ended)""" for c in (RANKED, EVERY))
LISTED = f"""own AS (SELECT qid, flatten(list(forms)) AS own FROM forms WHERE keyword NOT IN ('manual', 'manuales', 'documento', 'documentos', 'informacion') GROUP BY qid),
kind AS (SELECT qid, {any_of(trimmed(norm('question')), tx.DOCUMENT_SEARCHES)} AS lists FROM asked),
rows_of AS (SELECT qid, place, source, coalesce({held('lower(source)', 'own')}, false) AS own_path, source || ' (fragmento: ' || replace(substr(text, 1, 150), chr(10), ' ') || '...)' AS label FROM chosen JOIN chunks USING (chunk_id) LEFT JOIN own USING (qid)),
lists AS (SELECT qid, list(label ORDER BY place) AS labels, list(source ORDER BY place) AS paths, coalesce(list(source ORDER BY place) FILTER (own_path), []) AS own_paths FROM rows_of GROUP BY qid),
given AS (SELECT qid, CASE WHEN NOT lists THEN labels WHEN len(own_paths) > 0 THEN own_paths ELSE paths END AS every FROM lists JOIN kind USING (qid))"""

ORACLE_SQL: dict[str, str] = {
    "strip_accents_norm": f"SELECT doc_id, md5({norm('text')}) AS norm_md5, length({norm('text')}) AS chars FROM documents",
    "compound_codes": f"SELECT doc_id, len(c) AS n, array_to_string(c, ' ') AS codes FROM (SELECT doc_id, regexp_extract_all({norm('text')}, {CODE}) AS c FROM documents)",
    "word_counts": f"SELECT doc_id, len(regexp_extract_all(lower(text), '{WORDS}+')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '{WORDS}{{3,}}'))) AS n_tokens FROM documents",
    "image_block_strip": f"SELECT doc_id, md5({unmarked("'[DESCRIPCIÓN DE IMAGEN (img 1)]: ' || lang || '.] ' || text || ' [IMAGEN (img 2)]: sin descripción disponible.'")}) AS text_md5 FROM documents".replace("lang || '.] '", "lang || '.] '"),
    "useful_ratio": f"SELECT doc_id, round(length({trimmed(unmarked('t'))}) / length(t), 6) AS useful FROM (SELECT doc_id, '[DESCRIPCIÓN DE IMAGEN (img 1)]: ' || lang || '.]' || text AS t FROM documents)",
    "greeting_intent": f"SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN NULL {GREETED} END AS greeting FROM (SELECT conv_id, turn, {trimmed(norm('text'))} AS t FROM conversations)",
    "doc_search_intent": f"SELECT conv_id, turn, {any_of('t', tx.DOCUMENT_SEARCHES)} AS lists_documents FROM (SELECT conv_id, turn, {trimmed(norm('text'))} AS t FROM conversations)",
    "no_info_class": f"SELECT conv_id, turn, NOT {any_of('lower(text)', tx.NO_INFORMATION)} OR {any_of('lower(text)', tx.ALTERNATIVES)} AS found FROM conversations",
    "clarification": f"SELECT conv_id, turn, role = 'assistant' AS asks, md5(CASE WHEN role = 'assistant' THEN {trimmed('text')} ELSE text END) AS text_md5 FROM conversations",
    "caption_filter": f"SELECT conv_id, turn, md5(t) AS caption_md5, length(t) < 40 OR {any_of('t', tx.EMPTY_CAPTIONS)} AS is_empty FROM (SELECT conv_id, turn, {trimmed('text')} AS t FROM conversations)",
    "source_labels": f"WITH {CHUNKS} SELECT chunk_id, source || ' (fragmento: ' || replace(substr(text, 1, 150), chr(10), ' ') || '...)' AS label FROM chunks",
    "prompt_build": "SELECT conv_id, turn, md5('Responde solo con la información del contexto.' || chr(10) || chr(10) || 'Contexto:' || chr(10) || reverse(text) || chr(10) || chr(10) || 'Pregunta:' || chr(10) || text || chr(10) || chr(10) || 'Respuesta:') AS prompt_md5 FROM conversations WHERE role = 'user'",
    "keyword_extract_long_list": f"""WITH held AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({norm('text')}, '{WORDS}+')) AS word FROM documents), often AS (SELECT word FROM held GROUP BY word ORDER BY count(*) DESC, word LIMIT {STOPWORDS}),
        turns AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), own AS (SELECT DISTINCT unnest(regexp_extract_all({norm('question')}, '{WORDS}+')) AS w FROM turns),
        near AS (SELECT DISTINCT w FROM own JOIN often ON abs(length(w) - length(word)) <= 1 AND damerau_levenshtein({one_byte('w')}, {one_byte('word')}) <= 1),
        asked AS (SELECT *, (SELECT list(word) FROM often) AS stops, (SELECT list(w) FROM near) AS nears FROM turns), {keywords('conv_id, turn', lists=True)} SELECT conv_id, turn, array_to_string(in_order, ' ') AS in_order FROM kw""",
    "keyword_extract": f"WITH {TURNS}, {keywords('conv_id, turn')} SELECT conv_id, turn, array_to_string(found, ' ') AS keywords, array_to_string(in_order, ' ') AS in_order FROM kw",
    "legacy_keywords": f"SELECT conv_id, turn, array_to_string({in_order('w')}, ' ') AS keywords FROM (SELECT conv_id, turn, list_filter(regexp_extract_all({norm('text')}, '{WORDS}+'), lambda w: length(w) >= 4) AS w FROM conversations WHERE role = 'user')",
    "keyword_forms": f"WITH {TURNS}, {keywords('conv_id, turn')}, kw_rows AS (SELECT DISTINCT unnest(found) AS keyword FROM kw), {forms()} SELECT keyword, array_to_string(list_sort(list_distinct(core)), ' ') AS core, array_to_string(list_sort(list_distinct(forms)), ' ') AS forms FROM forms",
    "infinitive_variants": f"WITH {DISTINCT_WORDS} SELECT word, array_to_string({verbs()}, ' ') AS variants FROM words WHERE len({verbs()}) > 0",
    "nominalizations": f"WITH {DISTINCT_WORDS} SELECT word, array_to_string({nouns()}, ' ') AS variants FROM words WHERE len({nouns()}) > 0",
    "chunk_matches": f"WITH {MATCHES} SELECT qid, chunk_id, m, p, quality, priority FROM matches",
    "strong_and_score": f"""WITH {EVERY}
        SELECT qid, chunk_id, CASE WHEN m + p < req THEN false WHEN p > 0 THEN true ELSE m >= least(n, 3) END AS strong, CASE WHEN m + p < req THEN false WHEN p > 0 THEN true ELSE m >= greatest(req + 1, n) END AS strong_legacy,
        m >= req AND (p > 0 OR m >= least(greatest(req + 1, n), 3)) AS admitted,
        round(5000 * p + 1000 * m + 500 * useful + 1500 * quality + 6000 * priority - rank - CASE WHEN p = 0 AND priority = 0 THEN 2000 ELSE 0 END, 3)::DOUBLE AS score FROM r""",
    "coverage_ratio": f"""WITH {MATCHES}, c AS (SELECT qid, keyword, max(CASE WHEN {held('lower(text)', 'forms')} OR {held('lower(source)', 'forms')} THEN 1 ELSE 0 END) AS hit FROM forms LEFT JOIN matches USING (qid) GROUP BY qid, keyword)
        SELECT qid, count(*) AS n_keywords, sum(hit)::BIGINT AS covered FROM c GROUP BY qid""",
    "path_tokens": f"WITH {CHUNKS}, {TOKENS} SELECT source, array_to_string(list_sort(tokens), ' ') AS tokens FROM path_tokens",
    "source_token_index": f"WITH {CHUNKS}, {TOKENS} SELECT token, count(*) AS n_sources FROM token_index GROUP BY token",
    "scope_filter": f"WITH {CHUNKS} SELECT chunk_id, source FROM chunks WHERE prefix(source, 'e') AND (prefix(source, 'en/src1') OR prefix(source, 'es/src2'))",
    "chosen_sources": f"WITH {CHUNKS} SELECT chunk_id, source FROM chunks WHERE source IN ('en/src1/doc1.md', 'en/src1/doc3.md', 'fr/src2/doc2.md') AND prefix(source, 'en/')",
    "page_numbers": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN doc_id % 7 WHEN doc_id % 3 = 2 THEN doc_id % 11 END::INT AS page FROM documents",
    "usage_totals": "SELECT conv_id, sum(length(text) + CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END)::BIGINT AS tokens, count(*) + count(*) FILTER (turn % 2 = 0) AS counts FROM conversations GROUP BY conv_id",
    "path_parts": f"""SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, CASE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$')) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ps.TYPES.items())} ELSE 'application/octet-stream' END AS kind
        FROM (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '/+', '/', 'g'), '/') AS path FROM pages)""",
    "folder_tree": f"""WITH {CHUNKS}, s AS (SELECT DISTINCT string_split(source, '/') AS parts FROM chunks), p AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM s, range(1, 20) r(i) WHERE i < len(parts))
        SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS name, len(string_split(path, '/')) AS depth FROM p""",
    "path_token_match": by_name(f"WITH {FEATURES}, {NAMED} SELECT qid, token FROM named"),
    "priority_search": by_name(f"""WITH {MATCHES}, {TOKENS}, w AS (SELECT DISTINCT qid, unnest(forms) AS token FROM forms WHERE priority), s AS (SELECT DISTINCT qid, source FROM w JOIN token_index USING (token))
        SELECT qid, chunk_id FROM s JOIN matches USING (qid, source) QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY p DESC, m DESC, m / greatest(useful_chars, 1) DESC, chunk_id) <= 2"""),
    "source_augment": by_name(f"""WITH {MATCHES}, {NAMED}, s AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, source) AS i FROM named JOIN token_index USING (token) GROUP BY qid, source QUALIFY i <= 12),
        r AS (SELECT *, substr(text, 1, 100) AS head FROM s JOIN matches USING (qid, source) JOIN n USING (qid) WHERE NOT (m < greatest(1, CASE WHEN n <= 1 THEN 0 ELSE 1 END) AND p = 0)),
        b AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY p DESC, m DESC, m / greatest(useful_chars, 1) DESC, chunk_id) AS j FROM r QUALIFY j <= 2),
        c AS (SELECT *, min(i) OVER (PARTITION BY qid, head) AS first FROM b QUALIFY i = first)
        SELECT qid, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i, j) <= 12"""),
    "legacy_source_augment": by_name(f"""WITH {MATCHES}, {NAMED}, l AS (SELECT qid, token, min({{'p': pos, 'f': form}}) AS o FROM (FROM own UNION ALL FROM single) GROUP BY qid, token),
        l12 AS (SELECT * FROM l QUALIFY rank() OVER (PARTITION BY qid ORDER BY o.p) <= 12),
        s AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY min({{'o': o, 't': token}}), source) AS i FROM l12 JOIN token_index USING (token) GROUP BY qid, source QUALIFY i <= 12),
        b AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY p DESC, m DESC, length(text) DESC, chunk_id) AS j FROM s JOIN matches USING (qid, source) JOIN n USING (qid) WHERE p > 0 OR m >= greatest(1, CASE WHEN n <= 1 THEN 0 ELSE 1 END) QUALIFY j <= 2)
        SELECT qid, chunk_id FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i, j) <= 12"""),
    "batch_evaluation": f"""WITH {RANKED},
        s AS (SELECT *, CASE WHEN m + p < req THEN false WHEN p > 0 THEN true ELSE m >= greatest(req + 1, n) END AS strong FROM r),
        k AS (SELECT * FROM s QUALIFY strong OR NOT bool_or(strong) OVER (PARTITION BY qid)),
        g AS (SELECT qid, source, min(rank) AS first, sum(1.0::DOUBLE / (rank + 1)) * count(*) * (1 + 0.4::DOUBLE * sum(m) + 1.5::DOUBLE * sum(p)) * CASE WHEN sum(p) = 0 THEN 0.4::DOUBLE ELSE 1 END AS score FROM k GROUP BY qid, source),
        b AS (SELECT qid, source FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, source) = 1),
        u AS (SELECT qid, source, rank, {CLEANED} AS text FROM k JOIN b USING (qid, source)),
        w AS (SELECT qid, any_value(source) AS sources, count(*) AS documents_used, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (text <> ''), '') AS context FROM u GROUP BY qid)
        SELECT qid, coalesce(sources, '') AS sources, coalesce(documents_used, 0) AS documents_used, md5(coalesce(context, '')) AS context_md5 FROM asked LEFT JOIN w USING (qid)""",
    "compound_search": by_name(f"""WITH {CHUNKS}, {ASKED}, c AS (SELECT DISTINCT qid, lower(unnest(regexp_extract_all(question, {CODE}))) AS term FROM asked)
        SELECT DISTINCT qid, chunk_id FROM (SELECT qid, chunk_id FROM c JOIN chunks ON contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY qid, term ORDER BY chunk_id) <= 12)"""),
    "literal_search": f"""WITH {FEATURES}, h AS (SELECT qid, pos, chunk_id FROM kw_rows JOIN chunks ON length(keyword) >= 4 AND contains(lower(text), keyword) QUALIFY row_number() OVER (PARTITION BY qid, pos ORDER BY chunk_id) <= 10),
        g AS (SELECT qid, chunk_id, min(pos) AS pos FROM h GROUP BY qid, chunk_id) SELECT qid, chunk_id FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos, chunk_id) <= 20""",
    "vector_topk": f"WITH {VECTORS}, {nearest('SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings', 20)} SELECT qid, chunk_id, rank, round(dist, 6) AS dist FROM near",
    "fallback_widen": f"WITH {CHUNKS}, {VECTORS}, {nearest("SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings JOIN chunks ON vec_id = chunk_id WHERE prefix(source, 'en/') OR prefix(source, 'fr/')", 150)} SELECT qid, chunk_id, rank FROM near WHERE rank >= 20",
    "best_source_eval": f"""WITH {CHUNKS}, {VECTORS}, {nearest('SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings', 20)},
        r AS (SELECT qid, source, rank, contains(text, 'the')::INT AS m, contains(source, 'src1')::INT AS p FROM near JOIN chunks USING (chunk_id)),
        g AS (SELECT qid, source, count(*) AS chunks, min(rank) AS first, sum(1.0::DOUBLE / (rank + 1)) * count(*) * (1 + 0.4::DOUBLE * sum(m) + 1.5::DOUBLE * sum(p)) * CASE WHEN sum(p) = 0 THEN 0.4::DOUBLE ELSE 1 END AS score FROM r GROUP BY qid, source)
        SELECT qid, source, chunks, round(score, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, source) = 1""",
    "near_dup_pairs": f"""WITH s AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(text), '{WORDS}{{3,}}'))) AS t, min(doc_id) AS id FROM documents GROUP BY 1),
        w AS (SELECT id, len(t) AS n, unnest(t) AS w FROM s), c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
        SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM c WHERE k / (na + nb - k) > 0.6""",
    "near_dup_members": f"SELECT doc_id AS chunk_id, min(doc_id) OVER (PARTITION BY list_sort(list_distinct(regexp_extract_all(lower(text), '{WORDS}{{3,}}')))) AS id FROM documents",
    "context_concat": f"WITH {INDEXED}, c AS (SELECT source, chunk_index, {CLEANED} AS text FROM indexed) SELECT source, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) FILTER (text <> ''), '')) AS context_md5 FROM c GROUP BY source",
    "conversation_block": f"""WITH r AS (SELECT conv_id, turn, upper(CASE lower(trim(role)) WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END) AS role, {trimmed("coalesce(text, '')")} AS text FROM conversations),
        b AS (SELECT conv_id, right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 4000) AS block FROM r WHERE text <> '' GROUP BY conv_id) SELECT conv_id, md5(block) AS block_md5, length(block) AS chars FROM b""",
    "conversation_tail": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS tail_md5 FROM r WHERE i <= 3 GROUP BY conv_id",
    "doc_list": f"""WITH {INDEXED}, g AS (SELECT source, count(*) AS chunks, arg_min(source_hash, chunk_index) AS source_hash, bool_or(contains({norm('text')}, 'and')) AS found FROM indexed GROUP BY source)
        SELECT source, regexp_extract(source, '[^/]*$') AS name, regexp_replace(source, '/[^/]*$', '') AS folder, chunks, source_hash FROM g WHERE found AND contains(regexp_replace(source, '/[^/]*$', ''), 'src1')""",
    "doc_detail": f"WITH {DETAILS} SELECT source, part, chunks, content_md5 FROM details",
    "stored_detail": f"WITH {DETAILS} SELECT source, part, chunks, content_md5 FROM details WHERE doc_id % 50 = 0",
    "doc_delete": f"WITH {CHUNKS} SELECT source, count(*) AS chunks FROM chunks WHERE NOT prefix(source, 'de/') GROUP BY source",
    "force_reindex": f"WITH {CHUNKS} SELECT source, count(*) AS chunks FROM chunks WHERE contains(lower(source), 'en/src3') OR contains(lower(source), 'doc7') GROUP BY source",
    "path_index_upkeep": f"WITH {SNAPSHOTS}, chunks AS (SELECT source FROM disk), {TOKENS} SELECT token, count(*) AS n_sources FROM token_index GROUP BY token",
    "caption_cache": """WITH h AS (SELECT page_id, html, sha1(base64(encode(html))) AS hash FROM pages), c AS (SELECT DISTINCT hash FROM h WHERE page_id % 3 = 0), m AS (SELECT page_id, h.hash, c.hash IS NOT NULL AS hit FROM h LEFT JOIN c USING (hash))
        SELECT page_id, CASE WHEN hit THEN 'cached' ELSE 'new ' || substr(hash, 1, 8) END AS caption, count(*) FILTER (hit) OVER () AS hits, count(*) FILTER (NOT hit) OVER () AS misses FROM m""",
    "sync_plan": f"WITH {SNAPSHOTS} SELECT source, state FROM plan",
    "sync_apply": f"WITH {SNAPSHOTS} SELECT source, source_hash FROM idx WHERE source NOT IN (SELECT source FROM plan WHERE state <> 'nuevo') UNION ALL SELECT source, source_hash FROM disk WHERE source IN (SELECT source FROM plan WHERE state IN ('nuevo', 'modificado'))",
    "sync_notice": f"WITH {SNAPSHOTS} SELECT CASE WHEN state = 'eliminado' THEN 'eliminados' ELSE 'procesados' END AS list, regexp_extract(source, '[^/]*$') AS nombre, source AS ruta FROM plan WHERE state <> 'oculto'",
    "image_cache_keys": "SELECT page_id, sha256(url || '.PNG?size=1') || CASE WHEN contains(regexp_replace(url, '[?#].*$', ''), url) THEN '.png' ELSE coalesce(CASE WHEN length(e) <= 6 THEN e END, '') END AS key FROM (SELECT *, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '(\\.[^.]*)$')) AS e FROM pages)",
    "numbered_questions": "SELECT trim(text) AS question FROM benchmark WHERE trim(text) <> ''",
    "case_variants": f"""WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, {CODE})) AS code FROM documents),
        v AS (SELECT code, [code, lower(code), array_to_string(list_transform(regexp_extract_all(lower(code), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), ''), upper(code)] AS every FROM c)
        SELECT code, array_to_string({in_order('every')}, ' ') AS variants FROM v""",
    "query_expansion": f"WITH {EXPANDED}, o AS (SELECT conv_id, turn, unnest(own) AS word, generate_subscripts(own, 1) AS i FROM d), words AS (SELECT DISTINCT word FROM o), {STEMS}, f AS (SELECT conv_id, turn, stem, min(i) AS i FROM o JOIN stems USING (word) WHERE length(stem) >= 3 GROUP BY ALL), g AS (SELECT conv_id, turn, string_agg(stem, ' ' ORDER BY i) AS stemmed FROM f GROUP BY ALL) SELECT conv_id, turn, md5(array_to_string(list_filter([low, CASE WHEN base <> low THEN base ELSE '' END, coalesce(stemmed, ''), array_to_string(v, ' '), array_to_string(n, ' ')], lambda p: p <> ''), ' ')) AS expanded_md5 FROM d LEFT JOIN g USING (conv_id, turn)",
    "spanish_stems": f"WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}+')) AS word FROM documents), {STEMS} SELECT word, stem FROM stems",
    "table_markdown": f"WITH {CELLS} SELECT conv_id, turn, md5(array_to_string(list_transform(list_concat([head, rule], CASE WHEN len(body) = 0 THEN [nothing] ELSE body END), lambda r: array_to_string(r, ' | ')), chr(10))) AS table_md5 FROM d",
    "prioritize_dedup": f"WITH {EVERY_CHOSEN} SELECT qid, place, chunk_id FROM chosen",
    "source_lists": f"WITH {CHOSEN}, {LISTED} SELECT qid, array_to_string({in_order('every')}, chr(10)) AS sources FROM given",
}

#: Searches by an index give what those without one do.
ORACLE_SQL |= {f"{k}_indexed": ORACLE_SQL[k] for k in ("vector_topk", "chunk_matches", "compound_search", "literal_search")}
