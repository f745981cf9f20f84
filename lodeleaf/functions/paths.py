"""Column functions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeleaf.functions.text import normalised


def clean_path(path: Column) -> Column:
    """Slashes only, none doubled, no './' parts and none at the end; '..' takes its parent away."""
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(parts, none, lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.when(slashed.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def source_key(path: Column, roots: tuple[str, ...] = ()) -> Column:
    """A path as name of a source: cleaned, and cut behind the first of the roots that stands in it as whole parts."""
    clean = clean_path(path)
    out = clean
    for root in reversed(roots):
        pattern = rf"^(?:.*?/)?\Q{root}\E(?:/+|$)"
        out = F.when(clean.rlike(pattern), F.regexp_replace(clean, pattern, "")).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


# Types of served files by extension.
TYPES = {".pdf": "application/pdf", ".html": "text/html", ".md": "text/markdown", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp"}


def media_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def inside(path: Column, root: str) -> Column:
    """Whether a path stays under a root."""
    clean = clean_path(path)
    return (clean == root) | clean.startswith(root.rstrip("/") + "/")


def camel_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z0-9]*|[a-z][a-z0-9]*|[0-9]+"), F.lit(0))


def path_tokens(path: Column, shortest: int = 3) -> Column:
    """Distinct tokens of a path: parts between separators, and pieces of camel case."""
    pieces = F.filter(F.flatten(F.transform(F.split(path, r"[\\/]+"), lambda s: F.split(s, "[^a-zA-Z0-9áéíóúüñÁÉÍÓÚÜÑ]+"))), lambda p: p != "")
    split = F.transform(pieces, camel_parts)
    camel = F.flatten(F.filter(split, lambda c: F.size(c) > 1))
    return F.array_distinct(F.filter(F.transform(F.concat(pieces, camel), normalised), lambda t: F.length(t) >= shortest))


def ancestors(path: Column) -> Column:
    """The folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def in_scope(source: Column, root: str | None = None, prefixes: tuple[str, ...] = ()) -> Column:
    """Under the root and under any of the prefixes; without either everything is."""
    scope = F.lit(True) if not root else source.startswith(root)
    if prefixes:
        scope &= F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(source, p))
    return scope


def query_paths(text: Column) -> Column:
    """Comma-separated paths as an array."""
    return F.filter(F.transform(F.split(text, ","), lambda x: clean_path(F.trim(x))), lambda x: x != "")


def chosen(source: Column, exact: tuple[str, ...] = (), root: str | None = None, prefixes: tuple[str, ...] = ()) -> Column:
    """Exact paths inside the scope; without exact paths the scope alone. Paths none of which is in scope match nothing."""
    paths = tuple(p.strip().replace("\\", "/") for p in exact)
    if exact and not any(paths):
        raise ValueError("paths were given, but all of them are empty")
    scope = in_scope(source, root, prefixes)
    return source.isin(*(p for p in paths if p)) & scope if exact else scope
