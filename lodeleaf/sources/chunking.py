"""Texts to overlapping chunks along a list of separators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators by format, from coarse to fine.
SEPARATORS = {"md": ("\n## ", "\n### ", "\n\n", "\n", " ", ""), "html": ("\n\n", "\n", ". ", " ", ""), "pdf": ("\n\n", "\n", ". ", " ", "")}


def split_text(text: str, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, pieces that are too long cut further.

    Pieces are joined as long as they fit; the next chunk begins with pieces of the last one of at most ``overlap`` characters.
    """
    sep = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep in separators else ()
    pieces = list(text) if not sep else [p for p in (text.split(sep)[0], *(sep + p for p in text.split(sep)[1:])) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def give() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size and finer:
            give()
            held, length = [], 0
            out += split_text(piece, finer, size, overlap)
            continue
        if held and length + len(piece) > size:
            give()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    give()
    return out


def split_column(text: Column, kind: str, size: int = 1500, overlap: int = 300) -> Column:
    """Array of chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, SEPARATORS[kind], size, overlap) if t else [])

    return cut(text)


def chunked(docs: DataFrame, kind: str, size: int = 1500, overlap: int = 300) -> DataFrame:
    """docs(source, source_hash, text, ...) to chunks: chunk_id (a hash of source, position and source_hash), chunk_index, text."""
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.posexplode(split_column(F.col("text"), kind, size, overlap)).alias("chunk_index", "text"))
    key = F.concat_ws("|", "source", F.col("chunk_index").cast("string"), "source_hash")
    return rows.withColumn("chunk_id", F.sha1(key.cast("binary")))
