"""Which terms occur in which rows, found in one pass over the rows however many questions ask for a term."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeleaf.sources.scratch import bounded_batches, stored

#: Bytes of terms that go to all tasks at once; more terms take more passes over the rows.
TERM_BYTES = 4 << 20


def finder(terms, places: list[str], rest: list[str]):
    """Batches of rows to one row for each place and term in it. All terms are found in one walk over a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = terms.value
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found, where = [], [], []
            for place in places:
                for row, text in enumerate(batch.column(place).to_pylist()):
                    own = {i for _, i in automaton.iter(text)} if text else ()
                    rows += [row] * len(own)
                    found += [words[i] for i in sorted(own)]
                    where += [place] * len(own)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), pa.array(found, pa.string()), pa.array(where, pa.string())], [*rest, "term", "place"])

    return run


def occurrences(rows: DataFrame, places: list[str], terms: DataFrame) -> DataFrame:
    """rows(..., places) and terms(term) to the rows' other columns, term and place: one row for each place that holds a term.

    Distinct terms are a stated query set, sent to all tasks in passes of TERM_BYTES.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    terms = stored(terms.select("term").filter(F.length("term") > 0).distinct())
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-size // TERM_BYTES))
    rest = [c for c in rows.columns if c not in places]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    found = None
    for i in range(passes):
        own = [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect()]
        hits = rows.mapInArrow(finder(spark.sparkContext.broadcast(own), places, rest), f"{kinds}, term string, place string") if own else None
        found = hits if found is None else found if hits is None else found.unionByName(hits)
    return rows.select(*rest, F.lit("").alias("term"), F.lit("").alias("place")).limit(0) if found is None else found
