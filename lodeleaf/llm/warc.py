"""WARC archives: a writer, and a reader that verifies record boundaries by chains.

Archives are split text to Spark: tasks read ranges of a file, cut at the
version line wherever it stands. Each cut is a candidate record with a
successor, its offset plus the length its header gives. Pointer jumping from
the file's start keeps the reachable candidates only; a version line inside a
payload is not reachable and goes back into the payload around it.

Offsets of a file's candidates meet in one task (16 bytes each; a file of
usual size has at most some millions), payloads do not: of records which
contain a version line, the chunks are joined again by a shuffle on the record.
Payloads are UTF-8 text.

Edge cases: a null payload is empty; a null URL or id is left out of the
header and read as null; equal rows of one id are all responses; white space in a URL is percent-encoded; an
empty table writes no records and reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import shared_dir, small, stored, table

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 20_000


def write(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as WARC records; of equal payloads the largest page_id is stored, others revisit it."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    heads = rows.filter(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1 and head is not null")
    rows = rows.join(small(stored(heads.select("digest", "head"))), "digest", "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(BREAK))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(again, urn(F.col("head")))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(BREAK),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between version lines: file, split, seq, value. A file's first chunk is what stands before any."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def placed(rows: DataFrame) -> DataFrame:
    """rows (file, split, seq, size) with the offset of the version line before each chunk; negative for a file's first."""
    before = Window.partitionBy("file").orderBy("split", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC))


def field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.nullif(found, F.lit(""))


def after(text: Column, head: Column) -> Column:
    return text.substr(F.length(head) + len(BREAK) + 1, F.length(text))


def content(block: Column, kind: Column, digest: Column) -> list[Column]:
    """Length and digest of the full payload: of the stored bytes, or as a revisit's headers give them."""
    http = F.substring_index(block, BREAK, 1)
    payload = after(block, http)
    again = kind == "revisit"
    return [
        F.when(again, F.expr("cast(null as bigint)")).otherwise(F.octet_length(payload)).alias("stored_bytes"),
        F.when(again, field(http, "Content-Length").try_cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(again, digest).otherwise(F.sha1(payload.cast("binary"))).alias("payload_digest"),
    ]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk with its header's fields and, if the record ends with the chunk, its content's digest."""
    value, head = F.col("value"), F.col("head")
    rows = chunks(spark, path).select("file", "split", "seq", F.octet_length("value").cast("long").alias("size"), "value", F.substring_index("value", BREAK, 1).alias("head"))
    rows = rows.withColumn("length", F.when(F.contains(value, F.lit(BREAK)), field(head, "Content-Length").try_cast("long")))
    rows = rows.withColumn("span", F.octet_length("head") + 2 * len(BREAK) + F.col("length"))
    rows = rows.withColumn("kind", field(head, "WARC-Type")).withColumn("digest", F.regexp_extract(F.coalesce(field(head, "WARC-Payload-Digest"), F.lit("")), r"(?i)^sha1:([0-9a-f]{40})$", 1))
    whole = F.col("span") == F.col("size")
    block = F.when(whole, value.substr(F.length(head) + len(BREAK) + 1, F.length(value) - F.length(head) - 2 * len(BREAK)))
    urn = lambda name: F.regexp_extract(F.coalesce(field(head, name), F.lit("")), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return rows.select("file", "split", "seq", "size", "span", "kind", "digest", urn("WARC-Record-ID").alias("page_id"), urn("WARC-Refers-To").alias("refers_to"), field(head, "WARC-Target-URI").alias("url"), whole.alias("whole"), *content(block, F.col("kind"), F.col("digest")))


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets a chain of successors from offset 0 meets, by pointer jumping: as many rounds as the logarithm of their number."""
    n = len(at)
    if not n or at[0] != 0:
        return np.zeros(n, bool)
    found = np.searchsorted(at, following)
    jump = np.append(np.where((found < n) & (at[np.minimum(found, n - 1)] == following), found, n), n)
    met = np.zeros(n + 1, bool)
    met[0] = True
    for _ in range(max(1, n.bit_length())):
        met[jump[met]] = True
        jump = jump[jump]
    return met[:n]


def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in frames:
        part = part.sort_values("at", ignore_index=True)
        yield part[reachable(part["at"].to_numpy(), part["following"].to_numpy())]


def pieces(found: DataFrame, real: DataFrame, cut: DataFrame) -> DataFrame:
    """The chunks of cut records: file, split, seq, size, at, owner. Offsets and sizes only, no payload, meet in a file's task."""
    starts = real.select("file", "at", F.col("at").alias("start"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.select("file", "split", "seq", "size", "at").join(starts, ["file", "at"], "left").withColumn("owner", F.last("start", ignorenulls=True).over(order)).drop("start")
    return owned.join(cut.select("file", F.col("at").alias("owner"), "following"), ["file", "owner"]).filter("at < following").drop("following")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    found = stored(placed(candidates(spark, path)))
    links = found.filter("span is not null and kind is not null and at >= 0").select("file", "at", (F.col("at") + F.col("span") + len(MAGIC)).alias("following"))
    real = stored(links.groupBy("file").applyInPandas(lambda part: next(chained(iter([part]))), links.schema))
    records = found.join(real, ["file", "at"])
    out = ["page_id", "url", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"]
    cut = records.filter("not whole")
    if cut.isEmpty():
        return records.select(*out)
    # Records with a version line inside: all chunks from their start to their end, joined again.
    cut = stored(cut.select("file", "at", "following", "kind", "digest", "page_id", "refers_to", "url"))
    places = small(stored(pieces(found, real, cut)))
    owned = chunks(spark, path).join(places, ["file", "split", "seq"]).filter(F.octet_length("value") == F.col("size"))
    joined = owned.groupBy("file", F.col("owner").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    mended = joined.join(cut, ["file", "at"]).withColumn("head", F.substring_index("value", BREAK, 1))
    block = F.col("value").substr(F.length("head") + len(BREAK) + 1, F.length("value") - F.length("head") - 2 * len(BREAK))
    mended = mended.select("page_id", "url", "kind", "refers_to", *content(block, F.col("kind"), F.col("digest")))
    return records.filter("whole").select(*out).unionByName(mended.select(*out))


def op8_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
