"""WARC archives: written by Spark's text writer, read back by boundary-chain verification (operator 10).

Writing. A record is one string, and a record's end (two CR LF) is the writer's line separator, so each part file is an
archive of WARC 1.1. Of equal payloads of a least size the one of the largest id is a response and the others refer to it.

Reading. The text reader splits archives of any size at the magic line of a record, in blocks that tasks read side by side;
payloads may hold that line too, so what it finds are candidates only. The steps:

1. Each task numbers the segments of its blocks, reads the header behind each magic and emits offset and successor
   (offset, header, content, two CR LF). Inside a block pointer jumping takes every candidate to where its chain leaves it.
2. Pointer jumping between blocks (one written table of links a round, doubling their reach) finds where the chain from
   the start of each file enters each block.
3. From its entry each block marks the reachable candidates. All others were magic inside payloads.
4. Segments go to the record they lie in, and those of one record are put together again.

Only offsets and headers go through steps 1 to 3; payloads move once, in step 4, by archive. An archive is what a task
writes, so its size follows the partition sizes that the session asks for.

Defined results: a null payload is empty; a null id is written without one and is always a response, as are repeated rows of
the largest id; URLs lose control characters (percent-encoded) and null ones are `urn:none`; a table without rows gives an
archive without records. A file that ends inside a record keeps the records before it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.common import discard, new_path, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_SHARED = 1000
#: A group of equal payloads is spread over this many keys.
SALTS = 16


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2025-01-01T00:00:00Z", least_shared: int = LEAST_SHARED, path: str | None = None, compression: str = "gzip",
) -> str:
    """Write one record a row and return the folder of the archives.

    Compressed archives are a third of the size, but each is then read as one block; `none` leaves them splittable.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("size") >= least_shared).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("id").alias("first"))
    shared = shared.where("n > 1").select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "size", "salt"], "left")
    rows = rows.withColumn("refers", F.when(F.col("id") < F.col("first"), F.col("first")))
    rows.select(_record(date)).write.option("lineSep", END).option("compression", compression).text(path)
    return path


def _record(date: str) -> Column:
    """A record as text, without its end."""
    def urn(col: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))

    clean = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    revisit = F.col("refers").isNotNull()
    content = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *fields), F.lit(END), content).alias("value")


_HEAD = {b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-target-uri": "target_uri", b"warc-refers-to": "refers_to", b"warc-payload-digest": "digest"}
_SEGMENT = (
    "file string, block long, seq long, place long, size long, head long, content long, payload_length long, leaves long, "
    + ", ".join(f"{x} string" for x in _HEAD.values())
)


def parse_head(segment: bytes) -> dict | None:
    """Header fields behind a magic line; None where no whole header with a length stands."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in segment[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    own = fields.get(b"warc-payload-length", b"")
    out = {name: fields[k].decode("utf-8", "replace") if k in fields else None for k, name in _HEAD.items()}
    return out | {"head": end + 4, "content": int(length), "payload_length": int(own) if own.isdigit() else None}


def chain_ends(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the chain of each place leaves the given places, by pointer jumping; `places` ascend."""
    at = np.searchsorted(places, after)
    at = np.where((at < len(places)) & (places[np.minimum(at, len(places) - 1)] == after), at, -1)
    ends, jump = after.copy(), at
    while (inner := jump >= 0).any():
        ends = np.where(inner, ends[jump], ends)
        jump = np.where(inner, jump[jump], -1)
    return ends


def reached(places: np.ndarray, after: np.ndarray, entry: int) -> np.ndarray:
    """Which places the chain from `entry` visits, by pointer jumping."""
    at = np.searchsorted(places, after)
    jump = np.where((at < len(places)) & (places[np.minimum(at, len(places) - 1)] == after), at, -1)
    marks = places == entry
    while True:
        next_ = jump[marks & (jump >= 0)]
        if marks[next_].all():
            return marks
        marks[next_] = True
        jump = np.where(jump >= 0, jump[jump], -1)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Segments between magic lines, in order inside each block of a file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their number in their block."""
    now, n = None, 0
    for batch in batches:
        seqs = []
        for key in zip(batch["file"], batch["block"], strict=True):
            now, n = (now, n + 1) if key == now else (key, 0)
            seqs.append(n)
        yield batch.assign(seq=np.array(seqs, np.int64))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each segment, block by block; places are counted from the start of the block's first segment."""
    def closed(key: tuple, rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _SEGMENT.split(", ")])
        frame["file"], frame["block"] = key
        frame["seq"] = np.arange(len(rows))
        frame["place"] = np.cumsum(frame["size"]) - frame["size"]
        good = frame["head"].notna().to_numpy()
        places = frame["place"].to_numpy(np.int64)[good]
        after = places + len(MAGIC) + frame["head"].to_numpy(float)[good].astype(np.int64) + frame["content"].to_numpy(float)[good].astype(np.int64) + len(END)
        leaves = np.full(len(rows), np.nan)
        leaves[good] = chain_ends(places, after) if good.any() else after
        frame["leaves"] = leaves
        whole = ["head", "content", "payload_length", "leaves"]
        return frame.astype({c: "Int64" for c in whole} | {c: object for c in ("file", *_HEAD.values())})

    now, rows = None, []
    for batch in batches:
        for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if (file, block) != now:
                if rows:
                    yield closed(now, rows)
                now, rows = (file, block), []
            rows.append({"size": len(value) + len(MAGIC)} | (parse_head(bytes(value)) or {}))
    if rows:
        yield closed(now, rows)


def _entries(found: DataFrame) -> DataFrame:
    """`file, entry`: the offsets at which the chain from each file's start enters a block."""
    links = found.where("head IS NOT NULL").select("file", F.col("offset").alias("a"), F.col("leaves").alias("b"))
    targets = links.select("file", F.col("b").alias("a")).union(links.select("file", F.lit(0).cast("long").alias("a"))).distinct()
    links = stored(links.join(targets, ["file", "a"], "left_semi"), "chain")
    reach = stored(links.where("a = 0").select("file", "a"), "entries")
    while True:
        grown = reach.union(reach.join(links, ["file", "a"]).select("file", F.col("b").alias("a")).join(links.select("file", "a"), ["file", "a"], "left_semi")).distinct()
        grown = stored(grown, "entries")
        if grown.count() == reach.count():
            return grown.select("file", F.col("a").alias("entry"))
        reach = grown
        further = links.alias("x").join(links.select("file", F.col("a").alias("b"), F.col("b").alias("c")), ["file", "b"], "left")
        links = stored(further.select("file", "a", F.coalesce("c", "b").alias("b")), "chain")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`file, offset, record_type, record_id, target_uri, refers_to, digest, payload_length, payload` of every record."""
    scan = _scan(spark, path)
    found = stored(scan.mapInPandas(_candidates, _SEGMENT), "segments")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("_size"))
    base = F.coalesce(F.sum("_size").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", base.alias("_base"))
    # a segment's magic stands before it; the one before the first magic of a file has none
    at = F.col("_base") + F.col("place") - F.lit(len(MAGIC))
    found = found.join(blocks, ["file", "block"]).withColumns({"offset": at, "leaves": F.col("_base") - F.lit(len(MAGIC)) + F.col("leaves")}).where("offset >= 0")
    found = stored(found.drop("_base", "place"), "offsets")
    entries = _entries(found)
    entered = entries.join(found.select("file", "block", F.col("offset").alias("entry")), ["file", "entry"]).groupBy("file", "block").agg(F.min("entry").alias("entry"))
    chained = found.join(entered, ["file", "block"], "left")

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset", ignore_index=True)
        entry, good = frame["entry"].iloc[0], frame["head"].notna().to_numpy()
        marks = np.zeros(len(frame), bool)
        if not pd.isna(entry):
            places = frame["offset"].to_numpy()[good]
            after = places + len(MAGIC) + frame["head"][good].to_numpy(np.int64) + frame["content"][good].to_numpy(np.int64) + len(END)
            marks[good] = reached(places, after, int(entry))
        return frame.assign(reached=marks)[["file", "block", "seq", "offset", "reached"]]

    slim = chained.select("file", "block", "seq", "offset", "head", "content", "entry")
    marked = slim.groupBy("file", "block").applyInPandas(mark, "file string, block long, seq long, offset long, reached boolean")
    owner = F.last(F.when(F.col("reached"), F.col("offset")), True).over(W.partitionBy("file").orderBy("offset"))
    marked = marked.withColumn("owner", owner).where("owner IS NOT NULL").drop("offset").join(found, ["file", "block", "seq"])
    fields = ["head", "content", "payload_length", *_HEAD.values()]
    own = F.when(F.col("reached"), F.struct(*fields)).alias("fields")
    marked = stored(marked.select("file", "block", "seq", "offset", "owner", own), "owners")
    # a file's rows stay together from here on: payloads move once
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    values = scan.mapInPandas(_numbered, "file string, block long, value binary, seq long").repartition("file")
    segments = values.join(marked.repartition("file"), ["file", "block", "seq"])
    piece = F.struct("offset", F.when(F.col("offset") == F.col("owner"), F.col("value")).otherwise(F.concat(F.lit(MAGIC).cast("binary"), F.col("value"))).alias("value"))
    whole = segments.groupBy("file", F.col("owner").alias("offset")).agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max("fields").alias("fields"))
    several = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["value"])), ""))
    value = F.when(F.size("p") == 1, F.element_at("p", 1)["value"]).otherwise(several)
    whole = whole.select("file", "offset", "fields.*", value.alias("value")).where(F.octet_length("value") >= F.col("head") + F.col("content"))
    length = F.coalesce("payload_length", "content")
    start = F.col("head") + F.col("content") - length + 1
    payload = F.when(F.col("record_type") == "response", F.substring("value", start.cast("int"), length.cast("int")))
    return whole.select("file", "offset", "record_type", "record_id", "target_uri", "refers_to", F.regexp_extract("digest", "sha1:(.*)", 1).alias("digest"), "payload_length", payload.alias("payload"))


def id_of(urn: Column) -> Column:
    """The id in a record's name; null if it has none."""
    return F.nullif(F.regexp_extract(urn, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
