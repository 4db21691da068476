"""WARC fixity audit by Merkle trees: the archives' bytes are read and hashed, replicas compared root by root, and only branches that differ are descended.

An archive is a folder of gzipped WARC files, one for each shard of consecutive ids (a shard with
many more records than ids has several parts). Offsets are those in the uncompressed stream.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm.runtime import Workspace, give_back

#: Consecutive ids of a shard, and children of a tree node.
SHARD_IDS = 1024
FANOUT = 16
#: Records of a file at about; shards of repeated ids with four times as many are split.
PART_RECORDS = 1024
#: Bytes of records of a file at about, for shards that have four times as many.
PART_BYTES = 64 << 20
#: Shards to split (an id and a count) that are broadcast; more are joined by a shuffle of the records.
BROADCAST_SHARDS = 100_000
#: Shards that records without an id are dealt to, below all ids' shards.
NO_ID_SHARDS = 4096
#: What stands as WARC-Date where a crawl's time isn't known.
DATE = "1970-01-01T00:00:00Z"
_KEYS = ["shard", "part"]
_START = b"WARC/1.0\r\n"


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, shard, part, record: each page as a WARC resource record. Null ids, urls and bodies are written as nothing; other columns are ignored.

    A shard with many more records than ids, or with more than four times PART_BYTES, is split into parts. Repeated rows are a
    record each, dealt to the parts in turn; a very long page is one record, whole; an empty table gives no records.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), blank("page_id"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), blank("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(blank("html")).cast("string"), F.lit("\r\n\r\n"),
    )
    spread = -(2**40) - F.pmod(F.xxhash64(blank("url"), blank("html")), F.lit(NO_ID_SHARDS))
    shard = F.when(F.col("page_id").isNull(), spread).otherwise(F.expr(f"floor(page_id / {SHARD_IDS})")).cast("long")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), shard.alias("shard"), F.concat(head, blank("html"), F.lit("\r\n\r\n")).alias("record"))
    sizes = rows.select("shard", F.octet_length("record").cast("long").alias("_b")).groupBy("shard").agg(F.count("*").alias("_n"), F.sum("_b").alias("_b"))
    large = sizes.where((F.col("_n") > 4 * PART_RECORDS) | (F.col("_b") > 4 * PART_BYTES)).select("shard", F.greatest(F.ceil(F.col("_n") / PART_RECORDS), F.ceil(F.col("_b") / PART_BYTES)).cast("long").alias("_parts"))
    n = large.count()
    if not n:
        return rows.select("page_id", "shard", F.lit(0).alias("part"), "record")
    large = F.broadcast(large) if n <= BROADCAST_SHARDS else large
    small = rows.join(large, "shard", "left_anti").select("page_id", "shard", F.lit(0).alias("part"), "record")
    # equal records are counted where they are read, and their copies go to the parts in turn
    copies = rows.join(large, "shard").groupBy("shard", "page_id", "record", "_parts").agg(F.count("*").alias("_n"))
    each = copies.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return small.unionByName(each.select("page_id", "shard", F.pmod(F.xxhash64("record") + F.col("_i"), "_parts").cast("int").alias("part"), "record"))


def write_archive(recs: DataFrame, path: str) -> None:
    """One gzipped WARC file for each part of a shard, its records in order of ids, then digests."""
    body = F.expr("substring(record, 1, char_length(record) - 1)")  # the writer ends each record with the last line feed
    dealt = recs.withColumn("_sha", F.sha2("record", 256)).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "page_id", "_sha")
    dealt.select(*_KEYS, body.alias("value")).write.partitionBy(*_KEYS).option("lineSep", "\n").option("compression", "gzip").text(path)


def split(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an uncompressed archive. Where a header is damaged its record reaches to the next one that can be read; a cut-off record is what is left of it."""
    at, size = 0, len(stream)
    while at < size:
        head = stream.find(b"\r\n\r\n", at)
        length = re.search(rb"\r\nContent-Length: (\d{1,12})(?:\r\n|\Z)", stream[at:head]) if head > 0 and stream.startswith(_START, at) else None
        end = head + 8 + int(length[1]) if length else size
        if end < size and not stream.startswith(_START, end) or not length:
            # the length can't be trusted
            end = stream.find(_START, at + 1)
        end = size if end < 0 or end > size else end
        yield at, stream[at:end]
        at = end


def _unzipped(content: bytes) -> bytes:
    """All members of a gzipped file, or what can be read before damage."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content) + member.flush())
        except zlib.error:
            member = zlib.decompressobj(31)
            try:
                for i in range(0, len(content), 256):
                    out.append(member.decompress(content[i : i + 256]))
            except zlib.error:
                pass
            break
        content = member.unused_data
    return b"".join(out)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, shard, part, place, offset, length, sha256 of each record, from the files' bytes. A file is a row of its task: PART_RECORDS records at about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, part, content = (batch.column(c)[i].as_py() for c in ("shard", "part", "content"))
                rows: list[list] = [[], [], [], [], []]
                for place, (offset, record) in enumerate(split(_unzipped(content))):
                    name = re.search(rb"\r\nWARC-Record-ID: <urn:page:(-?\d{1,18})>\r\n", record[:4096])
                    for column, value in zip(rows, (int(name[1]) if name else None, place, offset, len(record), hashlib.sha256(record).hexdigest())):
                        column.append(value)
                columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([shard] * n, pa.int64()), pa.array([part] * n, pa.int32()), *columns[1:]], ["page_id", "shard", "part", "place", "offset", "length", "sha256"])
        give_back()

    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # an archive without records has no folders of shards
        files = files.withColumns({"shard": F.lit(0), "part": F.lit(0)}).limit(0)
    return files.select(F.col("shard").cast("long").alias("shard"), F.col("part").cast("int").alias("part"), "content").mapInArrow(run, "page_id long, shard long, part int, place long, offset long, length long, sha256 string")


class Tree:
    """Hash trees of the shards' parts: level 0 has a node for each record's digest and byte range, each further level one for FANOUT nodes in order.

    Records are read and hashed once: leaves and levels are written to the shared folder.
    """

    def __init__(self, leaf: DataFrame):
        space = Workspace(leaf.sparkSession, "fixity")
        self.leaf, seen = space.noted(leaf, "leaves", most=F.max("place"))
        most = (seen["most"] or 0) + 1
        self.levels = [self.leaf.select(*_KEYS, "place", F.sha2(F.concat_ws("|", "sha256", "offset", "length"), 256).alias("node"))]
        while most > 1:
            most = -(-most // FANOUT)
            children = F.array_sort(F.collect_list(F.struct("place", "node")))
            up = self.levels[-1].groupBy(*_KEYS, F.floor(F.col("place") / FANOUT).cast("long").alias("up")).agg(children.alias("c"))
            self.levels.append(space.keep(up.select(*_KEYS, F.col("up").alias("place"), F.sha2(F.array_join(F.transform("c", lambda x: x["node"]), ""), 256).alias("node")), "level", narrow=True))


def audit(one: Tree, other: Tree) -> DataFrame:
    """shard, part, place of the records in which two replicas differ: changed, moved, or present in one only. Replicas without records don't differ."""
    wrong = None
    height = max(len(one.levels), len(other.levels))
    for level in reversed(range(height)):
        # the root of a lower tree is compared with the node over the first records of the higher one
        sides = [t.levels[min(level, len(t.levels) - 1)] for t in (one, other)]
        if wrong is not None:
            here = F.floor(F.col("place") / FANOUT).cast("long")
            sides = [s.withColumn("up", here).join(wrong.withColumnRenamed("place", "up"), [*_KEYS, "up"], "left_semi").drop("up") for s in sides]
        a, b = sides[0].withColumnRenamed("node", "a"), sides[1].withColumnRenamed("node", "b")
        wrong = a.join(b, [*_KEYS, "place"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*_KEYS, "place")
    return wrong


def damaged_copy(pages: DataFrame, where: Column) -> DataFrame:
    """A replica for tests: the bodies of some pages with their first character replaced by one of equal size."""
    return pages.withColumn("html", F.when(where & F.col("html").rlike(r"^[\x00-\x7f]"), F.concat(F.when(F.substring("html", 1, 1) == "#", F.lit("%")).otherwise(F.lit("#")), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: an archive of all pages against a replica in which every 101st page is damaged, both written and read back: each record's place, and whether the audit found it to differ."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    space = Workspace(spark, "archives")
    trees = []
    for name, rows in (("one", pages), ("other", damaged_copy(pages, F.col("page_id") % 101 == 0))):
        write_archive(records(rows), f"{space.root}/{name}")
        trees.append(Tree(read_archive(spark, f"{space.root}/{name}")))
    wrong = audit(*trees).withColumn("damaged", F.lit(True))
    found = trees[0].leaf.join(wrong, [*_KEYS, "place"], "left")
    return found.select("page_id", "shard", F.col("offset").alias("byte_offset"), F.col("length").alias("n_bytes"), "sha256", F.coalesce("damaged", F.lit(False)).alias("damaged"))


ORACLE_SQL = f"""WITH r AS (SELECT page_id, floor(page_id / {SHARD_IDS}.0)::BIGINT AS shard, coalesce(html, '') AS html,
  concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Date: {DATE}', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
d AS (SELECT page_id, shard, strlen(record)::BIGINT AS n_bytes, sha256(record) AS sha256, coalesce(page_id % 101 = 0 AND regexp_matches(html, '^[\\x00-\\x7f]'), false) AS damaged FROM r)
SELECT page_id, shard, (sum(n_bytes) OVER (PARTITION BY shard ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING) - n_bytes)::BIGINT AS byte_offset, n_bytes, sha256, damaged FROM d"""
