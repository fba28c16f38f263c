"""Fixity audit of WARC replicas by Merkle trees.

Records lie in files, one after the other. A record's digest covers its bytes; a leaf of
the tree stands for a range of offsets of RANGE_BYTES and hashes the offsets, lengths and
digests of the records that begin in it; an inner node stands for FAN_OUT ranges in order
and hashes its children (Merkle 1988). Replicas of a file agree if their roots do. Where
the roots differ, only children of nodes that differ are compared, level by level, down to
the ranges, and there the records.

All of it is DataFrame work: a level is one grouping of at most FAN_OUT rows a group, and
a comparison one join of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedback_rank.session import checkpointed

RANGE_BYTES = 1 << 16
FAN_OUT = 16
FILE_PAGES = 1_000


def warc_records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(file, page_id, record) from (page_id, url, html): each page as a WARC response record.

    A file has the pages of ``file_pages`` consecutive ids; pages without id are spread over
    files by a hash. A record is the header block, the page and two line ends; a null url or
    html is empty. Repeated rows are repeated records; other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.encode(F.concat(header, html, F.lit("\r\n\r\n")), "utf-8")
    return pages.select(F.coalesce(F.floor(F.col("page_id") / file_pages), spread).alias("file"), "page_id", record.alias("record"))


def fixity(record: Column) -> tuple[Column, Column]:
    """(length, digest) of a record's bytes; null bytes are none."""
    record = F.coalesce(record, F.lit(b""))
    return F.octet_length(record).cast("long"), F.sha2(record, 256)


def laid_out(rows: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """``rows`` with ``offset``: where each begins if a file's records follow each other in ``order``.

    Give it lengths and digests, not the bytes: rows are shuffled by file.
    """
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def _joined(*parts: Column) -> Column:
    """Values as one text, a null as an empty part."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def merkle_nodes(digests: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(replica, file, level, place, records, hash): all nodes of each replica's and file's tree, level 0 the ranges of offsets.

    Every tree goes up to the level at which the largest file has one node, so roots are the
    nodes of the highest level. Only ranges in which a record begins have nodes. Records at
    the same offset are ordered by length and digest, those alike in all are counted. Written
    once: runs its jobs at once.
    """
    place = F.coalesce(F.floor(F.col("offset") / range_bytes), F.lit(0))
    entries = F.array_sort(F.collect_list(_joined(F.lpad("offset", 20, "0"), F.col("length"), F.col("digest"), F.col("copies"))))
    once = digests.groupBy("replica", "file", "offset", "length", "digest").agg(F.count("*").alias("copies"))
    ranges = once.withColumn("place", place).groupBy("replica", "file", "place").agg(
        F.sum("copies").alias("records"), F.sha2(F.array_join(entries, "\n"), 256).alias("hash")
    )
    level = nodes = checkpointed(ranges.select("replica", "file", F.lit(0).alias("level"), "place", "records", "hash"))
    highest, number = level.agg(F.max("place")).first()[0] or 0, 0
    while highest > 0:
        highest, number = highest // fan_out, number + 1
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))
        text = F.array_join(F.transform(children, lambda c: _joined(c["place"], c["hash"])), "\n")
        level = level.groupBy("replica", "file", F.floor(F.col("place") / fan_out).alias("parent")).agg(
            F.sum("records").alias("records"), F.sha2(text, 256).alias("hash")
        ).select("replica", "file", F.lit(number).alias("level"), F.col("parent").alias("place"), "records", "hash")
        nodes = nodes.unionByName(level)
    return checkpointed(nodes) if number else nodes


def mismatched_ranges(nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, place, ours, theirs): the ranges whose hashes differ between replicas 0 and 1, null where one has none.

    Begins at the roots and goes down only where nodes differ.
    """
    highest = nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    open_nodes = None
    for number in range(highest, -1, -1):
        rows = nodes.where(F.col("level") == number)
        if open_nodes is not None:
            parents = open_nodes.select(F.col("file").alias("_file"), F.col("place").alias("_place"))
            rows = rows.join(
                parents, (F.floor(F.col("place") / fan_out) == F.col("_place")) & F.col("file").eqNullSafe(F.col("_file")), "left_semi"
            )
        open_nodes = rows.groupBy("file", "place").agg(
            F.max(F.when(F.col("replica") == 0, F.col("hash"))).alias("ours"), F.max(F.when(F.col("replica") == 1, F.col("hash"))).alias("theirs")
        ).where(~F.col("ours").eqNullSafe(F.col("theirs")))
    return open_nodes


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, offset, status, our_length, their_length): where two replicas' records differ.

    ``ours`` and ``theirs`` are (file, offset, length, digest). ``status`` is ``changed`` for
    records of one offset that differ in bytes, length or number, ``missing`` where only we
    have one, ``extra`` where only they do. A record that moved is missing at one offset and
    extra at the other. Records of ranges that agree are not compared. Null files and offsets
    are values like others; equal replicas, and empty ones, give no rows. The trees are built
    at once.
    """
    columns = "file", "offset", "length", "digest"
    both = ours.select(F.lit(0).alias("replica"), *columns).unionByName(theirs.select(F.lit(1).alias("replica"), *columns))
    ranges = mismatched_ranges(merkle_nodes(both, range_bytes, fan_out), fan_out)
    ranges = ranges.select(F.col("file").alias("_file"), F.col("place").alias("_place"))
    place = F.coalesce(F.floor(F.col("offset") / range_bytes), F.lit(0))
    rows = both.join(ranges, (place == F.col("_place")) & F.col("file").eqNullSafe(F.col("_file")), "left_semi")
    once = rows.groupBy("replica", *columns).agg(F.count("*").alias("copies"))

    def side(replica: int) -> list[Column]:
        mine = F.col("replica") == replica
        return [
            F.array_sort(F.collect_list(F.when(mine, F.struct("length", "digest", "copies")))), F.max(F.when(mine, F.col("length")))
        ]

    (our, our_length), (their, their_length) = side(0), side(1)
    status = F.when(F.size("their") == 0, "missing").when(F.size("our") == 0, "extra").otherwise("changed")
    return once.groupBy("file", "offset").agg(
        our.alias("our"), their.alias("their"), our_length.alias("our_length"), their_length.alias("their_length")
    ).where(F.col("our") != F.col("their")).select("file", "offset", status.alias("status"), "our_length", "their_length")
