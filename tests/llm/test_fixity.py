"""Audits against comparing all records; trees against plain hashing; nulls, ties and empty replicas."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedback_rank.llm.fixity import audit, fixity, laid_out, merkle_nodes, mismatched_ranges, warc_records

SCHEMA = "file long, offset long, length long, digest string"


def replica(seed, n=400):
    rng, rows, offset = random.Random(seed), [], {}
    for _ in range(n):
        file = rng.choice([0, 0, 0, 1, None])
        length = rng.randrange(0, 900)
        rows.append((file, offset.get(file, 0), length, f"d{rng.randrange(10**9)}"))
        offset[file] = offset.get(file, 0) + max(length, 1)
    return rows


def plain(ours, theirs):
    found = []
    for file, offset in {r[:2] for r in ours + theirs}:
        a, b = ([r[2:] for r in rows if r[:2] == (file, offset)] for rows in (ours, theirs))
        if sorted(a, key=str) != sorted(b, key=str):
            status = "missing" if not b else "extra" if not a else "changed"
            lengths = [max((x[0] for x in side if x[0] is not None), default=None) for side in (a, b)]
            found.append((file, offset, status, *lengths))
    return sorted(found, key=str)


@pytest.mark.parametrize("range_bytes,fan_out", [(1 << 16, 16), (2000, 4)])
def test_audit_equals_plain(spark, range_bytes, fan_out):
    ours = replica(1)
    theirs = [r for i, r in enumerate(ours) if i % 60]
    theirs[7] = (*theirs[7][:3], "other")
    theirs[70] = (*theirs[70][:2], 1, "shorter")
    theirs += [(0, 10**6, 5, "far"), (9, 0, 5, "new file"), theirs[3], (0, None, None, None)]
    ours += [ours[5]] * 2 + [(1, None, 3, None)]
    frames = [spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", status string") for rows in (ours, theirs)]
    found = audit(*frames, range_bytes=range_bytes, fan_out=fan_out).collect()
    assert sorted(map(tuple, found), key=str) == plain(ours, theirs)


def test_equal_and_empty_replicas(spark):
    frame = spark.createDataFrame(replica(2), SCHEMA)
    assert audit(frame, frame.repartition(3), 3000, 4).count() == 0
    assert audit(frame.limit(0), frame.limit(0)).count() == 0
    assert audit(frame, frame.limit(0)).count() == len({r[:2] for r in replica(2)})


def test_tree_and_descent(spark):
    ours = [(0, 100 * i, 100, f"d{i}") for i in range(64)]
    theirs = ours[:40] + [(0, 4000, 100, "bad")] + ours[41:]
    frames = [spark.createDataFrame(rows, SCHEMA).withColumn("replica", F.lit(i)) for i, rows in enumerate((ours, theirs))]
    both = merkle_nodes(frames[0].unionByName(frames[1]), 100, 4)
    nodes = {(r.level, r.place): r.hash for r in both.where("replica = 0").collect()}
    assert len(nodes) == 64 + 16 + 4 + 1
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert nodes[0, 3] == sha(f"{300:020d}:100:d3:1")
    for level in (1, 2, 3):
        for place in range(64 // 4**level):
            assert nodes[level, place] == sha("\n".join(f"{c}:{nodes[level - 1, c]}" for c in range(4 * place, 4 * place + 4)))
    assert [(r.file, r.place) for r in mismatched_ranges(both, 4).collect()] == [(0, 40)]


def test_records_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "<p>é"), (1, "http://a", "<p>é"), (2, None, None), (None, "u", ""), (1500, "u", "x" * 2_000_000)], "page_id long, url string, html string"
    )
    rows = warc_records(pages).collect()
    assert len(rows) == 5 and sorted(r.file for r in rows)[1:] == [0, 0, 0, 1] and min(r.file for r in rows) < 0
    one = bytes(next(r.record for r in rows if r.page_id == 1))
    assert one == b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://a\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\n" + "<p>é".encode() + b"\r\n\r\n"
    records = warc_records(pages)
    length, digest = fixity(records["record"])
    narrow = records.select("file", "page_id", length.alias("length"), digest.alias("digest"))
    placed = laid_out(narrow, ["page_id", "digest"]).where("file = 0").orderBy("offset").collect()
    assert [r.offset for r in placed] == [0, len(one), 2 * len(one)] and placed[0].digest == hashlib.sha256(one).hexdigest()
