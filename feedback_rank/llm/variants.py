"""Spelling variants by permuterm rotations.

Every word gets an end mark, and every rotation of the marked word is a row. Where a code
point stands at the wrap, a rotation without its last place is the word without that code
point: the rest after it, the mark, the part before it. So two words that differ in one
replaced code point have the same rotation but for its last place, and a word that lacks one
code point of another has a whole rotation that is the other's without its last place. Rows
sorted by this common prefix stand together; one scan of the groups gives each word its
neighbours there. Of equal code points in a row only the last one counts as left out, so
that no pair of words meets twice.

All words of a group are neighbours, but for a few of equal code points in a row, so a group
gives each member a count and its best neighbour, and no pairs. A group holds at most one
word for each code point at the wrap and one without it.

Rotations of words above :data:`LONG` code points are told by four hashes of 31 bits and the
length instead of their text, from running sums, so a word's rows take space and time in
proportion to its length however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import checkpointed

LEAST_POINTS = 7   # code points of a word
LEAST_COUNT = 2    # times it occurs
TIMES = 10         # a form occurs so many times as often
LONG = 64          # code points of words whose rotations are rows of text
MARK = "$"
_WHOLE, _LAST_OF_RUN, _IN_RUN = 0, 1, 2
_MOST_FORMS = 18   # a chain of forms is no longer: each occurs TIMES as often, and counts have 63 bits

# fixed values: letters of words, and those that are lower-cased
_LETTERS = "A-Za-z\\u00C0-\\u00FF"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# primes below 2**31 and a base for each
_PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253), (2147483587, 1566083941), (2147483579, 1664525))


def dented_words(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """(word): every maximal run of letters of every whole text, A to Z in lower case.

    Of every 31st run by the crc32 of ``<doc_id>:<run>`` one code point is left out. What is
    shorter than ``least_points`` then is no word. A null text has none, and a null doc_id
    counts as an empty one. Repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]{{{least_points},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run).select(
        "doc", F.translate("run", _UPPER, _LOWER).alias("run")
    )
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    dented = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % 31 == 0, dented).otherwise(F.col("run")).alias("word")
    return hashed.select(word).where(F.char_length("word") >= least_points)


def _without(word: Column, at: Column, skipped: int) -> Column:
    """The rotation of the marked word that begins ``skipped`` behind ``at`` and ends before it."""
    return F.concat(F.substr(word, at + 1 + skipped), F.lit(MARK), F.substr(word, F.lit(1), at))


def _rotations(words: DataFrame) -> DataFrame:
    """(key, id, n, role) of every rotation, whole and without its last place."""
    word, at, length = F.col("word"), F.col("at"), F.char_length("word")
    placed = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    here, behind = F.substr(word, at + 1, F.lit(1)), F.substr(word, at + 2, F.lit(1))
    role = F.when(here == behind, _IN_RUN).otherwise(_LAST_OF_RUN)
    whole = F.struct(_without(word, at, 0).alias("key"), F.lit(_WHOLE).alias("role"))
    cut = F.when(at < length, F.struct(_without(word, at, 1).alias("key"), role.alias("role")))
    return placed.select("id", "n", F.inline(F.filter(F.array(whole, cut), lambda x: x.isNotNull()))).select("key", "id", "n", "role")


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * pow(base, done, prime) % prime
        done += step
    return out


def _rotation_hashes(points: np.ndarray, skipped: int) -> np.ndarray:
    """For each place the four hashes of :func:`_without`'s rotation, from running sums."""
    n = len(points)
    at = np.arange(n + 1 - skipped)
    out = []
    for prime, base in _PRIMES:
        up, down = _powers(base, n + 2, prime), _powers(pow(base, -1, prime), n + 2, prime)
        sums = np.concatenate([[0], np.cumsum(points * up[:n] % prime) % prime])
        tail = (sums[n] - sums[at + skipped]) % prime * down[at + skipped] % prime
        rest = n - at - skipped
        out.append((tail + ord(MARK) * up[rest] + sums[at] * up[rest + 1]) % prime)
    return np.stack(out, axis=1)


def _long_rotations(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """:func:`_rotations` of words of ``least`` code points or more; of those of just ``least`` the whole ones only."""
    for batch in batches:
        for row_id, n, word in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "word"))):
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
            keys, roles = [_rotation_hashes(points, 0)], [np.full(len(points) + 1, _WHOLE)]
            lengths = [np.full(len(points) + 1, len(points))]
            if len(points) > least:
                keys.append(_rotation_hashes(points, 1))
                roles.append(np.where(np.append(points[1:] == points[:-1], False), _IN_RUN, _LAST_OF_RUN))
                lengths.append(np.full(len(points), len(points) - 1))
            for some, role, length in zip(keys, roles, lengths):
                text = [f"{size}:{a:08x}{b:08x}{c:08x}{d:08x}" for size, (a, b, c, d) in zip(length.tolist(), some.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(text, pa.string()), "id": pa.array([row_id] * len(text), pa.int64()), "n": pa.array([n] * len(text), pa.int64()),
                    "role": pa.array(role, pa.int32()),
                })


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, most frequent first, to (id, near, best_n, best_id) of each word with neighbours in a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        keys = table.column("key")
        new = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            yield _groups(table.slice(0, last), np.concatenate([[0], new[:-1]]))
        held = table.slice(last).to_batches()
    if held:
        yield _groups(pa.Table.from_batches(held), np.zeros(1, np.int64))


def _groups(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    ids, counts, roles = (table.column(c).to_numpy() for c in ("id", "n", "role"))
    sizes = np.diff(np.append(starts, len(ids)))
    several = np.repeat(sizes > 1, sizes)
    ids, counts, roles = ids[several], counts[several], roles[several]
    sizes = sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    place, group, none = np.arange(len(ids)), np.repeat(np.arange(len(sizes)), sizes), len(ids)
    if not len(ids):
        near = best = keep = np.empty(0, np.int64)
    else:
        def first(which: np.ndarray) -> np.ndarray:
            return np.minimum.reduceat(np.where(which, place, none), starts)[group]

        cut, last_of_run = roles != _WHOLE, roles == _LAST_OF_RUN
        whole, top, top_last = first(~cut), first(cut), first(last_of_run)
        second = first(cut & (place != top))
        n_cut, n_last = np.add.reduceat(cut.astype(np.int64), starts)[group], np.add.reduceat(last_of_run.astype(np.int64), starts)[group]
        beside = np.where(place == top, second, top)
        below = np.where(last_of_run, whole, none)
        best = np.where(cut, np.minimum(beside, below), top_last)
        near = np.where(cut, n_cut - 1 + (below < none), n_last)
        keep = np.flatnonzero(near)
        best, near = best[keep], near[keep]
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids[keep], pa.int64()), "near": pa.array(near, pa.int64()),
        "best_n": pa.array(counts[best], pa.int64()), "best_id": pa.array(ids[best], pa.int64()),
    })


def _roots(links: DataFrame) -> DataFrame:
    """(id, form_id, root_id): the last of each chain, whose known part doubles each round."""
    reached = checkpointed(links.withColumn("root_id", F.col("form_id")))
    hops = 1
    while hops < _MOST_FORMS:
        ahead = reached.select(F.col("id").alias("at"), F.col("root_id").alias("ahead"))
        moved = checkpointed(reached.join(ahead, F.col("root_id") == F.col("at"), "left").select("id", "form_id", "root_id", "ahead"))
        if moved.where("ahead IS NOT NULL").isEmpty():
            break
        reached = moved.select("id", "form_id", F.coalesce("ahead", "root_id").alias("root_id"))
        hops *= 2
    return reached


def spelling_variants(words: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of each distinct word that occurs ``least_count`` times or more.

    ``words`` has a row for each occurrence, in a column ``word``; null is none. Two words are near
    that differ in exactly one inserted, deleted or replaced code point; ``n_near`` counts the
    near ones, 0 if none. ``form`` is the near word of the largest n, ties to the smallest by code point, if it occurs
    at least ``times`` times as often, else null; ``root`` is where following forms ends. Words of
    any length and with any code points but the mark are taken; an empty table gives no rows.
    Runs its jobs at once.
    """
    counted = words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    numbered = number_rows(counted, [F.col("word")], name="id")  # ids in the order of the words
    length = F.char_length("word")
    longer = numbered.where(length >= long).select("id", "n", "word").mapInArrow(
        lambda batches: _long_rotations(batches, long), "key string, id long, n long, role int"
    )
    rotations = _rotations(numbered.where(length <= long)).unionByName(longer)
    sorted_rows = rotations.repartition("key").sortWithinPartitions("key", F.desc("n"), "id")
    found = sorted_rows.mapInArrow(_scanned, "id long, near long, best_n long, best_id long")
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("best_id"))).alias("best")
    near = checkpointed(found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select(
        "id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.best_id")).alias("best_id")
    ))
    known = numbered.select("id", "word", "n").join(near, "id", "left")
    links = known.where(F.col("best_n") >= times * F.col("n")).select("id", F.col("best_id").alias("form_id"))
    form = numbered.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = numbered.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = _roots(links).join(form, "form_id").join(root, "root_id").select("id", "form", "form_n", "root")
    return known.join(named, "id", "left").select(
        "word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).alias("n_near")
    )
