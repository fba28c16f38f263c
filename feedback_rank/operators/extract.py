"""Feature requests out of the feedback texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.functions.names import free_names
from feedback_rank.functions.text import sentence_windows, words
from feedback_rank.operators.calls import IN_FLIGHT, LANE_CALLS, RETRY_WAITS, call_chunks
from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import Scratch, written

CHUNK_SIZE = 250  # fixed value: texts per call
PACK_TEXTS = 2000  # texts that are packed into chunks together
GRAM_WORDS = 4


def _grams(tokens: Column, length: int) -> Column:
    """The hash of every run of ``length`` words, with its place, from 1."""
    starts = F.sequence(F.lit(1), F.size(tokens) - length + 1)
    found = F.transform(starts, lambda at: F.struct(
        at.alias("at"), F.xxhash64(F.lit(length), F.slice(tokens, at, length)).alias("gram")
    ))
    none = F.array().cast("array<struct<at:int,gram:bigint>>")
    return F.when(F.size(tokens) >= length, found).otherwise(none)


def phrase_keys(phrases: DataFrame) -> DataFrame:
    """(feature, phrase) to (feature, phrase_words, gram, gram_words, gram_at).

    The key of a phrase is the hash of its run of words (at most four) that the fewest
    other phrases hold, so that a common opening does not put all phrases on one key.
    """
    split = (
        phrases.select("feature", words(F.col("phrase")).alias("phrase_words"))
        .where(F.size("phrase_words") > 0)
        .distinct()
        .withColumn("gram_words", F.least(F.size("phrase_words"), F.lit(GRAM_WORDS)))
    )
    by_length = F.lit(None).cast("array<struct<at:int,gram:bigint>>")
    for length in range(1, GRAM_WORDS + 1):
        by_length = F.when(F.col("gram_words") == length, _grams(F.col("phrase_words"), length)).otherwise(by_length)
    grams = split.select("feature", "phrase_words", "gram_words", F.inline(by_length).alias("gram_at", "gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("_phrases"))
    rarest = Window.partitionBy("feature", "phrase_words").orderBy("_phrases", "gram_at")
    return (
        grams.join(counts, "gram")
        .withColumn("_n", F.row_number().over(rarest))
        .where(F.col("_n") == 1)
        .select("feature", "phrase_words", "gram", "gram_words", "gram_at")
    )


def extract_mentions(feedback: DataFrame, phrases: DataFrame) -> DataFrame:
    """A mention for each feedback text that holds a phrase of a feature, whole words only.

    ``phrases`` is (feature, phrase). Each text gives the hashes of its runs of words, in
    rows of two keys, a place and a hash, however long the text is; these meet the keys of
    the phrases in one join, which the optimizer broadcasts or sorts by what it measures.
    Hits go back to their texts, and the whole phrase is checked on the words around. A text
    is known by hashes of all that makes up its mention, so ids may be null or repeated.
    Which lengths of runs the phrases need, at most four, is looked up at once.
    """
    keys = phrase_keys(phrases)
    lengths = sorted(row["gram_words"] for row in keys.select("gram_words").distinct().collect())

    columns = "insight_id", "account_name", "platform_client_id", "mrr"
    named = feedback.where(C.nonblank(F.col("feedback"))).select(
        *columns, "feedback", F.xxhash64(F.lit(1), *columns, "feedback").alias("_key"),
        F.xxhash64(F.lit(2), "feedback", *columns).alias("_key2"),
    )
    tokens = words(F.col("feedback"))
    none = F.array().cast("array<struct<at:int,gram:bigint>>")
    grams = named.select("_key", "_key2", tokens.alias("_words")).select(
        "_key", "_key2", F.inline(F.concat(none, *[_grams(F.col("_words"), n) for n in lengths])).alias("at", "gram")
    )
    start = F.col("at") - F.col("gram_at") + 1
    hits = grams.join(keys, "gram").where(start >= 1).select("_key", "_key2", "feature", "phrase_words", start.alias("_start"))
    texts = named.select(
        *columns, "_key", "_key2", C.truncate(F.col("feedback"), C.SAMPLE_LENGTH).alias("sample"),
        F.xxhash64("feedback").alias("sample_key"), tokens.alias("_words"),
    )
    whole = F.slice("_words", F.col("_start"), F.size("phrase_words")) == F.col("phrase_words")
    return texts.join(hits, ["_key", "_key2"]).where(whole).select(
        "insight_id", "feature", "account_name", "platform_client_id", "mrr", "sample", "sample_key"
    ).distinct()


def normalize_phrases(mentions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Replace a feature by its canonical English form, where ``synonyms`` has one.

    ``synonyms`` is (phrase, canonical); phrases are compared by their words, so
    case and punctuation do not matter. Of two forms for one phrase the smaller
    is taken.
    """
    forms = (
        synonyms.select(F.array_join(words(F.col("phrase")), " ").alias("_phrase"), "canonical")
        .groupBy("_phrase")
        .agg(F.min("canonical").alias("_canonical"))
    )
    keyed = mentions.withColumn("_phrase", F.array_join(words(F.col("feature")), " "))
    return (
        keyed.join(forms, "_phrase", "left")
        .withColumn("feature", F.coalesce("_canonical", "feature"))
        .select(*mentions.columns)
    )


def assign_chunks(feedback: DataFrame, chunk_size: int = CHUNK_SIZE, then: Sequence[str] = ()) -> DataFrame:
    """Add ``chunk_id``: ``chunk_size`` rows each, newest first, all columns kept.

    Rows of one time and id are ordered by the columns ``then``. A column ``chunk_id`` of the
    caller's is replaced. Numbers the rows at once.
    """
    (n,) = free_names(feedback.columns, "n")
    numbered = number_rows(feedback, [F.desc("created_at"), F.col("insight_id"), *map(F.col, then)], name=n)
    return numbered.select(
        *[c for c in feedback.columns if c != "chunk_id"], F.floor((F.col(n) - 1) / chunk_size).alias("chunk_id")
    )


def _windows(length: int, overlap: int, first_only: bool = False) -> Column:
    if not 0 <= overlap < length:
        raise ValueError("overlap must be at least 0 and below the length")
    if first_only:
        return F.array(F.struct(F.lit(0).alias("start"), F.lit(length).alias("stop")))
    return sentence_windows(F.col("feedback"), length, overlap)


def _line(window: Column) -> Column:
    text = F.substr("feedback", window["start"] + 1, window["stop"] - window["start"])
    return C.prompt_line(F.col("account_name"), F.col("platform_client_id"), F.col("mrr"), text)


def prompt_lines(
    feedback: DataFrame, length: int = C.PROMPT_TEXT_LENGTH, overlap: int = C.PROMPT_OVERLAP, first_only: bool = False
) -> DataFrame:
    """Texts that are not blank as prompt lines: (insight_id, created_at, part, line).

    A text has a line for each of its windows of at most ``length`` characters, which end
    where sentences end (see :func:`sentence_windows`): every sentence of up to ``length``
    characters is whole in a line, and the lines of a text share a sentence where there is room. Only a
    longer sentence is cut, into pieces that share ``overlap`` characters. ``first_only`` cuts the text instead.
    """
    windows = feedback.where(C.nonblank(F.col("feedback"))).select(
        "insight_id", "created_at", "account_name", "platform_client_id", "mrr", "feedback",
        F.posexplode(_windows(length, overlap, first_only)).alias("part", "window"),
    )
    return windows.select("insight_id", "created_at", (F.col("part") + 1).alias("part"), _line(F.col("window")).alias("line"))


def _packed(sizes: Column, room: int) -> Column:
    """Sizes in order, as (n, lines), into chunks of ``room`` lines: (used chunks, lines in the last, and of each n its first chunk)."""

    def state(chunk: Column, used: Column, placed: Column) -> Column:
        return F.struct(chunk.cast("long").alias("chunk"), used.cast("long").alias("used"), placed.alias("placed"))

    def add(s: Column, text: Column) -> Column:
        fits = s["used"] + text["lines"] <= room
        first = F.when(fits | (s["used"] == 0), s["chunk"]).otherwise(s["chunk"] + 1)
        more = F.floor((text["lines"] - 1) / room)  # chunks that a long text fills
        return state(
            first + F.when(fits, 0).otherwise(more), F.when(fits, s["used"] + text["lines"]).otherwise(text["lines"] - more * room),
            F.concat(s["placed"], F.array(F.struct(text["n"].alias("n"), first.alias("first")))),
        )

    none = F.array().cast("array<struct<n:bigint,first:bigint>>")
    return F.aggregate(sizes, state(F.lit(0), F.lit(0), none), add)


def chunked_lines(
    feedback: DataFrame, chunk_size: int = CHUNK_SIZE, length: int = C.PROMPT_TEXT_LENGTH, overlap: int = C.PROMPT_OVERLAP,
    pack_texts: int = PACK_TEXTS, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "numbered-texts"),
) -> DataFrame:
    """The prompt lines in chunks of at most ``chunk_size``, newest first: (chunk_id, lines, n_lines).

    ``lines`` is one text. A text's lines are kept in one chunk where they fit in one: a text that
    does not fit behind those before it begins the next chunk, and one of more lines fills chunks of its own.
    ``pack_texts`` texts each are packed by themselves, which is what one task sees at once, as
    numbers; so at most every so many texts a chunk is not full. Texts meet the places of their pack, which
    has all chunks that they go to, so they are moved once for both. ``keep`` writes the sorted texts. Runs jobs at once.
    """
    names = ["insight_id", "created_at", "account_name", "platform_client_id", "mrr", "feedback"]
    texts = feedback.where(C.nonblank(F.col("feedback"))).select(*names)
    order = [F.desc("created_at"), *(F.col(c) for c in names if c != "created_at")]
    placed = number_rows(texts, order, name="n", keep=keep, then={"windows": _windows(length, overlap)})
    numbered = placed.withColumn("block", F.floor((F.col("n") - 1) / pack_texts))
    sizes = numbered.select("n", F.size("windows").cast("long").alias("lines"), "block")
    packs = sizes.groupBy("block").agg(_packed(F.array_sort(F.collect_list(F.struct("n", "lines"))), chunk_size).alias("pack"))
    # one row per pack
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = packs.select(
        "block", F.coalesce(F.sum(F.col("pack.chunk") + 1).over(before), F.lit(0)).alias("before"), F.col("pack.placed").alias("placed")
    )
    # a pack's texts have the numbers one after the other
    first = F.col("before") + F.get("placed", (F.col("n") - 1 - F.col("block") * pack_texts).cast("int"))["first"]
    lines = numbered.join(places, "block").select("n", "block", first.alias("first"), *names, "windows").select(
        "n", "block", "first", *names, F.posexplode("windows").alias("part", "window")
    )
    chunk = (F.col("first") + F.floor(F.col("part") / chunk_size)).alias("chunk_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "part", "line"))), lambda x: x["line"])
    return lines.select("n", "block", "part", _line(F.col("window")).alias("line"), chunk).groupBy("block", "chunk_id").agg(
        F.array_join(ordered, "\n").alias("lines"), F.count("*").alias("n_lines")
    ).drop("block")


def extract_plugin(
    feedback: DataFrame,
    fn: Callable[[str], str],
    chunk_size: int = CHUNK_SIZE,
    waits: Sequence[float] = RETRY_WAITS,
    sleep: Callable[[float], None] = time.sleep,
    ledger: str | None = None,
    label: str = "",
    in_flight: int = IN_FLIGHT,
    lane_calls: int = LANE_CALLS,
    on_progress: Callable[[float], None] | None = None,
) -> DataFrame:
    """Call ``fn`` with the prompt lines of each chunk: (chunk_id, status, error, payload).

    ``fn`` takes the lines as one text and returns payload text; ``chunk_size`` counts lines,
    of which a long text has several (see :func:`chunked_lines`). ``in_flight`` chunks are called
    at once; one whose call fails is a row with status 'failed'. All calls are made now and kept in a
    ledger, so the result can be read often; with a ``ledger`` of the caller's, a later run calls
    only what is missing or failed (see :func:`call_chunks`).
    """
    with Scratch(feedback.sparkSession) as scratch:
        chunks = chunked_lines(feedback, chunk_size, keep=scratch.written)
        return call_chunks(chunks, fn, ledger, label, in_flight, lane_calls, waits, sleep, on_progress, once_read=scratch.close)
