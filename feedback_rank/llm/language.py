"""Language of whole texts, by spans: script ranges, scores of words, Viterbi.

Words are runs of letters. The script of a word's first letter narrows the languages to
those that were seen in that script; each of these scores the word by its letter
trigrams; a Viterbi pass with a penalty for each change of language labels the words.
Runs of words of one label are the spans of a mixed text, and the language with the most
letters is the text's own.

The model is the trigrams' counts by language over all labelled documents, hashed to a
fixed number of buckets and summed by Spark, so its size is that of the languages, not
of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import in_small_batches, lean, text_slices

BUCKETS = 1 << 16
MOST_LANGUAGES = 1_000  # more labels than this are an error: the model is sent to every task
PENALTY = 8.0           # of a change of language, in natural logarithms
PIECE = 40              # letters after which a run without a break is parted, as in scripts without spaces
SCRIPT_SHARE = 0.001    # of a language's letters that make a script one of its own
LETTER_BYTES = 500_000      # text taken apart at once
SCORES_AT_ONCE = 2_000_000  # scores of words by language labelled at once, or those of one longer text
UNKNOWN = "und"
LEAST_LETTERS = 20      # a text of fewer is too short to say that it is no language
LEAST_SOUND = 0.5       # share of a text's letters in sound spans, from which on it is in known languages

# fixed values: where scripts lie, by their first and last code points
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_OTHER = len(SCRIPTS)  # the script of all further letters


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter, 0 for what is none, and the script."""
    folded = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            folded[i] = ord(low) if len(low) == 1 else i
    script = np.full(0x110000, _OTHER, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first:last + 1] = number
    return folded, script


class _Letters:
    """The words of a few texts: their trigrams' buckets, and where each word begins and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        folded, scripts = _letters()
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        # where texts begin, in code points: bytes that do not continue one
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        letters = folded[points]
        inside = letters > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = at[:-1][at[:-1] < len(points)]
        begins[edges] = inside[edges]
        places = np.flatnonzero(inside)
        run = np.cumsum(begins[places]) - 1
        starts = np.flatnonzero(begins[places])
        offset = np.arange(len(places)) - starts[run] if len(starts) else np.empty(0, np.int64)
        cut = offset % PIECE == 0  # word starts, with those of the parts of very long runs
        self.starts = np.flatnonzero(cut)                    # among the letters
        self.lengths = np.diff(np.append(self.starts, len(places)))
        self.bounds = np.searchsorted(places[self.starts], at)  # words of each text
        self.scripts = scripts[points[places[self.starts]]]

        # around each letter: the one before and after it in the same run, else 0
        own = letters[places].astype(np.uint64)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:] = np.where(offset[1:] > 0, own[:-1], 0)
        after[:-1] = np.where(offset[1:] > 0, own[1:], 0)
        mix = (before * np.uint64(0x110000) + own) * np.uint64(0x110000) + after
        mix *= np.uint64(0x9E3779B97F4A7C15)
        self.buckets = (mix >> np.uint64(48)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) to (lang, kind, place, n): trigrams by bucket and letters by script, of a task."""
    trigrams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, upto, data, bounds in text_slices(batch.column(1), LETTER_BYTES):
            found = _Letters(data, bounds)
            of_text = langs[first:upto]
            words = np.diff(found.bounds)
            for lang in set(of_text.tolist()):
                mine = np.repeat(of_text == lang, words)
                in_bucket = np.bincount(found.buckets[np.repeat(mine, found.lengths)] % buckets, minlength=buckets)
                in_script = np.bincount(found.scripts[mine], found.lengths[mine], _OTHER + 1).astype(np.int64)
                for counts, new in ((trigrams, in_bucket), (scripts, in_script)):
                    counts[lang] = counts[lang] + new if lang in counts else new
    for kind, counts in enumerate((trigrams, scripts)):
        for lang, n in counts.items():
            places = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(places), pa.string()), "kind": pa.array([kind] * len(places), pa.int32()),
                "place": pa.array(places, pa.int32()), "n": pa.array(n[places], pa.int64()),
            })


class LanguageModel:
    """Log-probabilities of trigram buckets by language, and which scripts a language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smoothed = counts + 0.5
        logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.logs = np.ascontiguousarray(logs.T, dtype=np.float32)  # buckets by languages
        # what a letter of the language's own texts reaches, what one of any letters does, and half-way between
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.sound = ((share * logs).sum(axis=1) + logs.mean(axis=1)) / 2
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        written = (share >= SCRIPT_SHARE).T  # scripts by languages
        self.taught = written.any(axis=1)
        written[~self.taught] = True  # a script nobody was seen in narrows nothing
        self.barred = np.where(written, 0, -1e6).astype(np.float32)

    def word_scores(self, found: _Letters) -> np.ndarray:
        """By word and language: its letters' log-probabilities, of candidates by the word's script."""
        out = np.empty((len(found.starts), len(self.langs)), dtype=np.float32)
        step = max(1, (1 << 22) // max(1, len(self.langs)))  # letters at once
        ends = found.starts + found.lengths
        at = 0
        while at < len(out):
            upto = max(at + 1, int(np.searchsorted(ends, found.starts[at] + step)))
            first, last = found.starts[at], ends[upto - 1]
            scores = self.logs[found.buckets[first:last] % len(self.logs)]
            out[at:upto] = np.add.reduceat(scores, found.starts[at:upto] - first, axis=0)
            at = upto
        return out + self.barred[found.scripts]

    def labels(self, scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
        """The language of each word on the best path through its text; ``bounds`` are the texts' words.

        Texts go side by side, the t-th word of all of them at once, longer texts first.
        A path stays in its language or pays to come from the best one.
        """
        counts = np.diff(bounds)
        order = np.argsort(-counts, kind="stable")
        counts, begins = counts[order], bounds[:-1][order]
        labels = np.zeros(len(scores), dtype=np.int16)
        if not len(scores):
            return labels
        stays = np.zeros(scores.shape, dtype=bool)   # the path to this word in this language stayed in it
        best_before = np.zeros(len(scores), dtype=np.int16)
        active = len(counts) - np.searchsorted(counts[::-1], np.arange(1, counts[0] + 1))
        path = scores[begins[:active[0]]].copy()
        finals = np.zeros((len(counts), scores.shape[1]), dtype=np.float32)
        for t in range(1, int(counts[0])):
            n = int(active[t])
            if n < len(path):
                finals[n:len(path)] = path[n:]
                path = path[:n]
            at = begins[:n] + t
            top = path.argmax(axis=1)
            entry = path[np.arange(n), top] - penalty
            stayed = path >= entry[:, None]
            stays[at], best_before[at] = stayed, top
            path = np.where(stayed, path, entry[:, None]) + scores[at]
            path -= path.max(axis=1, keepdims=True)  # long texts stay within the numbers' range
        finals[:len(path)] = path
        here = finals.argmax(axis=1)
        for t in range(int(counts[0]) - 1, -1, -1):
            n = int(active[t])
            at = begins[:n] + t
            labels[at] = here[:n]
            if t:
                here[:n] = np.where(stays[at, here[:n]], here[:n], best_before[at])
        return labels


def train_language_model(labelled: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
    """The model from (lang, text): rows without language or text teach nothing.

    One pass over all texts; every task adds up its own, and Spark adds up the tasks. No
    labelled row gives a model without languages. More than MOST_LANGUAGES labels raise an error.
    """
    rows = in_small_batches(labelled).select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(lean(_counted, buckets), "lang string, kind int, place int, n long")
    summed = counted.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).groupBy("lang", "kind").agg(
        F.collect_list(F.struct("place", "n")).alias("counts")  # no more than there are buckets
    )
    langs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in summed.toLocalIterator():
        if row.lang not in langs:
            if len(langs) >= MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            langs[row.lang] = (np.zeros(buckets, np.int64), np.zeros(_OTHER + 1, np.int64))
        places, n = zip(*row.counts)
        langs[row.lang][row.kind][list(places)] = n
    names = sorted(langs)
    return LanguageModel(
        names, np.array([langs[x][0] for x in names], np.float64).reshape(len(names), buckets),
        np.array([langs[x][1] for x in names], np.float64).reshape(len(names), _OTHER + 1),
    )


def _found(column: pa.Array, model: LanguageModel, penalty: float) -> tuple[list[str], list[float], list[list[dict]], list[bool]]:
    """(languages, shares of letters, spans, whether in known languages) of all texts of a batch."""
    langs: list[str] = []
    shares: list[float] = []
    spans: list[list[dict]] = []
    known: list[bool] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for _, _, data, bounds in text_slices(column, LETTER_BYTES):
        found = _Letters(data, bounds)
        held.append((found.lengths, np.diff(found.bounds), model.word_scores(found), found.scripts))
        if sum(scores.size for _, _, scores, _ in held) > SCORES_AT_ONCE:
            _label(held, model, penalty, langs, shares, spans, known)
    _label(held, model, penalty, langs, shares, spans, known)
    return langs, shares, spans, known


def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel, penalty: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, shares, spans, _ = _found(batch.column(1), model, penalty)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, schema.field(3).type)], schema=schema
        )


def _label(
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], model: LanguageModel, penalty: float,
    langs: list[str], shares: list[float], spans: list[list[dict]], known: list[bool],
) -> None:
    """Add the results for the texts held, (letters by word, words by text, scores, scripts), and let go of them."""
    if not held:
        return
    lengths, words, scores, scripts = (np.concatenate(part) for part in zip(*held))
    held.clear()
    texts, size = len(words), len(model.langs)
    if not size:
        langs += [UNKNOWN] * texts
        shares += [0.0] * texts
        spans += [[]] * texts
        known += [False] * texts
        return
    labels = model.labels(scores, np.concatenate([[0], np.cumsum(words)]), penalty).astype(np.int64)
    of_text = np.repeat(np.arange(texts), words)
    letters = np.bincount(of_text * size + labels, lengths, texts * size).reshape(texts, size)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    langs += [model.langs[i] if n else UNKNOWN for i, n in zip(top.tolist(), total.tolist())]
    shares += (letters.max(axis=1) / np.maximum(total, 1)).tolist()
    # spans: runs of words of a text with one label
    new = np.ones(len(labels), dtype=bool)
    new[1:] = (labels[1:] != labels[:-1]) | (of_text[1:] != of_text[:-1])
    heads = np.flatnonzero(new)
    known += _in_known(model, lengths, scores, scripts, labels, of_text, new, texts).tolist()
    mine: list[list[dict]] = [[] for _ in range(texts)]
    for at, n in zip(heads.tolist(), np.diff(np.append(heads, len(labels))).tolist()):
        mine[of_text[at]].append({"lang": model.langs[labels[at]], "words": n})
    spans += mine


def _in_known(
    model: LanguageModel, lengths: np.ndarray, scores: np.ndarray, scripts: np.ndarray, labels: np.ndarray, of_text: np.ndarray,
    new: np.ndarray, texts: int,
) -> np.ndarray:
    """Whether half or more of each text's letters lie in sound spans, see :func:`in_known_languages`."""
    if not len(labels):
        return np.zeros(texts, dtype=bool)
    taught = model.taught[scripts]
    span, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    letters = np.bincount(span, lengths * taught)
    own = np.take_along_axis(scores, labels[:, None], axis=1)[:, 0]
    own[~taught] = 0
    reached = np.bincount(span, own)
    sound = reached >= model.sound[labels[heads]] * letters
    total, taught_letters = np.bincount(of_text, lengths, texts), np.bincount(of_text, lengths * taught, texts)
    in_sound = np.bincount(of_text[heads], letters * sound, texts)
    enough = np.where(total < LEAST_LETTERS, taught_letters, in_sound)
    return (total > 0) & (enough >= LEAST_SOUND * total)


def predict_language(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans): every document with its language.

    ``score`` is the share of the letters that the language has; ``spans`` are the runs of
    words of one language, in order. A text that is null or without letters has ``und``,
    score 0 and no spans; so has every text under a model without languages. Of languages
    with equally many letters the first by name is taken. Repeated rows stay, other columns
    are left out, and nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = narrow.select(
        "doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
        F.lit(None).cast("array<struct<lang: string, words: int>>").alias("spans"),
    ).schema
    for field in schema.fields:
        field.nullable = True
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return narrow.mapInArrow(lambda batches: _predicted(batches, shared.value, penalty, arrow), schema)


def in_known_languages(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` that are in languages of the model, one or several in any shares; the columns stay.

    A text stays if at least LEAST_SOUND of its letters lie in sound spans. A span, as
    :func:`predict_language` finds them, is sound if its letters reach, on average, under the language of
    the span, at least half-way from what letters at random have (the mean of the language's
    log-probabilities over all buckets) to what the language's own texts have (their mean over
    its trigrams). Letters of scripts that are no language's own never are sound. A text of fewer than
    LEAST_LETTERS letters is too short for that and stays if half of them are of a script taught. So what goes is: texts
    that are null, empty or without letters, scripts nobody taught, letters at random; all under a model
    without languages. Very long texts count whole; repeated rows each stay or go; nothing is shuffled.
    """
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_found(batch.column(text_at), shared.value, penalty)[3], pa.bool_()))

    return in_small_batches(docs).mapInArrow(lean(kept), docs.schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
