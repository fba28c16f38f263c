"""A hidden Markov language model of words, and the unigram scores it is measured against.

Every training word is counted. The most frequent words are symbols of their own; all
others emit the symbol of their class, told from their last letters, and within the class
the word by its own count. Baum-Welch (Baum et al. 1970) trains states on the symbols of
all training documents: each task adds up the expected starts, transitions and emissions of
its part, Spark adds up the tasks, and only those sums, bounded by states and symbols,
reach the driver. A start from a bounded sample breaks the symmetry of the states. A text
is scored by the scaled forward recursion over its whole sequence (Rabiner 1989), which
gives its likelihood, summed over all paths, exactly.

Words are 64-bit hashes. Their counts are a table as large as the vocabulary: its frequent
end, at most FREQUENT words, is known to every task, and all other words are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import Words, in_small_batches, mixed, word_slices
from feedback_rank.session import checkpointed

STATES = 8
SYMBOLS = 4096          # words that are symbols of their own
CLASSES = 1024          # symbols of all other words
FREQUENT = 1 << 19      # words at most whose counts are sent to every task
ROUNDS = 3              # of Baum-Welch over all training documents
SEGMENT = 1024          # words of a document trained on at once; scoring takes whole documents
START_SEGMENTS = 1_000  # of the sample for the start, about so many
START_ROUNDS = 25
SEED = 11
_HELD = 1 << 20         # distinct words a task counts before it hands them on
_TOKENS = 1 << 20       # tokens worked on at once


def _classes(words: Words) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    last = words.data[words.ends - 1].astype(np.uint64)
    second = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    third = np.where(words.ends - words.starts > 2, words.data[np.maximum(words.ends - 3, 0)], 0).astype(np.uint64)
    return (mixed(last | second << np.uint64(8) | third << np.uint64(16)) % np.uint64(CLASSES)).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, class, n), each word of a task once, or now and then again."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, classes, n = (np.concatenate(x) for x in zip(*held))
        keys, first, which = np.unique(words, return_index=True, return_inverse=True)
        return keys, classes[first], np.bincount(which, n).astype(np.int64)

    def rows(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        words, classes, n = part
        return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "class": pa.array(classes), "n": pa.array(n)})

    for batch in batches:
        for _, _, words in word_slices(batch.column(0)):
            keys, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((keys, _classes(words)[first], n))
            if sum(len(k) for k, _, _ in held) > 2 * _HELD:
                held[:] = [merged()]
                if len(held[0][0]) > _HELD:
                    yield rows(held.pop())
    if held:
        yield rows(merged())


@dataclass
class Vocabulary:
    """What every task knows of the words: the frequent ones' counts, the symbols, the classes' sizes."""

    words: np.ndarray      # hashes of frequent words, sorted
    counts: np.ndarray
    symbols: np.ndarray    # by frequent word its symbol, -1 for those without
    n_symbols: int         # words that are symbols; the classes follow, then the end
    class_logs: np.ndarray  # log10 of each class's words, counted as the unigram scores count them
    tokens: int            # all training tokens
    kinds: int             # all distinct ones
    ends: int              # training documents

    @property
    def alphabet(self) -> int:
        return self.n_symbols + CLASSES + 1


def count_words(texts: DataFrame) -> DataFrame:
    """(word, class, n): each word of all ``texts`` (text), as a hash, with its class and count."""
    counted = texts.select(F.col("text").cast("string")).mapInArrow(_counted, "word long, class int, n long")
    return checkpointed(counted.groupBy("word", "class").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, ends: int, frequent: int = FREQUENT, symbols: int = SYMBOLS) -> Vocabulary:
    """The bounded part of the counts. ``ends`` are the documents counted."""
    octave = F.floor(F.log2("n") * 16).cast("int").alias("octave")
    octaves = sorted(counts.groupBy(octave).agg(F.count("*"), F.sum("n")).collect(), reverse=True)
    total, kinds = sum(r[2] for r in octaves), sum(r[1] for r in octaves)
    least, many = None, 0
    for row in octaves:
        many += row[1]
        if many > frequent:
            break
        least = row[0]
    top = counts.where(F.floor(F.log2("n") * 16) >= least) if least is not None else counts.limit(0)
    top = top.toArrow()  # no more than ``frequent`` rows
    words, n, of = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["class"].to_numpy()
    order = np.argsort(words)
    words, n, of = words[order], n[order], of[order]
    own = np.lexsort((words, -n))[:symbols]
    symbol = np.full(len(words), -1, dtype=np.int32)
    symbol[own] = np.arange(len(own))
    sizes = np.zeros(CLASSES)
    for row in counts.groupBy("class").agg((F.sum("n") + F.count("*")).alias("size")).collect():
        sizes[row["class"]] = row["size"]
    np.subtract.at(sizes, of[own], n[own] + 1)
    return Vocabulary(words, n, symbol, len(own), np.log10(sizes + 1), total + ends, kinds + (ends > 0), ends)


_ENCODED = "doc_id {}, learned boolean, n_tokens long, n_known long, base_log double, class_log double, symbols binary, rare array<bigint>"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    logs = np.log10(vocabulary.counts + 1.0)
    end = vocabulary.alphabet - 1
    for batch in batches:
        for first, upto, words in word_slices(batch.column(2)):
            texts, bounds = upto - first, words.bounds
            of = np.repeat(np.arange(texts), words.counts)
            hashes = words.hashes()
            keys, which = np.unique(hashes, return_inverse=True)
            at = np.searchsorted(vocabulary.words, keys)
            found = np.zeros(len(keys), dtype=bool)
            if len(vocabulary.words):
                at = np.minimum(at, len(vocabulary.words) - 1)
                found = vocabulary.words[at] == keys
            symbol = np.where(found, vocabulary.symbols[at] if len(vocabulary.words) else -1, -1)[which]
            log = np.where(found, logs[at] if len(vocabulary.words) else 0.0, 0.0)[which]
            known, classes = found[which], _classes(words)
            in_class = symbol < 0
            sequence = np.where(in_class, vocabulary.n_symbols + classes, symbol)
            sums = lambda x: np.bincount(of, x, texts)
            symbols = np.insert(sequence, bounds[1:], end).astype("<u2")
            symbol_bounds = 2 * (bounds + np.arange(texts + 1))
            rare = np.flatnonzero(~known)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, texts), batch.column(1).slice(first, texts), pa.array(words.counts + 1),
                pa.array(sums(known).astype(np.int64)), pa.array(sums(log)),
                pa.array(sums(in_class * (log - vocabulary.class_logs[classes]))),
                pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(symbol_bounds.astype(np.int32)), pa.py_buffer(symbols)]),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds), pa.int32()), pa.array(hashes[rare].view(np.int64))),
            ], schema=schema)


@dataclass
class Hmm:
    """Probabilities: of starts, by state; of the next state, by state; of symbols, by symbol and state."""

    start: np.ndarray
    middle: np.ndarray  # of states anywhere, for segments that begin within a document
    move: np.ndarray
    emit: np.ndarray    # symbols by states

    @staticmethod
    def from_counts(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, alphabet: int) -> Hmm:
        """From expected counts; every symbol keeps a share of each state by its overall frequency."""
        overall = emissions.sum(axis=1) + 0.5
        overall /= overall.sum()
        shown = emissions + 20 * overall[:, None]
        start, move, middle = starts + 0.1, moves + 0.1, emissions.sum(axis=0) + 0.1
        return Hmm(
            start / start.sum(), middle / middle.sum(), move / move.sum(axis=1, keepdims=True), shown / shown.sum(axis=0, keepdims=True)
        )

    def _side_by_side(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences longest first: (their order, first places, how many are longer than t)."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        active = len(order) - np.searchsorted(lengths[::-1], np.arange(1, (lengths[0] if len(lengths) else 0) + 1))
        return order, bounds[:-1][order], active

    def log_likelihoods(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The natural logarithm of each whole sequence's probability, by the scaled forward recursion."""
        order, begins, active = self._side_by_side(bounds)
        totals = np.zeros(len(order))
        forward = np.tile(self.start, (len(order), 1))
        for t, n in enumerate(active.tolist()):
            forward = forward[:n] if t == 0 else forward[:n] @ self.move
            forward = forward * self.emit[symbols[begins[:n] + t]]
            scale = forward.sum(axis=1)
            forward /= scale[:, None]
            totals[:n] += np.log(scale)
        out = np.empty(len(order))
        out[order] = totals
        return out

    def expected(self, symbols: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected (starts, moves, emissions) and the log-likelihood of sequences; ``whole`` begin a document."""
        states = len(self.start)
        order, begins, active = self._side_by_side(bounds)
        starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states))
        if not len(active):
            return starts, moves, emissions, 0.0
        at = np.concatenate([[0], np.cumsum(active)])
        ordered = np.concatenate([symbols[begins[:n] + t] for t, n in enumerate(active.tolist())])
        shown = self.emit[ordered]
        forward, scales = np.empty((at[-1], states)), np.empty(at[-1])
        now = np.where(whole[order][:, None], self.start, self.middle)
        for t, n in enumerate(active.tolist()):
            now = (now[:n] if t == 0 else now[:n] @ self.move) * shown[at[t]:at[t + 1]]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            forward[at[t]:at[t + 1]], scales[at[t]:at[t + 1]] = now, scale
        shown /= scales[:, None]
        backward = np.ones((active[-1], states))
        for t in range(len(active) - 1, 0, -1):
            n = active[t]
            here = slice(at[t], at[t] + n)
            back = shown[here] * backward
            before = forward[at[t - 1]:at[t - 1] + n]
            moves += before.T @ back
            forward[here] *= backward  # now the state's probability given the whole sequence
            backward = np.ones((active[t - 1], states))
            backward[:n] = back @ self.move.T
        forward[:at[1]] *= backward
        starts += forward[:at[1]][whole[order]].sum(axis=0)
        for state in range(states):
            emissions[:, state] = np.bincount(ordered, forward[:, state], len(self.emit))
        return starts, moves * self.move, emissions, float(np.log(scales).sum())


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index("symbols"))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) // 2
    data = np.frombuffer(column.buffers()[2], "<u2") if column.buffers()[2] is not None else np.empty(0, "<u2")
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _segments(symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, bounds, which begin a document) of segments of up to SEGMENT symbols, some _TOKENS at a time."""
    parts = -(-np.diff(bounds) // SEGMENT)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.append(np.repeat(bounds[:-1], parts) + number * SEGMENT, bounds[-1])
    first = 0
    while first < len(number):
        upto = max(first + 1, int(np.searchsorted(starts, starts[first] + _TOKENS, side="right")) - 1)
        yield symbols[starts[first]:starts[upto]], starts[first:upto + 1] - starts[first], number[first:upto] == 0
        first = upto


def _expected(batches: Iterator[pa.RecordBatch], model: Hmm) -> Iterator[pa.RecordBatch]:
    """The expected counts of a task as (kind, i, j, value): starts, moves, emissions and the log-likelihood."""
    sums: list | None = None
    for batch in batches:
        for part in _segments(*_sequences(batch)):
            new = model.expected(*part)
            sums = list(new) if sums is None else [a + b for a, b in zip(sums, new)]
    if sums is None:
        return
    for kind, table in enumerate((sums[0][:, None], sums[1], sums[2], np.array([[sums[3]]]))):
        i, j = np.nonzero(table)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.full(len(i), kind), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
            "value": pa.array(table[i, j]),
        })


def _first_model(sequences: list[np.ndarray], alphabet: int, states: int, rounds: int, seed: int) -> Hmm:
    """Trained on a sample, from one sequence for each state that those before it explain badly."""
    rng = np.random.default_rng(seed)
    emissions = np.zeros((alphabet, states))
    if sequences:
        overall = np.bincount(np.concatenate(sequences), minlength=alphabet) + 0.5
        overall = overall / overall.sum()
        chosen: list[np.ndarray] = []
        for state in range(states):
            candidates = [sequences[i] for i in rng.integers(0, len(sequences), 48)]
            if chosen:  # the one that is worst explained, word by word
                best = np.log(np.max(chosen, axis=0))
                worth = [best[x].mean() - np.log(overall[x]).mean() for x in candidates]
                pick = candidates[int(np.argmin(worth))]
            else:
                pick = candidates[0]
            counts = np.bincount(pick, minlength=alphabet)
            shown = counts + 200 * overall
            chosen.append(shown / shown.sum())
            emissions[:, state] = 1000 * chosen[-1]
    model = Hmm.from_counts(np.ones(states), np.ones((states, states)) + 50 * np.eye(states), emissions, alphabet)
    if sequences:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
        symbols, whole = np.concatenate(sequences), np.ones(len(sequences), dtype=bool)
        for _ in range(rounds):
            model = Hmm.from_counts(*model.expected(symbols, bounds, whole)[:3], alphabet)
    return model


def train_hmm(
    encoded: DataFrame, alphabet: int, states: int = STATES, rounds: int = ROUNDS, start_segments: int = START_SEGMENTS, seed: int = SEED
) -> tuple[Hmm, list[float]]:
    """(model, log-likelihood before each round) from the learned rows of ``encoded``; runs its jobs at once."""
    learned = encoded.where("learned").select("symbols")
    many = learned.count()
    # copies of one document have one share, so the sample is of different ones
    share = F.pmod(F.xxhash64("symbols", F.lit(seed)), F.lit(1_000_000))
    sample = learned.where(share <= int(1_000_000 * start_segments / max(many, 1))).select(
        F.substring("symbols", 1, 2 * SEGMENT).alias("symbols")
    ).distinct().orderBy("symbols").limit(2 * start_segments).toArrow()
    sequences = [np.frombuffer(x.as_py(), "<u2") for x in sample["symbols"]]
    model, likelihoods = _first_model(sequences, alphabet, states, START_ROUNDS, seed), []
    shared = encoded.sparkSession.sparkContext
    for _ in range(rounds if many else 0):
        now = shared.broadcast(model)
        sums = learned.mapInArrow(lambda batches, now=now: _expected(batches, now.value), "kind int, i int, j int, value double")
        total = sums.groupBy("kind", "i", "j").agg(F.sum("value").alias("value")).toArrow()
        kind, i, j, value = (total[c].to_numpy() for c in ("kind", "i", "j", "value"))
        tables = [np.zeros((states, 1)), np.zeros((states, states)), np.zeros((alphabet, states)), np.zeros((1, 1))]
        for number, table in enumerate(tables):
            table[i[kind == number], j[kind == number]] = value[kind == number]
        model = Hmm.from_counts(tables[0][:, 0], tables[1], tables[2], alphabet)
        likelihoods.append(float(tables[3][0, 0]))
    return model, likelihoods


def _likely(batches: Iterator[pa.RecordBatch], model: Hmm) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = model.log_likelihoods(*_sequences(batch)) / np.log(10)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["row", "hmm_log"])


def score_documents(docs: DataFrame, learned: Column, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): every document scored, some learned from.

    ``learned`` tells the rows to learn from; null counts as not. Tokens are the words of the
    whole text, lower-cased in A to Z, and one end, which is all that a null or empty text has.
    ``base_score`` adds up log10((c + 1) / (N + V + 1)) of the tokens' training counts c, of
    all N training tokens and V distinct ones; ``score`` is log10 of the model's probability
    of the text. A word that was never seen has the share of one unseen word of its class.
    Repeated rows are scored alike; with nothing learned all states are alike. Other columns
    are not read. Runs its jobs at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    rows = in_small_batches(docs).select("doc_id", F.coalesce(learned, F.lit(False)).alias("learned"), F.col("text").cast("string").alias("text"))
    counts = count_words(rows.where("learned"))
    known = vocabulary(counts, rows.where("learned").count(), frequent, symbols)
    shared = spark.sparkContext.broadcast(known)
    schema = _ENCODED.format(rows.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    encoded = checkpointed(
        rows.mapInArrow(lambda batches: _encode(batches, shared.value, arrow), schema).withColumn("row", F.monotonically_increasing_id())
    )
    # counts of the words that tasks do not know; each is rare, so no key has many rows
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))

    model, _ = train_hmm(encoded, known.alphabet, states, rounds)
    trained = spark.sparkContext.broadcast(model)
    likely = encoded.select("row", "symbols").mapInArrow(lambda batches: _likely(batches, trained.value), "row long, hmm_log double")
    every = float(np.log10(known.tokens + known.kinds + 1))
    end_log, end_known = float(np.log10(known.ends + 1)), int(known.ends > 0)
    found = F.coalesce("rare_log", F.lit(0.0))
    # rare words' classes are in class_log already, their counts are not
    return encoded.drop("symbols", "rare").join(likely, "row").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + end_known).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + found + end_log - F.col("n_tokens") * every).alias("base_score"),
        (F.col("hmm_log") + F.col("class_log") + found).alias("score"),
    )
