"""Words of a text, request cues."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything that is no letter, mark, digit or underscore parts two words.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"

# Words that ask for something, in both languages of the feedback.
REQUEST_CUES = (
    "need", "needs", "want", "wants", "would like", "would love", "wish",
    "please add", "add", "allow", "enable", "support for", "integrate",
    "integration", "feature", "request", "requests", "should be able",
    "necesita", "necesitan", "necesitamos", "quiere", "quieren", "queremos",
    "agregar", "permitir", "integrar", "solicita", "solicitan", "solicitamos",
    "funcionalidad",
)

# Words of a support case, which is no request for the product.
SUPPORT_CUES = (
    "reset my password", "locked out", "ticket number", "status of my case",
    "restablecer mi contraseña", "número de ticket", "estado de mi caso",
)

# What ends a sentence: a mark with blanks after it, or a line break.
SENTENCE_END = r"(?<=[.!?…])\s+|[\r\n]+"

# A sentence with the blanks after it; what is left at a text's end is one too.
SENTENCE = r"(?s).*?(?:[.!?…][ \t\r\n]+|[\r\n]+)|.+"
_SENTENCE_BLANKS = " \t\r\n"


def words(col: Column) -> Column:
    """Lower-case words in order, without empty ones."""
    return F.filter(F.split(F.lower(col), WORD_BREAK), lambda word: word != "")


def any_phrase(col: Column, phrases: Sequence[str]) -> Column:
    """True if one of the given whole phrases is in the text."""
    if not phrases:
        return F.lit(False)
    options = "|".join(re.escape(phrase) for phrase in phrases)
    return F.coalesce(col, F.lit("")).rlike(rf"(?iuU)\b(?:{options})\b")


def is_actionable(
    col: Column,
    request_cues: Sequence[str] = REQUEST_CUES,
    support_cues: Sequence[str] = SUPPORT_CUES,
) -> Column:
    """True if a sentence of the text asks for something and is no support case."""
    asks = F.exists(
        F.split(F.coalesce(col, F.lit("")), SENTENCE_END),
        lambda sentence: any_phrase(sentence, request_cues) & ~any_phrase(sentence, support_cues),
    )
    # most texts ask for nothing, and are not taken apart
    return any_phrase(col, request_cues) & asks


def sentence_windows(col: Column, length: int, overlap: int) -> Column:
    """Places of windows over a text, as an array of (start, stop), characters from 0.

    Sentences are packed, in order, into windows of at most ``length`` characters, so every
    sentence up to that length is whole in a window. A window begins with the last
    sentence of the one before, unless the two do not fit together. A longer sentence has
    windows of just ``length`` characters, ``overlap`` of them shared with the one before, and
    the last of them is packed on. Blanks between two windows are in none.
    """
    step, place = length - overlap, "struct<start:int,stop:int>"
    none = F.array().cast(f"array<{place}>")

    def state(done: Column, start: Column, stop: Column, last: Column, at: Column) -> Column:
        return F.struct(done.alias("done"), start.alias("start"), stop.alias("stop"), last.alias("last"), at.alias("at"))

    def window(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"))

    def packed(s: Column, sentence: Column) -> Column:
        size = F.length(F.rtrim(sentence, F.lit(_SENTENCE_BLANKS)))
        begin, end, after = s["at"], s["at"] + size, s["at"] + F.length(sentence)
        first = s["start"] < 0
        closed = F.when(first, s["done"]).otherwise(F.concat(s["done"], F.array(window(s["start"], s["stop"]))))
        cuts = F.ceil((size - overlap) / step).cast("int") - 1  # windows of a long sentence but the last
        whole = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: window((begin + i * step).cast("int"), (begin + i * step + length).cast("int")))
        rest = (begin + cuts * step).cast("int")
        return (
            F.when(size == 0, state(s["done"], s["start"], s["stop"], s["last"], after))
            .when(~first & (end - s["start"] <= length), state(s["done"], s["start"], end, begin, after))
            .when(size > length, state(F.concat(closed, whole), rest, end, rest, after))
            .when(~first & (end - s["last"] <= length), state(closed, s["last"], end, begin, after))
            .otherwise(state(closed, begin, end, begin, after))
        )

    start = state(none, F.lit(-1), F.lit(-1), F.lit(-1), F.lit(0))
    return F.aggregate(
        F.regexp_extract_all(col, F.lit(SENTENCE), F.lit(0)), start, packed,
        lambda s: F.when(s["start"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(window(s["start"], s["stop"])))),
    )
