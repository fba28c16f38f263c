"""From scoped feedback to the ranked table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_rank.functions.text import SUPPORT_CUES, is_actionable
from feedback_rank.operators import extract, merge, payload, rollup
from feedback_rank.operators.cues import CueModel, asks
from feedback_rank.session import checkpointed


def merged_mentions(
    mentions: DataFrame, synonyms: DataFrame | None = None, threshold: float = merge.THRESHOLD
) -> DataFrame:
    """Normalise and merge; written twice on the way, as the mentions are read often. Starts jobs."""
    if synonyms is not None:
        mentions = extract.normalize_phrases(mentions, synonyms)
    return checkpointed(merge.merge_features(mentions, threshold))


def rank_mentions(
    mentions: DataFrame, synonyms: DataFrame | None = None, threshold: float = merge.THRESHOLD
) -> DataFrame:
    """Normalise, merge and rank. For the accounts behind the table see :func:`merged_mentions`."""
    return rollup.rank_features(merged_mentions(mentions, synonyms, threshold))


def _asking(feedback: DataFrame, request_cues: Sequence[str] | CueModel, support_cues: Sequence[str]) -> DataFrame:
    if isinstance(request_cues, CueModel):
        return feedback.where(asks(F.col("feedback"), request_cues))
    return feedback.where(is_actionable(F.col("feedback"), request_cues, support_cues)) if request_cues else feedback


def analyze(
    feedback: DataFrame,
    phrases: DataFrame,
    synonyms: DataFrame | None = None,
    request_cues: Sequence[str] | CueModel = (),
    threshold: float = merge.THRESHOLD,
    support_cues: Sequence[str] = SUPPORT_CUES,
) -> DataFrame:
    """The whole way with a phrase table; with ``request_cues``, phrases or a trained model, only texts that ask for something are read."""
    mentions = extract.extract_mentions(_asking(feedback, request_cues, support_cues), phrases).drop("insight_id")
    return rank_mentions(mentions, synonyms, threshold)


def analyze_with(
    feedback: DataFrame,
    fn: Callable[[str], str],
    synonyms: DataFrame | None = None,
    chunk_size: int = extract.CHUNK_SIZE,
    threshold: float = merge.THRESHOLD,
    request_cues: Sequence[str] | CueModel = (),
    support_cues: Sequence[str] = SUPPORT_CUES,
    **calls,
) -> tuple[DataFrame, DataFrame]:
    """The whole way with the user's own extraction: (ranked table, chunk status).

    Each chunk is called once; its payload is in the ledger before anything reads it,
    so no later failure costs the calls. ``calls`` are the options of :func:`extract_plugin`,
    such as ``ledger``, ``label``, ``in_flight`` and ``on_progress``.
    """
    chunks = extract.extract_plugin(_asking(feedback, request_cues, support_cues), fn, chunk_size, **calls)
    parsed = payload.parse_payload(chunks)
    mentions = payload.payload_mentions(parsed).drop("chunk_id")
    return rank_mentions(mentions, synonyms, threshold), payload.chunk_status(parsed)
