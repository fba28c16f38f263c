"""Column helpers: a Column in, a Column out, no Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedback_rank.schemas import FILTERS, MONEY
from feedback_rank.spec import MINIMUM_MRR, NO_FILTER, TOP_N_ACCOUNTS, RunSpec

# Fixed values of the text formats.
PROMPT_TEXT_LENGTH = 500
PROMPT_OVERLAP = 100  # our own: characters that a line shares with the one before of the same text
SAMPLE_LENGTH = 200
SAMPLES_KEPT = 3
SAMPLE_SEPARATOR = " | "
LABEL_SEPARATOR = ", "

# The characters that count as blanks.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Plain decimal numbers only: a cast alone would also take a Java suffix such as '12d'.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def to_number(col: Column) -> Column:
    """Text to double; whatever is no number, and NaN, becomes 0."""
    text = col.cast("string")
    number = F.when(text.rlike(_NUMBER) | text.rlike(_INFINITY), text.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def to_money(col: Column) -> Column:
    """Text or number to money; whatever does not fit becomes 0."""
    return F.coalesce(to_number(col).try_cast(MONEY), F.lit(0).cast(MONEY))


def to_ts(col: Column) -> Column:
    """Text to timestamp; whatever is no timestamp becomes null."""
    return F.try_to_timestamp(col)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def strip_nul(col: Column) -> Column:
    return F.replace(col, F.lit("\u0000"), F.lit(""))


def truncate(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)


def strip(col: Column) -> Column:
    """Drop blanks of every kind at both ends (a plain ``trim`` drops spaces only)."""
    return F.btrim(col, F.lit(BLANKS))


def nonblank(col: Column) -> Column:
    """True if the text holds anything but blanks (tabs and no-break blanks included)."""
    return F.coalesce(strip(col) != "", F.lit(False))


def keyword_match(col: Column, keyword: str) -> Column:
    """Whole-word, case-blind match of the trimmed keyword; null text never matches."""
    pattern = r"(?iuU)\b" + re.escape(keyword.strip()) + r"\b"
    return F.coalesce(col, F.lit("")).rlike(pattern)


def money(col: Column, digits: int = 2) -> Column:
    """Number to text with thousands commas."""
    return F.format_number(col, digits)


def account_label(name: Column, client_id: Column) -> Column:
    """``name (id)``, or the name alone where there is no id."""
    name = F.coalesce(name, F.lit(""))
    has_id = F.coalesce(client_id, F.lit("")) != ""
    return F.when(has_id, F.concat(name, F.lit(" ("), client_id, F.lit(")"))).otherwise(name)


def sample_join(samples: Column) -> Column:
    return F.array_join(F.slice(samples, 1, SAMPLES_KEPT), SAMPLE_SEPARATOR)


def sample_split(text: Column) -> Column:
    """Joined samples back to at most three trimmed, non-empty texts."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), strip)
    return F.slice(F.filter(parts, lambda part: part != ""), 1, SAMPLES_KEPT)


def prompt_line(name: Column, client_id: Column, mrr: Column, feedback: Column) -> Column:
    """``name | id | $mrr | text``."""
    return F.concat_ws(
        " | ",
        F.coalesce(name, F.lit("")),
        F.coalesce(client_id, F.lit("")),
        F.concat(F.lit("$"), money(zero_if_null(mrr), 2)),
        F.coalesce(feedback, F.lit("")),
    )


def filters_to_json(filters: Column) -> Column:
    """A filter struct as JSON text."""
    return F.to_json(filters)


def filters_json(spec: RunSpec) -> Column:
    """The filters of a run as JSON text."""
    def texts(values) -> Column:
        return F.array(*[F.lit(value) for value in values]).cast("array<string>")

    return filters_to_json(F.struct(
        texts(spec.subcategories).alias("subcategories"),
        texts(spec.account_owners).alias("account_owners"),
        F.lit(spec.mrr_filter).alias("mrr_filter"),
        F.lit(float(spec.min_mrr)).alias("min_mrr"),
        F.lit(int(spec.top_n)).alias("top_n"),
        F.lit(spec.keyword.strip()).alias("keyword"),
    ))


def filters_parse(col: Column) -> Column:
    """JSON text of the filters to a struct without nulls."""
    parsed = F.from_json(F.coalesce(col, F.lit("{}")), FILTERS)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(parsed["subcategories"], empty).alias("subcategories"),
        F.coalesce(parsed["account_owners"], empty).alias("account_owners"),
        F.coalesce(parsed["mrr_filter"], F.lit(NO_FILTER)).alias("mrr_filter"),
        F.coalesce(parsed["min_mrr"], F.lit(0.0)).alias("min_mrr"),
        F.coalesce(parsed["top_n"], F.lit(0)).alias("top_n"),
        F.coalesce(parsed["keyword"], F.lit("")).alias("keyword"),
    )


def filter_tags(filters: Column) -> Column:
    """Short labels of the filters: categories, owners, then the revenue cut."""
    mode = filters["mrr_filter"]
    minimum, top = filters["min_mrr"], filters["top_n"]
    revenue = (
        F.when((mode == MINIMUM_MRR) & (minimum != 0),
               F.array(F.concat(F.lit("MRR >= $"), money(minimum, 0))))
        .when((mode == TOP_N_ACCOUNTS) & (top != 0),
              F.array(F.concat(F.lit("Top "), top.cast("string"), F.lit(" accounts"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(filters["subcategories"], filters["account_owners"], revenue)
