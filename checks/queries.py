"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import Tables
from feedback_rank.functions import columns as C
from feedback_rank.functions.text import is_actionable
from feedback_rank.operators import calls, cues, extract, merge, payload, rollup, scope
from feedback_rank.plans import analyze, cache, history
from feedback_rank.session import checkpointed, scratch_path
from feedback_rank.sinks import csv as csv_sink
from feedback_rank.sinks import history as saved
from feedback_rank.sources import feedback as source
from feedback_rank.sources import history as stored
from feedback_rank.spec import MINIMUM_MRR, TOP_N_ACCOUNTS, RunSpec

EVERYTHING = RunSpec()
START = date(2025, 10, 2)
CATEGORIES = tuple(f"src{n}" for n in (1, 2, 3, 5, 8, 13))
OWNERS = tuple(f"NATION_{n}" for n in range(2, 20))
MINIMUM = RunSpec(mrr_filter=MINIMUM_MRR, min_mrr=1000.0)
CUES, NO_CUES = ("is the", "une", "und", "los"), ("on the", "la")

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def full(t: Tables, **more) -> RunSpec:
    """Some categories and owners of the first three quarters of all feedback."""
    return RunSpec(START, t.window_end(), CATEGORIES, OWNERS, **more)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def naive(name: str):
    """A timestamp in UTC as a plain one."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def day(name: str):
    return F.col(name).cast("string").alias(name)


# --- scans, lookups, projections -------------------------------------------------


@query
def feedback_scan(t):
    return source.read_feedback(t.feedback_fact(), t.account(), full(t))


@query
def feedback_scan_lists(t):
    """The same run with its categories and owners as tables."""
    categories = t.read("documents").select("source").where(F.col("source").isin(*CATEGORIES))
    owners = t.read("nation").where("n_nationkey BETWEEN 2 AND 19").select("n_name")
    return source.read_feedback(
        t.feedback_fact(), t.account(), RunSpec(START, t.window_end()), subcategories=categories, account_owners=owners
    )


@query
def flatten(t):
    return source.flatten(t.feedback_raw()).withColumn("created_at", naive("created_at"))


@query
def lookup_account(t):
    return source.lookup_account(t.feedback_fact(), t.account()).select(
        "insight_id", "account_name", "account_owner", "platform_client_id", "mrr", "tpv"
    )


@query
def lookup_creator(t):
    fact = t.feedback_fact().select("insight_id", (F.col("doc_id") % 11).alias("creator_id"))
    users = t.read("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("user_name"))
    return source.lookup_creator(fact, users).select("insight_id", "created_by")


@query
def numeric_coerce(t):
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(line == 1, F.concat(F.lit(" "), quantity, F.lit(" "))).when(line == 2, F.concat(quantity, F.lit("e2")))
        .when(line == 3, F.concat(quantity, F.lit("d"))).when(line == 4, F.concat(quantity, F.lit(",000")))
        .when(line == 5, F.lit("NaN")).when(line == 6, F.lit("")).otherwise(quantity)
    )
    return t.read("lineitem").select("l_orderkey", "l_linenumber", C.to_number(text).alias("value"))


@query
def timestamp_coerce(t):
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(moment, F.lit("Z")))
        .when(F.col("o_orderstatus") == "O", F.concat(moment, F.lit(".000+0000"))).otherwise(F.lit("bad"))
    )
    return t.read("orders").select("o_orderkey", C.to_ts(text).cast("timestamp_ntz").alias("value"))


@query
def strip_nul(t):
    dirty = F.replace(F.col("text"), F.lit(" "), F.lit(" \u0000"))
    return t.read("documents").select("doc_id", C.strip_nul(dirty).alias("text"))


@query
def truncate_text(t):
    return t.read("documents").select("doc_id", C.truncate(F.col("text"), C.PROMPT_TEXT_LENGTH).alias("text"))


@query
def sample_truncate(t):
    return t.read("documents").select("doc_id", C.truncate(F.col("text"), C.SAMPLE_LENGTH).alias("sample"))


@query
def account_label(t):
    return t.account().select("account_id", C.account_label(F.col("account_name"), F.col("platform_client_id")).alias("label"))


@query
def prompt_lines(t):
    return extract.prompt_lines(t.feedback()).select("insight_id", "part", "line")


@query
def sample_split(t):
    return t.read("documents").select("doc_id", F.array_join(C.sample_split(F.col("text")), "~").alias("samples"))


@query
def money_format(t):
    return t.read("customer").select(
        "c_custkey", C.money(F.col("c_acctbal"), 2).alias("exact"), C.money(F.col("c_acctbal"), 0).alias("whole")
    )


@query
def insight_text(t):
    ranked = rollup.feature_rank(t.account_mention())
    return ranked.select(
        "feature", rollup.insight_text(F.col("total_mrr"), F.col("account_count"), F.col("rank")).alias("ai_insight")
    )


# --- filters of a run ------------------------------------------------------------


@query
def record_type(t):
    return t.feedback().where(scope.is_client_feedback()).select("insight_id", "record_type")


@query
def date_range(t):
    feedback = t.feedback()
    for condition in scope.created_between(feedback, RunSpec(START, t.window_end())):
        feedback = feedback.where(condition)
    return feedback.select("insight_id", "created_at")


@query
def in_subcategory(t):
    feedback = t.feedback()
    return feedback.where(scope.source_conditions(RunSpec(subcategories=CATEGORIES), feedback)).select(
        "insight_id", "subcategory"
    )


@query
def in_owner(t):
    feedback = t.feedback()
    return feedback.where(scope.source_conditions(RunSpec(account_owners=OWNERS), feedback)).select(
        "insight_id", "account_owner"
    )


@query
def conjunction(t):
    feedback = t.feedback()
    return feedback.where(scope.source_conditions(full(t), feedback)).select("insight_id")


@query
def min_mrr(t):
    return scope.scope(t.feedback(), MINIMUM).select("insight_id", "account_name", "mrr")


@query
def top_n_accounts(t):
    return scope.keep_top_accounts(t.feedback(), 10).select("insight_id", "account_name", "mrr")


@query
def keyword_word(t):
    return scope.has_keyword(t.feedback(), "ou").select("insight_id")


@query
def nonblank(t):
    return t.feedback().where(C.nonblank(F.col("feedback"))).select("insight_id")


@query
def scope_all(t):
    spec = full(t, mrr_filter=TOP_N_ACCOUNTS, top_n=25, keyword=" la ")
    found = source.read_feedback(t.feedback_fact(), t.account(), spec, newest_first=False)
    return scope.scope(found, spec).select("insight_id", "account_name", "mrr", "created_at")


@query
def scope_totals(t):
    found = source.read_feedback(t.feedback_fact(), t.account(), EVERYTHING, newest_first=False)
    return scope.scope_totals(scope.scope(found, EVERYTHING))


@query
def among_owners(t):
    """The owners as a table, for lists too long for a condition."""
    owners = t.read("nation").where("n_nationkey % 3 = 0").select("n_name")
    return scope.among(t.feedback(), "account_owner", owners).select("insight_id", "account_owner")


@query
def filter_options(t):
    return scope.filter_options(t.feedback())


@query
def actionable(t):
    return t.feedback().where(is_actionable(F.col("feedback"), CUES, NO_CUES)).select("insight_id")


@query
def actionable_default(t):
    return t.letter().where(is_actionable(F.col("feedback"))).select("insight_id")


MARKS = cues.CueModel(tuple(((bucket * 37) % 101 - 50) / 64 for bucket in range(1 << 10)), 0.25)


@query
def cue_scores(t):
    """The sums that given weights make of every whole text."""
    return t.feedback().select("insight_id", cues.cue_score(F.col("feedback"), MARKS).alias("score"))


def labelled_sentences(t):
    """The sentences of all letters, labelled by hand, as it were: two kinds of endings ask for something."""
    sentences = cues.sentences_of(t.spread(t.letter()))
    return sentences.select("sentence", F.col("sentence").rlike("^(In my case we need ACH payouts|Queremos exportar)").alias("label"))


@query
def learned_requests(t):
    """Letters that ask for something, by a model of the labelled sentences; SQL cannot train it, a test does it plainly."""
    model = cues.train_cues(labelled_sentences(t))
    return t.spread(t.letter()).where(cues.asks(F.col("feedback"), model)).select("insight_id")


# --- mentions to ranked features -------------------------------------------------


@query
def feature_accounts(t):
    return rollup.feature_accounts(t.account_mention())


@query
def account_labels(t):
    return rollup.joined_labels(rollup.feature_accounts(t.account_mention()))


@query
def feature_rollup(t):
    return rollup.feature_rollup(t.account_mention())


@query
def feature_samples(t):
    return rollup.feature_samples(t.account_mention()).select("feature", C.sample_join(F.col("samples")).alias("samples"))


@query
def feature_rank(t):
    return rollup.feature_rank(t.account_mention())


@query
def ranked_features(t):
    return rollup.rank_features(t.account_mention())


# --- payloads --------------------------------------------------------------------


@query
def payload_parse(t):
    return payload.parse_payload(t.payload()).select(
        "chunk_id", "status", F.size("features").alias("feature_count"), F.try_element_at("features", F.lit(1))["feature"].alias("first_feature")
    )


@query
def payload_explode(t):
    return payload.payload_mentions(payload.parse_payload(t.payload()))


@query
def payload_defaults(t):
    return payload.payload_features(payload.parse_payload(t.payload())).select(
        "chunk_id", "feature", "total_mrr", "account_count", "insight"
    )


@query
def chunk_status(t):
    return payload.chunk_status(payload.parse_payload(t.payload()))


# --- extraction and merging ------------------------------------------------------


@query
def chunk_assign(t):
    slim = t.feedback().select("insight_id", "created_at")
    return extract.assign_chunks(slim).select("insight_id", "chunk_id")


@query
def extract_mentions(t):
    return extract.extract_mentions(t.spread(t.feedback()), t.phrase()).drop("sample_key")


def late_phrases(feedback, marked):
    """The plug-in's findings, once a text, of a phrase with the text's id behind the whole texts that are ``marked``."""
    def listed(lines: str) -> str:
        import json
        import re

        return json.dumps({"features": [{"feature": "late", "accounts": sorted(set(re.findall(r"zz (\S+) marker zz", lines)))}]})

    # within the overlap of windows a phrase stands in both of them, which may go to different calls
    text = F.concat(F.coalesce("feedback", F.lit("")), F.lit(" zz "), "insight_id", F.lit(" marker zz"))
    chunks = extract.extract_plugin(feedback.withColumn("feedback", F.when(marked, text).otherwise(F.col("feedback"))), listed)
    found = payload.payload_mentions(payload.parse_payload(chunks)).where(F.col("account_name") != "")
    return found.groupBy("feature", F.lit("found").alias("account_name")).agg(F.countDistinct("account_name").alias("texts"))


@query
def extract_late_phrase(t):
    """The plug-in reads all texts whole: it finds a phrase at the end of each."""
    return late_phrases(t.feedback(), F.lit(True))


@query
def chunk_lines(t):
    return extract.chunked_lines(t.feedback()).select("chunk_id", "n_lines", F.md5("lines").alias("lines"))


def _characters(lines: str) -> str:
    return f'{{"features": [{{"feature": "{len(lines)} characters"}}]}}'


def _characters_or_error(lines: str) -> str:
    if len(lines) % 3 == 0:
        raise ValueError("model gone")
    return _characters(lines)


@query
def call_ledger(t):
    """Every third chunk fails at first; the next run calls these alone, and a third run calls nothing."""
    path = scratch_path(t.spark, "call-ledger")
    for fn in (_characters_or_error, _characters, _characters):
        chunks = extract.extract_plugin(t.feedback(), fn, ledger=path, label="sizes")
    made = calls.read_ledger(t.spark, path).groupBy("key").agg(F.count("*").alias("calls"))
    keys = calls.chunk_keys(extract.chunked_lines(t.feedback()), "sizes").select("chunk_id", "key")
    found = payload.payload_features(payload.parse_payload(chunks)).select("chunk_id", "feature")
    return found.join(chunks.select("chunk_id", "status"), "chunk_id").join(keys.join(made, "key"), "chunk_id").select(
        "chunk_id", "status", "feature", "calls"
    )


@query
def call_lanes(t):
    """The lane and the wave of every chunk's call, three at a time and two a wave."""
    path = scratch_path(t.spark, "call-lanes")
    chunks = extract.chunked_lines(t.feedback()).withColumn("lines", F.concat(F.col("chunk_id").cast("string"), F.lit(" "), "lines"))
    calls.call_chunks(chunks, lambda lines: lines.split(" ", 1)[0], path, in_flight=3, lane_calls=2)
    return calls.read_ledger(t.spark, path).select(F.col("payload").cast("long").alias("chunk_id"), "lane", "wave")


@query
def call_progress(t):
    """The percentages that a run reports, from the first to the last."""
    seen: list[float] = []
    extract.extract_plugin(t.feedback(), _characters, in_flight=3, lane_calls=2, on_progress=seen.append)
    return t.spark.createDataFrame([(step, int(100 * share + 1e-9)) for step, share in enumerate(seen)], "step int, percent int")


@query
def extract_plugin(t):
    def accounts_with_an_id(lines: str) -> str:
        import json
        import re

        found = sorted(set(re.findall(r"^(Customer#\d+) \| (CL-\d+) \| \$", lines, re.MULTILINE)))
        accounts = [{"name": name, "platform_client_id": client_id} for name, client_id in found]
        return json.dumps({"features": [{"feature": "listed", "accounts": accounts}]})

    chunks = extract.extract_plugin(t.feedback(), accounts_with_an_id)
    return payload.payload_mentions(payload.parse_payload(chunks)).select(
        "chunk_id", "feature", "account_name", "platform_client_id"
    )


@query
def normalize_phrase(t):
    return extract.normalize_phrases(t.account_mention(), t.synonym()).select("feature", "account_name", "sample")


@query
def similar_pairs(t):
    links = merge.similar_links(merge.feature_support(t.feedback_mention()))
    return links.select(F.md5("feature").alias("feature"), F.md5("similar_to").alias("similar_to"))


@query
def merge_features(t):
    return merge.merge_features(t.feedback_mention()).select(
        F.md5("feature").alias("feature"), "account_name", "mrr", "sample"
    )


@query
def analyze_all(t):
    return analyze.analyze(t.spread(t.feedback()), t.phrase(), t.topic(), CUES, support_cues=NO_CUES)


# --- runs, history, exports ------------------------------------------------------


@query
def run_header(t):
    spec = RunSpec(subcategories=CATEGORIES, account_owners=OWNERS)
    found = source.read_feedback(t.feedback_fact(), t.account(), EVERYTHING, newest_first=False)
    header = saved.run_header(spec, scope.scope_totals(found), 1, F.lit("2025-12-01T00:00:00Z").cast("timestamp"))
    return header.select(
        "id", naive("created_at"), day("start_date"), day("end_date"), "filters",
        "total_feedbacks", "unique_accounts", "total_mrr",
    )


@query
def filters_json(t):
    return t.run().select("id", C.filters_to_json(C.filters_parse(F.col("filters"))).alias("filters"))


@query
def filters_parse(t):
    parsed = t.run().select("id", C.filters_parse(F.col("filters")).alias("f"))
    return parsed.select(
        "id", F.array_join("f.subcategories", ",").alias("subcategories"),
        F.array_join("f.account_owners", ",").alias("account_owners"), "f.mrr_filter", "f.min_mrr", "f.top_n",
    )


@query
def filter_tags(t):
    return t.run().select("id", F.array_join(C.filter_tags(C.filters_parse(F.col("filters"))), ",").alias("tags"))


@query
def history_runs(t):
    path = scratch_path(t.spark, "history-runs")
    saved.save_headers(t.run(), path)
    return stored.load_runs(t.spark, path).select(
        "id", naive("created_at"), day("start_date"), day("end_date"), "filters",
        "total_feedbacks", F.col("unique_accounts").cast("string").alias("unique_accounts"), "total_mrr",
    )


@query
def run_features(t):
    path = scratch_path(t.spark, "run-features")
    features = t.run_feature()
    saved.save_features(features, path)
    saved.save_headers(t.run(), path)
    # written by a save that never came to its header
    saved.save_features(features.withColumn("feature", F.lit("unfinished")), path, "1")
    return stored.load_run_features(t.spark, path, 7)


@query
def save_roundtrip(t):
    path = scratch_path(t.spark, "save-roundtrip")
    mentions = t.account_mention()
    once = rollup.written_once(mentions)
    totals, accounts = scope.scope_totals(t.feedback()), rollup.feature_accounts(mentions, once)
    ranked = checkpointed(rollup.rank_features(mentions, once))
    for run_id, table in ((1, ranked), (2, ranked), (2, ranked.limit(0)), (3, ranked)):
        saved.save_run(EVERYTHING, totals, table, path, run_id, accounts=accounts)
    saved.delete_runs(t.spark.range(3, 4).select(F.col("id").alias("run_id")), path)
    saved.save_run(EVERYTHING, totals, ranked, path, 3)
    saved.purge(t.spark, path)
    features, of_run = stored.load_features(t.spark, path), stored.load_accounts(t.spark, path)
    counts = of_run.groupBy("run_id", "feature").agg(F.count("*").alias("saved_accounts"))
    return features.join(counts, ["run_id", "feature"], "left").select(
        "run_id", "rank", "feature", "total_mrr", "account_count", "sample_feedbacks", F.coalesce("saved_accounts", F.lit(0)).alias("saved_accounts")
    )


@query
def cascade_delete(t):
    path = scratch_path(t.spark, "cascade-delete")
    runs = t.run()
    saved.save_features(t.run_feature(), path)
    saved.save_headers(runs, path)
    saved.delete_runs(runs.where(F.col("filters").contains("Top N")).select(F.col("id").alias("run_id")), path)
    saved.purge(t.spark, path)
    left = stored.load_features(t.spark, path).groupBy("run_id").agg(F.count("*").alias("features"))
    heads = stored.load_runs(t.spark, path).select("id")
    # a feature without its run would show as run -1
    return heads.join(left, heads["id"] == left["run_id"], "full").select(
        F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("features", F.lit(0)).alias("features")
    )


@query
def history_cards(t):
    return shown_cards(history.history_cards(t.run(), t.run_feature()))


def shown_cards(cards):
    line = F.transform("top_features", lambda f: F.concat(
        F.lit("#"), f["rank"].cast("string"), F.lit(" "), f["feature"], F.lit(" $"), f["mrr"], F.lit(" "),
        f["account_count"].cast("string"), F.lit(" accounts"),
    ))
    return cards.withColumns({
        "tags": F.array_join("tags", ","), "top_features": F.coalesce(F.array_join(line, "; "), F.lit("")),
    })


@query
def history_saved_cards(t):
    """Cards from what each save counted, after saves, saves of the same runs again, deletes and packing."""
    path, runs, features = scratch_path(t.spark, "saved-cards"), checkpointed(t.run()), checkpointed(t.run_feature())

    def save(condition):
        of_run = features.withColumnRenamed("run_id", "id").where(condition).withColumnRenamed("id", "run_id")
        saved.save_runs(runs.where(condition), of_run, path)

    saved.save_runs(runs, features.where("rank <= 2"), path)
    saved.compact(t.spark, path)
    save("id % 3 <> 2")
    saved.delete_runs(runs.where("id % 5 = 0").select(F.col("id").alias("run_id")), path)
    saved.compact(t.spark, path, rows_per_file=1000)
    save("id % 10 = 0")
    return shown_cards(history.saved_cards(t.spark, path))


@query
def scope_cached(t):
    """A run's feedback, made once and read from its stored table afterwards."""
    path, spec = scratch_path(t.spark, "scope-cache"), full(t, mrr_filter=TOP_N_ACCOUNTS, top_n=25, keyword=" la ")
    made: list[int] = []

    def make():
        made.append(1)
        found = source.read_feedback(t.feedback_fact(), t.account(), spec, newest_first=False)
        return scope.scope(found, spec).select("insight_id", "account_name", "mrr", "created_at")

    files = [f"{t.sf_dir}/{name}.parquet" for name in ("documents", "customer", "nation")]
    for _ in range(2):
        table = cache.cached_scope(t.spark, path, spec, files, make)
    return table.withColumn("times_made", F.lit(len(made)))


@query
def history_top3(t):
    return history.top_features(t.run_feature()).select("run_id", "rank", "feature", "total_mrr", "account_count")


@query
def history_detail(t):
    return history.history_detail(t.run(), t.run_feature()).withColumn("created_at", naive("created_at"))


@query
def csv_roundtrip(t):
    return through_csv(t, csv_sink.export_table(t.feedback(), csv_sink.RAW_EXPORT), csv_sink.RAW_EXPORT)


@query
def csv_features(t):
    mentions = t.account_mention()
    once = rollup.written_once(mentions)
    ranked = rollup.with_labels(rollup.rank_features(mentions, once), rollup.feature_accounts(mentions, once), most_characters=100_000_000)
    return through_csv(t, csv_sink.export_table(ranked, csv_sink.FEATURE_EXPORT), csv_sink.FEATURE_EXPORT)


@query
def csv_accounts(t):
    """The accounts of the features as rows: no text grows with a feature."""
    accounts = rollup.feature_accounts(t.account_mention())
    return through_csv(t, csv_sink.export_table(accounts, csv_sink.ACCOUNT_EXPORT), csv_sink.ACCOUNT_EXPORT)


def through_csv(t, table, kind):
    path = f"{scratch_path(t.spark, 'csv')}/{csv_sink.export_name(kind, RunSpec(START, t.window_end()))}"
    csv_sink.write_csv(table, path)
    return csv_sink.read_csv(t.spark, path, table.schema)


# names that are also modules or builtins here
QUERIES["scope"] = QUERIES.pop("scope_all")
QUERIES["analyze"] = QUERIES.pop("analyze_all")


def run_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return QUERIES[name](Tables(spark, sf_dir))
