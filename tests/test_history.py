from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedback_rank import RunSpec, delete_runs, export_name, history_cards, history_detail, load_run_features, load_runs, save_run, write_csv
from feedback_rank.sinks.csv import FEATURE_EXPORT, RAW_EXPORT, export_table, read_csv
from feedback_rank.plans.history import saved_cards
from feedback_rank.sinks.history import claim_run_id, compact, next_run_id, purge, run_features, save_features, save_runs
from feedback_rank.sources import history as stored
from feedback_rank.sources.history import generations, load_accounts, load_features, load_run_accounts
from feedback_rank.spec import MINIMUM_MRR

RANKED = (
    "rank long, feature string, total_mrr decimal(18,2), account_count long, sample_feedbacks string, ai_insight string"
)
SPEC = RunSpec(date(2025, 10, 1), date(2025, 10, 31), ["s'1"], [], MINIMUM_MRR, 1500.0, 0, "ach")


@pytest.fixture
def ranked(spark):
    rows = [(i, f"f\0{i}", Decimal(100 - i), i, "s1 | s2", "why") for i in range(1, 6)]
    return spark.createDataFrame(rows, RANKED)


@pytest.fixture
def totals(spark):
    return spark.createDataFrame([(7, 3, Decimal("1234.50"))], "total_feedbacks int, unique_accounts int, total_mrr decimal(18,2)")


def test_nothing_saved_yet(spark, tmp_path):
    path = str(tmp_path)
    assert load_runs(spark, path).count() == 0
    assert load_run_features(spark, path, 1).count() == 0
    assert next_run_id(spark, path) == 1


def test_save_load_delete(spark, tmp_path, ranked, totals):
    path = str(tmp_path)
    at = datetime(2025, 11, 1, 10, tzinfo=timezone.utc)
    assert save_run(SPEC, totals, ranked, path, created_at=at) == 1
    assert save_run(SPEC, totals, ranked.limit(0), path) == 2
    # a repeated save replaces its run
    assert save_run(SPEC, totals, ranked, path, run_id=1, created_at=at) == 1

    runs = load_runs(spark, path)
    assert [r["id"] for r in runs.collect()] == [2, 1]
    features = load_run_features(spark, path, 1).collect()
    assert [r["feature"] for r in features] == [f"f{i}" for i in range(1, 6)]
    assert load_run_features(spark, path, 2).count() == 0

    cards = {r["id"]: r for r in history_cards(runs, load_features(spark, path)).collect()}
    one = cards[1]
    assert (one["run_date"], one["period"]) == ("2025-11-01", "2025-10-01 to 2025-10-31")
    assert (one["total_feedbacks"], one["unique_accounts"], one["mrr_in_scope"]) == (7, "3", "$1,234")
    assert one["tags"] == ["s'1", "MRR >= $1,500"]
    assert (one["feature_count"], one["more_features"]) == (5, 2)
    assert [(f["rank"], f["mrr"]) for f in one["top_features"]] == [(1, "99.00"), (2, "98.00"), (3, "97.00")]
    assert (cards[2]["feature_count"], cards[2]["top_features"], cards[2]["more_features"]) == (0, None, 0)
    assert history_detail(runs, load_features(spark, path)).count() == 5

    delete_runs(spark.createDataFrame([(1,)], "run_id long"), path)
    assert [r["id"] for r in load_runs(spark, path).collect()] == [2]
    assert load_run_features(spark, path, 1).count() == 0
    assert next_run_id(spark, path) == 3


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([("f\0001", "A\0", "1", Decimal(5), "A (1)"), ("f\0001", "B", "", Decimal(3), "B")], "feature string, account_name string, platform_client_id string, mrr decimal(18,2), label string")


def test_an_empty_save_replaces_the_one_before(spark, tmp_path, ranked, totals, accounts):
    path = str(tmp_path)
    save_run(SPEC, totals, ranked, path, run_id=1, accounts=accounts)
    assert sorted((r["feature"], r["account_name"]) for r in load_run_accounts(spark, path, 1).collect()) == [("f1", "A"), ("f1", "B")]
    save_run(SPEC, totals, ranked.limit(0), path, run_id=1)
    assert load_run_features(spark, path, 1).count() == 0 and load_run_accounts(spark, path, 1).count() == 0
    assert load_runs(spark, path).count() == 1


def test_a_deleted_run_can_be_saved_again(spark, tmp_path, ranked, totals):
    path = str(tmp_path)
    gone = spark.createDataFrame([(1,)], "run_id long")
    save_run(SPEC, totals, ranked, path, run_id=1)
    delete_runs(gone, path)
    delete_runs(gone, path)
    assert load_runs(spark, path).count() == 0
    save_run(SPEC, totals, ranked.limit(2), path, run_id=1)
    assert load_runs(spark, path).count() == 1 and load_run_features(spark, path, 1).count() == 2


def test_features_without_a_header_are_not_there(spark, tmp_path, ranked):
    path = str(tmp_path)
    save_features(run_features(ranked, 4), path, "1")
    assert load_run_features(spark, path, 4).count() == 0 and load_features(spark, path).count() == 0
    assert next_run_id(spark, path) == 1


def _files(tmp_path, table):
    return [p for p in (tmp_path / table).rglob("part-*") if "manifest" not in str(p)]


def test_purge_keeps_what_a_header_needs(spark, tmp_path, ranked, totals, accounts):
    path = str(tmp_path)
    for run_id in (1, 1, 2, 3):
        save_run(SPEC, totals, ranked, path, run_id=run_id, accounts=accounts)
    save_features(run_features(ranked, 9), path, "unfinished")
    delete_runs(spark.createDataFrame([(2,)], "run_id long"), path)
    before = {table: sorted(map(str, load(spark, path).collect())) for table, load in (("f", load_features), ("a", load_accounts), ("r", load_runs))}
    assert purge(spark, path) == 1
    after = {table: sorted(map(str, load(spark, path).collect())) for table, load in (("f", load_features), ("a", load_accounts), ("r", load_runs))}
    assert after == before and {r["run_id"] for r in load_features(spark, path).collect()} == {1, 3}
    stored_rows = spark.read.parquet(*[str(p) for p in _files(tmp_path, "analysis_features")])
    assert stored_rows.count() == 10  # five of each run: what was replaced, deleted or unfinished is gone
    assert next_run_id(spark, path) == 4
    save_run(SPEC, totals, ranked, path, run_id=2)
    assert purge(spark, path) == 1 and {r["run_id"] for r in load_features(spark, path).collect()} == {1, 2, 3}


def _many(spark, n, features=4):
    runs = spark.range(1, n + 1).selectExpr(
        "id", "timestamp '2025-11-01 00:00:00' AS created_at", "date '2025-10-01' AS start_date", "date '2025-10-02' AS end_date",
        "cast(null AS string) AS filters", "id AS total_feedbacks", "id AS unique_accounts", "cast(id AS decimal(18,2)) AS total_mrr",
    )
    rows = spark.range(n * features).selectExpr(
        f"id div {features} + 1 AS run_id", f"id % {features} + 1 AS rank", "concat('f', id) AS feature", "cast(id AS decimal(18,2)) AS total_mrr",
        "id AS account_count", "'s' AS sample_feedbacks", "'w' AS ai_insight",
    )
    return runs, rows


def test_many_runs_are_in_few_files(spark, tmp_path, ranked, totals):
    path = str(tmp_path)
    runs, rows = _many(spark, 10_000)
    save_runs(runs, rows, path)
    save_run(SPEC, totals, ranked, path)
    assert compact(spark, path, rows_per_file=5_000) == 1
    save_run(SPEC, totals, ranked, path)
    detail = history_detail(load_runs(spark, path), load_features(spark, path))
    assert detail.count() == 40_010
    files = [f for f in load_features(spark, path).inputFiles() if "analysis_features" in f]
    assert len([f for f in files if "packed" in f]) == 9 and len(files) <= 9 + 8
    # one run: of the packed files those that hold it
    one = load_run_features(spark, path, 7_000)
    assert [r["rank"] for r in one.collect()] == [1, 2, 3, 4]
    assert len([f for f in one.inputFiles() if "analysis_features/packed" in f]) <= 2
    assert load_run_features(spark, path, 10_002).count() == 5 and load_run_features(spark, path, 20_000).count() == 0
    assert saved_cards(spark, path).count() == 10_002


def test_a_run_larger_than_a_file(spark, tmp_path):
    path = str(tmp_path)
    runs, rows = _many(spark, 3, features=500)
    save_runs(runs, rows, path)
    compact(spark, path, rows_per_file=200)
    assert [r["rank"] for r in load_run_features(spark, path, 2).collect()] == list(range(1, 501))


@pytest.mark.parametrize("sent", [stored.SENT_SAVES, 1])
def test_a_save_of_most_rows_is_not_one_task(spark, monkeypatch, sent):
    """Rows meet their saves where they are, or in parts of a save."""
    monkeypatch.setattr(stored, "SENT_SAVES", sent)
    rows = spark.range(2000).select(
        F.when(F.col("id") % 100 != 0, F.lit(1)).otherwise(F.nullif(F.col("id") % 700, F.lit(0))).cast("long").alias("run_id"),
        F.array(F.struct(F.col("id").alias("part"))).alias("part"), F.when(F.col("id") % 3 > 0, F.lit("s")).alias("save_id"),
    )
    saves = spark.createDataFrame([("s", 1, "rest"), ("s", 100, "rest"), (None, 200, "rest"), ("t", 300, "rest")], "save_id string, run_id long, more string")
    found = stored.under_saves(rows, saves)
    assert found.columns == rows.columns
    plain = rows.where("save_id = 's' AND run_id IN (1, 100)")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty() and plain.count() > 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = stored.under_saves(rows, saves).groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks < 500


def test_saves_pack_the_store_by_themselves(spark, tmp_path, ranked, totals, monkeypatch):
    from feedback_rank.sinks import history

    monkeypatch.setattr(history, "COMPACT_SAVES", 3)
    path = str(tmp_path)
    for _ in range(7):
        save_run(SPEC, totals, ranked.limit(1), path)
    assert generations(spark, path).packed == 2
    assert [r["id"] for r in load_runs(spark, path).orderBy("id").collect()] == list(range(1, 8))


def test_ids_of_many_writers(spark, tmp_path, ranked, totals):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path)
    sessions = [spark.newSession() for _ in range(4)]

    def writer(session):
        mine, of_all = session.createDataFrame(ranked.collect(), ranked.schema), session.createDataFrame(totals.collect(), totals.schema)
        return [save_run(SPEC, of_all, mine, path) for _ in range(2)]

    with ThreadPoolExecutor(4) as pool:
        ids = [i for found in pool.map(writer, sessions) for i in found]
    assert len(set(ids)) == 8
    assert {r["id"] for r in load_runs(spark, path).collect()} == set(ids) and load_features(spark, path).count() == 40


def test_an_id_that_someone_claimed_is_left_out(spark, tmp_path, ranked, totals):
    path = str(tmp_path)
    assert claim_run_id(spark, path) == 1  # and never saved
    assert save_run(SPEC, totals, ranked, path) == 2
    delete_runs(spark.createDataFrame([(2,)], "run_id long"), path)
    purge(spark, path)
    assert save_run(SPEC, totals, ranked, path) == 3


@pytest.mark.parametrize("when", ["before the header", "after the header"])
def test_a_save_while_the_store_is_packed_is_not_lost(spark, tmp_path, ranked, totals, monkeypatch, when):
    from feedback_rank.sinks import history

    path, real, done = str(tmp_path), history.save_headers, []
    save_run(SPEC, totals, ranked, path)

    def header(*args, **options):
        if when == "after the header":
            real(*args, **options)
        if not done:
            done.append(compact(spark, path))
        if when == "before the header":
            real(*args, **options)

    monkeypatch.setattr(history, "save_headers", header)
    assert save_run(SPEC, totals, ranked.limit(2), path) == 2
    assert [r["id"] for r in load_runs(spark, path).orderBy("id").collect()] == [1, 2]
    assert load_run_features(spark, path, 2).count() == 2
    purge(spark, path)
    assert load_run_features(spark, path, 2).count() == 2 and load_features(spark, path).count() == 7


def test_a_crash_while_packing_loses_nothing(spark, tmp_path, ranked, totals, monkeypatch):
    from feedback_rank.sinks import history

    path, real = str(tmp_path), history._mark
    save_run(SPEC, totals, ranked, path)

    def crash(spark, path, generation, state, *more):
        if state == "packed":
            raise RuntimeError("gone")
        real(spark, path, generation, state, *more)

    monkeypatch.setattr(history, "_mark", crash)
    with pytest.raises(RuntimeError):
        compact(spark, path)
    monkeypatch.setattr(history, "_mark", real)
    assert load_features(spark, path).count() == 5
    save_run(SPEC, totals, ranked.limit(1), path)
    compact(spark, path)
    assert load_features(spark, path).count() == 6 and load_runs(spark, path).count() == 2


def test_cards_are_those_from_scratch(spark, tmp_path, ranked, totals):
    path = str(tmp_path)

    def check():
        from_scratch = history_cards(load_runs(spark, path), load_features(spark, path)).collect()
        assert saved_cards(spark, path).collect() == from_scratch
        return [(r["id"], r["feature_count"]) for r in from_scratch]

    at = datetime(2025, 11, 1, 10, tzinfo=timezone.utc)
    for run_id, n in ((1, 5), (2, 0), (3, 4)):
        save_run(SPEC, totals, ranked.limit(n), path, run_id, at)
    assert check() == [(3, 4), (2, 0), (1, 5)]
    save_run(SPEC, totals, ranked.limit(1), path, 1, at)
    delete_runs(spark.createDataFrame([(3,)], "run_id long"), path)
    assert check() == [(2, 0), (1, 1)]
    compact(spark, path)
    save_run(SPEC, totals, ranked, path, 3, at)
    assert check() == [(3, 5), (2, 0), (1, 1)]
    plan = saved_cards(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "analysis_features" not in plan


def test_export_names():
    assert export_name(RAW_EXPORT, SPEC) == "feedback_raw_2025-10-01_2025-10-31.csv"
    assert export_name(FEATURE_EXPORT, SPEC) == "feature_analysis_2025-10-01_2025-10-31.csv"


def test_export_headers(spark, tmp_path):
    from feedback_rank.schemas import FEEDBACK, RUN_FEATURES

    raw = export_table(spark.createDataFrame([], FEEDBACK), RAW_EXPORT)
    assert raw.columns[:5] == ["Account Owner", "Platform Client ID", "Account Name", "Real MRR Last Month", "Last Invoiced TPV"]
    ranked = spark.createDataFrame([], RUN_FEATURES).withColumn("accounts", F.lit(""))
    assert export_table(ranked, FEATURE_EXPORT).columns == ["Feature", "Total MRR", "Account Count", "Accounts", "Sample Feedbacks", "AI Insight"]


def test_csv_text(spark, tmp_path):
    """The same bytes as a pandas export, and the same rows back."""
    path = str(tmp_path / "out.csv")
    df = spark.createDataFrame(
        [("a,b", 'q"q', " lead", None), ("line\nbreak", "", "tail ", 1.5), ("é", "back\\slash", "'", 0.0)], "a string, b string, c string, d double"
    ).coalesce(1)
    write_csv(df, path)
    part = next(p for p in (tmp_path / "out.csv").iterdir() if p.name.startswith("part-"))
    assert part.read_bytes() == df.toPandas().to_csv(index=False).encode("utf-8")
    back = read_csv(spark, path, df.schema)
    want = df.withColumn("b", F.when(F.col("b") != "", F.col("b")))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_a_store_is_sorted_some_runs_at_a_time(spark):
    """A run of any size is sorted by itself; small ones are sorted together."""
    from feedback_rank.sinks import history

    sizes = {1: 3, 2: 3, 3: 50, 4: 3}
    rows = [(run, rank, f"f{rank}", None, 1, "", "") for run, size in sizes.items() for rank in range(1, size + 1)]
    features = spark.createDataFrame(rows, "run_id long, rank long, feature string, total_mrr decimal(18,2), account_count long, sample_feedbacks string, ai_insight string")
    spans = history._spans(features, 10)
    assert spans == [(1, 3, 56), (4, 4, 3)]
    assert history._spans(features.limit(0), 10) == []
    assert sum(count for _, _, count in spans) == len(rows)
