"""Stored scopes: the same spec reads, a new file or an hour makes anew."""

from datetime import date

import pytest

from feedback_rank import RunSpec
from feedback_rank.plans.cache import cached_scope, inputs_digest, scope_key
from feedback_rank.spec import MINIMUM_MRR


@pytest.fixture
def inputs(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    return path


def test_read_again_until_something_changes(spark, tmp_path, inputs):
    made, clock, folder = [], [1_800_000_000.0], str(tmp_path / "cache")

    def get(spec=RunSpec(keyword="x"), session=spark):
        def make():
            made.append(spec)
            return session.read.parquet(inputs)

        return cached_scope(session, folder, spec, [inputs], make, now=lambda: clock[0]).count()

    assert (get(), get(), len(made)) == (10, 10, 1)
    assert get(session=spark.newSession()) == 10 and len(made) == 1  # another session
    clock[0] += 3599
    assert get() == 10 and len(made) == 1
    clock[0] += 2
    assert get() == 10 and len(made) == 2  # an hour has passed
    assert get(RunSpec(keyword="y")) == 10 and len(made) == 3
    spark.range(5).write.mode("append").parquet(inputs)
    assert (get(), len(made)) == (15, 4)  # a new file
    assert (get(), len(made)) == (15, 4)


def test_a_write_that_crashed_is_not_read(spark, tmp_path, inputs):
    folder, calls = str(tmp_path / "cache"), []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("gone")
        return spark.range(3)

    with pytest.raises(RuntimeError):
        cached_scope(spark, folder, RunSpec(), [inputs], make)
    assert cached_scope(spark, folder, RunSpec(), [inputs], make).count() == 3
    assert cached_scope(spark, folder, RunSpec(), [inputs], make).count() == 3 and len(calls) == 2


def test_keys(spark, tmp_path, inputs):
    one = RunSpec(date(2025, 10, 1), None, ("b", "a"), (), MINIMUM_MRR, 5.0)
    assert scope_key(one, "i") == scope_key(RunSpec(date(2025, 10, 1), None, ("a", "b"), (), MINIMUM_MRR, 5.0), "i")
    others = [RunSpec(date(2025, 10, 2), None, ("b", "a"), (), MINIMUM_MRR, 5.0), RunSpec(date(2025, 10, 1), None, (), ("b", "a"), MINIMUM_MRR, 5.0),
              RunSpec(date(2025, 10, 1), None, ("b", "a"), (), MINIMUM_MRR, 6.0), RunSpec(date(2025, 10, 1), None, ("ba",), (), MINIMUM_MRR, 5.0)]
    keys = {scope_key(one, "i"), scope_key(one, "j"), scope_key(one, "i", ["v2"]), *(scope_key(x, "i") for x in others)}
    assert len(keys) == 7
    assert inputs_digest(spark, [inputs]) == inputs_digest(spark, [inputs])
    assert spark.read.format("binaryFile").load(inputs).count() == int(inputs_digest(spark, [inputs]).split("-")[0])
