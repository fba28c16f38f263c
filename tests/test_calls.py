"""The ledger, the lanes and the progress of calls."""

import json
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedback_rank.operators import calls

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the service goes to the workers whole


def _chunks(spark, n, text="lines of {}"):
    return spark.createDataFrame([(i, text.format(i)) for i in range(n)], "chunk_id long, lines string").repartition(3)


class Service:
    """Allows ``most`` calls at once over all processes, and keeps what it was asked, in files."""

    def __init__(self, folder, most=1000, takes=0.0, crash=None, broken=()):
        self.folder, self.most, self.takes, self.crash, self.broken = Path(folder), most, takes, crash, tuple(broken)
        for name in ("open", "asked", "seen"):
            (self.folder / name).mkdir(exist_ok=True)

    def __call__(self, lines):
        import os
        import uuid

        mine = self.folder / "open" / uuid.uuid4().hex
        mine.touch()
        try:
            now = len(os.listdir(self.folder / "open"))
            (self.folder / "seen" / f"{now}-{mine.name}").touch()
            if now > self.most:
                raise RuntimeError("429 too many requests")
            if lines == self.crash:
                os._exit(3)
            (self.folder / "asked" / f"{lines} {mine.name}").touch()
            time.sleep(self.takes)
            if lines in self.broken:
                raise ValueError("500")
            return json.dumps(lines)
        finally:
            mine.unlink()

    def asked(self):
        return sorted(name.name.rsplit(" ", 1)[0] for name in (self.folder / "asked").iterdir())

    def most_seen(self):
        return max(int(name.name.split("-")[0]) for name in (self.folder / "seen").iterdir())


def _rows(frame):
    return sorted((r["chunk_id"], r["status"], r["error"], r["payload"]) for r in frame.collect())


def test_a_second_run_calls_only_what_failed(spark, tmp_path):
    ledger, chunks = str(tmp_path / "ledger"), _chunks(spark, 10)
    first = calls.call_chunks(chunks, Service(tmp_path, broken=["lines of 3", "lines of 7"]), ledger, in_flight=2)
    rows = _rows(first)
    assert [r[:3] for r in rows if r[1] == "failed"] == [(3, "failed", "500"), (7, "failed", "500")]
    again = calls.call_chunks(chunks, Service(tmp_path), ledger, in_flight=2)
    assert _rows(again) == [(i, "ok", None, json.dumps(f"lines of {i}")) for i in range(10)]
    assert _rows(first) == rows  # a result does not change under its reader
    # more chunks, and numbers that moved: known by their lines
    calls.call_chunks(_chunks(spark, 12).withColumn("chunk_id", F.col("chunk_id") + 5), Service(tmp_path), ledger)
    expected = [f"lines of {i}" for i in [*range(12), 3, 7]]
    assert Service(tmp_path).asked() == sorted(expected)
    assert calls.read_ledger(spark, ledger).count() == 14
    # another prompt
    calls.call_chunks(_chunks(spark, 2), Service(tmp_path), ledger, label="other")
    assert len(Service(tmp_path).asked()) == 16


def test_a_crash_costs_only_the_tasks_under_way(spark, tmp_path):
    ledger, chunks = str(tmp_path / "ledger"), _chunks(spark, 12)
    with pytest.raises(Exception):
        calls.call_chunks(chunks, Service(tmp_path, crash="lines of 8"), ledger, in_flight=2, lane_calls=2)
    done = {r["key"] for r in calls.read_ledger(spark, ledger).collect()}
    assert len(done) >= 8  # two waves of four
    calls.call_chunks(chunks, Service(tmp_path), ledger, in_flight=2, lane_calls=2)
    asked = Service(tmp_path).asked()
    assert set(asked) == {f"lines of {i}" for i in range(12)} and len(asked) <= 12 + 2 * 2
    assert all(asked.count(f"lines of {i}") == 1 for i in range(8))


def test_no_more_calls_at_once_than_allowed(spark, tmp_path):
    chunks = _chunks(spark, 24)
    found = calls.call_chunks(chunks, Service(tmp_path, most=3, takes=0.03), in_flight=3, lane_calls=4, waits=())
    assert [r[1] for r in _rows(found)] == ["ok"] * 24
    assert 1 < Service(tmp_path).most_seen() <= 3


def test_lanes_and_times_in_the_ledger(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    calls.call_chunks(_chunks(spark, 20), Service(tmp_path, takes=0.02), ledger, in_flight=4, lane_calls=2)
    rows = calls.read_ledger(spark, ledger).collect()
    assert {(r["lane"], r["wave"]) for r in rows} == {(i % 4, i // 8) for i in range(20)}
    for lane in range(4):  # one after the other
        spans = sorted((r["started_at"], r["ended_at"]) for r in rows if r["lane"] == lane)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_lane_keeps_its_pause(tmp_path):
    answers, slept = ["429", "ok", "ok", "ok", "429", "429", "ok", "500", "ok"], []

    def fn(data):
        answer = answers.pop(0)
        if answer != "ok":
            raise RuntimeError(answer)
        return answer

    lane = calls.Lane(fn, waits=(4, 8), sleep=slept.append)
    assert lane("a") == "ok" and slept == [4]
    assert lane("b") == "ok" and slept == [4, 2]  # half of it before the next call
    assert lane("c") == "ok" and slept == [4, 2, 1]
    assert lane("d") == "ok" and slept == [4, 2, 1, 4, 8]  # none before: it was below a second
    with pytest.raises(RuntimeError, match="500"):
        lane("e")
    assert lane("f") == "ok" and slept == [4, 2, 1, 4, 8, 4, 4]


def test_progress_grows_to_all(spark, tmp_path):
    seen, ledger = [], str(tmp_path / "ledger")
    calls.call_chunks(_chunks(spark, 10), Service(tmp_path, broken=["lines of 1"]), ledger, in_flight=2, lane_calls=2, on_progress=seen.append)
    assert seen == [0.0, 0.4, 0.8, 1.0]
    seen.clear()
    calls.call_chunks(_chunks(spark, 20), Service(tmp_path), ledger, in_flight=2, lane_calls=20, on_progress=seen.append)
    assert seen == [9 / 20, 1.0]
    seen.clear()
    calls.call_chunks(_chunks(spark, 20), Service(tmp_path), ledger, on_progress=seen.append)
    assert seen == [1.0]


def test_repeated_null_and_no_chunks(spark, tmp_path):
    seen = []
    rows = [(0, "same", 1), (1, "same", 2), (2, None, 3), (3, "", 4)]
    chunks = spark.createDataFrame(rows, "chunk_id long, lines string, key int")
    found = calls.call_chunks(chunks, Service(tmp_path), on_progress=seen.append)
    assert [(r[0], r[3]) for r in _rows(found)] == [(0, '"same"'), (1, '"same"'), (2, '""'), (3, '""')]
    assert Service(tmp_path).asked() == ["", "same"] and seen == [0.0, 1.0]
    assert calls.call_chunks(chunks.limit(0), Service(tmp_path), on_progress=seen.append).collect() == [] and len(seen) == 2
    with pytest.raises(ValueError):
        calls.call_chunks(chunks, Service(tmp_path), in_flight=0)


def test_quick_calls_take_several_waves_a_job(spark, tmp_path, monkeypatch):
    """A job a wave before: 25 of them; now the waves of a job double, and all else is the same."""
    ledger, seen = str(tmp_path / "ledger"), []
    found = calls.call_chunks(_chunks(spark, 99), Service(tmp_path), ledger, in_flight=2, lane_calls=2, on_progress=seen.append)
    assert _rows(found) == [(i, "ok", None, json.dumps(f"lines of {i}")) for i in range(99)]
    assert seen == [0.0, *(min(1.0, (99 - max(0, 99 - 4 * wave)) / 99) for wave in range(1, 26))]
    rows = calls.read_ledger(spark, ledger).collect()
    assert sorted((r["lane"], r["wave"]) for r in rows) == sorted((i % 2, i // 4) for i in range(99))
    assert len(list(Path(ledger).glob("*/*/_SUCCESS"))) < 15


def test_a_task_ends_with_its_wave_once_its_time_is_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "TASK_SECONDS", 0.0)
    ledger = str(tmp_path / "ledger")
    calls.call_chunks(_chunks(spark, 13), Service(tmp_path), ledger, in_flight=2, lane_calls=2)
    assert sorted(Service(tmp_path).asked()) == sorted(f"lines of {i}" for i in range(13))
    assert len(list(Path(ledger).glob("*/*/_SUCCESS"))) == 4  # a job a wave
