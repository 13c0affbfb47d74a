"""The jobs: reruns, growing input, failures midway, command lines."""

import json
import math
import sys

import pytest

from jobs import conversation_codes, training_codes
from jobs.common import settings

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, users, n=20):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + k, start + datetime.timedelta(seconds=37 * k), u, "e", float("nan") if k == 3 else float((k * k + u) % 11), '{"k": %d}' % (k * u % 7)) for u in users for k in range(n)]
    return spark.createDataFrame(rows, EVENT)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


# training codes


def test_training_codes_rerun(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "codes")
    events(spark, range(30)).unionByName(events(spark, [30, 31], 6)).write.parquet(src)
    first = rows(training_codes.run(spark, src, out))
    got = training_codes.run(spark, src, out)
    assert rows(got) == first
    assert {p.name for p in (tmp_path / "codes").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    assert 12 not in {r["label"] for r in got.select("label").collect()}
    short = got.filter("status = 'short'").collect()
    assert {r["seq_id"] for r in short} == {30, 31} and all(r["level"] is None for r in short)
    for r in got.filter("status = 'ok'").groupBy("seq_id").agg({"*": "count", "sx": "max"}).collect():
        assert r["count(1)"] == 15
    size = {}
    for r in got.filter("status = 'ok'").collect():
        size[r["seq_id"]] = size.get(r["seq_id"], 0) + r["sx"] ** 2 + r["sy"] ** 2 + r["sz"] ** 2
    assert all(math.isclose(x, 1, rel_tol=1e-7) for x in size.values())


def test_training_codes_replace_what_is_gone(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "codes")
    events(spark, range(30)).write.parquet(src)
    training_codes.run(spark, src, out)
    events(spark, range(5)).write.mode("overwrite").parquet(src)
    assert {r["seq_id"] for r in training_codes.run(spark, src, out).collect()} == set(range(5))


def test_training_codes_empty_and_still(spark, tmp_path):
    src = str(tmp_path / "events")
    events(spark, []).write.parquet(src)
    assert training_codes.run(spark, src, str(tmp_path / "none")).count() == 0
    events(spark, [1]).selectExpr("event_id", "timestamp '2024-01-01' as ts", "user_id", "event_type", "1.0d as value", "'{\"k\": 1}' as props").write.mode("overwrite").parquet(src)
    assert training_codes.run(spark, src, str(tmp_path / "still"), training_codes.Config(shortest=1, ends=0)).filter("abs(sx) > 0").isEmpty()


# conversation codes

TURN = "conv_id long, turn long, role string, text string"


def turns(convs, first, last):
    return [(c, t, "user" if t % 2 else "assistant", f"w{t} " * ((c * 5 + t * 3) % 9) + "\n" * (t % 3)) for c in convs for t in range(first, last)]


def whole(spark, data):
    df = spark.createDataFrame(data, TURN)
    return rows(conversation_codes.codes(conversation_codes.points(df, 4)))


def add(spark, data, path):
    spark.createDataFrame(data, TURN).coalesce(1).write.mode("append").parquet(path)


CONFIG = conversation_codes.Config(buckets=4)


def test_growing_input(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")
    a, b = turns(range(12), 0, 4), turns(range(3, 6), 4, 9) + turns([50], 0, 2)
    add(spark, a, src)
    assert rows(conversation_codes.run(spark, src, out, CONFIG)) == whole(spark, a)
    add(spark, b, src)
    assert rows(conversation_codes.run(spark, src, out, CONFIG)) == whole(spark, a + b)
    # the second run took the new turns alone
    landed = spark.read.parquet(f"{out}/points")
    assert {r["batch"]: r["count"] for r in landed.groupBy("batch").count().collect()} == {0: len(a), 1: len(b)}


def test_nothing_new_changes_nothing(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")
    add(spark, turns(range(6), 0, 5), src)
    first = rows(conversation_codes.run(spark, src, out, CONFIG))
    files = lambda: sorted((str(p), p.stat().st_mtime_ns) for d in ("points", "codes") for p in (tmp_path / "out" / d).rglob("part-*"))
    before = files()
    assert rows(conversation_codes.run(spark, src, out, CONFIG)) == first and files() == before


def test_a_batch_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")
    a, b = turns(range(6), 0, 5), turns(range(6), 5, 7)
    add(spark, a, src)
    conversation_codes.run(spark, src, out, CONFIG)
    add(spark, b, src)
    with monkeypatch.context() as m:
        m.setattr(conversation_codes, "codes", lambda p: 1 / 0)  # after the points have landed
        with pytest.raises(Exception, match="ZeroDivisionError"):
            conversation_codes.run(spark, src, out, CONFIG)
    assert rows(conversation_codes.run(spark, src, out, CONFIG)) == whole(spark, a + b)


def test_batches_of_one_file(spark, tmp_path):
    src = str(tmp_path / "turns")
    data = [turns(range(k, k + 4), k, k + 3) for k in range(3)]
    for d in data:
        add(spark, d, src)
    got = conversation_codes.run(spark, src, str(tmp_path / "out"), conversation_codes.Config(buckets=4, files_per_batch=1))
    assert rows(got) == whole(spark, sum(data, []))
    assert spark.read.parquet(str(tmp_path / "out/points")).select("batch").distinct().count() == 3


def test_repeats_nulls_and_no_input(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")
    add(spark, [], src)
    assert conversation_codes.run(spark, src, out, CONFIG).count() == 0
    odd = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "another text"), (1, None, None, None), (None, 3, "user", "x"), (2, 7, "user", ""), (3, 1, "user", "long " * 200_000), (3, 2, "user", "b\nc")]
    add(spark, odd, src)
    got = conversation_codes.run(spark, src, out, CONFIG)
    assert rows(got) == whole(spark, odd)
    assert {(r["conv_id"], r["turns"]) for r in got.collect()} == {(1, 2), (2, 1), (3, 2)}
    add(spark, odd[:3][::-1], src)
    assert rows(conversation_codes.run(spark, src, out, CONFIG)) == whole(spark, odd)


# command lines


def test_settings_refuse_unknown_names():
    assert settings(training_codes.Config, {"without": [3]}).without == (3,)
    with pytest.raises(ValueError, match="frames"):
        settings(training_codes.Config, {"frames": 2})


def test_command_line_parses_config_and_paths(tmp_path, monkeypatch):
    from jobs import common

    seen, stopped = [], []

    class Fake:
        builder = property(lambda self: self)
        appName = config = lambda self, *a: self
        getOrCreate = lambda self: self
        stop = lambda self: stopped.append(1)

    monkeypatch.setattr(common, "SparkSession", Fake())
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"buckets": 3}))
    common.command_line("x", conversation_codes.Config, ("turns", "out"), lambda s, *a: seen.append(a), ["--turns", "a", "--out", "b", "--config", str(c)])
    assert seen == [("a", "b", conversation_codes.Config(buckets=3))] and stopped == [1]


def test_shipped_configs():
    from pathlib import Path

    for m in (training_codes, conversation_codes):
        settings(m.Config, json.loads(Path(m.__file__).with_suffix(".json").read_text()))


def test_command_line_runs(spark, tmp_path):
    import os
    import subprocess
    from pathlib import Path

    events(spark, range(6)).write.parquet(str(tmp_path / "events"))
    root = Path(training_codes.__file__).resolve().parents[1]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    r = subprocess.run([sys.executable, "-m", "jobs.training_codes", "--events", str(tmp_path / "events"), "--out", str(tmp_path / "out"), "--config", "jobs/training_codes.json"], cwd=root, env=env, capture_output=True, text=True, timeout=240)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "reading" in r.stderr and "wrote" in r.stderr
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 * 15
