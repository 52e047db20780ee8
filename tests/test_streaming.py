import time

import pandas as pd
import pytest

from sparrowhawk.streaming import sessions as S


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


@pytest.fixture()
def source(spark, tmp_path):
    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.05)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def acts(n, user=1, start=0):
    t0 = pd.Timestamp("2024-01-01")
    return [(user, start + i, (t0 + pd.Timedelta(minutes=start + i)).to_pydatetime(), "blocked" if i % 5 == 0 else "file_read", 5 if i % 5 == 0 else 1) for i in range(n)]


SCHEMA = "user_id long, event_id long, ts timestamp, type string, risk int"


def test_reports_every_twenty(spark, source):
    got = run(spark, S.running_reports(source([acts(30), acts(30, start=30), acts(5, user=2)], SCHEMA)), "reports")
    assert sorted((r["user_id"], r["events"], r["risk_score"], r["blocks"]) for r in got) == [(1, 20, 36, 4), (1, 40, 72, 8), (1, 60, 108, 12)]


def test_totals_are_those_of_a_batch(spark, source):
    rows = [acts(30), acts(10, user=2, start=30)]
    got = {(r["user_id"], r["events"], r["risk_score"], r["risk_level"]) for r in run(spark, S.totals_of(source(rows, SCHEMA)), "totals", "complete")}
    want = S.totals_of(spark.createDataFrame(rows[0] + rows[1], SCHEMA))
    assert got == {(r["user_id"], r["events"], r["risk_score"], r["risk_level"]) for r in want.collect()}


def test_windowed_sessions(spark, source):
    late = [(9, 0, pd.Timestamp("2024-01-05").to_pydatetime(), "file_read", 1)]
    got = run(spark, S.windowed_sessions(source([acts(10), acts(5, start=200), late, late], SCHEMA)), "windows")
    assert sorted((r["user_id"], r["events"], r["risk_score"]) for r in got if r["user_id"] == 1) == [(1, 5, 9), (1, 10, 18)]


def test_secrets_in_pieces(spark, source):
    key = "sk-ant-" + "a1" * 15
    text = "x" * 300 + f" {key} tail " + "y" * 300
    cut = [text[:310], text[310:330], text[330:]]
    rows = [[(1, i, part), (2, i, "nothing")] for i, part in enumerate(cut)]
    got = {(r["stream_id"], r["rule_id"], r["at"]) for r in run(spark, S.delta_violations(source(rows, "stream_id long, seq int, delta string")), "deltas")}
    assert (1, "secret.anthropic-key", text.index(key)) in got
    assert {(s, r) for s, r, _ in got} == {(1, "secret.anthropic-key")} and len(got) == 1


def test_long_values_with_predicates_in_small_pieces(spark, source):
    value = "Zx8" * 300
    text = f"note password = '{value}' and mongodb+srv://svc:{'h' * 400}@db password = 'changeme'"
    pieces = [text[i : i + 7] for i in range(0, len(text), 7)]
    rows = list(enumerate(pieces))
    got = run(spark, S.delta_violations(source([[(1, i, p) for i, p in rows[j : j + 60]] for j in range(0, len(rows), 60)], "stream_id long, seq int, delta string")), "long_deltas")
    assert sorted((r["rule_id"], r["at"], r["first"]) for r in got) == [("secret.connection-string", text.index("mongodb"), False), ("secret.generic-credential", text.index("password"), True)]


def test_open_from():
    assert S.open_from("x" * 1000, 256) == 0  # one run
    assert S.open_from("x " * 500, 256) == 744
    text = "a b " * 200 + "password = 'word word " + "w " * 300
    assert S.open_from(text, 256) == text.index("password")


def test_recent_events_keep_a_bounded_buffer(spark, source):
    got = run(spark, S.recent_events(source([acts(30), acts(10, start=30)], SCHEMA), most=8), "recent", "append")
    last = max(got, key=lambda r: r["events"])
    assert (last["events"], last["kept"], last["risk_score"], len(last["types"])) == (40, 8, 72, 8)


def test_tool_arguments_are_whole_once(spark, source):
    parts = ['{"cmd": "a', ' }", "n"', ": [1]}", " "]
    rows = [[(1, 0, i, p), (1, 1, i, "[" if i == 0 else "]" if i == 3 else "")] for i, p in enumerate(parts)]
    got = run(spark, S.tool_arguments(source(rows, "stream_id long, call int, seq int, delta string")), "tools")
    assert sorted((r["call"], r["arguments"]) for r in got) == [(0, "".join(parts[:3])), (1, "[]")]


def test_changed_paths(spark, source):
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    got = run(spark, S.changed_paths(source([[("a", t), ("a", t)], [("a", t), ("b", t)]], "path string, ts timestamp")), "paths")
    assert sorted(r["path"] for r in got) == ["a", "b"]


def test_sink_is_written_once(spark, source, tmp_path):
    stream = source([acts(3), acts(3, start=3)], SCHEMA)
    for _ in range(2):  # the second start finds nothing new
        q = S.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.select("batch").distinct().count() == 2
