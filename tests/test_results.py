"""Results: order-dependent folds, statistics at their edges, guards, JSON trees, reports."""

import itertools
import json

import pytest

from flatewise.operators import results
from flatewise.sources import files, reports

KEY = "tool string, level int, threads int, data_type string"


def test_dedup_depends_on_order(spark):
    rows = [(5, 0.04), (10, 0.09), (7, 0.06)]
    winners = set()
    for order in itertools.permutations(range(3)):
        df = spark.createDataFrame([("a", 1, i, *rows[j]) for i, j in enumerate(order)], "tool string, level int, arrival int, trials int, cv double")
        winners.add(results.deduplicated(df, ["tool", "level"], "arrival").first()["trials"])
    assert winners == {5, 7, 10}


@pytest.mark.parametrize(("times", "want"), [([3.0], (3.0, 0.0, 1)), ([1.0, 1.0], (1.0, 0.0, 2)), ([1.0, 1.1, 0.9, 9.0], (1.0, 0.1, 3)), ([0.0, 0.0, 5.0, 5.0, 5.0], (5.0, 2.7386, 5))])
def test_robust(spark, times, want):
    got = results.robust_stats(spark.createDataFrame([("a", t) for t in times], "k string, t double"), ["k"], "t").first()
    assert (got["median"], round(got["stdev"], 4), got["n_kept"]) == want


def test_welch_edges(spark):
    frame = lambda xs: spark.createDataFrame([("k", x) for x in xs], "k string, t double")
    assert not results.welch(frame([1.0]), frame([1.0, 2.0]), ["k"], "t", 5).first()["ok"]
    assert results.welch(frame([1.0, 1.0]), frame([1.0, 1.0]), ["k"], "t", 5).first()["ok"]
    assert not results.welch(frame([2.0, 2.0]), frame([1.0, 1.0]), ["k"], "t", 5).first()["ok"]


def test_guards_and_tally(spark):
    rows = [("self", 9, 1, "text", 95.0, 1006, 1), ("pigz", 9, 1, "text", 100.0, 1000, 2), ("self", 1, 1, "text", 1.0, 1, 3), ("pigz", 1, 1, "text", 0.0, 1, 4), ("self", 3, 1, "x", 1.0, 1, 5)]
    got = results.compression_guards(spark.createDataFrame(rows, f"{KEY}, speed double, size long, arrival int"), "self", "arrival")
    assert {r["metric"]: r["passed"] for r in got.collect()} == {"speed_vs_pigz": True, "size_vs_pigz": False}
    assert results.tally(got).first()["exit_code"] == 1
    none = results.tally(got.where("false")).first()
    assert (none["n_guards"], none["all_passed"]) == (0, False)
    assert reports.summary(results.tally(got)) == "FAIL: 1 of 2 guards"


def test_convergence(spark):
    rows = [("a", i, t) for i, t in enumerate([1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    got = results.converged_at(spark.createDataFrame(rows, "k string, i int, t double"), ["k"], "i", "t", 0.34).first()
    assert got["converged_at"] == 7


def test_json_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "text-1.json").write_text(json.dumps({"results": [{"tool": "unpigz", "speed_mbps": 5.0, "level": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"tool": "self", "speed": 7.0}, {"tool": "self", "error": "x"}]))
    (tmp_path / "c.json").write_text(json.dumps({"compression": [{"tool": "gzip"}], "decompression": [{"tool": "gzip"}]}))
    (tmp_path / "bad.json").write_text("{no json")
    (tmp_path / "other.txt").write_text("[]")
    got = results.normalised(files.result_files(spark, str(tmp_path))).collect()
    assert sorted((r["tool"], r["speed"]) for r in got) == [("gzip", 0.0), ("gzip", 0.0), ("pigz", 5.0), ("self", 0.0), ("self", 7.0)]
    files.write_results(spark.createDataFrame([("a", 1)], "tool string, level int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", None)], "tool string, speed double")
    assert reports.markdown(df, ["tool"]).splitlines()[2:] == ["| a | - |", "| b | 2.00 |"]
    assert "<td>2.00</td>" in reports.html_table(df, ["tool"]) and "#" in reports.bars(df, "tool", "speed")


def test_reports_hold_all_rows(spark):
    from flatewise.sources import reports

    rows = spark.range(1200).selectExpr("id as name", "cast(id as double) as value")
    assert len(reports.markdown(rows, ["name"]).splitlines()) == 1202
    assert reports.html_table(rows, ["name"]).count("<tr>") == 1201
    assert len(reports.bars(rows, "name", "value").splitlines()) == 1200
    assert len(reports.markdown(rows, ["name"], limit=3).splitlines()) == 5
