import datetime
import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import extend, report
from scanloom.operators.scan import scan
from scanloom.streaming import incremental as inc


@pytest.fixture(scope="module")
def found(spark):
    rows = [("p/a.py", "python", "eval(a)\nos.system(b)\nyaml.load(c)"), ("p/b.go", "go", "rand.Int()\nmath/rand"),
            ("q/c.js", "javascript", "Math.random()\nel.innerHTML = x")]
    return scan(spark.createDataFrame(rows, "path string, language string, text string"), threshold="info").cache()


def test_counts_keep_empty_severities(found):
    row = report.severity_counts(found).first()
    assert row.info == 0 and row.total == found.count() and row.critical > 0
    summary = report.scan_report(found, "id", "now").first().summary
    assert summary.severity_counts["info"] == 0 and summary.total_vulnerabilities == row.total
    assert summary.scanned_files == 3


def test_order_and_top(found):
    rows = [(r.path, r.line) for r in report.in_order(found).collect()]
    assert rows == sorted(rows)
    assert [r.severity for r in report.most_severe(found, 2).collect()] == ["critical", "critical"]
    top = report.top_per(found, "path", 1)
    assert top.count() == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_filters_and_display(found):
    assert report.filter_findings(found, path="q/c.js", threshold="high").where("severity = 'medium'").count() == 0
    assert report.display(found).first().confidence == "medium"


def test_exports_are_json(found):
    result = json.loads(report.sarif_results(found).first().result)
    assert result["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1
    assert "code_snippet" in json.loads(report.report_lines(found).first().json)


def test_new_and_fixed_findings(found):
    before = found.where("path <> 'q/c.js'")
    assert {r.path for r in report.new_findings(found, before).collect()} == {"q/c.js"}
    assert {r.path for r in report.fixed_findings(before, found).collect()} == {"q/c.js"}


def test_latest_scans_and_trend(spark):
    scans = spark.createDataFrame([(f"s{i}", i) for i in range(15)], "scan_id string, scan_ts int")
    assert [r.scan_id for r in report.latest_scans(scans).collect()][:2] == ["s14", "s13"]
    counts = spark.createDataFrame([(1, "high", 3), (2, "high", 5)], "scan_ts int, severity string, total int")
    assert [(r.scan_ts, r.change) for r in report.trend(counts).orderBy("scan_ts").collect()] == [(1, 3), (2, 2)]


def test_risk_score(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4), (50, 0, 0, 0)], "c int, h int, m int, l int")
    assert [r[0] for r in frame.select(report.risk_score(*[F.col(c) for c in "chml"])).collect()] == [30, 100]


def test_own_detector_and_helpers(spark, texts):
    def shouting(text, language):
        for number, line in enumerate(text.split("\n"), 1):
            if line.isupper():
                yield {"rule_id": "shout", "line": number, "matched_code": line}

    rows = extend.run_detector(texts(("a", "x", "hi\nHO"), ("b", "x", "ho")), shouting).collect()
    assert [(r.path, r.line, r.severity, r.column_start, r.cwe) for r in rows] == [("a", 2, "medium", 1, "CWE-UNKNOWN")]
    maps = spark.sql("SELECT map('a', 1, 'b', 2) x, map('b', 3, 'c', 4) y")
    assert maps.select(extend.merge_maps(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 3, "c": 4}
    ids = spark.sql("SELECT timestamp'2026-01-02 03:04:05' t").select(
        extend.make_scan_id(F.lit("root"), F.col("t")), extend.iso_time(F.col("t"))).first()
    assert len(ids[0]) == 16 and ids[1] == "2026-01-02T03:04:05.000000Z"


# --- streams -----------------------------------------------------------------

SCHEMA = "path string, language string, text string, ts timestamp"


def at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def land(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    return query


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"f{i}", "python", f"eval(a{i})\nos.system(b)", at(i)) for i in range(20)]
    for part in (rows[:7], rows[7:15], rows[15:] + rows[:2]):
        land(spark, tmp_path / "in", *part)
    stream = inc.scan_stream(inc.table_stream(spark, str(tmp_path / "in"), SCHEMA, 1), threshold="info")
    query = run(stream, "found")
    got = sorted(r.finding_id for r in spark.table("found").collect())
    query.stop()
    table = spark.createDataFrame(rows, SCHEMA).drop("ts")
    assert got == sorted(r.finding_id for r in scan(table, threshold="info").collect())


def test_windows_on_a_stream_drop_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    land(spark, folder, ("a", "python", "eval(x)", at(5)), ("b", "python", "eval(x)", at(50)))
    counts = inc.window_counts(inc.scan_stream(inc.table_stream(spark, str(folder), SCHEMA, 1), packs=["pattern"],
                                               delay="10 minutes"), "1 hour")
    query = run(counts, "windows")
    for name, minute in (("c", 130), ("d", 200), ("late", 8), ("e", 400)):
        land(spark, folder, (name, "python", "eval(x)", at(minute)))
        query.processAllAvailable()
    rows = {(r.window_start, r.total) for r in spark.table("windows").collect()}
    query.stop()
    assert {(at(0), 2), (at(120), 1), (at(180), 1)} == rows


def test_sessions_in_slices_equal_sessions_by_hand(spark):
    times = [0, 10, 39, 70, 1435, 1441, 1460, 3000, 3000, 5000]
    frame = spark.createDataFrame([("hot", at(t)) for t in times] + [("x", at(3))], "path string, ts timestamp")
    rows = inc.session_counts(frame, "30 minutes").orderBy("path", "session_start").collect()
    assert [(r.path, r.session_start, r.session_end, r.total) for r in rows] == [
        ("hot", at(0), at(69), 3), ("hot", at(70), at(100), 1), ("hot", at(1435), at(1490), 3),
        ("hot", at(3000), at(3030), 2), ("hot", at(5000), at(5030), 1), ("x", at(3), at(33), 1)]


def test_only_new_findings_are_stored(spark, tmp_path):
    land(spark, tmp_path / "in", ("a", "python", "eval(x)", at(0)), ("b", "python", "eval(x)", at(1)))
    stream = inc.scan_stream(inc.table_stream(spark, str(tmp_path / "in"), SCHEMA), packs=["pattern"], delay="1 minute")
    store = lambda: inc.write_new(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    store()
    land(spark, tmp_path / "in", ("a", "python", "eval(x)", at(500)), ("c", "python", "eval(x)", at(501)))
    store()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.path for r in rows) == ["a", "b", "c"]


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("eval(x)\r\n")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("eval(x)")
    query = run(inc.scan_stream(inc.file_stream(spark, str(tmp_path / "src")), packs=["pattern"]), "files_found")
    rows = spark.table("files_found").collect()
    query.stop()
    assert [(r.path.split("/")[-1], r.rule_id) for r in rows] == [("a.py", "py-eval-usage")]




def test_report_of_a_scan_by_id(spark, texts):
    from scanloom.operators.report import report_of

    found = scan(texts(("a", "python", "eval(x)\nexec(x)")), packs=["pattern"], scan_id="s3")
    scans = spark.createDataFrame([(f"s{i}", i) for i in range(12)], "scan_id string, scan_ts int")
    known = report_of(found, scans, "s3").collect()
    assert [(r.known, r.total, r.last_scans) for r in known] == [(True, found.count(), None)]
    empty = report_of(found, scans, "s5").first()
    assert empty.known and empty.total == 0
    unknown = report_of(found, scans, "none").first()
    assert not unknown.known and unknown.last_scans == sorted(f"s{i}" for i in range(2, 12))


def test_a_stored_report_is_read_back(spark, found):
    lines = report.report_lines(found)
    back = report.read_report_lines(lines)
    assert sorted(map(str, back.drop("problem").collect())) == sorted(map(str, report.display(found).collect()))
    odd = spark.createDataFrame([("{",), ("[1]",), (None,), ("{}",), ('{"id": "a", "line": "x"}',)], "json string")
    assert [r.problem is not None for r in report.read_report_lines(odd).collect()] == [True] * 5


def test_history_kept_scan_by_scan_equals_history_of_all(spark):
    import random

    rng = random.Random(3)
    scans = [(f"s{k}", k, sorted(rng.sample(range(40), rng.randrange(30)))) for k in range(5)]
    rows = [(str(i), s, t) for s, t, ids in scans for i in ids]
    whole = report.history(spark.createDataFrame(rows, "finding_id string, scan_id string, scan_ts int"))
    held = report.history(spark.createDataFrame([r for r in rows if r[1] == "s0"], "finding_id string, scan_id string, scan_ts int"))
    for s, t, ids in scans[1:]:
        held = report.updated_history(held, spark.createDataFrame([(str(i),) for i in ids] * 2, "finding_id string"), s, t)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, whole.collect()))
    state = {r.finding_id: r.state for r in report.with_state(held, "s4").collect()}
    last, before = set(scans[4][2]), {i for _, _, ids in scans[:4] for i in ids}
    assert state == {str(i): "fixed" if i not in last else "open" if i in before else "new" for i in last | before}


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_report_lines_are_read_once(spark):
    lines = spark.createDataFrame([('{"id": "a", "line": 3}',), ("none",), (None,)], "json string")
    read = report.read_report_lines(lines)
    assert _plan(read.where("problem IS NULL")).count("from_json") == 1
    assert [(r.id, r.line, r.problem) for r in read.collect()] == [("a", 3, None), (None, None, "none"), (None, None, "")]


def test_history_sends_its_rows_once(spark):
    rows = spark.createDataFrame([("a", "s1", 1, "x"), ("a", "s2", 2, "x"), ("a", "s2", 2, "y"), ("b", "s1", 1, "x")], "finding_id string, scan_id string, scan_ts int, path string")
    held = report.history(rows)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "path" not in plan.split("Exchange")[1].split("\n")[1]
    assert sorted(map(tuple, held.select("finding_id", "first_seen", "last_seen", "scans").collect())) == [("a", "s1", "s2", 2), ("b", "s1", "s1", 1)]
