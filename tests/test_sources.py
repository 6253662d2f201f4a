import json

from pyspark.sql import functions as F

from scanloom.functions import language as lang
from scanloom.functions import text as tx
from scanloom.functions.severity import int_to_severity, meets, severity_rank, severity_to_int
from scanloom.operators.scan import scan
from scanloom.rules.catalog import builtin_rules, check_rules, enable_rules, list_rules, rules_frame, upsert_rules
from scanloom.sources.files import read_files
from scanloom.sources.rule_files import read_rule_file, read_rules, write_rules
from scanloom.sources.tables import as_texts, scripts, write_findings


def write(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_read_files(spark, tmp_path):
    root = tmp_path / "build"
    write(root, "a.py", "x\r\ny\rz")
    write(root, "bom.py", b"\xef\xbb\xbfeval(x)")
    write(root, "latin.PY", b"caf\xe9")
    write(root, "early.py", b"a\x00b")
    write(root, "late.py", b"a" * 8192 + b"\x00")
    write(root, "empty.js", "")
    write(root, "sub/deep/B.tsx", "é")
    write(root, ".hidden.py", "x")
    write(root, "app.min.js", "x")
    write(root, "poetry.lock", "x")
    for directory in lang.SKIP_DIRECTORIES:
        write(root, f"lib/{directory}/c.py", "x")
    rows = {r.rel_path: r for r in read_files(spark, str(root)).collect()}
    assert sorted(rows) == ["a.py", "bom.py", "late.py", "latin.PY", "sub/deep/B.tsx"]
    assert rows["a.py"].text == "x\ny\nz" and rows["a.py"].encoding == "utf-8"
    assert rows["bom.py"].text == "﻿eval(x)"
    assert rows["latin.PY"].text == "café" and rows["latin.PY"].encoding == "latin-1"
    assert rows["latin.PY"].language == "python" and rows["sub/deep/B.tsx"].language == "javascript"
    assert rows["late.py"].size == 8193


def test_read_files_by_extension_pattern_and_path(spark, tmp_path):
    for name in ("a.py", "b.js", "test_c.py", "sub/d.py"):
        write(tmp_path, name, "x")
    names = lambda **o: sorted(r.rel_path for r in read_files(spark, str(tmp_path), **o).collect())
    assert names(file_extensions=[".py"]) == ["a.py", "sub/d.py", "test_c.py"]
    assert names(exclude_patterns=["test_*", "sub/*"]) == ["a.py", "b.js"]
    assert names(recursive=False, file_extensions=[".py"]) == ["a.py", "test_c.py"]
    one = read_files(spark, [str(tmp_path / "a.py"), str(tmp_path / "b.js")]).collect()
    assert sorted(r.file_name for r in one) == ["a.py", "b.js"]


def test_scan_a_tree_and_store_it(spark, tmp_path):
    write(tmp_path, "src/a.py", "ok\nv = eval(user_input)\n")
    found = scan(read_files(spark, str(tmp_path / "src")), scan_id="s1")
    write_findings(found, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out")).where("scan_id = 's1'")
    assert {r.rule_id for r in stored.collect()} >= {"py-eval-usage", "PY001", "PY030"}


def test_texts_from_columns(spark):
    table = spark.createDataFrame([(1, "def f(): pass"), (2, "let x = 1")], "id long, body string")
    rows = as_texts(table, "t", "id", "body", "auto").orderBy("path").collect()
    assert [(r.path, r.language) for r in rows] == [("t/1", "python"), ("t/2", "javascript")]


def test_scripts(spark):
    page = "<SCRIPT>\nvar a = 1;\n</SCRIPT><script type='x'>eval(b)</script><script></script><scripty>no</scripty>"
    rows = scripts(spark.createDataFrame([(7, page)], "page_id long, html string")).collect()
    assert [(r.path, r.text) for r in rows] == [("pages/7:1", "\nvar a = 1;\n"), ("pages/7:2", "eval(b)")]


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*columns).first())


def test_text_functions(spark):
    v = F.col("v")
    text = "a\r\nb\x0bc d\n"
    assert one(spark, text, tx.truncate_lines(v, 3), tx.truncate_lines(v, 4)) == ("a\nb\nc\n...", text)
    assert one(spark, "a\nb\nc", tx.sanitize_lines(v, 2), tx.sanitize_lines(v, 3)) == ("a\nb\n...", "a\nb\nc")
    assert one(spark, "abcdefgh", tx.truncate_string(v, 6), tx.truncate_string(v, 8)) == ("abc...", "abcdefgh")
    assert one(spark, " \t a b\r", tx.strip(v)) == ("a b",)
    assert one(spark, "a/.b.tar.GZ", lang.extension(v)) == (".gz",)
    assert one(spark, "a/.bashrc", lang.extension(v), lang.language_of(v)) == ("", None)
    assert one(spark, "x.ts", lang.language_of(v), lang.language_of(v, "detect")) == ("javascript", "typescript")
    assert one(spark, "go", lang.extension_of(v)) == (".go",) and one(spark, "perl", lang.extension_of(v)) == (".txt",)
    assert one(spark, "use std::io", lang.guess_language(v)) == ("rust",)


def test_severities(spark):
    v = F.col("v")
    assert one(spark, "HIGH", severity_rank(v), severity_to_int(v)) == (0, 4)
    assert one(spark, "high", severity_rank(v), meets(v, "medium"), meets(v, "critical")) == (3, True, False)
    assert one(spark, "odd", severity_rank(v), severity_to_int(v), int_to_severity(F.lit(9))) == (0, 0, "info")


WRITTEN = [
    {"id": "a", "name": "A", "language": "python", "severity": "HIGH", "patterns": "danger($X)", "cwe": "CWE-95"},
    {"id": "b", "name": "B", "languages": ["go", "rust"], "severity": "strange", "patterns": [r"bad\w+"], "cwe_id": "CWE-79"},
    {"id": "c", "name": "C", "severity": "low", "patterns": ["x"]},
    {"id": "d", "name": "D", "languages": ["go"], "severity": "low", "patterns": ["(open", "fine"]},
]


def test_check_rules():
    rows, errors = check_rules(WRITTEN)
    assert [(r[0], r[3], r[4], len(r[13])) for r in rows] == [
        ("a", "python", "high", 1), ("b", "go", "medium", 1), ("b", "rust", "medium", 1), ("d", "go", "low", 1)]
    assert [e[0] for e in errors] == ["b", "c", "d"]


def test_rule_files(spark, tmp_path, texts):
    import yaml
    (tmp_path / "r.json").write_text(json.dumps({"rules": WRITTEN}))
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({"rules": WRITTEN}))
    for name in ("r.json", "r.yaml"):
        rules, errors = read_rule_file(spark, str(tmp_path / name))
        assert rules.count() == 4 and errors.count() == 3
    found = scan(texts(("x", "python", "danger(a)"), ("y", "rust", "badly")), rules=rules, threshold="info")
    assert sorted((r.path, r.rule_id) for r in found.collect()) == [("x", "a"), ("y", "b")]
    write_rules(rules, str(tmp_path / "out"))
    assert sorted(map(str, read_rules(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rules.collect()))


def test_upsert_enable_and_list(spark):
    rules = rules_frame(spark, packs=["generic"])
    row = dict(zip(rules.columns, next(r for r in builtin_rules() if r[0] == "generic-ip_address")))
    update = [tuple({**{c: None for c in rules.columns}, "rule_id": row["rule_id"], "pack": "generic", "language": "any",
                     "severity": "high"}[c] for c in rules.columns)]
    new = check_rules(WRITTEN[:1])[0]
    merged = upsert_rules(rules, spark.createDataFrame(update + new, rules.schema))
    assert merged.count() == 16
    changed = merged.where("rule_id = 'generic-ip_address'").first()
    assert changed.severity == "high" and changed.cwe == "CWE-200"
    assert enable_rules(merged, ["a"]).where("enabled").count() == 1
    assert enable_rules(merged, ["*"]).where("enabled").count() == 16
    assert list_rules(merged).columns == ["rule_id", "name", "severity", "language", "enabled", "cwe", "category"]
    found = list_rules(rules_frame(spark), "Secrets").collect()
    assert len(found) == 27 and {r.category for r in found} == {"secrets"}


def test_disabled_rules_do_not_match(spark, texts):
    rules = enable_rules(rules_frame(spark), ["py-eval-usage"])
    found = scan(texts(("a", "python", "eval(x)\nexec(x)")), rules=rules, threshold="info")
    assert {r.rule_id for r in found.collect()} == {"py-eval-usage"}


def test_lines_are_parted_only_where_a_text_has_several(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x85", "\u2028", "\u2029"]
    for text, want in [("one", "one"), ("", ""), (None, None), *((f"a{end}b{end}c", "a\nb\n...") for end in ends)]:
        assert one(spark, text, tx.truncate_lines(F.col("v"), 2)) == (want,)
    plan = spark.range(1).select(tx.truncate_lines(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()  # asked before the text is parted
