"""The index of rules against the scan that tries every rule on every text."""
import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators.rule_index import WORDS, candidates, check_rule_table, pattern_table, pieces_of, words_of
from scanloom.operators.scan import scan
from scanloom.rules.catalog import check_rules, rules_frame

WRITTEN = "id string, name string, language string, languages array<string>, severity string, patterns array<string>, pattern_kind string, cwe string"
COLUMNS = ["path", "rule_id", "line", "column_start", "matched_code", "snippet", "severity", "language"]


def rows(*rules):
    return [(r["id"], r.get("name", "n"), r.get("language"), r.get("languages"), r.get("severity", "low"), r.get("patterns"), r.get("pattern_kind"), r.get("cwe"))
            for r in rules]


RULES = [
    {"id": "a", "language": "python", "patterns": ["launch($X)", "os.remove"], "severity": "high", "cwe": "CWE-22"},
    {"id": "b", "languages": ["generic", "python"], "patterns": [r"\bsecret_[a-z]{2}\b|token=\w+"]},
    {"id": "c", "languages": ["any"], "patterns": [r"[0-9]{5}"]},
    {"id": "d", "languages": ["go"], "patterns": [r"(?i)Password\s*:="], "severity": "critical"},
    {"id": "e", "languages": ["generic"], "patterns": ["://", "x{2}y"]},
    {"id": "f", "languages": ["python"], "patterns": ["(?:beginningoftheverylongword|another_very_long_word_indeed)[0-9]"]},
    {"id": "g", "languages": ["generic"], "patterns": ["(", "fine_[a-z]+"]},
    {"id": "h", "languages": ["generic"], "severity": "low"},
]
BITS = ["launch(a)", "relaunch( b )", "os.remove(x)", "secret_ab", "xsecret_ab", "token=é", "12345", "PASSWORD :=", "password:= 1", "http://", "xxy", "\n", " ",
        "beginningoftheverylongword1", "q" * 50 + "another_very_long_word_indeed7", "fine_day", "Fine_day", "ÉCOLE", "İ", "lauſch", "\x01"]


def test_same_findings_as_every_rule_on_every_text(spark, texts):
    rng = random.Random(4)
    table = texts(*((f"p{i}", rng.choice(["python", "generic", "go", None]), "".join(rng.choices(BITS, k=rng.randrange(8)))) for i in range(300)), ("null", "go", None))
    plain, _ = check_rules([{k: v for k, v in r.items()} | {"name": "n", "severity": r.get("severity", "low")} for r in RULES])
    want = scan(table, rules=plain, threshold="info").select(COLUMNS)
    checked = check_rule_table(spark.createDataFrame(rows(*RULES), WRITTEN))
    own = checked.where("problem IS NULL").drop("problem")
    got = scan(table, rules=own, threshold="info").select(COLUMNS)
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert want.count() > 100
    assert {(r.rule_id, r.problem.split(":")[0]) for r in checked.where("problem IS NOT NULL").collect()} == {("g", "pattern refused"), ("h", "missing patterns")}
    severe = scan(table, rules=own, threshold="high").select("rule_id").distinct().collect()
    assert {r.rule_id for r in severe} == {"a", "d"}


def test_shipped_and_own_rules_of_one_table(spark, texts):
    table = texts(("a.py", "python", "eval(x)\nlaunch(y)"))
    own = check_rule_table(spark.createDataFrame(rows(RULES[0]), WRITTEN)).drop("problem")
    found = scan(table, rules=rules_frame(spark, packs=["pattern"]).unionByName(own), threshold="info")
    assert {"a"} < {r.rule_id for r in found.collect()}


def test_only_candidates_meet_a_pattern(spark, texts):
    table = texts(*((f"p{i}", "generic", f"see part{i} and apart{i}s") for i in range(200)))
    many = [{"id": f"r{i}", "languages": ["generic"], "patterns": [rf"\bpart{i}\b"]} for i in range(0, 2000, 5)]
    patterns = pattern_table(check_rule_table(spark.createDataFrame(rows(*many), WRITTEN)).drop("problem"))
    pairs = candidates(table, patterns).select("path", "rule_id").collect()
    # part1 is inside part10 to part19 and part100 to part199, too: candidates, no findings
    assert len(pairs) < 200 * 4 and {(f"p{i}", f"r{i}") for i in range(0, 200, 5)} <= {tuple(r) for r in pairs}


def test_pieces(spark):
    def of(*words):
        return spark.range(1).select(pieces_of(F.lit([list(w) for w in words]) if words else F.array().cast("array<array<string>>")).alias("p")).first().p

    assert of(["eval("]) == ["eval"]
    assert of(["ab"], ["innerhtml ="]) == ["innerhtml"]
    assert of(["password", "pw"], ["key_"]) == ["key_"]
    assert of(["://"]) is None and of() is None
    assert of(["beginningoftheverylongword"]) == ["beginningofthever"[:16]]


def test_long_words_are_read_in_overlapping_stretches(spark, texts):
    word = "".join(random.Random(1).choices("abcdefgh", k=500))
    got = [r.word for r in words_of(texts(("p", "go", f"x {word}-end"))).collect()]
    assert all(len(w) <= 64 for w in got) and all(any(word[i:i + 16] in w for w in got) for i in range(len(word) - 15))


@pytest.mark.parametrize("size", [200_000])
def test_one_very_long_word(spark, texts, size):
    table = texts(("p", "generic", "ab" * size + "fine_day"))
    own = check_rule_table(spark.createDataFrame(rows({"id": "g", "languages": ["generic"], "patterns": ["fine_[a-z]+"]}), WRITTEN)).drop("problem")
    assert [(r.column_start, r.matched_code) for r in scan(table, rules=own, threshold="info", width=100).collect()] == [(2 * size + 1, "fine_day")]


def test_no_rules_and_no_texts(spark, texts):
    own = check_rule_table(spark.createDataFrame([], WRITTEN)).drop("problem")
    assert scan(texts(("p", "go", "x")), rules=own, threshold="info").count() == 0
    some = check_rule_table(spark.createDataFrame(rows(*RULES[:2]), WRITTEN)).where("problem IS NULL").drop("problem")
    assert scan(texts(("p", "go", "x")).limit(0), rules=some, threshold="info").count() == 0


def test_numbered_pieces_meet_only_the_words_that_hold_them(spark):
    from scanloom.operators.rule_index import words_with_pieces

    words = [f"item_{i}" for i in range(300)] + ["ab", "xitem_12y", "x" * 60 + "item_299"]
    pieces = [f"item_{i}" for i in range(0, 300, 3)] + ["q" * 16, "tem"]
    got = words_with_pieces(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(p,) for p in pieces], "piece string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, p) for w in words for p in pieces if p in w)
    # A join by a shared gram made pairs of all numbered names and then asked which hold which.
    assert "contains(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_large_rule_tables_are_not_broadcast_whatever_their_file_had(spark, texts):
    table = texts(*((f"p{i}", "generic", f"see part{i}x and 12345") for i in range(50)))
    number = F.col("id").cast("string")
    # 240 KB as Spark reads its size, 15 MB of rules
    written = spark.range(30_000).select(F.concat(F.lit("r"), number).alias("id"), F.lit("n").alias("name"), F.array(F.lit("generic")).alias("languages"),
                                         F.lit("low").alias("severity"), F.array(F.concat(F.lit(r"\bpart"), number, F.lit("x"))).alias("patterns"))
    checked = check_rule_table(written).where("problem IS NULL").drop("problem")
    found = scan(table, rules=checked, threshold="info")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "[gram" in plan and "SortMergeJoin" in plan  # the beginnings of pieces, 37 ** 3 at most
    assert sorted((r.path, r.rule_id) for r in found.collect()) == sorted((f"p{i}", f"r{i}") for i in range(50))


@pytest.mark.parametrize("size, loose_size", [(0, 1), (0, 1 << 40), (1 << 40, 1), (1 << 40, 1 << 40)])
def test_same_hits_broadcast_or_dealt(spark, texts, size, loose_size):
    from scanloom.operators.rule_index import indexed_hits

    rng = random.Random(5)
    table = texts(*((f"p{i}", rng.choice(["python", "generic", "go"]), "".join(rng.choices(BITS, k=5))) for i in range(60)))
    own = check_rule_table(spark.createDataFrame(rows(*RULES), WRITTEN)).where("problem IS NULL").drop("problem")
    plain, _ = check_rules([{**r, "name": "n", "severity": "low"} for r in RULES])
    want = scan(table, rules=plain, threshold="info").select("path", "rule_id", "line", "matched_code")
    hits = indexed_hits(table, own, size=size, loose_size=loose_size).select("path", "rule_id", "hit.line", "hit.matched").distinct()
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
