import random

from pyspark.sql import functions as F

from scanloom.operators import cve
from scanloom.sources.cve_seed import CVE_ROWS


def key(version):
    parts = version.strip().split(".")
    return tuple(int(p) for p in parts) + (0,) * (9 - len(parts)) if all(p.isdigit() for p in parts) else None


def affected(version, ranges):
    v = key(version)
    for part in (p.strip() for p in ranges.split(",")) if v else ():
        if part.startswith("<="):
            hit = v <= key(part[2:])
        elif part.startswith("<"):
            hit = v < key(part[1:])
        else:
            hit = key(part.split("-")[0]) <= v <= key(part.split("-")[1])
        if hit:
            return True
    return False


def made(n=2000):
    rng = random.Random(2)
    packages = sorted({r[1] for r in CVE_ROWS}) + ["other"]
    rows = []
    for i in range(n):
        package = "django" if i % 3 == 0 else rng.choice(packages)  # a hot package
        version = rng.choice(["4.2.14", "4.2.15", "5.0.10", "5.0.2", "3.14", "3.13.9", "2026.02.23", "2026.2.24", "0.7.2",
                              "0.7.3", "5.0rc1", "", "11.3", f"{rng.randint(0, 5)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}"])
        rows.append((f"p{i % 400}", package.title() if i % 7 == 0 else package, version))
    return rows


def want(rows):
    return sorted((p, package, v, r[0]) for p, package, v in rows for r in CVE_ROWS
                  if package.lower() == r[1] and affected(v, r[4]))


def test_versions_in_ranges_with_broadcast_and_without(spark):
    rows = made()
    deps = spark.createDataFrame(rows, "project string, package string, version string")
    got = sorted(tuple(r) for r in cve.vulnerable(deps, cve.cve_frame(spark)).collect())
    assert got == want(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r) for r in cve.vulnerable(deps, cve.cve_frame(spark)).collect()) == want(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_of_any_length(spark):
    from scanloom.functions.versions import version_key

    ordered = ["0", "0.0.1", "1.2", "1.2.3.4.5.6.7", "1.2.3.4.5.6.7.0.1", "1.10", "2", "00123456789012345678901234567890", "9" * 40]
    rows = spark.createDataFrame([(v,) for v in [*ordered, "1.x", "", "1..2", None, ".1", "-1"]], "v string")
    keyed = rows.select("v", version_key(F.col("v")).alias("k"))
    assert [r.v for r in keyed.where("k is not null").orderBy("k").collect()] == ordered
    equal = spark.createDataFrame([("3.14", "3.14.0.0"), ("0", "0.0.0"), (" 1.02 ", "1.2")], "a string, b string")
    assert equal.where(version_key(F.col("a")) != version_key(F.col("b"))).count() == 0


def test_version_order_is_by_number(spark):
    deps = spark.createDataFrame([("django", "5.0.10"), ("django", "5.0.2")], "package string, version string")
    got = cve.vulnerable(deps, cve.by_id(cve.cve_frame(spark), "CVE-2024-42005")).collect()
    assert [r.version for r in got] == ["5.0.2"]


def test_lookups(spark):
    cves = cve.cve_frame(spark)
    assert cves.count() == 43 and cves.select("package").distinct().count() == 35
    assert cve.by_package(cves, "DJANGO").count() == 4
    assert [cve.by_severity(cves, s).count() for s in ("critical", "high", "medium")] == [19, 15, 9]
    assert [cve.by_year(cves, y).count() for y in (2024, 2025, 2026)] == [3, 33, 7]
    assert cve.search(cves, "PICKLE").count() == 2
    assert cve.package_index(cves).where("package = 'python'").first().cve_ids == [
        "CVE-2025-1795", "CVE-2025-4435", "CVE-2025-4516", "CVE-2025-4517"]
    assert str(cve.by_id(cves, "CVE-2025-3248").first().cvss) == "9.8"


def test_rules_know_their_vulnerabilities(spark):
    from scanloom.rules.catalog import rules_frame
    rows = cve.rule_cves(rules_frame(spark, packs=["python"]), cve.cve_frame(spark))
    assert {r.cve_id for r in rows.where("rule_id = 'PY034'").collect()} == {
        "CVE-2025-34211", "CVE-2024-42005", "CVE-2024-53908"}
