"""Known vulnerabilities: look-ups, and dependencies against version ranges."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import version_key
from ..sources.cve_seed import CVE_ROWS

CVE_SCHEMA = """cve_id string, package string, severity string, cvss decimal(3,1), description string,
affected_versions string, fixed_versions string, cwe string, references array<string>, year int"""


def cve_frame(spark: SparkSession) -> DataFrame:
    """The shipped vulnerabilities."""
    rows = [(cve_id, package, severity, score, description, affected, fixed, cwe, int(cve_id.split("-")[1]))
            for cve_id, package, severity, score, affected, fixed, cwe, description in CVE_ROWS]
    table = spark.createDataFrame(rows, """cve_id string, package string, severity string, cvss string,
        description string, affected_versions string, fixed_versions string, cwe string, year int""")
    link = F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cve_id")
    return (table.withColumn("cvss", F.col("cvss").cast("decimal(3,1)")).withColumn("references", F.array(link))
            .select("cve_id", "package", "severity", "cvss", "description", "affected_versions", "fixed_versions",
                    "cwe", "references", "year"))


def by_id(cves: DataFrame, cve_id: str) -> DataFrame:
    return cves.where(F.col("cve_id") == cve_id)


def by_package(cves: DataFrame, package: str) -> DataFrame:
    return cves.where(F.col("package") == package.lower())


def by_severity(cves: DataFrame, *severities: str) -> DataFrame:
    return cves.where(F.col("severity").isin(*severities))


def by_year(cves: DataFrame, year: int) -> DataFrame:
    return cves.where(F.col("year") == year)


def search(cves: DataFrame, query: str) -> DataFrame:
    """Part of the package's name or of the description, in any case."""
    wanted = query.lower()
    return cves.where(F.lower("package").contains(wanted) | F.lower("description").contains(wanted))


def package_index(cves: DataFrame) -> DataFrame:
    return cves.groupBy("package").agg(F.sort_array(F.collect_set("cve_id")).alias("cve_ids"))


def rule_cves(rules: DataFrame, cves: DataFrame) -> DataFrame:
    """The vulnerabilities each rule is about."""
    named = rules.select("rule_id", F.explode("cves").alias("cve_id"))
    return named.join(cves, "cve_id")


def cve_ranges(cves: DataFrame) -> DataFrame:
    """Affected versions as ranges: ``<v``, ``<=v`` and ``a-b``, several parted by commas.

    One row per vulnerability, with an array of its ranges.
    """

    def one(part):
        closed = part.rlike("^[0-9.]+-[0-9.]+$")
        below = F.regexp_extract(part, "^<=?([0-9.]+)$", 1)
        return F.struct(
            F.when(closed, version_key(F.substring_index(part, "-", 1))).alias("lo"),
            version_key(F.when(closed, F.substring_index(part, "-", -1)).otherwise(below)).alias("hi"),
            (closed | part.startswith("<=")).alias("hi_included"))

    ranges = F.transform(F.split("affected_versions", r"\s*,\s*"), one)
    return cves.select("cve_id", F.lower("package").alias("package"),
                       F.filter(ranges, lambda r: r["hi"].isNotNull()).alias("ranges"))


def vulnerable(deps: DataFrame, cves: DataFrame) -> DataFrame:
    """Rows of ``deps`` (package, version, ...) with each vulnerability their version falls in.

    Versions that are no dotted numbers match nothing.  The vulnerability table is
    broadcast if its size allows; else a package that half the projects use is a
    skewed key of a plain join, which adaptive execution splits.
    """
    ranges = cve_ranges(cves).withColumnRenamed("package", "range_package")
    key = version_key(F.col("version"))

    def inside(r):
        after = r["lo"].isNull() | (F.col("version_key") >= r["lo"])
        return after & ((F.col("version_key") < r["hi"]) | (r["hi_included"] & (F.col("version_key") == r["hi"])))

    hit = (F.lower(F.col("package")) == F.col("range_package")) & F.exists("ranges", inside)
    return deps.withColumn("version_key", key).join(ranges, hit).select(*deps.columns, "cve_id")
