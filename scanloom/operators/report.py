"""Reports over findings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, severity_rank
from ..functions.text import truncate_lines


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """One column per severity, zero included; severities not known are not counted."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(*by).agg(*counts, F.count("*").alias("total"))


def severity_map() -> Column:
    """severity -> count over the columns of ``severity_counts``."""
    pairs = []
    for s in SEVERITIES:
        pairs += [F.lit(s), F.col(s)]
    return F.create_map(*pairs)


def files_scanned(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """How many files have findings, and how many were read."""
    both = (findings.select("path", F.lit(True).alias("found"))
            .unionByName(texts.select("path", F.lit(False).alias("found"))))
    return both.agg(F.countDistinct(F.when(F.col("found"), F.col("path"))).alias("files_with_findings"),
                    F.count_if(~F.col("found")).alias("files_read"))


def risk_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """0 to 100: 10 for a critical finding, 5 high, 2 medium, 1 low."""
    return F.least(F.lit(100), critical * 10 + high * 5 + medium * 2 + low).cast("int")


def risk_by(findings: DataFrame, *by: str) -> DataFrame:
    counts = severity_counts(findings, *by)
    return counts.withColumn("risk_score", risk_score(*[F.col(s) for s in ("critical", "high", "medium", "low")]))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(
        F.count("*").alias("total"), F.max_by("severity", "sev_rank").alias("highest_severity"))


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by language, severity and weakness, with subtotals (null means all)."""
    return (findings.rollup("language", "severity", "cwe")
            .agg(F.count("*").alias("total"), F.grouping_id().alias("level")))


def filter_findings(findings: DataFrame, severities=None, categories=None, path=None, threshold=None) -> DataFrame:
    if severities:
        findings = findings.where(F.col("severity").isin(*severities))
    if categories:
        findings = findings.where(F.col("category").isin(*categories))
    if path:
        findings = findings.where(F.col("path") == path)
    if threshold:
        findings = findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold)))
    return findings


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "column_start", "rule_id")


def most_severe(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.orderBy(F.desc("sev_rank"), "path", "line", "column_start", "rule_id").limit(n)


def top_per(findings: DataFrame, by: str, n: int = 3) -> DataFrame:
    """The ``n`` most severe findings of each ``by``.

    Spark keeps at most ``n`` rows per group and task before the shuffle, so one
    group that holds much of the data still sends little.
    """
    order = W.partitionBy(by).orderBy(F.desc("sev_rank"), "path", "line", "column_start", "rule_id")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def display(findings: DataFrame) -> DataFrame:
    """Findings the way a person reads them."""
    return findings.select(
        F.col("finding_id").alias("id"), "severity", F.col("path").alias("file"), "line",
        truncate_lines(F.col("snippet")).alias("code_snippet"), F.col("message").alias("description"), "cwe",
        "remediation", "auto_fixable", F.lit("medium").alias("confidence"), "rule_id")


def scan_report(findings: DataFrame, scan_id: str, timestamp: str) -> DataFrame:
    """One row: id, time and totals of a scan.  The findings themselves stay a table."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    totals = findings.agg(*counts, F.count("*").alias("total"), F.countDistinct("path").alias("scanned_files"))
    return totals.select(
        F.lit(scan_id).alias("scan_id"), F.lit(timestamp).alias("timestamp"),
        F.struct(F.col("total").alias("total_vulnerabilities"), severity_map().alias("severity_counts"),
                 "scanned_files").alias("summary"))


def report_lines(findings: DataFrame) -> DataFrame:
    """One JSON text per finding, for export."""
    shown = display(findings)
    return shown.select(F.col("id"), F.to_json(F.struct(*shown.columns)).alias("json"))


SHOWN = ("id string, severity string, file string, line int, code_snippet string, description string, cwe string, remediation string, "
         "auto_fixable boolean, confidence string, rule_id string")


def read_report_lines(lines: DataFrame, column: str = "json") -> DataFrame:
    """Findings from the JSON texts of a stored report, one a row; a text that is none has a ``problem`` and nothing else."""
    names = [part.split()[0] for part in SHOWN.split(", ")]
    # Out of a generator, as a filter on the problem would be asked where the texts are made, and read them once more.
    read = F.from_json(F.col("source"), SHOWN + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(F.col(column).alias("source")).select("source", F.explode(F.array(read)).alias("read"))
    bad = F.col("read").isNull() | F.col("read._corrupt").isNotNull() | F.col("read.id").isNull()
    return rows.select(*[F.when(~bad, F.col(f"read.{n}")).alias(n) for n in names], F.when(bad, F.coalesce("source", F.lit(""))).alias("problem"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result object of the SARIF format per finding, as JSON."""
    level = (F.when(F.col("sev_rank") >= 3, "error").when(F.col("sev_rank") == 2, "warning").otherwise("note"))
    region = F.struct(F.col("line").alias("startLine"), F.col("column_start").alias("startColumn"),
                      F.col("column_end").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
                              region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"),
                      F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("finding_id", F.to_json(result).alias("result"))


def read_scan(findings: DataFrame, scan_id: str) -> DataFrame:
    """The findings of one scan; only its partition is read."""
    return findings.where(F.col("scan_id") == scan_id)


def report_of(findings: DataFrame, scans: DataFrame, scan_id: str) -> DataFrame:
    """One row: a stored scan's totals, or for an unknown id ``known`` false and the ids of the last ten scans.

    ``scans`` has ``scan_id`` and ``scan_ts``; a scan without findings is a known one.
    """
    found = scans.where(F.col("scan_id") == scan_id).agg((F.count("*") > 0).alias("known"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    totals = read_scan(findings, scan_id).agg(*counts, F.count("*").alias("total"))
    last = latest_scans(scans).agg(F.array_sort(F.collect_list("scan_id")).alias("last_scans"))
    one = found.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(last))
    return one.select(F.lit(scan_id).alias("scan_id"), "known", "total", *SEVERITIES, F.when(~F.col("known"), F.col("last_scans")).alias("last_scans"))


def latest_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    """The last scans of a table with ``scan_id`` and ``scan_ts``."""
    return scans.orderBy(F.desc("scan_ts"), F.desc("scan_id")).limit(n)


def new_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before.select("finding_id"), "finding_id", "left_anti")


def fixed_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    return new_findings(before, now)


def history(findings: DataFrame) -> DataFrame:
    """Of each finding the first and the last scan that has it, and the number of scans; ``findings`` have ``scan_id`` and ``scan_ts``."""
    at = F.struct("scan_ts", "scan_id")
    # Dealt by finding first, so that both aggregates find their rows together: they are sent once, without the columns not used here.
    dealt = findings.select("finding_id", "scan_id", "scan_ts").repartition("finding_id")
    seen = dealt.groupBy("finding_id", "scan_id", "scan_ts").agg(F.lit(1).alias("one"))
    return seen.groupBy("finding_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("scans")).select(
        "finding_id", F.col("first.scan_id").alias("first_seen"), F.col("first.scan_ts").alias("first_ts"), F.col("last.scan_id").alias("last_seen"),
        F.col("last.scan_ts").alias("last_ts"), "scans")


def updated_history(held: DataFrame, now: DataFrame, scan_id: str, scan_ts) -> DataFrame:
    """``history`` with one more scan, later than those in it: its findings meet the history once, older scans are not read again."""
    ids = now.select("finding_id").distinct().withColumn("here", F.lit(True))
    kind = held.schema["last_ts"].dataType
    both = held.join(ids, "finding_id", "full")

    def new(name, value):
        return F.when(F.col("here"), F.lit(value).cast(held.schema[name].dataType)).otherwise(F.col(name)).alias(name)

    return both.select("finding_id", F.coalesce("first_seen", F.lit(scan_id)).alias("first_seen"), F.coalesce("first_ts", F.lit(scan_ts).cast(kind)).alias("first_ts"),
                       new("last_seen", scan_id), new("last_ts", scan_ts), (F.coalesce("scans", F.lit(0)) + F.coalesce("here", F.lit(False)).cast("long")).alias("scans"))


def with_state(held: DataFrame, scan_id: str) -> DataFrame:
    """``history`` with each finding's state after the scan ``scan_id``: new, open or fixed."""
    state = F.when(F.col("last_seen") != scan_id, "fixed").when(F.col("first_seen") == scan_id, "new").otherwise("open")
    return held.withColumn("state", state)


def trend(counts: DataFrame, time: str = "scan_ts", key: str = "severity", value: str = "total") -> DataFrame:
    """Change of each count against the scan before; ``counts`` has one row per scan and key."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(time))
    return counts.withColumn("before", before).withColumn("change", F.col(value) - F.coalesce(before, F.lit(0)))
