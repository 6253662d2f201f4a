"""Text columns of tables as texts to scan, and findings as tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import guess_language
from ..functions.regex import END, START, find_all


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table, in the splits it is read in.

    Sessions for tests and benches set ``spark.scanloom.spread``: their tables are files
    of one row group, which only a shuffle spreads over the cores.
    """
    table = spark.read.parquet(path)
    table = table.select(*columns) if columns else table
    spread = spark.conf.get("spark.scanloom.spread", None)
    return table.repartition(int(spread)) if spread else table


def by_key(table: DataFrame, *keys: str) -> DataFrame:
    """Short rows that much is made of, dealt by ``keys`` over all cores, however few splits they were read in."""
    spark = table.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table.repartition(tasks, *keys)


def as_texts(table: DataFrame, name: str, key: str | Column, text: str | Column,
             language: str | Column = "generic") -> DataFrame:
    """Rows of ``table`` as texts; ``language`` is a name, a column or ``auto``."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    if isinstance(language, str):
        language = guess_language(text) if language == "auto" else F.lit(language)
    return table.select(F.concat(F.lit(name + "/"), key.cast("string")).alias("path"),
                        language.alias("language"), text.alias("text"))


SCRIPT = r"(?i)(<script(?:\s[^>]*+)?+>)([\s\S]*?)(?=</script)"


def scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The script bodies of web pages, each as one JavaScript text with its number in the path."""
    found = find_all(F.col(html), SCRIPT, f"$1{START}$2{END}")
    bodies = F.filter(F.transform(found, lambda hit: hit["matched"]), lambda body: body != "")
    rows = pages.select(F.col(key), F.posexplode(bodies).alias("number", "body"))
    return as_texts(rows, "pages", F.concat_ws(":", F.col(key).cast("string"), F.col("number") + 1), "body",
                    "javascript")


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Keep findings by scan."""
    findings.write.mode(mode).partitionBy("scan_id").parquet(path)


def write_patched(patched: DataFrame, path: str) -> None:
    """Patched texts, one row per path."""
    patched.write.mode("overwrite").parquet(path)
