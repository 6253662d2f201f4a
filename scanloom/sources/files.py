"""Source trees as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import extension, file_name, in_skipped_directory, is_skipped, language_of
from ..functions.text import decode_bytes, is_binary


def file_list(spark: SparkSession, path, file_extensions=None, exclude_patterns=None, recursive: bool = True,
              skip_unreadable: bool = True, name_glob: str | None = None) -> DataFrame:
    """Every file under ``path`` (one path or a list) with its content, and whether a scan skips it.

    Names are judged relative to the path given, so that a root called ``build`` is
    still read.  Spark's listing leaves out empty files, in which nothing can be found.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
              .option("ignoreMissingFiles", str(skip_unreadable).lower())
              .option("ignoreCorruptFiles", str(skip_unreadable).lower()))
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(paths)
    roots = [p.rstrip("/").split(":", 1)[-1].lstrip("/") for p in paths]
    full = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "")
    relative = full
    for root in roots:
        inside = full.startswith(root + "/")
        relative = F.when(inside, full.substr(F.lit(len(root) + 2), F.length(full))).otherwise(relative)
    relative = F.when(full.isin(roots), file_name(full)).otherwise(relative)
    files = files.select(
        "path", relative.alias("rel_path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"), "content")
    skipped = is_skipped(F.col("rel_path"))
    if file_extensions:
        skipped = skipped | ~extension(F.col("rel_path")).isin([e.lower() for e in file_extensions])
    for pattern in exclude_patterns or []:
        regex = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".\\+()[]{}^$|" else c
                        for c in pattern)
        skipped = skipped | F.col("rel_path").rlike(f"(?s)^{regex}$") | file_name(F.col("rel_path")).rlike(f"^{regex}$")
    return (files.withColumn("file_name", file_name(F.col("rel_path")))
            .withColumn("ext", extension(F.col("rel_path")))
            .withColumn("in_skipped_directory", in_skipped_directory(F.col("rel_path")))
            .withColumn("skipped", skipped))


def read_files(spark: SparkSession, path, **options) -> DataFrame:
    """Text files under ``path``, ready for a scan."""
    files = file_list(spark, path, **options).where(~F.col("skipped")).where(~is_binary(F.col("content")))
    text, encoding = decode_bytes(F.col("content"))
    return files.select("path", "rel_path", "file_name", "ext", language_of(F.col("rel_path")).alias("language"),
                        "size", "mtime", encoding.alias("encoding"), text.alias("text"))
