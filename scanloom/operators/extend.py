"""Places for a user's own code: detectors, and small helpers on columns."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detectors import adapt_detector_rows

DETECTED = """path string, language string, rule_id string, severity string, message string, line int,
column_start int, matched_code string, cwe string, remediation string"""
_OWN = ["rule_id", "severity", "message", "line", "column_start", "matched_code", "cwe", "remediation"]


def run_detector(texts: DataFrame, detect: Callable[[str, str], Iterable[dict]]) -> DataFrame:
    """Findings of ``detect(text, language)``, which gives dicts with a finding's fields.

    Runs on Arrow batches in the tasks that hold the texts; fields left out get
    their defaults.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[path, language, *[found.get(f) for f in _OWN]]
                    for path, language, text in zip(batch["path"], batch["language"], batch["text"])
                    for found in detect(text, language)]
            out = pd.DataFrame(rows, columns=["path", "language", *_OWN])
            out["line"] = out["line"].astype("Int32")
            out["column_start"] = out["column_start"].astype("Int32")
            yield out

    return adapt_detector_rows(texts.select("path", "language", "text").mapInPandas(run, DETECTED))


def merge_maps(base: Column, override: Column) -> Column:
    """Both maps' entries; ``override`` wins."""
    return F.map_zip_with(base, override, lambda _, old, new: F.coalesce(new, old))


def make_scan_id(root: Column, timestamp: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", root, timestamp.cast("string")), 256), 1, 16)


def iso_time(timestamp: Column) -> Column:
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
