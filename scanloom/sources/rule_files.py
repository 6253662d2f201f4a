"""Rules from and to files."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..rules.catalog import ERROR_SCHEMA, RULE_SCHEMA, check_rules


def read_rule_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, errors) of a YAML or JSON file holding a list of rules, or ``rules: [...]``."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML rules need the yaml module; JSON rules do not") from missing
        written = yaml.safe_load(text)
    else:
        written = json.loads(text)
    written = written.get("rules", []) if isinstance(written, dict) else written or []
    rows, errors = check_rules(written)
    return spark.createDataFrame(rows, RULE_SCHEMA), spark.createDataFrame(errors, ERROR_SCHEMA)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path)
