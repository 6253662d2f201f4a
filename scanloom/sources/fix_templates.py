"""Fix templates and what they are for.

Fixed values: ids, severities, patterns and replacements, and the table from
kinds of vulnerability to templates.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import to_java, to_replacement

JS = ["javascript", "typescript"]

# id, languages, severity, pattern, replacement, needs a person's review
TEMPLATES = [
    ("js_eval_dangerous", JS, "critical", r"eval\s*\(\s*([^)]+)\s*\)", r"JSON.parse(\1)", False),
    ("js_innerhtml_xss", JS, "high", r"\.innerHTML\s*=", ".textContent =", False),
    ("js_math_random_insecure", JS, "medium", r"Math\.random\s*\(\s*\)", "crypto.getRandomValues(new Uint32Array(1))[0] / 4294967296", False),
    ("js_console_log_secrets", JS, "medium", r"console\.(log|debug|info|warn|error)\s*\(\s*[^)]*(?:password|secret|token|key|auth)[^)]*\s*\)\s*;?", "", False),
    ("js_document_write_xss", JS, "high", r"document\.write\s*\(\s*([^)]+)\s*\)", r'const tempDiv = document.createElement("div"); tempDiv.textContent = \1; document.body.appendChild(tempDiv)', False),
    ("js_exec_command_injection", JS, "critical", r"(child_process\.)?exec\s*\(", "execFile(", False),
    ("py_eval_dangerous", ["python"], "critical", r"eval\s*\(\s*([^)]+)\s*\)", r"ast.literal_eval(\1)", False),
    ("py_sql_injection_string", ["python"], "critical", r'(?:execute|query)\s*\(\s*["\'][^"\']*%s[^"\']*["\']', 'execute("SELECT ...", params)', False),
    ("py_sql_injection_format", ["python"], "critical", r'(?:execute|query)\s*\(\s*["\'][^"\']*\{[^}]*\}[^"\']*["\']\.format', 'execute("SELECT ...", params)', False),
    ("py_sql_injection_fstring", ["python"], "critical", r'(?:execute|query)\s*\(\s*f["\']', 'execute("SELECT ...", params)', False),
    ("py_os_system_command_injection", ["python"], "critical", r"os\.system\s*\(", "subprocess.run([", False),
    ("py_yaml_unsafe", ["python"], "high", r"yaml\.load\s*\(", "yaml.safe_load(", False),
    ("py_pickle_unsafe", ["python"], "high", r"pickle\.(loads?|dumps?)", r"json.\1", True),
    ("py_debug_true", ["python"], "medium", r"debug\s*=\s*True", "debug=False", False),
    ("py_assert_usage", ["python"], "low", r"assert\s+([^,]+)(?:,\s*(.+))?", r'if not (\1): raise ValueError(\2 if \2 else "Assertion failed")', True),
    ("go_sql_injection", ["go"], "critical", r'(?:db|tx|stmt)\.Query\s*\(\s*[^"]*\+', 'db.Query("SELECT ...", params)', False),
    ("go_math_rand_insecure", ["go"], "medium", r'"math/rand"', '"crypto/rand"', False),
    ("go_http_no_tls", ["go"], "high", r'http\.ListenAndServe\s*\(\s*"[^"]*"\s*,', 'http.ListenAndServeTLS("addr", "cert.pem", "key.pem",', True),
    ("go_insecure_skip_verify", ["go"], "high", r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false", False),
]

# kind of vulnerability, language, template
KIND_TEMPLATES = [
    ("eval", "python", "py_eval_dangerous"),
    ("eval", "javascript", "js_eval_dangerous"),
    ("eval", "typescript", "js_eval_dangerous"),
    ("command injection", "python", "py_os_system_command_injection"),
    ("command injection", "javascript", "js_exec_command_injection"),
    ("sql injection", "python", "py_sql_injection_string"),
    ("sql injection", "go", "go_sql_injection"),
    ("xss", "javascript", "js_innerhtml_xss"),
    ("xss", "typescript", "js_innerhtml_xss"),
    ("insecure randomness", "javascript", "js_math_random_insecure"),
    ("insecure randomness", "go", "go_math_rand_insecure"),
    ("deserialization", "python", "py_pickle_unsafe"),
    ("yaml load", "python", "py_yaml_unsafe"),
    ("hardcoded credentials", "javascript", "js_console_log_secrets"),
    ("insecure tls", "go", "go_insecure_skip_verify"),
    ("debug mode enabled", "python", "py_debug_true"),
]

# Ours: which template mends what a rule finds.
RULE_TEMPLATES = {
    "py_eval_dangerous": ["py-eval-usage", "PY001"],
    "py_sql_injection_string": ["py-sql-injection", "PY004"],
    "py_os_system_command_injection": ["PY009"],
    "py_yaml_unsafe": ["py-yaml-load", "PY007", "PY028"],
    "py_pickle_unsafe": ["py-pickle-load", "PY005", "PY029"],
    "py_debug_true": ["py-flask-debug", "PY014"],
    "py_assert_usage": ["PY017"],
    "js_eval_dangerous": ["js-eval-usage", "JS-EVAL-USAGE", "JS-EVAL-001"],
    "js_innerhtml_xss": ["js-dangerous-innerHTML", "JS-INNERHTML-XSS", "JS-XSS-001"],
    "js_math_random_insecure": ["js-insecure-random", "JS-INSECURE-RANDOM", "JS-CRYPTO-001"],
    "js_document_write_xss": ["js-dangerous-document-write", "JS-DOCUMENT-WRITE", "JS-XSS-002"],
    "js_exec_command_injection": ["js-child-process", "JS-CHILD-PROCESS-EXEC", "JS-EXEC-001"],
    "go_sql_injection": ["go-sql-injection", "go-sql-injection-fmt", "go-sql-injection-concat",
                         "go-sql-injection-format", "go-sql-injection-var-concat"],
    "go_math_rand_insecure": ["go-weak-rand", "go-weak-random", "go-predictable-random"],
    "go_http_no_tls": ["go-insecure-http"],
    "go_insecure_skip_verify": ["go-insecure-tls"],
}


def templates_frame(spark: SparkSession) -> DataFrame:
    rows = [(t, t.split("_", 1)[1], languages, severity, to_java(regex, ignore_case=True, multiline=True),
             to_replacement(replacement), review) for t, languages, severity, regex, replacement, review in TEMPLATES]
    return spark.createDataFrame(rows, """template_id string, name string, languages array<string>, severity string,
        regex string, replacement string, manual_review boolean""")


def kind_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KIND_TEMPLATES, "kind string, language string, template_id string")


def rule_templates(spark: SparkSession) -> DataFrame:
    rows = [(rule, template) for template, rules in RULE_TEMPLATES.items() for rule in rules]
    return spark.createDataFrame(rows, "rule_id string, template_id string")


def template_by_id(spark: SparkSession, template_id: str) -> DataFrame:
    return templates_frame(spark).where(F.col("template_id") == template_id)


def templates_for(spark: SparkSession, language: str) -> DataFrame:
    return templates_frame(spark).where(F.array_contains("languages", language.lower()))


def fixes_by_language(spark: SparkSession) -> DataFrame:
    return (templates_frame(spark).select(F.explode("languages").alias("language"), "template_id")
            .groupBy("language").agg(F.sort_array(F.collect_list("template_id")).alias("templates")))


def likely_template(kind: Column, language: Column) -> Column:
    """The first template for the language with a word of its id in the kind."""
    kind, language = F.lower(kind), F.lower(language)
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for template, languages, *_ in TEMPLATES:
        named = [kind.contains(word) for word in template.split("_")]
        chosen = chosen.when(language.isin([x.lower() for x in languages]) & reduce(Column.__or__, named), F.lit(template))
    return chosen


def template_for_kind(kinds: DataFrame) -> DataFrame:
    """The template for each row's ``kind`` and ``language``: the known one, else a likely one, else null."""
    table = kind_templates(kinds.sparkSession).select(
        F.col("kind").alias("known_kind"), F.col("language").alias("known_language"), "template_id")
    same = ((F.lower(F.col("kind")) == F.col("known_kind")) & (F.lower(F.col("language")) == F.col("known_language")))
    found = kinds.join(F.broadcast(table), same, "left").drop("known_kind", "known_language")
    return found.withColumn("template_id", F.coalesce("template_id", likely_template(F.col("kind"), F.col("language"))))
