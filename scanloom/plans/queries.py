"""Queries by name, each with the SQL that must give the same rows (or none).

Every query reads the given tables whole: texts as they are, or source files,
dependency lists and event texts derived from them row by row.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import text as tx
from ..functions.regex import count_matches, to_java, to_replacement
from ..functions.severity import int_to_severity, severity_rank, severity_to_int
from ..operators import cve, patch, report
from ..operators.facts import assignments, calls
from ..operators.rule_index import check_rule_table
from ..operators.scan import scan
from ..rules.catalog import FACT, RULE_SCHEMA, builtin_rules, check_rules, list_rules, rules_frame, upsert_rules
from ..sources.cve_seed import CVE_ROWS
from ..sources.fix_templates import TEMPLATES as FIX_TEMPLATES
from ..sources.fix_templates import RULE_TEMPLATES, template_for_kind
from ..sources.tables import as_texts, by_key, read_table, scripts
from ..streaming.incremental import session_counts, window_counts
from . import oracle as sql
from .corpus import TEMPLATES, code_files, quote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a query under its function's name."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if text is not None:
            SQL[function.__name__] = text
        return function
    return register


# --- inputs ------------------------------------------------------------------

def files(spark: SparkSession, folder: str) -> DataFrame:
    return code_files(read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_custkey")).drop("o_orderkey")


def documents(spark: SparkSession, folder: str, language: str = "generic") -> DataFrame:
    return as_texts(read_table(spark, f"{folder}/documents.parquet", "doc_id", "text"), "documents", "doc_id", "text",
                    language)


DOCUMENTS = "files AS (SELECT 'documents/' || doc_id AS path, text, 'generic' AS language FROM documents)"
PAGES = "files AS (SELECT 'pages/' || page_id AS path, html AS text, 'generic' AS language FROM pages)"
TURNS = ("files AS (SELECT 'conversations/' || conv_id || ':' || turn AS path, text, 'generic' AS language "
         "FROM conversations)")

HITS = ["path", "line", "rule_id", "column_start", "matched_code"]


def found(texts: DataFrame, **options) -> DataFrame:
    return scan(texts, threshold="info", masked=False, facts=False, **options).select(*HITS)


# --- finding -----------------------------------------------------------------

@query(sql.with_files(sql.pattern_pack()))
def pattern_findings(spark, folder):
    """Rules written as code with wildcards, over seven languages."""
    return found(files(spark, folder), packs=["pattern"])


@query(sql.with_files(sql.python_lines()))
def python_line_findings(spark, folder):
    return found(files(spark, folder), packs=["python"])


@query(sql.with_files(sql.rust_lines()))
def rust_line_findings(spark, folder):
    return found(files(spark, folder), packs=["rust"])


@query(sql.with_files(sql.javascript_rules()))
def javascript_findings(spark, folder):
    return found(files(spark, folder), packs=["javascript"])


@query(sql.with_files(sql.go_rules()))
def go_findings(spark, folder):
    """Whole-text rules, whose matches may run over lines."""
    return found(files(spark, folder), packs=["go"])


@query(sql.with_files(sql.generic_rules()))
def generic_findings_code(spark, folder):
    return found(files(spark, folder), packs=["generic"])


@query(f"WITH {DOCUMENTS} {sql.generic_rules()}")
def generic_findings_documents(spark, folder):
    return found(documents(spark, folder), packs=["generic"])


@query(f"WITH {PAGES} {sql.generic_rules()}")
def generic_findings_pages(spark, folder):
    pages = read_table(spark, f"{folder}/pages.parquet", "page_id", "html")
    return found(as_texts(pages, "pages", "page_id", "html"), packs=["generic"])


@query(f"WITH {TURNS} {sql.generic_rules()}")
def generic_findings_conversations(spark, folder):
    turns = read_table(spark, f"{folder}/conversations.parquet", "conv_id", "turn", "text")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return found(as_texts(turns, "conversations", key, "text"), packs=["generic"])


@query(f"WITH {DOCUMENTS} {sql.go_rules(None, 'files')}")
def go_findings_documents(spark, folder):
    """Go's rules and secrets over prose, read as Go."""
    return found(documents(spark, folder, "go"), packs=["go"])


FACT_ROWS = [r for r in builtin_rules() if r[12] == FACT and r[0] != "go-defer-in-loop"]


@query(sql.with_files(sql.facts()))
def fact_findings(spark, folder):
    """Rules on calls, assignments and try blocks, for all four languages."""
    hits = scan(files(spark, folder), rules=FACT_ROWS, threshold="info")
    return hits.select("path", "line", "rule_id", "column_start")


@query(sql.with_files(sql.defer_hits(), sql.DEFER))
def defer_in_loop(spark, folder):
    rules = [r for r in builtin_rules() if r[0] == "go-defer-in-loop" and r[1] == "go"]
    hits = scan(files(spark, folder), rules=rules, threshold="info")
    return hits.select("path", "line", "rule_id", "column_start")


@query(sql.with_files(f"SELECT path, line, column_start, func_text, n_args::INTEGER AS n_args FROM ({sql.call_labels()})"))
def call_facts(spark, folder):
    rows = calls(files(spark, folder))
    return rows.select("path", "line", "column_start", "func_text", F.size("args").alias("n_args"))


@query(sql.with_files("""SELECT path, line::INTEGER AS line, regexp_extract(t, '^(\\w+) = ', 1) AS target,
  trim(regexp_extract(t, '^\\w+ = (.*)$', 1)) AS value FROM lines
  WHERE language = 'python' AND regexp_matches(t, '^\\w+ = ')"""))
def assignment_facts(spark, folder):
    rows = assignments(files(spark, folder).where(F.col("language") == "python"))
    return rows.select("path", "line", "target", "value")


@query(sql.with_files(f"""SELECT a.pack, a.path, a.line::INTEGER AS line, a.rule_id, a.column_start::INTEGER AS column_start,
  r.severity, r.sev_rank, r.cwe, r.category, r.message
  FROM ({sql.all_findings()}) a JOIN {sql.rule_values(['pack', 'rule_id', 'severity', 'sev_rank', 'cwe', 'category', 'message'])}
  AS r(pack, rule_id, severity, sev_rank, cwe, category, message) ON a.pack = r.pack AND a.rule_id = r.rule_id
  WHERE r.sev_rank >= 2""", sql.DEFER))
def code_findings(spark, folder):
    """The whole scan at the default threshold: every pack, text and fact rules, rule metadata."""
    return scan(files(spark, folder)).select("pack", "path", "line", "rule_id", "column_start", "severity",
                                             "sev_rank", "cwe", "category", "message")


MASKED = sql.with_files(f"""SELECT path, line, rule_id, column_start,
  CASE WHEN rule_id IN ('JS-HARDCODED-SECRET', 'PY012', 'PY013', 'PY024', 'RS013', 'RS014')
    THEN regexp_replace(matched_code, {quote("[" + chr(34) + "'`][^" + chr(34) + "'`]+[" + chr(34) + "'`]")},
      '"***REDACTED***"', 'g')
    ELSE regexp_replace(matched_code, ':[^@]+@', ':***@', 'g') END AS matched_code
  FROM (SELECT * FROM ({sql.javascript_rules()}) WHERE rule_id = 'JS-HARDCODED-SECRET'
    UNION ALL SELECT * FROM ({sql.python_lines()}) WHERE rule_id IN ('PY012', 'PY013', 'PY024')
    UNION ALL SELECT * FROM ({sql.rust_lines()}) WHERE rule_id IN ('RS013', 'RS014')
    UNION ALL SELECT * FROM ({sql.go_rules()}) WHERE rule_id = 'go-hardcoded-db-conn')""")


@query(MASKED)
def masked_secrets(spark, folder):
    """Findings with a secret in them, as they leave the scan."""
    wanted = ["JS-HARDCODED-SECRET", "PY012", "PY013", "PY024", "RS013", "RS014", "go-hardcoded-db-conn"]
    rules = [r for r in builtin_rules() if r[0] in wanted]
    return scan(files(spark, folder), rules=rules, threshold="info", facts=False).select(*HITS)


@query(sql.with_files(f"""SELECT h.path, h.line, h.rule_id, concat_ws(chr(10), b.t, m.t, n.t) AS snippet
  FROM ({sql.python_lines()}) h JOIN lines m ON m.path = h.path AND m.line = h.line
  LEFT JOIN lines b ON b.path = h.path AND b.line = h.line - 1
  LEFT JOIN lines n ON n.path = h.path AND n.line = h.line + 1
  WHERE h.rule_id IN ('PY004', 'PY009', 'PY011', 'PY014', 'PY017', 'PY023', 'PY026')"""))
def context_snippets(spark, folder):
    """The line before, the line and the line after."""
    rules = [r for r in builtin_rules()
             if r[0] in ("PY004", "PY009", "PY011", "PY014", "PY017", "PY023", "PY026")]
    hits = scan(files(spark, folder), rules=rules, threshold="info", facts=False)
    return hits.select("path", "line", "rule_id", "snippet")


CUSTOM = [
    {"id": "own-sha1-text", "name": "Forty hex digits", "languages": ["generic"], "severity": "LOW",
     "patterns": [r"\b[0-9a-f]{40}\b"], "cwe_id": "CWE-200"},
    {"id": "own-email", "name": "Mail address", "languages": ["generic"], "severity": "odd",
     "patterns": [r"[a-z0-9._]+@[a-z0-9-]+\.[a-z]{2,}"]},
    {"id": "own-broken", "name": "No patterns", "language": "generic", "severity": "low"},
]


@query(f"""WITH {DOCUMENTS}, lines AS (SELECT path, language, unnest(string_split(text, chr(10))) AS t,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM files)
  SELECT path, line, rule_id, column_start, matched_code,
    CASE rule_id WHEN 'own-email' THEN 'medium' ELSE 'low' END AS severity FROM (""" + sql._distinct([
        "SELECT path, line, rule_id, column_start, matched_code FROM ("
        + sql.line_rule(rule["id"], rule["patterns"][0], "generic") + ")" for rule in CUSTOM[:2]]) + ")")
def custom_rule_findings(spark, folder):
    """Rules a user wrote, one of them refused."""
    rows, _ = check_rules(CUSTOM)
    return scan(documents(spark, folder), rules=rows, threshold="info").select(*HITS, "severity")


TURN_RULES = [
    {"id": "own-long-word", "name": "A long word", "languages": ["generic"], "severity": "low", "patterns": [r"\b[a-z]{14,}\b"]},
    {"id": "own-wordy", "name": "A common word", "languages": ["generic"], "severity": "high", "patterns": [r"\b(?:that|with|para|nicht|pour)\b"]},
]


@query(f"""WITH {TURNS}, lines AS (SELECT path, language, unnest(string_split(text, chr(10))) AS t,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM files)
  SELECT path, line, rule_id, column_start, matched_code,
    CASE rule_id WHEN 'own-wordy' THEN 'high' ELSE 'low' END AS severity FROM (""" + sql._distinct([
        "SELECT path, line, rule_id, column_start, matched_code FROM (" + sql.word_rule(rule["id"], whole) + ")"
        for rule, whole in zip(TURN_RULES, ["[a-z]{14,}", "that|with|para|nicht|pour"])]) + ")")
def custom_rule_findings_conversations(spark, folder):
    """Rules of a user's own over every turn of every conversation."""
    turns = read_table(spark, f"{folder}/conversations.parquet", "conv_id", "turn", "text")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows, _ = check_rules(TURN_RULES)
    return scan(as_texts(turns, "conversations", key, "text"), rules=rows, threshold="info").select(*HITS, "severity")


PART_RULES = """rules AS (SELECT p_partkey AS k, 'part-' || p_partkey || '-' || kind AS rule_id,
    CASE WHEN p_size < 20 THEN 'low' ELSE 'high' END AS severity, kind
  FROM part, (VALUES ('use'), ('take'), ('ship')) AS v(kind))"""


def part_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Three rules for every part, as a user writes them: a regular expression, code with a wildcard, an alternative."""
    parts = by_key(read_table(spark, f"{folder}/part.parquet", "p_partkey", "p_size"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    kinds = [("use", F.concat(F.lit(r"\bitem_"), key, F.lit(r"\b")), "regex"), ("take", F.concat(F.lit("take(part"), key, F.lit(", $X)")), "literal"),
             ("ship", F.concat(F.lit("(?:ship|send)_"), key, F.lit("x[0-9]+")), "regex")]
    rules = F.array(*[F.struct(F.concat(F.lit("part-"), key, F.lit(f"-{kind}")).alias("id"), source.alias("patterns"), F.lit(how).alias("pattern_kind"))
                      for kind, source, how in kinds])
    severity = F.when(F.col("p_size") < 20, "low").otherwise("high")
    return parts.select(F.explode(rules).alias("r"), severity.alias("severity")).select(
        "r.id", F.col("r.id").alias("name"), F.lit("generic").alias("language"), "severity", F.array("r.patterns").alias("patterns"), "r.pattern_kind")


def shipping_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A text for every line of an order that names its part in one of several ways, some of them near misses."""
    lines = read_table(spark, f"{folder}/lineitem.parquet", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    path = F.concat(F.lit("lines/"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    lines = by_key(lines.select("*", path.alias("path")), "path")
    key = F.col("l_partkey").cast("string")
    forms = [F.concat(F.lit("use item_"), key, F.lit(" now")), F.concat(F.lit("x = take(part"), key, F.lit(", 5)\ntake(part"), key, F.lit(", many)")),
             F.concat(F.lit("send_"), key, F.lit("x44;ship_"), key, F.lit("x7")), F.concat(F.lit("item_"), key, F.lit("z or myitem_"), key),
             F.concat(F.lit("take(part"), key, F.lit(", f(2))"))]
    which = F.pmod(F.col("l_orderkey") * 3 + F.col("l_linenumber"), F.lit(len(forms))).cast("int") + 1
    text = F.concat(F.lit("by "), F.col("l_suppkey").cast("string"), F.lit("\n"), F.element_at(F.array(*forms), which))
    return lines.select("path", F.lit("generic").alias("language"), text.alias("text"))


@query(f"""WITH {PART_RULES}, notes AS (
    SELECT 'lines/' || l_orderkey || ':' || l_linenumber AS path, l_partkey AS k, (l_orderkey * 3 + l_linenumber) % 5 AS form FROM lineitem),
  hits AS (
    SELECT path, k, 'use' AS kind, 2 AS line, 5 AS column_start, 'item_' || k AS matched_code FROM notes WHERE form = 0
    UNION ALL SELECT path, k, 'take', 2, 5, 'take(part' || k || ', 5)' FROM notes WHERE form = 1
    UNION ALL SELECT path, k, 'take', 3, 1, 'take(part' || k || ', many)' FROM notes WHERE form = 1
    UNION ALL SELECT path, k, 'ship', 2, 1, 'send_' || k || 'x44' FROM notes WHERE form = 2
    UNION ALL SELECT path, k, 'ship', 2, 10 + len(k::VARCHAR), 'ship_' || k || 'x7' FROM notes WHERE form = 2)
  SELECT DISTINCT path, line, rule_id, column_start::INTEGER AS column_start, matched_code, severity FROM hits JOIN rules USING (k, kind)""")
def part_rule_findings(spark, folder):
    """Thousands of rules of a user's own over a text for every line of an order, by the index of required words."""
    checked = check_rule_table(part_rules(spark, folder))
    return scan(shipping_notes(spark, folder), rules=checked.where("problem IS NULL").drop("problem"), threshold="info").select(*HITS, "severity")


# --- languages, names, texts -------------------------------------------------

ENDINGS = [".py", ".JS", ".tsx", ".go", ".rs", ".min.js", ".lock", ".txt", ".d.ts", "", ".yml", ".hpp"]
FOLDERS = ["src", "node_modules/a", "lib/build", "vendor", "docs/out/x", "app", ".git/hooks"]


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Made of an order's key and customer: a folder, a name and an ending."""
    orders = read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_custkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]),
                          F.pmod("o_orderkey", F.lit(len(ENDINGS))).cast("int") + 1)
    place = F.element_at(F.array(*[F.lit(d) for d in FOLDERS]),
                         F.pmod("o_custkey", F.lit(len(FOLDERS))).cast("int") + 1)
    name = F.concat(F.when(F.col("o_orderkey") % 17 == 0, ".f").otherwise("f"), F.col("o_orderkey"), ending)
    return orders.select("o_orderkey", F.concat(place, F.lit("/"), name).alias("path"))


PATHS = f"""paths AS (SELECT o_orderkey, {FOLDERS!r}[o_custkey % {len(FOLDERS)} + 1] || '/'
  || CASE WHEN o_orderkey % 17 = 0 THEN '.f' ELSE 'f' END || o_orderkey
  || {ENDINGS!r}[o_orderkey % {len(ENDINGS)} + 1] AS path FROM orders),
  named AS (SELECT *, split_part(path, '/', -1) AS name FROM paths),
  ext AS (SELECT *, lower(regexp_extract(name, '^.+?(\\.[^.]+)$', 1)) AS ext FROM named)"""


def _cases(table: dict) -> str:
    return "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(f"""WITH {PATHS} SELECT o_orderkey, path, ext, {_cases(lang.SCAN_LANGUAGES)} AS language,
  {_cases(lang.DETECT_LANGUAGES)} AS detected FROM ext""")
def source_languages(spark, folder):
    """Extension and language of file names, by both tables."""
    path = F.col("path")
    return paths(spark, folder).select(
        "o_orderkey", "path", lang.extension(path).alias("ext"), lang.language_of(path).alias("language"),
        lang.language_of(path, "detect").alias("detected"))


@query(f"""WITH {PATHS} SELECT o_orderkey, path FROM named
  WHERE NOT (name LIKE '.%' OR len(list_intersect(string_split(path, '/'), {lang.SKIP_DIRECTORIES!r})) > 0
    OR {' OR '.join(f"lower(name) LIKE '%{e}'" for e in lang.SKIP_EXTENSIONS)})""")
def files_not_skipped(spark, folder):
    rows = paths(spark, folder)
    return rows.where(~lang.is_skipped(F.col("path")))


@query("""SELECT conv_id, turn, CASE
  WHEN contains(text, 'def ') OR contains(text, 'import ') THEN 'python'
  WHEN contains(text, 'function ') OR contains(text, 'const ') OR contains(text, 'let ') THEN 'javascript'
  WHEN contains(text, 'func ') THEN 'go'
  WHEN contains(text, 'fn ') OR contains(text, 'impl ') OR contains(text, 'use std::') OR contains(text, 'let mut ')
    THEN 'rust' ELSE 'generic' END AS language FROM conversations""")
def guessed_languages(spark, folder):
    turns = read_table(spark, f"{folder}/conversations.parquet", "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", lang.guess_language(F.col("text")).alias("language"))


@query("""SELECT doc_id, CASE WHEN len(text) <= 100 THEN text ELSE left(text, 97) || '...' END AS short,
  CASE WHEN len(string_split(text, chr(10))) <= 5 THEN text
       ELSE array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) || '...' END AS first_lines,
  md5(CASE WHEN n <= 10 THEN text ELSE array_to_string(l[1:10], chr(10)) || chr(10) || '...' END) AS ten_lines
  FROM (SELECT *, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n
    FROM (SELECT *, regexp_split_to_array(text,
      '\\r\\n|[\\n\\r\\x0B\\f\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents))""")
def shortened_texts(spark, folder):
    """Texts cut for display in three ways."""
    text = F.col("text")
    docs = read_table(spark, f"{folder}/documents.parquet", "doc_id", "text")
    return docs.select("doc_id", tx.truncate_string(text).alias("short"), tx.sanitize_lines(text).alias("first_lines"),
                       F.md5(tx.truncate_lines(text)).alias("ten_lines"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND regexp_matches(text, '[\\x{80}-\\x{10FFFF}]')
    AND regexp_matches(narrow, '[\\x{80}-\\x{FF}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  md5(regexp_replace(CASE WHEN doc_id % 2 = 1 THEN narrow ELSE text END, '\\r\\n?', chr(10), 'g')) AS text_md5
  FROM (SELECT doc_id, text, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS narrow FROM documents)
  WHERE doc_id % 10 <> 3""")
def decoded_documents(spark, folder):
    """Documents as bytes of files: every other one in Latin-1, every tenth with a NUL byte, read back."""
    docs = read_table(spark, f"{folder}/documents.parquet", "doc_id", "text")
    narrow = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 1, narrow).otherwise(F.encode("text", "UTF-8"))
    nul = F.lit(bytearray(b"\x00"))
    content = F.when(F.col("doc_id") % 10 == 3, F.concat(nul, content)).otherwise(content)
    rows = docs.select("doc_id", content.alias("content")).where(~tx.is_binary(F.col("content")))
    text, encoding = tx.decode_bytes(F.col("content"))
    return rows.select("doc_id", encoding.alias("encoding"), F.md5(text).alias("text_md5"))


PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}


@query("""SELECT o_orderkey, severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
    WHEN 'low' THEN 1 ELSE 0 END AS rank, n AS number,
  CASE n WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS back
  FROM (SELECT *, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2
    ELSE 0 END AS n FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical'
    WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'none' END AS severity
    FROM orders))""")
def severity_numbers(spark, folder):
    """Severities to numbers and back, for orders by their priority."""
    orders = read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_orderpriority")
    named = F.lit("none")
    for priority, severity in PRIORITY.items():
        named = F.when(F.col("o_orderpriority") == priority, severity).otherwise(named)
    rows = orders.select("o_orderkey", named.alias("severity"))
    number = severity_to_int(F.col("severity"))
    return rows.select("*", severity_rank(F.col("severity")).alias("rank"), number.alias("number"),
                       int_to_severity(number).alias("back"))


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::INTEGER AS number, body
  FROM (SELECT page_id, unnest(bodies) AS body, unnest(range(len(bodies))) AS i
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script(?:\\s[^>]*)?>(.*?)</script', 1) AS bodies FROM pages))
  WHERE body <> ''""")
def page_scripts(spark, folder):
    """Scripts out of web pages, ready to be scanned as JavaScript."""
    rows = scripts(read_table(spark, f"{folder}/pages.parquet", "page_id", "html"))
    place = F.split(F.substring_index("path", "/", -1), ":")
    return rows.select(F.get(place, F.lit(0)).cast("long").alias("page_id"),
                       F.get(place, F.lit(1)).cast("int").alias("number"), F.col("text").alias("body"))


# --- reports -----------------------------------------------------------------

RULE = "r(pack, rule_id, severity, sev_rank, cwe, category, name, message, remediation)"
RULE_NAMES = ["pack", "rule_id", "severity", "sev_rank", "cwe", "category", "name", "message", "remediation"]
REPORTED = f"""reported AS MATERIALIZED (SELECT h.*, language, severity, sev_rank, cwe, category, message, remediation,
    CASE language WHEN 'python' THEN '.py' WHEN 'javascript' THEN '.js' ELSE '' END AS suffix
  FROM (SELECT * FROM ({sql.pattern_pack()})) h JOIN files USING (path)
  JOIN {sql.rule_values(RULE_NAMES, ['pattern'])} AS {RULE} ON r.rule_id = h.rule_id)"""


def reported(spark: SparkSession, folder: str) -> DataFrame:
    """The findings that reports are made of: the pattern pack at every severity."""
    return scan(files(spark, folder), packs=["pattern"], threshold="info", facts=False)


SEVERITY_COLUMNS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}"
                             for s in ("critical", "high", "medium", "low", "info"))


@query(sql.with_files(f"SELECT language, {SEVERITY_COLUMNS}, count(*) AS total FROM reported GROUP BY language", REPORTED))
def severity_counts(spark, folder):
    return report.severity_counts(reported(spark, folder), "language")


@query(sql.with_files(f"""SELECT split_part(path, '/', 1) AS project, {SEVERITY_COLUMNS}, count(*) AS total,
  least(100, 10 * count(*) FILTER (severity = 'critical') + 5 * count(*) FILTER (severity = 'high')
    + 2 * count(*) FILTER (severity = 'medium') + count(*) FILTER (severity = 'low'))::INTEGER AS risk_score
  FROM reported GROUP BY 1""", REPORTED))
def risk_by_project(spark, folder):
    rows = reported(spark, folder).withColumn("project", F.substring_index("path", "/", 1))
    return report.risk_by(rows, "project")


@query(sql.with_files("""SELECT category, count(*) AS total, arg_max(severity, sev_rank) AS highest_severity
  FROM reported GROUP BY category""", REPORTED))
def category_report(spark, folder):
    return report.category_counts(reported(spark, folder))


@query(sql.with_files("""SELECT language, severity, cwe, count(*) AS total,
  grouping(language, severity, cwe)::BIGINT AS level FROM reported GROUP BY ROLLUP (language, severity, cwe)""", REPORTED))
def rollup_report(spark, folder):
    return report.rollup(reported(spark, folder))


@query(sql.with_files("""SELECT path, line, column_start, rule_id, severity, matched_code FROM reported
  ORDER BY sev_rank DESC, path, line, column_start, rule_id LIMIT 5""", REPORTED))
def most_severe_findings(spark, folder):
    rows = report.most_severe(reported(spark, folder), 5)
    return rows.select("path", "line", "column_start", "rule_id", "severity", "matched_code")


@query(sql.with_files("""SELECT language, path, line, column_start, rule_id, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY sev_rank DESC, path, line, column_start, rule_id) AS place
  FROM reported) WHERE place <= 3""", REPORTED))
def top_findings_per_language(spark, folder):
    rows = report.top_per(reported(spark, folder), "language", 3)
    return rows.select("language", "path", "line", "column_start", "rule_id", "place")


@query(sql.with_files("""SELECT (SELECT count(DISTINCT path) FROM reported) AS files_with_findings,
  (SELECT count(*) FROM files) AS files_read""", REPORTED))
def files_scanned(spark, folder):
    return report.files_scanned(reported(spark, folder), files(spark, folder))


@query(sql.with_files("""SELECT path, line, rule_id, severity, category FROM reported
  WHERE severity IN ('critical', 'high') AND category = 'injection'""", REPORTED))
def severe_injections(spark, folder):
    rows = report.filter_findings(reported(spark, folder), severities=["critical", "high"], categories=["injection"])
    return rows.select("path", "line", "rule_id", "severity", "category")


@query(sql.with_files("""SELECT md5(concat_ws(':', rule_id, path, line, matched_code)) AS id, severity, path AS file, line,
  matched_code AS code_snippet, message AS description, cwe, remediation, 'medium' AS confidence, rule_id
  FROM reported""", REPORTED))
def displayed_findings(spark, folder):
    return report.display(reported(spark, folder)).drop("auto_fixable")


@query(SQL["displayed_findings"])
def findings_read_back(spark, folder):
    """Findings from the JSON lines of a report."""
    read = report.read_report_lines(report.report_lines(reported(spark, folder)))
    return read.where("problem IS NULL").drop("problem", "auto_fixable")


#: Five scans of one project: a finding is in a scan or not by its file's and its line's number.
IN_SCAN = "(file_number * (scan + 1) + line) % 3 <> 0"


@query(sql.with_files(f"""SELECT finding_id, 'scan-' || min(scan) AS first_seen, 'scan-' || max(scan) AS last_seen, count(*) AS scans,
    CASE WHEN max(scan) < 4 THEN 'fixed' WHEN min(scan) = 4 THEN 'new' ELSE 'open' END AS state
  FROM (SELECT md5(concat_ws(':', rule_id, path, line, matched_code)) AS finding_id, line,
          CAST(regexp_extract(path, 'f([0-9]+)[.]', 1) AS BIGINT) AS file_number FROM reported), (SELECT unnest(range(5)) AS scan)
  WHERE {IN_SCAN} GROUP BY finding_id""", REPORTED))
def finding_history(spark, folder):
    """First and last scan of every finding over five scans, and whether it is new, open or fixed after the last."""
    found = reported(spark, folder).select("finding_id", "line", F.regexp_extract("path", r"f([0-9]+)[.]", 1).cast("long").alias("file_number"))
    held = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scan")).where(IN_SCAN)
    held = held.select("finding_id", F.concat(F.lit("scan-"), "scan").alias("scan_id"), F.col("scan").alias("scan_ts"))
    return report.with_state(report.history(held), "scan-4").drop("first_ts", "last_ts")


@query(sql.with_files("""SELECT 'scan-1' AS scan_id, count(*) AS total_vulnerabilities,
  count(DISTINCT path) AS scanned_files, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'info') AS info FROM reported""", REPORTED))
def scan_summary(spark, folder):
    row = report.scan_report(reported(spark, folder), "scan-1", "2026-01-01T00:00:00Z")
    counts = F.col("summary.severity_counts")
    return row.select("scan_id", "summary.total_vulnerabilities", "summary.scanned_files",
                      counts["critical"].alias("critical"), counts["info"].alias("info"))


@query(sql.with_files("""SELECT md5(concat_ws(':', rule_id, path, line, matched_code)) AS finding_id,
  '{"ruleId":"' || rule_id || '","level":"' || CASE WHEN sev_rank >= 3 THEN 'error' WHEN sev_rank = 2 THEN 'warning'
  ELSE 'note' END || '","message":{"text":"' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"'
  || path || '"},"region":{"startLine":' || line || ',"startColumn":' || column_start || ',"endColumn":'
  || (column_start + len(matched_code)) || '}}}]}' AS result FROM reported""", REPORTED))
def sarif_export(spark, folder):
    return report.sarif_results(reported(spark, folder))


def _scan_of(spark, folder, *statuses) -> DataFrame:
    orders = read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_custkey", "o_orderstatus")
    texts = code_files(orders.where(F.col("o_orderstatus").isin(*statuses)))
    return scan(texts, packs=["pattern"], threshold="info", facts=False)


@query(sql.with_files("""SELECT path, line, rule_id, matched_code FROM reported JOIN files USING (path)
  JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'O'""", REPORTED))
def new_since_last_scan(spark, folder):
    """Findings of a scan that an earlier one, of fewer files, did not have."""
    now = _scan_of(spark, folder, "F", "P", "O")
    return report.new_findings(now, _scan_of(spark, folder, "F", "P")).select("path", "line", "rule_id", "matched_code")


@query(sql.with_files("""SELECT scan_ts, severity, total, before, total - coalesce(before, 0) AS change FROM (
  SELECT *, lag(total) OVER (PARTITION BY severity ORDER BY scan_ts) AS before FROM (
    SELECT year(o_orderdate)::INTEGER AS scan_ts, severity, count(*) AS total FROM reported JOIN files USING (path)
    JOIN orders USING (o_orderkey) GROUP BY ALL))""", REPORTED))
def severity_trend(spark, folder):
    """Findings by year of the order and severity, against the year before."""
    orders = read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_custkey", "o_orderdate")
    # The year travels in the path, so the findings need no join.
    texts = code_files(orders, "o_orderdate").withColumn("path", F.concat_ws("/", F.year("o_orderdate"), "path"))
    hits = scan(texts, packs=["pattern"], threshold="info", facts=False)
    counts = hits.groupBy(F.substring_index("path", "/", 1).cast("int").alias("scan_ts"), "severity").agg(
        F.count("*").alias("total"))
    return report.trend(counts)


# --- rules -------------------------------------------------------------------

@query(sql.with_files(f"""SELECT r.rule_id, r.severity, count(h.path) AS findings
  FROM {sql.rule_values(RULE_NAMES, ['pattern'])} AS {RULE} LEFT JOIN ({sql.pattern_pack()}) h ON h.rule_id = r.rule_id
  GROUP BY ALL"""))
def rule_usage(spark, folder):
    """Every rule of a pack with how often it was broken."""
    listed = list_rules(rules_frame(spark, packs=["pattern"])).select("rule_id", "severity")
    counts = reported(spark, folder).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return listed.join(F.broadcast(counts), "rule_id", "left").select(
        "rule_id", "severity", F.coalesce("findings", F.lit(0)).alias("findings"))


@query(sql.with_files(f"""SELECT path, line, rule_id, column_start, matched_code,
  CASE rule_id WHEN 'php-eval-usage' THEN 'low' ELSE 'high' END AS severity FROM (
  SELECT * FROM ({sql.pattern_pack('php')}) WHERE rule_id IN ('php-eval-usage', 'php-xss-echo'))"""))
def findings_after_rule_update(spark, folder):
    """A scan after one rule's severity was changed and only two rules were left on."""
    from ..rules.catalog import enable_rules
    rules = rules_frame(spark, packs=["pattern"])
    change = {"rule_id": "php-eval-usage", "pack": "pattern", "language": "php", "severity": "low", "sev_rank": 1}
    update = spark.createDataFrame([tuple(change.get(c) for c in rules.columns)], RULE_SCHEMA)
    rules = enable_rules(upsert_rules(rules, update), ["php-eval-usage", "php-xss-echo"])
    return scan(files(spark, folder), rules=rules, threshold="low", facts=False).select(*HITS, "severity")


# --- dependencies ------------------------------------------------------------

PACKAGES = sorted({row[1] for row in CVE_ROWS}) + ["unknown-package"]


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """project, package, version of one to nine parts, made of each part's key and size."""
    parts = read_table(spark, f"{folder}/part.parquet", "p_partkey", "p_size")
    package = F.element_at(F.array(*[F.lit(p) for p in PACKAGES]),
                           F.pmod("p_partkey", F.lit(len(PACKAGES))).cast("int") + 1)
    key = F.col("p_partkey")
    numbers = F.array(F.col("p_size") % 6, key % 5, key % 16, *[key % 3] * 6).cast("array<string>")
    version = F.array_join(F.slice(numbers, F.lit(1), (key % 9 + 1).cast("int")), ".")
    return parts.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("project"), package.alias("package"),
                        F.when(F.col("p_partkey") % 50 == 49, F.concat(version, F.lit("rc1"))).otherwise(version)
                        .alias("version"))


def _key(version: str) -> str:
    return f"list_resize(list_transform(string_split({version}, '.'), lambda x: x::BIGINT), 12, 0)"


CVE_VALUES = ", ".join(f"('{n}', '{p}', '{s}', {score}, '{a}', {n[4:8]}, '{w}', {quote(d)})"
                       for n, p, s, score, a, f, w, d in CVE_ROWS)
DEPS = f"""deps AS (SELECT 'p' || p_partkey AS project, {PACKAGES!r}[p_partkey % {len(PACKAGES)} + 1] AS package,
  array_to_string(([p_size % 6, p_partkey % 5, p_partkey % 16] || list_resize([p_partkey % 3], 6, p_partkey % 3))[:p_partkey % 9 + 1], '.') || CASE WHEN p_partkey % 50 = 49 THEN 'rc1' ELSE '' END
  AS version FROM part),
cve AS (SELECT * FROM (VALUES {CVE_VALUES}) AS c(cve_id, package, severity, cvss, affected, year, cwe, description)),
ranges AS (SELECT cve_id, package, trim(unnest(string_split(affected, ','))) AS r FROM cve),
parsed AS (SELECT cve_id, package, CASE WHEN r LIKE '<%' THEN NULL ELSE {_key("split_part(r, '-', 1)")} END AS lo,
  CASE WHEN r LIKE '<=%' THEN {_key("r[3:]")} WHEN r LIKE '<%' THEN {_key("r[2:]")}
       ELSE {_key("split_part(r, '-', 2)")} END AS hi, r NOT LIKE '<%' OR r LIKE '<=%' AS closed FROM ranges),
keyed AS (SELECT *, {_key("version")} AS v FROM deps WHERE regexp_matches(version, '^[0-9.]+$')),
vulnerable AS (SELECT DISTINCT project, k.package, version, cve_id FROM keyed k JOIN parsed p ON k.package = p.package
  WHERE (lo IS NULL OR v >= lo) AND (v < hi OR (closed AND v = hi)))"""


@query(f"WITH {DEPS} SELECT * FROM vulnerable")
def vulnerable_dependencies(spark, folder):
    return cve.vulnerable(dependencies(spark, folder), cve.cve_frame(spark))


@query(f"""WITH {DEPS} SELECT severity, year, count(*) AS total, count(DISTINCT project) AS projects,
  max(cvss)::DECIMAL(3,1) AS worst FROM vulnerable JOIN cve USING (cve_id) GROUP BY severity, year""")
def vulnerabilities_by_severity_and_year(spark, folder):
    cves = cve.cve_frame(spark)
    rows = cve.vulnerable(dependencies(spark, folder), cves).join(
        F.broadcast(cves.select("cve_id", "severity", "year", "cvss")), "cve_id")
    return rows.groupBy("severity", "year").agg(F.count("*").alias("total"),
                                                F.countDistinct("project").alias("projects"),
                                                F.max("cvss").alias("worst"))


@query(f"""WITH {DEPS} SELECT v.* FROM vulnerable v JOIN cve USING (cve_id)
  WHERE contains(lower(cve.package), 'injection') OR contains(lower(description), 'injection')""")
def dependencies_by_search(spark, folder):
    """Dependencies with a vulnerability that a search finds."""
    return cve.vulnerable(dependencies(spark, folder), cve.search(cve.cve_frame(spark), "Injection"))


@query(f"""WITH {DEPS} SELECT project, package, version, n AS known FROM deps
  JOIN (SELECT package, count(*) AS n FROM cve WHERE package = 'django' GROUP BY package) USING (package)""")
def known_vulnerabilities_of_package(spark, folder):
    """Dependencies on one package, with how many vulnerabilities are known for it."""
    index = cve.package_index(cve.by_package(cve.cve_frame(spark), "Django"))
    return dependencies(spark, folder).join(F.broadcast(index), "package").select(
        "project", "package", "version", F.size("cve_ids").cast("long").alias("known"))


@query(f"""WITH {DEPS} SELECT project, vulnerable.package, version, cve_id FROM vulnerable JOIN cve USING (cve_id)
  WHERE severity IN ('critical', 'high') AND year = 2025""")
def severe_recent_vulnerabilities(spark, folder):
    cves = cve.by_year(cve.by_severity(cve.cve_frame(spark), "critical", "high"), 2025)
    return cve.vulnerable(dependencies(spark, folder), cves)


# --- patches -----------------------------------------------------------------

def _fix_values() -> str:
    rows = []
    by_id = {t[0]: t for t in FIX_TEMPLATES}
    for template, rules in RULE_TEMPLATES.items():
        _, languages, _, regex, replacement, review = by_id[template]
        for rule in rules:
            for language in languages:
                rows.append(f"('{rule}', '{language}', '{template}', {quote('(?im)' + regex)}, {quote(replacement)}, "
                            f"{str(review).lower()})")
    return "(VALUES " + ", ".join(rows) + ") AS fix(rule_id, fix_language, template_id, regex, replacement, review)"


def _replaced() -> str:
    """regexp_replace with each template's own constant pattern."""
    cases = "".join(f"WHEN '{t[0]}' THEN regexp_replace(original_code, {quote('(?im)' + t[3])}, {quote(t[4])}, 'g') "
                    for t in FIX_TEMPLATES)
    return f"CASE template_id {cases} END"


SECTIONS = f"""findings AS MATERIALIZED (SELECT DISTINCT path, line, rule_id FROM ({sql.pattern_pack()})),
patched AS MATERIALIZED (SELECT *, {_replaced()} AS patched_code FROM (
  SELECT path, text, language, rule_id, template_id, line, review, first,
    array_to_string(all_lines[first:last], chr(10)) AS original_code, all_lines[1:first - 1] AS head,
    all_lines[last + 1:] AS tail FROM (
    SELECT f.path, files.text, language, f.rule_id, template_id, f.line, review,
      string_split(files.text, chr(10)) AS all_lines, greatest(f.line - 3, 1) AS first,
      least(f.line + 3, len(string_split(files.text, chr(10)))) AS last
    FROM findings f JOIN files USING (path) JOIN {_fix_values()}
      ON fix.rule_id = f.rule_id AND fix_language = language)))"""


@query(sql.with_files("""SELECT path, rule_id, template_id, line, original_code, patched_code,
  review AS requires_manual_review FROM patched""", SECTIONS))
def patched_sections(spark, folder):
    """Each finding's section before and after its template."""
    texts = files(spark, folder)
    rows = patch.patch_each(texts, one_per_line(reported(spark, folder))).where("template_id IS NOT NULL")
    return rows.select("path", "rule_id", "template_id", "line", "original_code", "patched_code",
                       "requires_manual_review")


def one_per_line(findings: DataFrame) -> DataFrame:
    return findings.select("path", "language", "line", "rule_id").distinct()


def _counted(text: str, char: str) -> str:
    return f"(len({text}) - len(replace({text}, '{char}', '')))"


def _paired(text: str, pairs: str) -> str:
    return " AND ".join(f"{_counted(text, a)} = {_counted(text, b)}" for a, b in pairs.split())


def _dangers(language: str, text: str) -> str:
    from ..operators.validate import DANGEROUS
    return "[" + ", ".join(f"len(regexp_extract_all({text}, {quote('(?i)' + rx)}))" for rx, _ in DANGEROUS[language]) + "]"


def _dangers_of(text: str) -> str:
    return f"CASE language WHEN 'python' THEN {_dangers('python', text)} WHEN 'javascript' THEN {_dangers('javascript', text)} WHEN 'go' THEN {_dangers('go', text)} END"


CODE_ONLY = "regexp_replace(after, '\"[^\"\\n]*\"|''[^''\\n]*''|#[^\\n]*', '', 'g')"


# A file is counted once; a patch is counted by its file's text with the section in its place, once for equal ones.
JUDGED = f"""SELECT path, rule_id, template_id, line, paired AND len(list_filter(list_zip(now, was), lambda x: x[1] > x[2])) = 0 AS success FROM patched
  JOIN (SELECT path, {_dangers_of('text')} AS was FROM files WHERE path IN (SELECT path FROM patched)) USING (path)
  JOIN (SELECT path, first, patched_code, {_dangers_of('after')} AS now, CASE language
      WHEN 'python' THEN {_paired(CODE_ONLY, "{{}} () []".replace("{{}}", "{}"))}
      WHEN 'javascript' THEN {_paired('after', "{} () []")} ELSE {_paired('after', "{}")} END AS paired
    FROM (SELECT DISTINCT path, language, first, patched_code,
            array_to_string(head || string_split(patched_code, chr(10)) || tail, chr(10)) AS after FROM patched)) USING (path, first, patched_code)
UNION ALL SELECT f.path, f.rule_id, NULL, f.line, false FROM findings f JOIN files USING (path)
WHERE NOT EXISTS (SELECT 1 FROM {_fix_values()} WHERE fix.rule_id = f.rule_id AND fix_language = language)"""


@query(sql.with_files(JUDGED, SECTIONS))
def patch_results(spark, folder):
    """Each finding's patch, checked on the whole file: brackets, indents, nothing dangerous added; a failure without a template."""
    rows = patch.patch_each(files(spark, folder), one_per_line(reported(spark, folder)))
    return rows.select("path", "rule_id", "template_id", "line", "success")


@query(sql.with_files("""SELECT path, rule_id, template_id, line, array_to_string(
    flatten(list_transform(list_filter(range(1, len(o) + 1), lambda i: o[i] <> n[i]),
                           lambda i: ['-' || o[i], '+' || n[i]])), chr(10)) AS diff
  FROM (SELECT *, string_split(original_code, chr(10)) AS o, string_split(patched_code, chr(10)) AS n FROM patched)""",
  SECTIONS))
def patch_previews(spark, folder):
    rows = patch.preview(files(spark, folder), one_per_line(reported(spark, folder)))
    return rows.select("path", "rule_id", "template_id", "line", F.array_join("diff", "\n").alias("diff"))


@query()
def patched_files(spark, folder):
    """Whole files with all their patches, from the last line up."""
    rows = patch.patch_files(files(spark, folder), reported(spark, folder))
    return rows.select("path", "language", "text", "patched_text", F.size("patches").alias("attempts"),
                       F.size(F.filter("patches", lambda p: p["success"])).alias("applied"))


def _line_verdict() -> str:
    """Whether a line may be put for another: brackets change alike, nothing dangerous is added."""
    def bare(column):
        return CODE_ONLY.replace("(after,", f"({column},")

    def alike(old, new, pairs):
        return " AND ".join(f"{_counted(new, a)} - {_counted(old, a)} = {_counted(new, b)} - {_counted(old, b)}" for a, b in pairs.split())

    cases = {"python": alike(bare("old"), bare("new"), "{} () []"), "javascript": alike("old", "new", "{} () []"), "go": alike("old", "new", "{}")}
    return "CASE language " + " ".join(
        f"WHEN '{name}' THEN {brackets} AND len(list_filter(list_zip({_dangers(name, 'new')}, {_dangers(name, 'old')}), lambda x: x[1] > x[2])) = 0"
        for name, brackets in cases.items()) + " END"


APART = f"""places AS (SELECT path, line, min((rule_id, template_id)) AS chosen FROM patched GROUP BY path, line),
whole AS (SELECT path, language, text, CASE language WHEN 'python' THEN {_paired(CODE_ONLY.replace('(after,', '(text,'), "{} () []")}
    WHEN 'javascript' THEN {_paired('text', "{} () []")} ELSE {_paired('text', "{}")} END AS paired FROM files),
tried AS (SELECT path, line, language, t AS old, {_replaced().replace('original_code', 't')} AS new
  FROM (SELECT l.path, l.line, l.language, l.t, chosen[2] AS template_id FROM lines l JOIN places p ON l.path = p.path AND l.line = p.line)),
judged AS (SELECT tried.*, paired AND {_line_verdict().replace('CASE language', 'CASE tried.language')} AS good FROM tried JOIN whole USING (path))
SELECT path, string_agg(CASE WHEN good THEN new ELSE t END, chr(10) ORDER BY line) AS patched_text,
  count(good)::INTEGER AS attempts, count(*) FILTER (good)::INTEGER AS applied
FROM lines LEFT JOIN (SELECT path, line, new, good FROM judged) USING (path, line) WHERE path IN (SELECT path FROM places) GROUP BY path"""


@query(sql.with_files(f"SELECT * FROM (WITH {APART})", SECTIONS))
def patched_files_by_line(spark, folder):
    """Whole files with the patches of all their lines, each on its line alone, so that places stand apart."""
    found = patch.with_templates(reported(spark, folder)).groupBy("path", "language", "line").agg(F.min("rule_id").alias("rule_id"))
    rows = patch.patch_files(files(spark, folder), found, context_lines=0)
    return rows.select("path", "patched_text", F.size("patches").alias("attempts"), F.size(F.filter("patches", lambda p: p["success"])).alias("applied"))


@query(sql.with_files(f"""SELECT count(*) AS total_patches, count(*) FILTER (success) AS successful,
  count(*) FILTER (NOT success) AS failed, count(DISTINCT path) AS files_patched,
  count(*) AS dry_runs, string_agg(DISTINCT template_id, ',' ORDER BY template_id) AS vulnerability_types
  FROM ({JUDGED})""", SECTIONS))
def patch_totals(spark, folder):
    rows = patch.patch_each(files(spark, folder), one_per_line(reported(spark, folder)))
    totals = patch.patch_summary(rows, "template_id")
    return totals.select("total_patches", "successful", "failed", "files_patched", "dry_runs",
                         F.array_join("vulnerability_types", ",").alias("vulnerability_types"))


@query(sql.with_files(f"""SELECT path, line, rule_id FROM reported
  WHERE rule_id NOT IN ({', '.join(repr(r) for rules in RULE_TEMPLATES.values() for r in rules)})""", REPORTED))
def findings_without_fix(spark, folder):
    return patch.unpatchable(reported(spark, folder)).select("path", "line", "rule_id")


EVAL = next(t for t in FIX_TEMPLATES if t[0] == "py_eval_dangerous")


@query(sql.with_files(f"""SELECT path, regexp_replace(text, {quote('(?im)' + EVAL[3])}, {quote(EVAL[4])}) AS fixed,
  len(regexp_extract_all(text, {quote('(?im)' + EVAL[3])}))::INTEGER AS matches FROM files
  WHERE language = 'python' AND regexp_matches(text, {quote('(?im)' + EVAL[3])})"""))
def first_fixes(spark, folder):
    """Python files with just the first match of a template replaced, and how many matches there are."""
    regex = to_java(EVAL[3], ignore_case=True, multiline=True)
    text = F.col("text")
    rows = files(spark, folder).where((F.col("language") == "python") & text.rlike(regex))
    return rows.select("path", patch.replace_first(text, regex, to_replacement(EVAL[4])).alias("fixed"),
                       count_matches(text, regex).alias("matches"))


KINDS = ["eval", "XSS", "SQL injection", "insecure tls", "yaml load", "unheard of", "unsafe pickle", "weak random"]


def _by_word() -> str:
    """(place, language, word, template_id): each word of a template's id, in the templates' order."""
    rows = [f"({place}, '{language}', '{word}', '{t[0]}')" for place, t in enumerate(FIX_TEMPLATES)
            for language in t[1] for word in t[0].split("_")]
    return "(VALUES " + ", ".join(rows) + ") AS w(place, word_language, word, likely)"


@query(sql.with_files(f"""SELECT path, kind, language, coalesce(template_id, (SELECT arg_min(likely, place) FROM {_by_word()}
    WHERE word_language = language AND contains(lower(kind), word))) AS template_id FROM (
  SELECT path, {KINDS!r}[o_orderkey % {len(KINDS)} + 1] AS kind, language FROM files)
  LEFT JOIN (VALUES ('eval','python','py_eval_dangerous'), ('eval','javascript','js_eval_dangerous'),
    ('xss','javascript','js_innerhtml_xss'), ('sql injection','python','py_sql_injection_string'),
    ('sql injection','go','go_sql_injection'), ('insecure tls','go','go_insecure_skip_verify'),
    ('yaml load','python','py_yaml_unsafe')) AS k(known, known_language, template_id)
  ON lower(kind) = known AND language = known_language"""))
def templates_by_kind(spark, folder):
    """The template for a kind of vulnerability in a language, a likely one for kinds not known, else null."""
    rows = code_files(read_table(spark, f"{folder}/orders.parquet", "o_orderkey", "o_custkey"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod("o_orderkey", F.lit(len(KINDS))).cast("int") + 1)
    return template_for_kind(rows.select("path", kind.alias("kind"), "language"))


# --- windows over time -------------------------------------------------------

def event_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of one line of Python per event, with the event's time; ``path`` is the user."""
    events = read_table(spark, f"{folder}/events.parquet", "event_id", "ts", "user_id")
    lines = TEMPLATES["python"][1]
    line = F.element_at(F.array(*[F.lit(x) for x in lines]), F.pmod("event_id", F.lit(len(lines))).cast("int") + 1)
    texts = events.select(F.concat_ws("/", F.lit("user"), "user_id", "event_id").alias("path"),
                          F.lit("python").alias("language"), line.alias("text"), F.col("ts").cast("timestamp"))
    from ..operators.scan import active_rules, hits_of, keyed_hits, with_rules
    rules = active_rules(None, "info", ["pattern"])
    rows = with_rules(keyed_hits(hits_of(texts, rules, False, keep=("ts",)), keep=("ts",)), rules, keep=("ts",))
    # One event is one text, so its duplicates share the time.
    return rows.dropDuplicates(["finding_id"])


EVENT_LINES = f"""lines AS (SELECT concat_ws('/', 'user', user_id, event_id) AS path, 'python' AS language, 1 AS line,
  ([{', '.join(quote(x) for x in TEMPLATES['python'][1])}])[event_id % {len(TEMPLATES['python'][1])} + 1] AS t FROM events),
hits AS (SELECT h.*, ts, 'user/' || user_id AS owner, severity FROM ({sql.pattern_pack('python')}) h
  JOIN events ON h.path = concat_ws('/', 'user', user_id, event_id)
  JOIN {sql.rule_values(RULE_NAMES, ['pattern'])} AS {RULE} ON r.rule_id = h.rule_id)"""


@query(f"""WITH {EVENT_LINES} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, severity, count(*) AS total
  FROM hits GROUP BY ALL""")
def hourly_severity_counts(spark, folder):
    return _plain(window_counts(event_findings(spark, folder), "1 hour"))


@query(f"""WITH {EVENT_LINES} SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, severity, count(*) AS total
  FROM (SELECT severity, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE,
    time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS w FROM hits) GROUP BY ALL""")
def sliding_severity_counts(spark, folder):
    return _plain(window_counts(event_findings(spark, folder), "1 hour", "20 minutes"))


@query(f"""WITH {EVENT_LINES}, marked AS (SELECT owner, ts, path, rule_id, column_start, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END
    AS begins FROM hits WINDOW w AS (PARTITION BY owner ORDER BY ts, path, rule_id, column_start)),
  numbered AS (SELECT *, sum(begins) OVER (PARTITION BY owner ORDER BY ts, path, rule_id, column_start ROWS UNBOUNDED PRECEDING) AS n FROM marked)
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, owner, count(*) AS total
  FROM numbered GROUP BY owner, n""")
def user_sessions(spark, folder):
    """Runs of findings per user with pauses under six hours."""
    rows = event_findings(spark, folder).withColumn("owner", F.substring_index("path", "/", 2))
    return _plain(session_counts(rows, "6 hours", "owner"))


def _plain(rows: DataFrame) -> DataFrame:
    """Window borders without time zone."""
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith(("_start", "_end")) else F.col(c)
                         for c in rows.columns])
