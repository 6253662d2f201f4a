"""Rules on facts: calls, macros, assignments and loops, per language.

Each rule is a predicate over the fact tables.  Where the established order is
"first match wins", a CASE chain keeps it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .facts import SKIP_TEXT_OUT, assignment_finder, call_columns, call_finder

# The words that tell what an argument holds and which methods are meant.
USER_INPUT = ["request.", "input(", "params", "args", "form", "query", "user_"]
USER_INPUT_FILE = USER_INPUT + ["sys.argv", "input_"]
USER_DATA = ["user", "input", "data", "req", "request"]
REQUEST_PARTS = ["req.", "request.", "body.", "query.", "params.", "headers."]
SQL_METHODS = ["query", "execute", "run", "exec", "prepare", "all", "get"]
SQL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE"]
RANDOM_CONTEXT = ["token", "password", "secret", "key", "salt", "nonce", "uuid", "id", "random"]
FILE_METHODS = ["readFile", "writeFile", "readFileSync", "writeFileSync", "createReadStream", "createWriteStream",
                "rename", "mkdir"]
REDIRECTS = ["redirect", "res.redirect", "Response.redirect", "window.location"]
UNSAFE_GO = ["unsafe.Pointer", "unsafe.Slice", "unsafe.String", "unsafe.StringData", "unsafe.SliceData"]

# Words in a call's lower-case name without which no rule applies.
CALL_WORDS = {
    "python": ["eval", "exec", "pickle", "marshal", "yaml.load", "subprocess", "popen", "call", "run", "system",
               "mktemp", "open", "md5", "sha1", "fromstring", "_create_unverified_context", "random", "json.load",
               "input", "torch.compile", "pipeline", "numpy", "np", "celery"],
    "javascript": ["eval", "function", "settimeout", "setinterval", "document.write", "query", "execute", "run",
                   "exec", "prepare", "all", "get", "math.random", "json.parse", "fetch", "axios", "post",
                   "readfile", "writefile", "createreadstream", "createwritestream", "rename", "mkdir", "redirect",
                   "window.location"],
    "go": ["unsafe."],
    "rust": ["unwrap", "expect", "transmute", "forget", "uninitialized", "drop_in_place", "panic", "debug_assert",
             "format"],
}


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def any_argument(test) -> Column:
    return F.exists("args", test)


def keyword(name: str, value: str) -> Column:
    """A keyword argument ``name`` whose value matches the Java pattern ``value``."""
    return F.exists("kwargs", lambda k: k["name"].rlike(name) & k["value"].rlike(value))


def first_rule(*cases: tuple[Column, str]) -> Column:
    chain = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, rule_id in cases[1:]:
        chain = chain.when(test, F.lit(rule_id))
    return chain


def each_rule(*cases: tuple[Column, str]) -> list[Column]:
    return [F.when(test, F.lit(rule_id)) for test, rule_id in cases]


def python_call_rules() -> Column:
    f, n = F.col("func_text"), F.col("func_lc")
    is_eval = (n == "eval") | f.endswith(".eval")
    is_exec = (n == "exec") | f.endswith(".exec")
    unsafe_yaml = f.contains("yaml.load") & ~f.contains("safe_load")
    user = any_argument(lambda a: has_any(F.lower(a), USER_INPUT))
    call = first_rule(
        (is_eval, "PY001"),
        (is_exec, "PY002"),
        (f.contains("literal_eval"), "PY003"),
        (n.contains("pickle"), "PY005"),
        (n.contains("marshal"), "PY006"),
        (unsafe_yaml, "PY007"),
        ((f.contains("subprocess") | n.isin("popen", "call", "run")) & keyword("^shell$", "^True$"), "PY008"),
        (f.contains("os.system") | (n == "system"), "PY009"),
        (f.contains("os.popen") | (n == "popen"), "PY010"),
        (f.contains("mktemp"), "PY015"),
        ((n == "open") & has_any(F.lower(F.get("args", F.lit(0))), USER_INPUT_FILE), "PY016"),
        (f.contains("hashlib.md5") | (n == "md5"), "PY018"),
        (f.contains("hashlib.sha1") | (n == "sha1"), "PY019"),
        (f.contains("fromstring") & n.contains("xml"), "PY021"),
        (f.contains("_create_unverified_context"), "PY022"),
        (n.isin("random", "randint", "choice") & f.contains("random"), "PY025"),
        (f.endswith("json.load") | f.endswith("json.loads"), "PY027"),
        (n == "input", "PY020"))
    with_user = first_rule((is_eval & user, "PY030"), (is_exec & ~is_eval & user, "PY031"))
    known = first_rule(
        (unsafe_yaml, "PY028"),
        (f.contains("pickle") & (f.endswith(".loads") | f.endswith(".load")), "PY029"),
        (f.contains("torch.compile") | (n == "torch.compile"), "PY039"),
        (f.contains("pipeline") & f.contains("transformers") & keyword("^trust_remote_code$", "(?i)^true$"), "PY040"),
        ((f.contains("numpy") | f.contains("np")) & n.contains("array") & user, "PY041"),
        (n.contains("celery") & keyword("task_serializer|result_serializer", "(?i)pickle"), "PY042"))
    return F.array(call, with_user, known)


def _bare(argument: Column) -> Column:
    """An argument without what stands in quotes and brackets."""
    quotes = F.regexp_replace(argument, r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\]|\\.)*+\'|`(?:[^`\\]|\\.)*+`', "_")
    return F.regexp_replace(F.regexp_replace(quotes, r"\([^()]*+\)", "_"), r"\([^()]*+\)", "_")


def _is_template(argument: Column) -> Column:
    return argument.rlike(r"^`[\s\S]*`$")


def _is_binary(argument: Column) -> Column:
    plain = ~argument.contains("=>") & ~argument.rlike(r"^(?:function\b|async\b|[{\[]|new )")
    return plain & _bare(argument).rlike(r"[^+\-!~]\s*(?:[-+*/%]|&&|\|\||[<>]=?|[!=]==?)\s*\S")


def javascript_call_rules() -> Column:
    f = F.col("func_text")
    first = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    bare_first = F.regexp_replace(first, "^[\"'`]", "")

    def built_sql(a):
        return (_is_template(a) | _is_binary(a)) & (a.contains("${") | a.contains("+"))

    def dynamic(a):
        name = a.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$") & ~a.isin("true", "false", "null", "undefined", "this")
        return _is_template(a) | _is_binary(a) | name

    def climbs(a):
        return a.contains("..") | F.lower(a).contains("%2e%2e")

    goes_out = reduce(lambda x, y: x | y, [bare_first.startswith(p) for p in ("http://", "https://", "//", "${")])
    return F.array(*each_rule(
        (f == "eval", "JS-EVAL-001"),
        (f == "Function", "JS-EVAL-002"),
        (f.isin("setTimeout", "setInterval") & first.rlike("^[\"'`]") & ~_is_binary(first), "JS-TIMER-001"),
        (f.contains("document.write"), "JS-XSS-002"),
        (has_any(f, SQL_METHODS) & any_argument(built_sql), "JS-SQLI-001"),
        (f.contains("exec") & any_argument(dynamic), "JS-EXEC-001"),
        (f.contains("Math.random") & has_any(F.lower("hit.own_line"), RANDOM_CONTEXT), "JS-CRYPTO-001"),
        (has_any(f, ["fetch", "axios", "get", "post"]) & has_any(first, REQUEST_PARTS), "JS-SSRF-001"),
        (has_any(f, FILE_METHODS) & any_argument(climbs), "JS-PATH-001"),
        (has_any(f, REDIRECTS) & (goes_out | first.contains("'${") | first.contains('"${')), "JS-REDIRECT-001")))


def rust_call_rules() -> Column:
    f = F.col("func_text")
    macro = f.endswith("!")
    call = F.when(~macro, first_rule(
        ((f == "unwrap") | f.endswith(".unwrap"), "RS010"),
        ((f == "expect") | f.endswith(".expect"), "RS011"),
        (f.contains("transmute"), "RS022"),
        (f.contains("forget") & f.contains("mem"), "RS023"),
        (f.contains("uninitialized"), "RS024"),
        (f.contains("drop_in_place"), "RS025")))
    return F.array(call, *each_rule(
        (macro & f.contains("panic") & has_any(F.lower("args_text"), USER_DATA), "RS009"),
        (macro & f.contains("debug_assert"), "RS020"),
        (macro & f.contains("format") & has_any(F.upper("args_text"), SQL_KEYWORDS), "RS005")))


def go_call_rules() -> Column:
    return F.array(*each_rule((F.col("func_text").isin(UNSAFE_GO), "go-unsafe-pointer-ast")))


def javascript_assignment_rules() -> Column:
    target, value = F.col("target"), F.col("value")
    fixed_text = value.rlike(r"""^\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')\s*[;,]?\s*$""")
    return F.array(*each_rule(
        (target.rlike(r"\.(?:innerHTML|outerHTML)") & ~fixed_text, "JS-XSS-001"),
        (target.contains("__proto__") | target.contains("constructor.prototype"), "JS-PROTO-001"),
        (target == "dangerouslySetInnerHTML", "JS-REACT-001")))


CALL_RULES = {"python": python_call_rules, "javascript": javascript_call_rules, "rust": rust_call_rules,
              "go": go_call_rules}

# Ways of finding facts, handled like the rules' own patterns.
CALL, ASSIGNMENT, DEFER, PARSE = "call", "assignment", "defer", "parse"
CONTEXT = {"python": 1, "rust": 1, "javascript": 3, "go": 0}
TARGETS = ["innerhtml", "outerhtml", "__proto__", "constructor.prototype"]


def fact_patterns() -> list[tuple]:
    """pack, rule_language, scope, finder, replacement, words, names, context of every way to find facts.

    A text without a word of each list in ``words`` is passed over; so is a fact whose lower-case
    name holds none of ``names``.
    """
    rows = [(language, language, CALL, call_finder(language), SKIP_TEXT_OUT, [words], words, CONTEXT[language])
            for language, words in CALL_WORDS.items()]
    rows.append(("javascript", "javascript", ASSIGNMENT, assignment_finder("javascript"), SKIP_TEXT_OUT, [TARGETS],
                 TARGETS, 3))
    rows.append(("javascript", "javascript", PARSE, call_finder("javascript"), SKIP_TEXT_OUT, [["json.parse"]],
                 ["json.parse"], 3))
    rows.append(("go", "go", DEFER, "", "", [["defer "]], None, 0))
    return rows


def with_fact_rules(rows: DataFrame, keep=()) -> DataFrame:
    """One row per rule for rows of pack, scope, rule_id (null for facts) and hit."""
    scope, pack = F.col("scope"), F.col("pack")
    call_rules = F.lit(None).cast("array<string>")
    for language, rules in CALL_RULES.items():
        call_rules = F.when(pack == language, rules()).otherwise(call_rules)
    rule_ids = (F.when(scope == CALL, call_rules)
                .when(scope == ASSIGNMENT, javascript_assignment_rules())
                .when(scope == DEFER, F.array(F.lit("go-defer-in-loop")))
                .when(scope == PARSE, F.array(F.lit("JS-JSON-001")))
                .otherwise(F.array("rule_id")))
    hit = F.col("hit")
    matched = (F.when(scope.isin(CALL, PARSE), F.concat(hit["matched"], F.lit("("), hit["extra"], F.lit(")")))
               .when(scope == ASSIGNMENT, F.concat(hit["matched"], F.lit(" = "), strip(hit["extra"])))
               .otherwise(hit["matched"]))
    # Rules read the arguments of Python's and JavaScript's calls. Which rules are broken is a column first: inside a generator nothing is compiled, and
    # a plain explode lets Spark work it out once more, for its size.
    facts = (call_columns(rows, (scope == CALL) & pack.isin("python", "javascript"))
             .withColumn("target", hit["matched"]).withColumn("value", hit["extra"])
             .select("path", "language", *keep, "pack", rule_ids.alias("rule_ids"), hit.withField("matched", matched).alias("hit")))
    return (facts.select("path", "language", *keep, "pack", F.explode_outer("rule_ids").alias("rule_id"), "hit")
            .where(F.col("rule_id").isNotNull()))


def adapt_detector_rows(rows: DataFrame) -> DataFrame:
    """Rows of an outside detector with its gaps filled in."""
    defaults = {"severity": "medium", "line": 1, "column_start": 1, "cwe": "CWE-UNKNOWN"}
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                         for c in rows.columns])
