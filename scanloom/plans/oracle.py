"""SQL for DuckDB that says what a query must give, written apart from the Spark plans.

Line rules are applied to each line by itself here, with the patterns as they are
written; the Spark side looks through whole texts with translated patterns.
"""
from __future__ import annotations

from ..rules import language_packs as lp
from ..rules import web_packs as wp
from ..rules.catalog import builtin_rules, wildcard_regex
from ..rules.pattern_pack import PATTERN_RULES
from .corpus import TEMPLATES, files_sql, quote
from .labels import CALLS, FACT_RULES


def _flagged(regex: str, flags: str) -> str:
    regex = regex.removeprefix("(?i)") if regex.startswith("(?i)") else regex
    return f"(?{flags}){regex}" if flags else regex


def _case(regex: str, ignore_case: bool) -> str:
    return "i" if ignore_case or regex.startswith("(?i)") else ""


PREFIX = "replace(array_to_string(parts[1:i-1], ''), chr(2), '')"


def line_rule(rule_id: str, regex: str, language: str | None, flags: str = "", extra: str = "") -> str:
    """path, line, rule_id, column_start, matched_code, t of every match on every line."""
    rx = quote(_flagged(regex, flags))
    where = f"language = '{language}' AND " if language else ""
    return f"""SELECT path, line, '{rule_id}' AS rule_id, len({PREFIX}) + 1 AS column_start,
  string_split(parts[i], chr(2))[1] AS matched_code, t
FROM (SELECT path, line, t, string_split(regexp_replace(t, '(' || {rx} || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1))
      AS parts FROM lines WHERE {where}regexp_matches(t, {rx}){extra}), unnest(range(2, len(parts) + 1)) AS u(i)"""


def word_rule(rule_id: str, regex: str) -> str:
    """The same for whole words. RE2's word bounds know ASCII only, so words are runs of letters of any script first."""
    return f"""SELECT * FROM ({line_rule(rule_id, r"[\p{L}\p{N}_]+", None)}) WHERE regexp_full_match(matched_code, {quote(regex)})"""


def text_rule(rule_id: str, regex: str, language: str | None, flags: str = "i", table: str = "files") -> str:
    """The same over whole texts."""
    rx = quote(_flagged(regex, flags))
    where = f"language = '{language}' AND " if language else ""
    return f"""SELECT path, (1 + len(pre) - len(replace(pre, chr(10), '')))::INTEGER AS line, '{rule_id}' AS rule_id,
  len(string_split(pre, chr(10))[-1]) + 1 AS column_start, matched_code
FROM (SELECT path, {PREFIX} AS pre, string_split(parts[i], chr(2))[1] AS matched_code
  FROM (SELECT path, string_split(regexp_replace(text, '(' || {rx} || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1))
        AS parts FROM {table} WHERE {where}regexp_matches(text, {rx})), unnest(range(2, len(parts) + 1)) AS u(i))"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(f"({p})" for p in parts)


def _distinct(parts: list[str]) -> str:
    return f"""SELECT path, line::INTEGER AS line, rule_id, min(column_start)::INTEGER AS column_start, matched_code
FROM ({_union(parts)}) GROUP BY path, line, rule_id, matched_code"""


def _once(parts: list[str]) -> str:
    return f"""SELECT path, line::INTEGER AS line, rule_id, min(column_start)::INTEGER AS column_start,
  arg_min(matched_code, column_start) AS matched_code
FROM ({_union(parts)}) GROUP BY path, line, rule_id"""


def pattern_pack(language: str | None = None) -> str:
    return _distinct([
        "SELECT path, line, rule_id, column_start, matched_code FROM ("
        + line_rule(rule_id, wildcard_regex(p), lang) + ")"
        for rule_id, lang, _, _, _, patterns in PATTERN_RULES for p in patterns
        if language is None or lang == language])


def _guard(words: list[str]) -> str:
    return f" AND NOT regexp_matches(t, {quote('(?i)' + '|'.join(words))})"


def python_lines() -> str:
    parts = []
    for rule_id, (regex, must, guarded) in lp.PYTHON_LINES.items():
        # No look-ahead there: an equals sign not followed by another.
        extra = "".join(f" AND regexp_matches(t, {quote(m.replace('(?!=)', '(?:[^=]|$)'))})" for m in must)
        extra += _guard(lp.PYTHON_NO_SECRET) if guarded else ""
        parts.append("SELECT path, line, rule_id, column_start, matched_code FROM ("
                     + line_rule(rule_id, regex, "python", _case(regex, False), extra) + ")")
    return _once(parts)


def rust_lines() -> str:
    return _once([
        "SELECT path, line, rule_id, column_start, matched_code FROM ("
        + line_rule(rule_id, regex, "rust", "i" if ignore_case else "", _guard(lp.RUST_NO_SECRET) if guarded else "")
        + ")" for rule_id, (regex, ignore_case, guarded) in lp.RUST_LINES.items()])


def javascript_rules() -> str:
    parts = []
    for rule_id, _, _, regex, _ in wp.JAVASCRIPT_LINES:
        extra = ""
        if "(?!" in regex:  # no look-ahead there: the same, said by two conditions
            extra = f" AND NOT regexp_matches(t, {quote('(?i)' + regex.replace('(?!', '(?:'))})"
            regex = regex[:regex.index("(?!")]
        parts.append("SELECT path, line, rule_id, column_start, matched_code FROM ("
                     + line_rule(rule_id, regex, "javascript", "i", extra) + ")")
    nested = f" AND regexp_matches(t, {quote('|'.join(wp.NESTED_QUANTIFIERS))})"
    slow = _once(["SELECT path, line, rule_id, column_start, matched_code FROM ("
                  + line_rule("JS-REGEX-001", wp.REGEX_LITERAL, "javascript", "", nested) + ")"])
    parts += [text_rule("JS-HARDCODED-SECRET", p, "javascript") for p in wp.JAVASCRIPT_SECRETS]
    return _distinct(parts) + " UNION ALL " + slow


def go_rules(language: str | None = "go", table: str = "files", secrets_only: bool = False) -> str:
    parts = [] if secrets_only else [
        text_rule(rule_id, regex, language, "im", table) for rule_id, _, _, regex in lp.GO_RULES]
    parts += [text_rule(rule_id, regex, language, "i", table) for rule_id, _, regex, _ in lp.GO_SECRETS]
    return _distinct(parts)


def generic_rules(table: str = "files") -> str:
    return _distinct([text_rule(rule_id, regex, None, "i", table) for rule_id, _, _, regex, _, _ in wp.GENERIC])


def template_rows() -> str:
    """VALUES (language, number, template line)."""
    rows = [f"('{lang}', {i}, {quote(line)})" for lang, (_, lines) in TEMPLATES.items()
            for i, line in enumerate(lines)]
    return "(VALUES " + ", ".join(rows) + ") AS tpl(tpl_language, number, template)"


def labelled(labels: dict, fields: str) -> str:
    """The labels' fields for every line of every file; column -1 stands for the last dot."""
    rows = []
    for lang, lines in labels.items():
        for number, entries in lines.items():
            for entry in entries:
                values = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in entry[1:])
                rows.append(f"('{lang}', {number}, {entry[0]}, {values})")
    names = ", ".join(fields.split())
    column = "CASE WHEN label_column = -1 THEN len(t) - position('.' IN reverse(t)) + 1 ELSE label_column END"
    return f"""SELECT path, language, line::INTEGER AS line, ({column})::INTEGER AS column_start, {names}
FROM (SELECT l.*, f.o_orderkey FROM lines l JOIN files f USING (path))
JOIN {template_rows()} ON tpl_language = language AND t = replace(template, '{{k}}', o_orderkey::VARCHAR)
JOIN (VALUES {', '.join(rows)}) AS lab(lab_language, lab_number, label_column, {names})
  ON lab_language = language AND lab_number = number"""


def facts() -> str:
    return f"SELECT path, line, rule_id, column_start FROM ({labelled(FACT_RULES, 'rule_id')})"


def call_labels() -> str:
    return labelled(CALLS, "func_text n_args")


DEFER = """walk AS (
  SELECT path, 0::BIGINT AS line, false AS inside, 0 AS braces, false AS hit FROM files WHERE language = 'go'
  UNION ALL
  SELECT path, line, CASE WHEN opens THEN true ELSE inside AND NOT (now = 0 AND s LIKE '%}') END,
         now, inside AND NOT opens AND contains(s, 'defer ') AND now > 0
  FROM (SELECT w.path, l.line, w.inside, regexp_matches(trim(l.t, ' ' || chr(9)), '^for\\s') AS opens,
          trim(l.t, ' ' || chr(9)) AS s,
          CASE WHEN regexp_matches(trim(l.t, ' ' || chr(9)), '^for\\s') THEN len(l.t) - len(replace(l.t, '{', ''))
               WHEN w.inside THEN w.braces + 2 * len(l.t) - len(replace(l.t, '{', '')) - len(l.t)
                                  - (len(l.t) - len(replace(l.t, '}', '')))
               ELSE w.braces END AS now
        FROM walk w JOIN lines l ON l.path = w.path AND l.line = w.line + 1))"""


def defer_hits() -> str:
    return """SELECT path, line::INTEGER AS line, 'go-defer-in-loop' AS rule_id,
  position('defer' IN t)::INTEGER AS column_start FROM walk JOIN lines USING (path, line) WHERE hit"""


def with_files(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([files_sql(), *ctes]) + "\n" + body


def rule_values(columns: list[str], packs=None) -> str:
    """VALUES of rule metadata, one row per pack and rule."""
    from ..rules.catalog import RULE_COLUMNS

    rows = []
    for row in builtin_rules():
        rule = dict(zip(RULE_COLUMNS, row))
        if packs is None or rule["pack"] in packs:
            values = [rule[c] for c in columns]
            rows.append("(" + ", ".join(quote(v) if isinstance(v, str) else "NULL" if v is None else str(v)
                                        for v in values) + ")")
    return "(VALUES " + ", ".join(rows) + ")"


def all_findings() -> str:
    """pack, path, line, rule_id, column_start of a scan with every pack, before a severity is asked for."""
    parts = [("pattern", pattern_pack()), ("python", python_lines()), ("rust", rust_lines()),
             ("javascript", javascript_rules()), ("go", go_rules()), ("generic", generic_rules())]
    rows = [f"SELECT '{pack}' AS pack, path, line, rule_id, column_start FROM ({sql})" for pack, sql in parts]
    rows.append("""SELECT CASE language WHEN 'python' THEN 'python' WHEN 'go' THEN 'go' ELSE 'javascript' END AS pack,
      path, line, rule_id, column_start FROM (""" + labelled(FACT_RULES, "rule_id") + ")")
    rows.append(f"SELECT 'go' AS pack, path, line, rule_id, column_start FROM ({defer_hits()})")
    return _union(rows)
