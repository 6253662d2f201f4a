"""Calls and assignments found in source text, and folds over its lines.

There is no parser here.  One regular expression per language walks over the
text, passes over strings and comments, and stops at every name followed by a
bracket (a call) or an equals sign (an assignment).  A call's arguments are read
by a look-ahead, so calls inside arguments are found as well; where brackets are too
deep for it, a fold over the text after the name reads them, however deep they are.

Known limits: text of f-strings and template strings is read as code; a method
definition without a keyword looks like a call.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import END, EXTRA, HIT, START, clean, exploded, hits_in, let, mark, settled
from ..functions.text import shown_part, snippet, strip

IDENT = r"[\p{L}_$][\p{L}\p{N}_$]*+"
# A name is tried from its first part only: a later part ends at the same place.
NAME_START = r"(?<![\p{L}\p{N}_$])(?<![\p{L}\p{N}_$]\.)(?<![\p{L}\p{N}_$]::)"
DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"'
SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'"
BACKTICK = r"`(?:[^`\\]++|\\[\s\S])*+`"
NOT_FSTRING = r"(?<![fF])(?<![fF][rR])"
SLASH_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"

SKIPPED = {
    "python": "|".join([
        NOT_FSTRING + r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""',
        NOT_FSTRING + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''",
        NOT_FSTRING + DOUBLE, NOT_FSTRING + SINGLE, r"#[^\n]*+"]),
    "javascript": "|".join([DOUBLE, SINGLE, SLASH_COMMENT]),
    "go": "|".join([DOUBLE, r"`[^`]*+`", r"'(?:[^'\\\n]|\\[^\n]{1,9})'", SLASH_COMMENT]),
    "rust": "|".join([r'"(?:[^"\\]++|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[^\n]{1,9})'", SLASH_COMMENT]),
}
DEFINED = "".join(f"(?<!{word} )" for word in ("def", "func", "fn", "function", "class"))
KEYWORDS = ["if", "elif", "while", "for", "switch", "catch", "return", "and", "or", "not", "in", "is", "func", "fn",
            "function", "match", "print ", "await", "assert", "except", "lambda", "yield", "typeof", "else", "with",
            "as", "from", "import", "del", "raise", "throw", "case", "let", "const", "var", "type", "async"]


def _balanced(depth: int) -> str:
    """Text with matched round brackets; brackets in strings do not count."""
    body = r"""[^()"'`]++|""" + DOUBLE + "|" + SINGLE + "|" + BACKTICK + r"""|["'`]"""
    inner = f"(?:{body})*+"
    for _ in range(depth):
        inner = rf"(?:{body}|\({inner}\))*+"
    return inner


CALL_NAME = rf"(?:(?<=[)\]\"'`\s])\.)?{IDENT}(?:(?:\.|::){IDENT})*+!?"
ARGUMENT = (r"""(?:[^,()\[\]{}"'`]++|""" + DOUBLE + "|" + SINGLE + "|" + BACKTICK
            + rf"|\({_balanced(3)}\)"
            + r"""|\[(?:[^\[\]"']++|""" + DOUBLE + "|" + SINGLE + r"""|\[[^\[\]]*+\]|["'])*+\]"""
            + r"""|\{(?:[^{}"']++|""" + DOUBLE + "|" + SINGLE + r"""|\{[^{}]*+\}|["'])*+\}"""
            + r"""|["'`\[\](){}])++""")
TARGET = rf"{IDENT}(?:\.{IDENT}|\[[^\]\n]*+\])*+"
VALUE = r"""[^;\n"'`]++|""" + DOUBLE + "|" + SINGLE + "|" + BACKTICK + r"""|["'`]"""
SKIP_TEXT_OUT = f"$1{START}$2{EXTRA}$3{END}"


def call_finder(language: str) -> str:
    return (rf"({SKIPPED[language]})|{NAME_START}{DEFINED}({CALL_NAME})"
            rf"(?:(?=[ \t]*+\(({_balanced(4)})\))|(?=[ \t]*+\())")


def assignment_finder(language: str) -> str:
    return (rf"({SKIPPED[language]})|(?<![\p{{L}}\p{{N}}_$.])({TARGET})"
            r"(?=[ \t]*+(?::(?!=)[\p{L}\p{N}_&<>\[\], \t|'.]*?)?(?:[-+*/%&|^:]|//|\*\*|<<|>>)?=(?![=>])[ \t]*+((?:" + VALUE + r")*+))")


def marked_by_language(text: Column, make) -> Column:
    """``text`` with marks around what the finder for the row's language finds; other languages with braces read like JavaScript.

    Each finder is a constant, so it is compiled once, not whenever the language changes from row to row.
    """
    def found(language):
        return settled(mark(text, make(language), SKIP_TEXT_OUT))

    chosen = F.when(F.col("language") == "python", found("python"))
    for language in ("go", "rust"):
        chosen = chosen.when(F.col("language") == language, found(language))
    return chosen.otherwise(found("javascript"))


BRACKET_TOKENS = "|".join([DOUBLE, SINGLE, BACKTICK, r"[()]", r"""[^()"'`]++""", r"""["'`]"""])
ARGUMENT_TOKENS = "|".join([DOUBLE, SINGLE, BACKTICK, r"[()\[\]{},]", r"""[^()\[\]{},"'`]++""", r"""["'`]"""])


def deep_arguments(rest: Column) -> Column:
    """What stands in the bracket that ``rest`` begins with, read token by token; empty if it never closes."""
    def step(state, token):
        depth = state["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        return F.when(state["done"], state).otherwise(F.struct(
            depth.alias("depth"), (state["size"] + F.length(token)).alias("size"), (depth == 0).alias("done")))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    read = F.aggregate(F.regexp_extract_all(rest, F.lit(BRACKET_TOKENS), F.lit(0)), zero, step)
    return let(read, lambda r: F.when(r["done"], rest.substr(F.lit(2), r["size"] - 2)).otherwise(""))


def with_deep_arguments(hit: Column, lines: Column) -> Column:
    """``hit``, a call; arguments that the look-ahead did not reach are read from the lines."""
    tail = F.get(lines, hit["line"] - 1).substr(hit["column_start"] + F.length(hit["matched"]), F.length(F.get(lines, hit["line"] - 1)))
    rest = F.ltrim(F.concat_ws("\n", tail, F.array_join(F.slice(lines, hit["line"] + 1, F.size(lines)), "\n")), F.lit(" \t"))
    deep = (hit["extra"] == "") & tail.rlike(r"^[ \t]*+\((?![ \t]*+\))")
    return F.when(deep, hit.withField("extra", deep_arguments(rest))).otherwise(hit)


def dress(hits: Column, lines: Column, around: Column, width: int | None = None, begins: bool = True) -> Column:
    """Add the hit's own line, its snippet and, with ``begins``, whether it begins the line; ``width`` shortens long lines in the snippet only."""

    def add(both):
        def one(hit):
            def with_own(own):
                part = shown_part(own, hit["column_start"], width)
                shown = (F.when(around < 0, hit["matched"]).when(around == 0, strip(part))
                         .otherwise(snippet(both["lines"], hit["line"], around, part, width)))
                # Blanks are looked for as blanks: a long line is not cut out for each of its hits.
                begins_line = (hit["column_start"] == 1) | (F.length(F.regexp_extract(own, r"^[ \t\r\x0b\x0c]*+", 0)) >= hit["column_start"] - 1)
                return F.struct(hit["line"], hit["column_start"], hit["matched"], hit["extra"],
                                own.alias("own_line"), shown.alias("snippet"), *([begins_line.alias("begins_line")] if begins else []))
            return let(F.get(both["lines"], hit["line"] - 1), with_own)
        return F.transform(both["hits"], one)

    return let(F.struct(hits.alias("hits"), lines.alias("lines")), add)


def context_lines() -> Column:
    """Lines of context around a finding, by language."""
    return (F.when(F.col("language").isin("python", "rust"), 1)
            .when(F.col("language") == "javascript", 3).otherwise(0))


def _facts(texts: DataFrame, make, keep) -> DataFrame:
    marked = texts.select("path", "language", clean(F.col("text")).alias("text")).select("*", marked_by_language(F.col("text"), make).alias("marked"))
    found = F.filter(hits_in(F.col("marked")), keep)
    read = marked.select("path", "language", F.struct(found.alias("hits"), F.split("text", "\n").alias("lines")).alias("both"))

    def shown(both):
        hits = both["hits"]
        if make is call_finder:
            hits = F.transform(hits, lambda hit: with_deep_arguments(hit, both["lines"]))
        return dress(hits, both["lines"], context_lines())

    return exploded(read.select("path", "language", let(F.col("both"), shown).alias("hits")), "path", "language")


def arguments(args_text: Column) -> Column:
    """The arguments of a call, split at its own commas; by a fold where brackets may be too deep for a pattern."""
    def many(mark, number):
        return F.length(args_text) - F.length(F.replace(args_text, F.lit(mark))) > number

    parts = F.when(many("(", 3) | many("[", 2) | many("{", 2), folded_arguments(args_text)).otherwise(
        F.regexp_extract_all(args_text, F.lit(ARGUMENT), F.lit(0)))
    return F.filter(F.transform(parts, strip), lambda a: a != "")


def folded_arguments(args_text: Column) -> Column:
    def step(state, token):
        opens, closes = token.isin("(", "[", "{"), token.isin(")", "]", "}")
        depth = F.greatest(state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        ends = (token == ",") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(ends, "").otherwise(F.concat(state["own"], token)).alias("own"),
                        F.when(ends, F.concat(state["parts"], F.array(state["own"]))).otherwise(state["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("own"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(F.regexp_extract_all(args_text, F.lit(ARGUMENT_TOKENS), F.lit(0)), zero, step,
                       lambda state: F.concat(state["parts"], F.array(state["own"])))


def keyword_arguments(args: Column) -> Column:
    named = F.filter(args, lambda a: a.rlike(r"^[\p{L}_]\w*\s*=(?!=)"))
    return F.transform(named, lambda a: F.struct(
        F.regexp_extract(a, r"^(\w+)", 1).alias("name"),
        F.regexp_extract(a, r"^\w+\s*=\s*([\s\S]*)$", 1).alias("value")))


def call_columns(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Name and arguments of the call in ``hit``; arguments are taken apart where ``wanted``, by default everywhere."""
    args = arguments(F.col("args_text"))
    return (rows.withColumn("func_text", F.col("hit.matched"))
            .withColumn("func_lc", F.lower("func_text"))
            .withColumn("args_text", F.col("hit.extra"))
            .withColumn("args", args if wanted is None else F.when(wanted, args))
            .withColumn("kwargs", keyword_arguments(F.col("args"))))


def calls(texts: DataFrame) -> DataFrame:
    """Every call in ``texts``."""
    rows = _facts(texts, call_finder, lambda h: (h["matched"] != "") & ~h["matched"].isin(KEYWORDS))
    return call_columns(rows).select(
        "path", "language", "hit.line", "hit.column_start", "func_text", "func_lc", "args_text", "args", "kwargs")


def assignments(texts: DataFrame) -> DataFrame:
    """Every assignment; in Python only those that begin a line, the rest being keyword arguments."""
    rows = _facts(texts, assignment_finder, lambda h: h["matched"] != "")
    return (rows.where((F.col("language") != "python") | F.col("hit.begins_line"))
            .select("path", "language", "hit.line", "hit.column_start", F.col("hit.matched").alias("target"),
                    strip(F.col("hit.extra")).alias("value")))


# --- folds -------------------------------------------------------------------

def defer_in_loop(text: Column) -> Column:
    """Lines with a Go ``defer`` inside a ``for`` body, as an array of hits.

    A ``for`` line opens the body and sets the brace count anew; the body ends
    where the count is back at 0 on a line ending in a closing brace.
    """

    def count(line, brace):
        return F.length(line) - F.length(F.replace(line, F.lit(brace)))

    def step(state, row):
        line = strip(row["text"])
        opens = line.rlike(r"^for\s")
        inside = state["inside"] & ~opens
        braces = F.when(opens, count(line, "{")).when(
            inside, state["braces"] + count(line, "{") - count(line, "}")).otherwise(state["braces"])
        found = inside & line.contains("defer ") & (braces > 0)
        ends = inside & (braces == 0) & line.endswith("}")
        hit = F.struct(row["line"].alias("line"), F.instr(row["text"], "defer").alias("column_start"),
                       line.alias("matched"), F.lit("").alias("extra"))
        return F.struct((opens | (inside & ~ends)).alias("inside"), braces.alias("braces"),
                        F.when(found, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    rows = F.transform(F.split(text, "\n"),
                       lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("braces"),
                    F.array().cast(f"array<struct<{HIT}>>").alias("hits"))
    return F.aggregate(rows, zero, step, lambda state: state["hits"])


PARSE = r"(?<![\p{L}\p{N}_$.])JSON\.parse[ \t]*+(?=\()"
TRY_TOKENS = (rf"(?:{SKIPPED['javascript']})|\b(?:try|finally|catch\s*+(?:\([^)]*+\))?+)\s*+\{{|[{{}}]|{PARSE}")


def parse_in_try(text: Column) -> Column:
    """For each ``JSON.parse`` call in order, whether a try statement is around it."""

    def step(state, token):
        opens_try = token.rlike(r"^(?:try|catch|finally)")
        opens = opens_try | (token == "{")
        closes = token == "}"
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        # The depths at which open try blocks began, innermost last.
        left = F.filter(state["tries"], lambda d: ~closes | (d < depth + 1))
        tries = F.when(opens_try, F.concat(left, F.array(depth))).otherwise(left)
        flags = F.when(token.startswith("JSON.parse"),
                       F.concat(state["flags"], F.array(F.size(state["tries"]) > 0))).otherwise(state["flags"])
        return F.struct(depth.alias("depth"), tries.alias("tries"), flags.alias("flags"))

    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("tries"),
                    F.array().cast("array<boolean>").alias("flags"))
    tokens = F.regexp_extract_all(text, F.lit(TRY_TOKENS), F.lit(0))
    return F.aggregate(tokens, zero, step, lambda state: state["flags"])
