"""The scan: a table of texts against a table of rules gives a table of findings.

Plan, with one read of the texts: they are joined with the broadcast patterns on
the language; the join's further condition asks for the words the pattern cannot
match without, so most (text, pattern) pairs end there at the price of a
substring search.  For the pairs left, one expression finds all matches with
positions, applies the rule's line conditions and cuts the snippet.  The rules on
calls, assignments and loops go the same way: what finds the facts is a pattern
too, and a CASE over the fact says which rules it breaks.  Only hits are
shuffled, to drop duplicates, after a partial aggregate in each task.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import FIND, START, clean, exploded, fold, hit_at, hits_in, let, lines_before, mark, settled
from ..functions.severity import SEVERITY_RANK
from ..functions.text import mask, shown_part, snippet, strip
from ..rules.catalog import ANY_LANGUAGE, FILE, LINE, RULE_COLUMNS, builtin_rules
from .detectors import ASSIGNMENT, CALL, CALL_RULES, DEFER, PARSE, fact_patterns, with_fact_rules
from .facts import defer_in_loop, dress, parse_in_try, with_deep_arguments
from .fixes import line_fix, template_fix
from .rule_index import indexed_hits, table_sizes, to_meet

# Patterns are broadcast up to this many bytes at a time; a larger rule table is
# worked through in parts, each of which reads the texts again.
PATTERN_BYTES = 64 << 20

# So many hits of a pattern in a text become rows of their own, each with the text.
FEW = 16

# Packs that report a rule once per line; the others report each different match.
ONCE_A_LINE = ("python", "rust")
RULE_FIELDS = ["name", "severity", "sev_rank", "message", "category", "cwe", "remediation", "auto_fixable",
               "fix_template", "mask"]
FINDING_COLUMNS = ["finding_id", "rule_id", "pack", "name", "severity", "sev_rank", "language", "path", "line",
                   "column_start", "column_end", "matched_code", "snippet", "message", "category", "cwe",
                   "remediation", "auto_fixable", "fixed_code", "mask"]
PATTERN_SCHEMA = """rule_id string, pack string, rule_language string, scope string, once boolean,
must array<string>, guard string, context int, finder string, words array<array<string>>, replacement string,
names array<string>"""
KNOWN_SCHEMA = """known_pack string, known_id string, known_language string, name string, severity string,
sev_rank int, message string, category string, cwe string, remediation string, auto_fixable boolean,
fix_template string, mask string"""


def active(rows, threshold: str = "info", packs=None) -> list[dict]:
    """Rules that can match, are switched on, in ``packs`` and at least as severe as ``threshold``."""
    least = SEVERITY_RANK.get(threshold, 0)
    rules = [dict(zip(RULE_COLUMNS, row)) for row in rows]
    return [r for r in rules if r["enabled"] and r["implemented"] and r["sev_rank"] >= least
            and (packs is None or r["pack"] in packs)]


def pattern_rows(rules: list[dict], facts: bool = True) -> list[tuple]:
    """One row per pattern to look for, from the rules and from the ways to find facts."""
    rows = [
        (r["rule_id"], r["pack"], r["language"], r["scope"], r["once"], r["must"], r["guard"], r["context"],
         finder, words, FIND, None)
        for r in rules if r["scope"] in (LINE, FILE) for _, finder, words in r["patterns"]]
    packs = {r["pack"] for r in rules} & set(CALL_RULES) if facts else ()
    return rows + [
        (None, pack, language, scope, False, [], None, context, finder, words, replacement, names)
        for pack, language, scope, finder, replacement, words, names, context in fact_patterns() if pack in packs]


def text_hits(text: Column, marked: Column, lines: Column, width: int | None = None) -> Column:
    """Hits of the joined pattern, which are ``marked`` in ``text``, that pass its conditions; any number and kind."""
    scope = F.col("scope")
    found = F.when(scope == DEFER, defer_in_loop(text)).otherwise(hits_in(marked, over_lines=scope != LINE))

    def named(hit):
        return F.col("names").isNull() | F.exists("names", lambda name: F.lower(hit["matched"]).contains(name))

    def passing(hits):
        in_try = F.when(scope == PARSE, parse_in_try(text)).otherwise(F.array().cast("array<boolean>"))

        def choose(both):
            def keep(hit, i):
                own = F.get(both["lines"], hit["line"] - 1)
                first = ~F.col("once") | (i == 0) | (F.get(hits, i - 1)["line"] != hit["line"])
                guarded = F.coalesce(F.regexp_like(own, F.col("guard")), F.lit(False))
                safe = F.coalesce(F.get(both["in_try"], i), F.lit(False))
                return first & ~guarded & ~safe & F.forall("must", lambda m: F.regexp_like(own, m))

            free = ~F.col("once") & F.col("guard").isNull() & (F.size("must") == 0) & (scope != PARSE)
            kept = F.when(free, hits).otherwise(F.filter(hits, keep))
            called = F.when(scope == CALL, F.transform(kept, lambda hit: with_deep_arguments(hit, both["lines"]))).otherwise(kept)
            return dress(called, both["lines"], F.col("context"), width, begins=False)

        both = F.struct(lines.alias("lines"), in_try.alias("in_try"))
        return F.when(F.size(hits) > 0, let(both, choose))

    exact = F.filter(found, lambda h: (scope != PARSE) | (h["matched"] == "JSON.parse"))
    return let(F.when(F.col("names").isNull(), found).otherwise(F.filter(exact, named)), passing)


def single_hit(one: Column, own: Column, lines: Column, width: int | None = None) -> Column:
    """``one``, a hit on the line ``own``, as :func:`text_hits` gives it."""
    part = shown_part(own, one["column_start"], width)
    first = F.greatest(one["line"] - F.col("context"), F.lit(1))
    near = F.array_join(F.slice(lines, first, one["line"] + F.col("context") - first + 1), "\n")
    near = near if width is None else snippet(lines, one["line"], F.col("context"), part, width)
    shown = F.when(F.col("context") < 0, one["matched"]).when(F.col("context") == 0, strip(part)).otherwise(near)
    return F.struct(one["line"], one["column_start"], one["matched"], one["extra"], own.alias("own_line"), shown.alias("snippet"))


def single_passes(one: Column, own: Column, new_line: Column) -> Column:
    """Whether the hit ``one`` on the line ``own`` passes the pattern's conditions; ``new_line`` says that the hit before is on another line."""
    named = F.col("names").isNull() | let(F.lower(one["matched"]), lambda low: F.exists("names", lambda name: low.contains(name)))
    guarded = F.col("guard").isNotNull() & F.coalesce(F.regexp_like(own, F.col("guard")), F.lit(False))
    must = (F.size("must") == 0) | F.forall("must", lambda m: F.regexp_like(own, m))
    return named & (~F.col("once") | new_line) & ~guarded & must


def pair_hits(pairs: DataFrame, *keep: str, width: int | None = None) -> DataFrame:
    """The columns to ``keep`` and ``hit`` of texts joined with patterns.

    Step by step, each a column of its own: most pairs that get here have no match or few. These become a row each, which plain
    functions read, and Spark compiles these where they stand outside of lambdas and generators. Of many, a row each would have the
    text many times: these are folded.
    """
    scope, lines, one = F.col("scope"), F.col("lines"), F.col("one")
    conditions = ["scope", "once", "must", "guard", "context", "names"]
    needed = list(dict.fromkeys([*keep, *conditions, "text"]))
    marked = pairs.select(*needed, F.when(scope != DEFER, mark(F.col("text"), F.col("finder"), F.col("replacement"))).alias("marked"))
    # Rules' own patterns leave no marks around nothing.
    marked = marked.withColumn("marked", F.when(scope.isin(LINE, FILE), F.col("marked")).otherwise(settled(F.col("marked"))))
    parted = marked.select("*", F.split("marked", START).alias("pieces"))
    number = F.coalesce(F.size("pieces") - 1, F.lit(0))
    few = (number > 0) & (number <= FEW) & scope.isin(LINE, FILE, CALL, ASSIGNMENT)
    counted = parted.select("*", F.when((number > 0) | (scope == DEFER), F.split("text", "\n")).alias("lines"), F.when(few, number).alias("few"))
    many = F.col("few").isNull()
    carried = [c for c in needed if c != "text"] + ["lines", F.when(many, F.col("text")).alias("text"), F.when(many, F.col("marked")).alias("marked"), "pieces"]
    each = counted.select(*carried, F.explode_outer(F.when(F.col("few").isNotNull(), F.sequence(F.lit(1), F.col("few")))).alias("n"))
    begun = each.select("*", F.when(F.col("n").isNotNull(), lines_before(F.col("pieces"), F.col("n"), scope.isin(CALL, ASSIGNMENT))).alias("before"))
    read = begun.select("*", F.when(F.col("n").isNotNull(), hit_at(F.col("before"), F.get("pieces", F.col("n")))).alias("one"))
    owned = read.select("*", F.get(lines, one["line"] - 1).alias("own"), ((F.col("n") == 1) | F.get("pieces", F.col("n") - 1).contains("\n")).alias("new_line"))
    passing = owned.select("*", F.when(one.isNotNull(), single_passes(one, F.col("own"), F.col("new_line"))).alias("passes"))
    called = F.when(scope == CALL, with_deep_arguments(one, lines)).otherwise(one)
    full = passing.withColumn("one", F.when(F.col("passes"), called))
    hits = F.when(one.isNotNull(), F.array(single_hit(one, F.col("own"), lines, width))).when(
        F.col("n").isNull() & lines.isNotNull(), text_hits(F.col("text"), F.col("marked"), lines, width))
    return exploded(full.select(*keep, hits.alias("hits")), *keep)


def hits_of(texts: DataFrame, rules: list[dict], facts: bool = True, keep=(), width: int | None = None) -> DataFrame:
    """path, language, pack, rule_id and hit of ``rules`` in ``texts``, with the columns to ``keep``."""
    parts = pattern_parts(pattern_rows(rules, facts))
    return reduce(DataFrame.unionByName, [_part_hits(texts, rows, facts, keep, width) for rows in parts])


def pattern_parts(rows: list[tuple]) -> list[list[tuple]]:
    """The rows in parts small enough to broadcast."""
    parts, size = [[]], 0
    for row in rows:
        own = len(repr(row)) * 2
        if parts[-1] and size + own > PATTERN_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += own
    return parts


def _part_hits(texts: DataFrame, rows: list[tuple], facts: bool, keep, width: int | None) -> DataFrame:
    spark = texts.sparkSession
    patterns = spark.createDataFrame(rows, PATTERN_SCHEMA)
    known = sorted({row[2] for row in rows})
    keys = F.array_intersect(F.array(F.lit(ANY_LANGUAGE), F.coalesce("language", F.lit(ANY_LANGUAGE))),
                             F.array(*[F.lit(k) for k in known]).cast("array<string>"))
    keyed = (texts.select("path", "language", clean(F.col("text")).alias("text"), *keep,
                          fold(F.col("text")).alias("folded"), keys.alias("keys"))
             .select("path", "language", "text", *keep, "folded", F.explode("keys").alias("text_language")))
    may_match = F.forall("words", lambda some: F.exists(some, lambda word: F.col("folded").contains(word)))
    pairs = keyed.join(F.broadcast(patterns), (F.col("text_language") == F.col("rule_language")) & may_match)
    hits = pair_hits(pairs, "path", "language", *keep, "pack", "rule_id", "scope", width=width)
    return with_fact_rules(hits, keep) if facts else hits.drop("scope")


def keyed_hits(hits: DataFrame, keep=()) -> DataFrame:
    """Hits as plain columns, with the key that tells findings apart."""
    hit = F.col("hit")
    code = F.when(F.col("pack").isin(*ONCE_A_LINE), F.lit("")).otherwise(hit["matched"])
    return hits.select(
        F.md5(F.concat_ws(":", "rule_id", "path", hit["line"], code)).alias("finding_id"),
        "rule_id", "pack", "language", "path", *keep, hit["line"].alias("line"),
        hit["column_start"].alias("column_start"),
        (hit["column_start"] + F.length(hit["matched"])).alias("column_end"),
        hit["matched"].alias("matched_code"), hit["snippet"].alias("snippet"),
        line_fix(F.col("rule_id"), hit["own_line"]).alias("fixed_code"))


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding per rule, path, line and matched code (or per line): the first in the line.

    ``finding_id`` stands for that key; the aggregate is partial before the shuffle. Texts that come
    dealt by path need no shuffle.
    """
    keys, order = ["finding_id", "path"], ["column_start", "column_end", "matched_code", "pack"]
    rest = [c for c in findings.columns if c not in order + keys]
    return (findings.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
            .select(*[c if c in keys else F.col(f"first.{c}").alias(c) for c in findings.columns]))


def with_rules(hits: DataFrame, rules: list[dict], keep=()) -> DataFrame:
    """Add the rule's fields; a rule id can stand in several packs and languages."""
    rows = [(r["pack"], r["rule_id"], r["language"], *[r[f] for f in RULE_FIELDS]) for r in rules]
    known = hits.sparkSession.createDataFrame(rows, KNOWN_SCHEMA)
    return with_known(hits, F.broadcast(known) if len(repr(rows)) * 2 <= PATTERN_BYTES else known, keep)


def known_fields(rules: DataFrame) -> DataFrame:
    """A rule table's fields for :func:`with_known`."""
    return rules.select(F.col("pack").alias("known_pack"), F.col("rule_id").alias("known_id"), F.col("language").alias("known_language"), *RULE_FIELDS)


def with_known(hits: DataFrame, known: DataFrame, keep=()) -> DataFrame:
    """Add the fields of a table of rules."""
    same = ((F.col("pack") == F.col("known_pack")) & (F.col("rule_id") == F.col("known_id"))
            & F.col("known_language").isin(F.lit(ANY_LANGUAGE), F.col("language")))
    joined = hits.join(known, same)
    return joined.withColumn("fixed_code", F.coalesce(
        "fixed_code", template_fix(F.col("fix_template"), F.col("matched_code")))).select(*FINDING_COLUMNS, *keep)


def hide_secrets(findings: DataFrame) -> DataFrame:
    """Mask what secret rules found, in the match and in the snippet."""
    code, kind = F.col("matched_code"), F.col("mask")
    # One after the other: inside a lambda, a column named in the same select may mean the new one.
    return (findings.withColumn("snippet", F.when(kind != "", mask(F.col("snippet"), code, kind))
                                .otherwise(F.col("snippet")))
            .withColumn("matched_code", F.when(kind != "", mask(code, code, kind)).otherwise(code))
            .drop("mask"))


def active_rules(rules, threshold: str, packs=None) -> list[dict]:
    """The active ones of a rule table, of rows of one, or of the shipped rules."""
    if isinstance(rules, DataFrame):
        rules = rules.select(*RULE_COLUMNS).collect()
    return active(builtin_rules() if rules is None else rules, threshold, packs)


def parted_rules(rules: DataFrame, threshold: str, packs=None) -> tuple[list[dict], DataFrame, Row]:
    """Of a rule table, by one pass: the active shipped rules, the user's own, and the sizes of these (see ``table_sizes``).

    The user's own may be any number and stay a table.
    """
    custom = F.coalesce("is_custom", F.lit(False))
    chosen = custom if packs is None else custom & F.col("pack").isin(*packs)
    shipped = F.collect_list(F.when(~custom, F.struct(*RULE_COLUMNS))).alias("shipped")
    measured = rules.agg(shipped, *table_sizes(chosen)).first()
    return active(measured.shipped, threshold, packs), rules.where(chosen), measured


def scan(texts: DataFrame, rules=None, packs=None, threshold: str = "medium", facts: bool = True, masked: bool = True,
         scan_id: str | None = None, width: int | None = None) -> DataFrame:
    """Findings of ``rules`` (all shipped ones by default) in ``texts``.

    ``texts`` has ``path``, ``language`` and ``text``; ``rules`` is a rule table or
    rows of one.  ``facts`` adds the rules on calls, assignments and loops.  A ``width``
    shortens longer lines in snippets, which minified files need: there, each of
    thousands of findings would show the whole file.  Matches and fixes are whole anyway.
    """
    table = isinstance(rules, DataFrame)
    chosen, own, sizes = parted_rules(rules, threshold, packs) if table else (active_rules(rules, threshold, packs), None, None)
    if table and sizes.rules:
        hits, known = indexed_hits(texts, own, threshold, width, sizes.bytes, sizes.loose_bytes), known_fields(own)
        if chosen:
            hits = hits.unionByName(hits_of(texts, chosen, facts, width=width))
            known = known.unionByName(known_fields(rules.where(~F.coalesce("is_custom", F.lit(False)))))
        findings = with_known(dedupe(keyed_hits(hits)), to_meet(known, sizes.bytes))
    elif chosen:
        findings = with_rules(dedupe(keyed_hits(hits_of(texts, chosen, facts, width=width))), chosen)
    else:
        findings = no_findings(texts.sparkSession)
    findings = hide_secrets(findings) if masked else findings.drop("mask")
    return findings.withColumn("scan_id", F.lit(scan_id)) if scan_id else findings


def no_findings(spark: SparkSession) -> DataFrame:
    numbers = {"sev_rank": "int", "line": "int", "column_start": "int", "column_end": "int", "auto_fixable": "boolean"}
    return spark.createDataFrame([], ", ".join(f"{c} {numbers.get(c, 'string')}" for c in FINDING_COLUMNS))


def scan_code(spark: SparkSession, code: str, language: str = "auto", **options) -> DataFrame:
    """Scan one snippet."""
    from ..functions.language import guess_language

    texts = spark.createDataFrame([("<inline>", code)], "path string, text string")
    chosen = guess_language(F.col("text")) if language == "auto" else F.lit(language)
    return scan(texts.withColumn("language", chosen), **options)
