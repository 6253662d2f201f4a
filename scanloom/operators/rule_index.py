"""Scans with very many rules: an inverted index of the words their patterns cannot match without.

Rules stay a table. Tasks check them and work out required words; each pattern is entered under pieces of words, of which
any text it matches holds one inside a word of its own. Three joins on equal keys lead from texts to candidate patterns:

1. the different words of all texts, cut into parts where some piece may begin, meet the pieces that are equal to a part;
2. the words of each text meet those words;
3. the pieces found meet their patterns.

Only candidate pairs of text and pattern run a regular expression, so time grows with hits rather than with rules. Patterns
without a piece of ``GRAM`` letters meet every text of their language. Nothing of the rules or texts is collected; rules are
broadcast up to ``TABLE_BYTES`` as measured, else both sides of a join are dealt by its key.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.regex import FIND, WORD, clean, fold
from ..functions.severity import SEVERITY_RANK
from ..rules.catalog import ANY_LANGUAGE, FILE, LINE, RULE_COLUMNS, RULE_SCHEMA, check_rules
from ..session import send_package

GRAM = 3
#: Letters of a piece at most. Words are read in stretches of ``STRETCH`` letters that overlap by as many.
PIECE = 16
STRETCH = 64
WORDS = rf"(?=([{WORD}]{{1,{STRETCH}}}))[{WORD}]{{1,{STRETCH - PIECE}}}"
#: Patterns without a piece are dealt to so many parts of the texts.
SALT = 64
#: Rules are broadcast up to so many bytes, as JSON.
TABLE_BYTES = 8 << 20


def check_rule_table(written: DataFrame) -> DataFrame:
    """Rules a user wrote, one a row with the fields that ``check_rules`` takes, as rows of the rule table.

    Refused rules and patterns are rows of their own with a ``problem`` and no pack.
    """
    send_package(written.sparkSession)
    schema = StructType([*StructType.fromDDL(RULE_SCHEMA).fields, StructField("problem", StringType())])
    arrow = to_arrow_schema(schema)
    parts = ["source", "finder", "words"]

    def run(batches):
        for batch in batches:
            out = []
            for rule in batch.to_pylist():
                rows, errors = check_rules([{k: v for k, v in rule.items() if v is not None}])
                for row in rows:
                    fields = dict(zip(RULE_COLUMNS, row))
                    out.append({**fields, "patterns": [dict(zip(parts, p)) for p in fields["patterns"]], "problem": None})
                out += [{**dict.fromkeys(RULE_COLUMNS), "rule_id": rule_id, "problem": problem} for rule_id, problem in errors]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return written.mapInArrow(run, schema)


def pattern_table(rules: DataFrame, threshold: str = "info") -> DataFrame:
    """One row per pattern of the rules that are switched on and severe enough, as the scan's matching step takes them."""
    least = SEVERITY_RANK.get(threshold, 0)
    chosen = rules.where(F.col("enabled") & F.col("implemented") & (F.col("sev_rank") >= least) & F.col("scope").isin(LINE, FILE))
    rows = chosen.select("rule_id", "pack", F.col("language").alias("rule_language"), "scope", "once", "must", "guard", "context",
                         F.explode("patterns").alias("p"))
    fields = F.struct("rule_id", "pack", "rule_language", "scope", "once", "must", "guard", "context", "p.finder", "p.words")
    # One struct, whatever of it is read later: the rules are checked and shuffled once for all their uses.
    once = rows.select(F.xxhash64("pack", "rule_id", "rule_language", "p.finder").alias("pattern_id"), fields.alias("fields"))
    return once.groupBy("pattern_id").agg(F.first("fields").alias("fields")).select(
        "pattern_id", "fields.*", F.lit(FIND).alias("replacement"), F.lit(None).cast("array<string>").alias("names"))


def table_sizes(own: Column) -> list[Column]:
    """Aggregates over a rule table: the number of rules for which ``own`` holds, their bytes, and the bytes of those with a pattern without a piece."""
    size = F.octet_length(F.to_json(F.struct(*RULE_COLUMNS)))
    loose = F.exists("patterns", lambda p: pieces_of(p["words"]).isNull())
    return [F.count_if(own).alias("rules"), F.coalesce(F.sum(F.when(own, size)), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(F.when(own & loose, size)), F.lit(0)).alias("loose_bytes")]


def to_meet(table: DataFrame, size: int) -> DataFrame:
    """``table``, made of ``size`` bytes of rules, to be joined: broadcast if that is little, else both sides are dealt by the key.

    Spark's own guess is the size of the file that rules are made of. It may be a hundredth of the rules, and a broadcast once planned is
    not taken back when the real size is known, as that would take more shuffles.
    """
    return F.broadcast(table) if size <= TABLE_BYTES else table.hint("merge")


def _longest(word: Column) -> Column:
    """The longest piece of letters in a required string."""
    runs = F.regexp_extract_all(word, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.aggregate(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)).substr(1, PIECE)


def pieces_of(words: Column) -> Column:
    """Pieces of which a match holds at least one, from any-of lists of required strings; null if there are none long enough."""
    lists = F.transform(words, lambda some: F.array_distinct(F.transform(some, _longest)))
    scored = F.transform(lists, lambda some: F.struct(
        (F.array_min(F.transform(some, F.length)) - 0.25 * F.size(some)).alias("score"), some.alias("pieces")))
    usable = F.filter(scored, lambda s: F.forall(s["pieces"], lambda p: F.length(p) >= GRAM) & (F.size(s["pieces"]) > 0))
    return F.array_max(usable)["pieces"]


def grams_of(word: Column) -> Column:
    """All stretches of ``GRAM`` letters of a word that long, with their place."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - GRAM + 1), lambda i: F.struct(i.alias("place"), word.substr(i, F.lit(GRAM)).alias("gram")))


def parts_at(word: Column, place: Column, lengths: Column) -> Column:
    """The parts of a word from ``place`` on that have one of ``lengths``."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(word) - place + 1), lambda n: word.substr(place, n))


def words_of(texts: DataFrame) -> DataFrame:
    """(path, word): the different words of each text, long ones in overlapping stretches."""
    return texts.select("path", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("text")), F.lit(WORDS), F.lit(1)))).alias("word"))


def words_with_pieces(words: DataFrame, pieces: DataFrame, size: int = TABLE_BYTES + 1) -> DataFrame:
    """(word, piece) for all pieces, of ``size`` bytes of rules, inside the different words of ``words``.

    Where a word has the letters that some pieces begin with, it is cut into parts of these pieces' lengths, at most ``PIECE`` of them, and a
    part is a piece or not: a row meets only what it holds. Pieces that share much with each other, such as numbered names, cost no more
    than others. Beginnings are broadcast: pieces are made of 37 letters, so there are 37 ** ``GRAM`` at most.
    """
    own = pieces.select("piece").distinct()
    begins = own.groupBy(F.substring("piece", 1, GRAM).alias("gram")).agg(F.array_sort(F.collect_set(F.length("piece"))).alias("lengths"))
    places = words.select("word").distinct().where(F.length("word") >= GRAM).select("word", F.inline(grams_of(F.col("word"))))
    cut = (places.join(F.broadcast(begins), "gram")
           .select("word", F.explode(parts_at(F.col("word"), F.col("place"), F.col("lengths"))).alias("piece")).distinct())
    return cut.join(to_meet(own, size), "piece").select("word", "piece")


def candidates(texts: DataFrame, patterns: DataFrame, size: int = TABLE_BYTES + 1) -> DataFrame:
    """(path, pattern columns): what may match, by the index, of patterns from ``size`` bytes of rules.

    A pattern that asks for one of several pieces comes once for each of them that a text holds; findings are told apart later.
    """
    entered = patterns.select(F.explode(pieces_of(F.col("words"))).alias("piece"), *(c for c in patterns.columns if c != "words"))
    words = words_of(texts)
    found = words.hint("merge").join(words_with_pieces(words, entered, size), "word").select("path", "piece").distinct()
    return found.join(to_meet(entered, size), "piece").drop("piece")


def indexed_hits(texts: DataFrame, rules: DataFrame, threshold: str = "info", width: int | None = None, size: int = TABLE_BYTES + 1,
                 loose_size: int = TABLE_BYTES + 1) -> DataFrame:
    """path, language, pack, rule_id and hit of the rule table's patterns in ``texts``; the sizes as ``table_sizes`` gives them."""
    from .scan import pair_hits

    patterns = pattern_table(rules, threshold)
    of_language = F.col("rule_language").isin(F.lit(ANY_LANGUAGE), F.col("language"))
    plain = texts.select("path", "language", "text")
    columns = ["path", "language", "text", *(c for c in patterns.columns if c not in ("pattern_id", "words"))]
    pairs = plain.hint("merge").join(candidates(texts, patterns, size), "path").where(of_language).select(columns)
    if loose_size:
        rest = patterns.where(pieces_of(F.col("words")).isNull())
        keys = F.array_distinct(F.array(F.lit(ANY_LANGUAGE), F.coalesce("language", F.lit(ANY_LANGUAGE))))
        keyed, on = plain.select("*", F.explode(keys).alias("rule_language")), ["rule_language"]
        if loose_size > TABLE_BYTES:
            keyed, on = keyed.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")), ["rule_language", "salt"]
            rest = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        pairs = pairs.unionByName(keyed.join(to_meet(rest, loose_size), on).select(columns))
    return pair_hits(pairs.withColumn("text", clean(F.col("text"))), "path", "language", "pack", "rule_id", width=width)
