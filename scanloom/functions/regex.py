"""Regular expressions as columns.

Rules are written in Python's dialect.  ``to_java`` turns them into the dialect
of Spark's regular-expression functions with the same meaning, and ``find_all``
gives every match with its position, which Spark has no function for.

A rule that looks at one line at a time is turned into an expression none of
whose parts can take a newline.  Such an expression finds in the whole text just
what the original finds line by line, so no pack needs the text split in rows.
"""
from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters, digits, spaces as Python's str patterns see them.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r" \t\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Marks put around matches; a text's own marks are read as U+FFFD.
START, END, EXTRA, NEWLINE = "\u0001", "\u0002", "\u0003", "\u0004"

HIT = "line:int,column_start:int,matched:string,extra:string"
FIND = f"{START}$1{END}"
GROUP = 256


def let(value: Column, body) -> Column:
    """Use ``value`` several times in ``body`` and compute it once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- dialect ---------------------------------------------------------------

def _is_word(code: int) -> bool:
    return code < 128 and (chr(code).isalnum() or code == 95)


def _begins_with_word(tree) -> bool:
    """Whether every match of the parsed pattern begins with a letter, a digit or ``_``."""
    for kind, value in tree:
        if kind is sre.LITERAL:
            return _is_word(value)
        if kind is sre.IN:
            return all((k is sre.LITERAL and _is_word(v)) or (k is sre.RANGE and _is_word(v[0]) and _is_word(v[1]))
                       or v in (sre.CATEGORY_DIGIT, sre.CATEGORY_WORD) for k, v in value)
        if kind is sre.SUBPATTERN:
            return _begins_with_word(value[3])
        if kind is sre.BRANCH:
            return all(_begins_with_word(branch) for branch in value[1])
        if kind not in (sre.MAX_REPEAT, sre.MIN_REPEAT) or not _begins_with_word(value[2]):
            return False
        if value[0] > 0:
            return True
    return False


def _boundary(before: str, rest: str) -> str:
    try:
        if _begins_with_word(sre_parser.parse(rest)):
            return f"(?<![{WORD}])"
    except re.error:  # the rest is part of a group
        if re.match(r"\w(?![?*{])", rest, re.A):
            return f"(?<![{WORD}])"
    if re.match(r"\w", before, re.A):
        return f"(?![{WORD}])"
    return f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java_body(pattern: str, by_line: bool = False, shift: int = 0) -> str:
    """``pattern`` without flags in Java's dialect; ``shift`` renumbers back-references."""
    newline = "" if by_line else r"\n"
    classes = {
        "s": f"[{SPACE}{newline}]", "S": rf"[^{SPACE}\n]",
        "w": f"[{WORD}]", "W": f"[^{WORD}" + (r"\n]" if by_line else "]"),
        "d": f"[{DIGIT}]", "D": f"[^{DIGIT}" + (r"\n]" if by_line else "]"),
        "A": r"\A", "Z": r"\z", "v": r"\x0B",
    }
    inside = {"s": SPACE + newline, "w": WORD, "d": DIGIT, "b": r"\x08", "v": r"\x0B"}
    out, i, last = [], 0, ""
    in_class = negated = False
    while i < len(pattern):
        c, two = pattern[i], pattern[i:i + 2]
        step, plain = 1, ""
        if c == "\\":
            e, step = pattern[i + 1], 2
            if in_class:
                if e in "SWD":
                    raise ValueError(f"\\{e} inside a character class is not supported")
                out.append(inside.get(e, two))
            elif e == "b":
                out.append(_boundary(last, pattern[i + 2:]))
            elif e == "B":
                out.append(f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))")
            elif e in "123456789":
                out.append(f"\\{int(e) + shift}")
            else:
                out.append(classes.get(e, two))
        elif in_class:
            if c == "]":
                out.append(r"\n]" if negated and by_line else "]")
                in_class = False
            else:
                out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class, negated = True, pattern[i + 1:i + 2] == "^"
            out.append("[^" if negated else "[")
            step = 2 if negated else 1
            if pattern[i + step:i + step + 1] == "]":
                out.append(r"\]")
                step += 1
        elif c == ".":
            out.append(r"[^\n]")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            step = 4
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4:end]}>")
            step = end - i + 1
        else:
            out.append(c)
            plain = c
        last = plain
        i += step
    return "".join(out)


LEADING_RUN = re.compile(r"\(?(\[(?:\^?\]?)(?:\\.|[^\]\\])*\])(?:\+|\{[1-9]\d*,\})(?!\?)")


def _run_start(pattern: str, by_line: bool) -> str:
    """For a pattern that begins with a run of one class: do not try again inside a run.

    A match that could begin inside a run could begin before, too, unless the
    previous match ends there.  Without this, long runs take quadratic time.
    """
    run = LEADING_RUN.match(pattern)
    if not run:
        return ""
    return f"(?:(?<!{java_body(run.group(1), by_line)})|\\G)"


def _flags(pattern: str, ignore_case: bool) -> tuple[str, bool]:
    if pattern.startswith("(?i)"):
        return pattern[4:], True
    return pattern, ignore_case


def to_java(pattern: str, ignore_case=False, multiline=False, by_line=False) -> str:
    """Python pattern to Java pattern, for ``rlike`` and ``regexp_replace``."""
    pattern, ignore_case = _flags(pattern, ignore_case)
    flags = "d" + ("m" if multiline or by_line else "") + ("iu" if ignore_case else "")
    return f"(?{flags})" + java_body(pattern, by_line)


def to_finder(pattern: str, ignore_case=False, multiline=False, by_line=False) -> str:
    """Like ``to_java``, with the whole match as group 1, for ``find_all``."""
    pattern, ignore_case = _flags(pattern, ignore_case)
    flags = "d" + ("m" if multiline or by_line else "") + ("iu" if ignore_case else "")
    return f"((?{flags})" + _run_start(pattern, by_line) + java_body(pattern, by_line, shift=1) + ")"


def to_replacement(python_replacement: str) -> str:
    r"""A replacement with \1 groups in Java's form."""
    text = re.sub(r"\$", r"\\$", python_replacement)
    return re.sub(r"\\(\d)", r"$\1", text)


# --- words a match must contain ---------------------------------------------

MAX_WORDS = 12
MAX_SETS = 5


def _score(words) -> float:
    return min(len(w) for w in words) - 0.25 * (len(words) - 1)


def _class_letters(items) -> list[str] | None:
    letters = set()
    for kind, value in items:
        if kind is sre.LITERAL and value < 128:
            letters.add(chr(value).lower())
        else:
            return None
    return sorted(letters)


def _word_sets(tree) -> list[list[str]]:
    """Any-of lists of lower-case strings; every match holds one of each list."""
    found, run = [], [""]

    def flush():
        nonlocal run
        if run != [""]:
            found.append(run)
        run = [""]

    for kind, value in tree:
        letters = None
        if kind is sre.LITERAL and value < 128:
            letters = [chr(value).lower()]
        elif kind is sre.IN:
            letters = _class_letters(value)
        if letters and len(run) * len(letters) <= 8:
            run = [a + b for a, b in product(run, letters)]
            continue
        flush()
        if kind is sre.SUBPATTERN:
            found += _word_sets(value[3])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _word_sets(value[2])
        elif kind is sre.BRANCH:
            parts = [_word_sets(branch) for branch in value[1]]
            if all(parts):
                words = sorted({w for part in parts for w in max(part, key=_score)})
                if len(words) <= MAX_WORDS:
                    found.append(words)
    flush()
    return found


def required_words(pattern: str) -> list[list[str]]:
    """Lists of lower-case words; any text matching ``pattern`` holds one word of each list.

    The most telling list comes first.  Empty when the pattern asks for no fixed text.
    """
    sets = sorted({tuple(words) for words in _word_sets(sre_parser.parse(pattern))}, key=lambda w: (-_score(w), w))
    return [list(words) for words in sets[:MAX_SETS]]


def first_letters(pattern: str) -> set[str] | None:
    """The ASCII letters, digits, dots and ``_`` one of which every match begins with; none if it may begin otherwise."""
    def first(tree):
        for kind, value in tree:
            if kind is sre.AT and value is sre.AT_BEGINNING:
                continue
            if kind is sre.LITERAL:
                return {chr(value)} if _is_word(value) or value == 46 else None
            if kind is sre.SUBPATTERN:
                return first(value[3])
            if kind is sre.BRANCH:
                parts = [first(branch) for branch in value[1]]
                return set().union(*parts) if all(parts) else None
            return None
        return None

    return first(sre_parser.parse(pattern))


def fold(text: Column) -> Column:
    """Lower case, with the letters that match ASCII ones when case is ignored."""
    usual = text
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        usual = F.replace(usual, F.lit(odd), F.lit(plain))
    # A text without other letters than ASCII has as many bytes as characters.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(usual))


# --- find all ----------------------------------------------------------------

def clean(text: Column) -> Column:
    has_mark = text.contains(START)
    for mark in (END, EXTRA, NEWLINE):
        has_mark = has_mark | text.contains(mark)
    return F.when(has_mark, F.translate(text, START + END + EXTRA + NEWLINE, "\ufffd" * 4)).otherwise(text)


def _one_line(part: Column) -> Column:
    """Write a match on the line it starts on and keep later positions right."""
    head = F.substring_index(part, END, 1)

    def move(head):
        matched = F.substring_index(head, EXTRA, 1)
        tail = part.substr(F.length(head) + 2, F.length(part))
        newlines = F.length(matched) - F.length(F.replace(matched, F.lit("\n")))
        moved = F.concat(
            F.replace(head, F.lit("\n"), F.lit(NEWLINE)), F.lit(END),
            F.repeat(F.lit("\n"), newlines),
            F.when(newlines > 0, F.repeat(F.lit(" "), F.length(F.substring_index(matched, "\n", -1)))).otherwise(""),
            tail)
        return F.when(head.contains("\n"), moved).otherwise(part)

    return let(head, move)


def _line_hits(line: Column, i: Column) -> Column:
    """The hits of a marked line, the ``i``-th from 0."""
    def hit_of(segment, position):
        """The hit that ``segment`` begins with, at ``position`` characters into the line, and its place in the segment."""
        head = F.substring_index(segment, END, 1)
        matched = F.substring_index(head, EXTRA, 1)
        extra = head.substr(F.length(matched) + 2, F.length(head))
        hit = F.struct((i + 1).alias("line"), (position + 1).alias("column_start"),
                       F.replace(matched, F.lit(NEWLINE), F.lit("\n")).alias("matched"),
                       F.replace(extra, F.lit(NEWLINE), F.lit("\n")).alias("extra"))
        return hit, F.length(head) - F.length(matched)

    def step(acc, segment):
        hit, handed_out = hit_of(segment, acc["position"])
        # What is handed out as extra takes no room, nor does END.
        width = F.length(segment) - 1 - handed_out
        return F.struct((acc["position"] + width).alias("position"),
                        F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def empty(shape):
        return F.array().cast(f"array<{shape}>")

    def fold_group(acc, group):
        part = F.aggregate(group, F.struct(acc["position"].alias("position"), empty(f"struct<{HIT}>").alias("hits")), step)
        return let(part, lambda p: F.struct(p["position"].alias("position"),
                                            F.concat(acc["groups"], F.array(p["hits"])).alias("groups")))

    def run(segments):
        # In groups, as appending to one long array would take quadratic time.
        last = F.floor((F.size(segments) - 2) / GROUP).cast("int")
        groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(segments, g * GROUP + 2, F.lit(GROUP)))
        zero = F.struct(F.length(F.get(segments, F.lit(0))).alias("position"),
                        empty(f"array<struct<{HIT}>>").alias("groups"))
        many = F.flatten(F.aggregate(groups, zero, fold_group, lambda acc: acc["groups"]))
        # Most lines with a hit have one: no fold is needed.
        one = F.array(hit_of(F.get(segments, F.lit(1)), F.length(F.get(segments, F.lit(0))))[0])
        return F.when(F.size(segments) == 2, one).otherwise(many)

    return let(F.split(line, START), run)


def mark(text: Column, finder, replacement=FIND) -> Column:
    """``text`` with marks around every match of ``finder`` (a Java pattern whose group 1 is the match)."""
    finder = F.lit(finder) if isinstance(finder, str) else finder
    replacement = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.regexp_replace(text, finder, replacement)


def settled(marked: Column) -> Column:
    """``marked`` without the marks around nothing, which are text the finder passed over."""
    return F.replace(marked, F.lit(START + EXTRA + END), F.lit(""))


def lines_before(pieces: Column, n: Column, with_extra: Column) -> Column:
    """The lines down to the ``n``-th hit, from 1, of a marked text that falls into ``pieces`` at START; END stays in them.

    What matches hand out as extra is no part of the text before the hit; ``with_extra`` says that they may do so.
    """
    marked = F.array_join(F.slice(pieces, F.lit(1), n), "")
    return F.split(F.when(with_extra, F.regexp_replace(marked, f"{EXTRA}[^{END}]*+", "")).otherwise(marked), "\n")


def hit_at(lines: Column, after: Column) -> Column:
    """The hit that stands before the piece of text ``after`` it, with its :func:`lines_before`, as a struct of HIT."""
    head = F.substring_index(after, END, 1)
    matched = F.substring_index(head, EXTRA, 1)
    return F.struct(F.size(lines).alias("line"), (F.length(F.replace(F.element_at(lines, -1), F.lit(END), F.lit(""))) + 1).alias("column_start"),
                    matched.alias("matched"), head.substr(F.length(matched) + 2, F.length(head)).alias("extra"))


def hits_in(marked: Column, over_lines: Column | bool = True) -> Column:
    """The marked matches in order, as array<struct<HIT>>.

    Lines and columns count from 1, columns in code points.  Text between EXTRA and
    END is handed out as ``extra`` and takes no room in the text; marks around
    nothing are text the finder passed over.
    """

    def hits(marked):
        # Only where a match does go over a line's end are the marked parts written anew.
        if over_lines is False:
            flat = marked
        else:
            goes_over = marked.rlike(f"{START}[^{END}\n]*+\n")
            flow = F.array_join(F.transform(F.split(marked, START), _one_line), START)
            flat = F.when(goes_over if over_lines is True else over_lines & goes_over, flow).otherwise(marked)
        found = F.transform(F.split(flat, "\n"), lambda line, i: F.when(line.contains(START), _line_hits(line, i)))
        return F.when(marked.contains(START), F.flatten(F.array_compact(found))).otherwise(F.array().cast(f"array<struct<{HIT}>>"))

    return let(settled(marked), hits)


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to ``keep`` and each ``hit`` of the column ``hits``.

    A plain explode lets Spark ask for a size above 0 first, down to where the texts are made: the work would be done twice.
    """
    return rows.select(*keep, F.explode_outer("hits").alias("hit")).where(F.col("hit").isNotNull())


def find_all(text: Column, finder, replacement=FIND, over_lines: Column | bool = True) -> Column:
    """Every match of ``finder`` in ``text``, in order; see ``mark`` and ``hits_in``."""
    return hits_in(mark(clean(text), finder, replacement), over_lines)


def count_matches(text: Column, java_pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java_pattern))
