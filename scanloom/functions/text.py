"""Text: decoding, cutting, masking, snippets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
#: What every line end holds.
LINE_END = LINE_ENDS.removeprefix(r"\r\n|")
BLANKS = " \t\r\n\x0b\x0c"
REDACTED = "***REDACTED***"


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,192 bytes."""
    return F.coalesce(F.position(F.lit(bytearray(b"\x00")), F.substring(content, 1, 8192)) > 0, F.lit(True))


def decode_bytes(content: Column) -> tuple[Column, Column]:
    """(text, encoding): UTF-8 where valid, else Latin-1; line ends become newlines."""
    as_utf8 = content.cast("string")
    valid = F.is_valid_utf8(as_utf8)
    text = F.when(valid, as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    text = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return text, F.when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


def truncate_lines(code: Column, max_lines: int = 10) -> Column:
    """The first lines and ``...``; any line end counts, a last empty line does not."""

    def cut(lines):
        count = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
        return F.when(count <= max_lines, code).otherwise(
            F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n...")))

    longer = let(F.split(code, LINE_ENDS), cut)
    # Most snippets are one line: a search for a line's end costs less than to part them.
    return F.when(~code.rlike(LINE_END), code).otherwise(longer) if max_lines > 0 else longer


def sanitize_lines(code: Column, max_lines: int = 5) -> Column:
    """The first lines and a ``...`` line; only newlines count."""
    return let(F.split(code, "\n"), lambda lines: F.when(F.size(lines) <= max_lines, code).otherwise(
        F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n..."))))


def truncate_string(text: Column, max_length: int = 100) -> Column:
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, max_length - 3), F.lit("...")))


def shown_part(line: Column, column: Column, width: int | None) -> Column:
    """The line; with a ``width``, of a longer one the stretch of that many characters ``column`` is in and the next."""
    if width is None:
        return line
    begin = F.floor((column - 1) / width).cast("int") * width + 1
    return F.when(F.length(line) <= width, line).otherwise(line.substr(begin, F.lit(2 * width)))


def snippet(lines: Column, line: Column, around: Column, own: Column, width: int | None) -> Column:
    """The lines from ``around`` before to ``around`` after; ``own`` stands for the line itself.

    With a ``width``, its neighbours are shown up to that many characters.
    """
    first = F.greatest(line - around, F.lit(1))
    near = F.slice(lines, first, line + around - first + 1)
    return F.array_join(F.transform(near, lambda other, i: F.when(first + i == line, own).otherwise(
        other if width is None else F.substring(other, 1, width))), "\n")


def mask(text: Column, matched: Column, kind: Column) -> Column:
    """Hide the secret in ``text``; ``kind`` is the rule's way of masking."""
    assigned = F.regexp_replace(text, r"""[=:]\s*["'][^"']{8,}["']""", f'= "{REDACTED}"')
    backquoted = F.regexp_replace(text, r"""["`][^"`]+["`]""", f"`{REDACTED}`")
    quoted = F.regexp_replace(text, r"""["'`][^"'`]+["'`]""", f'"{REDACTED}"')
    dsn = F.regexp_replace(text, r":[^@]+@", ":***@")

    # Where the usual way leaves the match readable, the match itself is hidden.
    def sure(masked, with_quotes):
        left = masked.contains(matched) & (F.length(matched) > 0)
        if with_quotes:
            left = left & (masked == text)
        return F.when(left, F.replace(masked, matched, F.lit(REDACTED))).otherwise(masked)

    return (F.when(kind == "assigned", let(assigned, lambda m: sure(m, True)))
            .when(kind == "backquote", let(backquoted, lambda m: sure(m, False)))
            .when(kind == "quoted", let(quoted, lambda m: sure(m, False)))
            .when(kind == "dsn", let(dsn, lambda m: sure(m, False)))
            .when(kind == "whole", F.replace(text, matched, F.lit(REDACTED)))
            .otherwise(text))
