"""The text rules applied one by one with Python's re, to compare the scan with."""
from __future__ import annotations

import re

from scanloom.rules import language_packs as lp
from scanloom.rules import web_packs as wp
from scanloom.rules.pattern_pack import PATTERN_RULES


def wildcard(pattern):
    out = re.escape(pattern)
    for name in (r"\$X", r"\$Y"):
        out = out.replace(name, r"([^\s()]+)")
    return out


def by_line(regex, text, flags=0):
    for number, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(regex, line, flags):
            yield number, m.start() + 1, m.group(0), line


def whole(regex, text, flags=0):
    lines = text.split("\n")
    for m in re.finditer(regex, text, flags):
        number = text.count("\n", 0, m.start()) + 1
        yield number, m.start() - text.rfind("\n", 0, m.start()), m.group(0), lines[number - 1]


def guarded(words, line):
    return any(re.search(w, line, re.I) for w in words)


def findings(path, language, text):
    """{(pack, rule, path, line, matched): column}, one per line for Python and Rust."""
    found = {}

    def add(pack, rule, hit, once=False):
        line, column, matched, _ = hit
        key = (pack, rule, path, line, None if once else matched)
        if key not in found or column < found[key][0]:
            found[key] = (column, matched)

    for rule, lang, _, _, _, patterns in PATTERN_RULES:
        if lang == language:
            for p in patterns:
                for hit in by_line(wildcard(p), text):
                    add("pattern", rule, hit)
    if language == "python":
        for rule, (regex, must, guard) in lp.PYTHON_LINES.items():
            for hit in by_line(regex, text):
                if all(re.search(m, hit[3]) for m in must) and not (guard and guarded(lp.PYTHON_NO_SECRET, hit[3])):
                    add("python", rule, hit, True)
    if language == "rust":
        for rule, (regex, ignore, guard) in lp.RUST_LINES.items():
            for hit in by_line(regex, text, re.I if ignore else 0):
                if not (guard and guarded(lp.RUST_NO_SECRET, hit[3])):
                    add("rust", rule, hit, True)
    if language == "javascript":
        for rule, _, _, regex, _ in wp.JAVASCRIPT_LINES:
            for hit in by_line(regex, text, re.I):
                add("javascript", rule, hit)
        for number, line in enumerate(text.split("\n"), 1):
            literal = re.search(wp.REGEX_LITERAL, line)
            if literal and any(re.search(p, line) for p in wp.NESTED_QUANTIFIERS):
                add("javascript", "JS-REGEX-001", (number, literal.start() + 1, literal.group(0), line))
        for regex in wp.JAVASCRIPT_SECRETS:
            for hit in whole(regex, text, re.I):
                add("javascript", "JS-HARDCODED-SECRET", hit)
    if language == "go":
        for rule, _, _, regex in lp.GO_RULES:
            for hit in whole(regex, text, re.I | re.M):
                add("go", rule, hit)
        for rule, _, regex, _ in lp.GO_SECRETS:
            for hit in whole(regex, text, re.I):
                add("go", rule, hit)
    for rule, _, _, regex, _, _ in wp.GENERIC:
        for hit in whole(regex, text, re.I):
            add("generic", rule, hit)
    return {(k[0], k[1], k[2], k[3], column, matched) for k, (column, matched) in found.items()}
