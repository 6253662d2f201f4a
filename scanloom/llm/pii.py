"""Personal data: pattern matches, and a skip-chain conditional random field that adds to them.

The patterns give the base spans. The tokens of the field are the runs without white space
that hold a digit or an ``@``; all others are outside for certain. Neighbouring tokens share a
chain potential, tokens that are the same or similar (equal text without outer marks, equal
digits, equal last seven digits, equal part before the ``@``) a skip potential; each token is
linked to the next similar one, so a document has at most one skip link per token and
notion of similarity, however often a token repeats. Loopy message passing, until no message
changes, makes the labels of a document agree at any distance; a token that ends up with a kind, outside the base spans, is an added
span. Base spans stay as they are.

Weights are fitted by pseudo-likelihood on the whole corpus with the base spans as labels: Spark
counts equal (features, neighbour labels, label) patterns, and the driver gets one row per
pattern. A pattern consists of the values below, so their number has a bound
whatever the corpus.

Defined results: null counts as an empty text, which has no spans; documents without an id and
repeated documents are worked row by row. Without a pattern of personal data in the corpus
nothing is added.
"""
from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .words import slices

#: The kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
OUTER = " \t.,;:!?\"'()[]{}<>*#$%&"
LABELS = len(KINDS) + 1
#: Messages are settled when they change by less. After so many turns of its own, a message's steps shrink by a factor each.
TOLERANCE = 1e-7
ROUNDS = 200
FADE = 0.95
#: The prior mean of a skip potential between two tokens of one kind; the corpus may have few repeats to learn from.
AGREE = 3.0
#: An added token's probability of its kind, at least.
SURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the address pattern, each ``@`` looked at once."""
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match that passes its test, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                    if all(len(x.lstrip("0")) <= 3 and int(x[-3:] if not x[:-3].strip("0") else "999") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


class Tokens(NamedTuple):
    """Tokens of one document: places, feature numbers, chain links (i, i + 1) and skip links."""
    start: list
    end: list
    features: list
    chain: list
    skips: list


#: Feature columns: name and number of values.
SHAPES = [("marks", 32), ("digits", 8), ("letters", 4), ("length", 5), ("before", 3)]


def _shape(word: str, before: str) -> tuple[int, ...]:
    digits = sum(map(str.isdigit, word))
    letters = sum(map(str.isalpha, word))
    marks = sum(1 << i for i, mark in enumerate("@.-+(") if mark in word)
    many = 0 if digits < 1 else 1 if digits < 4 else 2 if digits < 7 else 3 if digits < 10 else 4 if digits < 14 else 5 if digits < 20 else 6
    before = 0 if not before else 1 if before[-1] in ":=" else 2
    return (marks, many, 0 if not letters else 1 if letters < digits else 2 if digits else 3,
            min(4, len(word) // 6), before)


def tokens(text: str) -> Tokens:
    start, end, shapes, links, skips = [], [], [], [], []
    last: dict[tuple, int] = {}
    for at, match in enumerate(TOKEN.finditer(text)):
        raw = match[0]
        word = raw.strip(OUTER) or raw
        begin = match.start() + raw.find(word)
        if at and not text[match_end: match.start()].strip():
            links.append(at - 1)
        match_end = match.end()
        start.append(begin)
        end.append(begin + len(word))
        shapes.append(_shape(word, text[max(0, begin - 1): begin].strip() or (text[max(0, match.start() - 2): match.start()].strip())))
        digits = "".join(c for c in word if c in "0123456789")
        similar = {("same", word.lower())}
        if len(digits) >= 7:
            similar |= {("digits", digits), ("last", digits[-7:])}
        if "@" in word:
            similar.add(("local", word.partition("@")[0].lower()))
        near = {last[k] for k in similar if k in last}
        skips += [(x, at) for x in sorted(near)]
        for key in similar:
            last[key] = at
    return Tokens(start, end, shapes, links, skips)


def silver(found: Tokens, spans: list[tuple[int, int, int]]) -> list[int]:
    """Each token's label from the base spans it touches, the first of them."""
    out, at = [], 0
    for begin, end in zip(found.start, found.end):
        while at < len(spans) and spans[at][2] <= begin:
            at += 1
        out.append(next((kind + 1 for a, kind, b in spans[at:at + LABELS] if a < end and b > begin), 0))
    return out


OFFSETS = np.cumsum([0, *(n for _, n in SHAPES)])
WIDTH = int(OFFSETS[-1])


class Field(NamedTuple):
    """Weights: node (features x labels, and a bias row), chain and skip potentials (labels x labels)."""
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _design(shapes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(shapes), WIDTH + 1))
    rows = np.arange(len(shapes))
    for column in range(len(SHAPES)):
        out[rows, OFFSETS[column] + shapes[:, column]] = 1
    out[:, -1] = 1
    return out


def fit_patterns(patterns: list[tuple], steps: int = 300, penalty: float = 1.0) -> Field | None:
    """Weights from counted patterns: (shape values..., left, right, skip label, label, count); -1 is no neighbour."""
    if not patterns:
        return None
    table = np.array(patterns, float)
    shapes, around = table[:, : len(SHAPES)].astype(int), table[:, len(SHAPES): len(SHAPES) + 3].astype(int)
    label, count = table[:, -2].astype(int), table[:, -1]
    if len(set(label.tolist())) < 2:
        return None
    left, right, skip = (np.eye(LABELS + 1)[around[:, i]][:, :LABELS] for i in range(3))
    x = np.hstack([_design(shapes), left + right, skip])
    y = np.eye(LABELS)[label]
    prior = np.zeros((x.shape[1], LABELS))
    prior[-LABELS:][1:, 1:] = AGREE * np.eye(LABELS - 1)
    weights = prior.copy()
    count = count / count.mean()
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):  # Adam on the penalised pseudo-likelihood
        logits = x @ weights
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ ((p - y) * count[:, None]) / count.sum() + penalty * 1e-4 * (weights - prior)
        moment = 0.9 * moment + 0.1 * slope
        square = 0.999 * square + 0.001 * slope ** 2
        weights -= 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    chain, skip = weights[WIDTH + 1: WIDTH + 1 + LABELS], weights[WIDTH + 1 + LABELS:]
    return Field(weights[: WIDTH + 1], (chain + chain.T) / 2, (skip + skip.T) / 2)


def beliefs(field: Field, found: Tokens, known: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """Each token's label probabilities when loopy message passing has settled; known labels (not 0) are held.

    A round works on the messages that changed or whose sender did. One that is not settled after ``rounds`` turns takes
    smaller and smaller steps, so that fields without a fixed point come to an end, too."""
    size = len(known)
    node = _design(np.array(found.features)) @ field.node
    held = np.flatnonzero(known)
    node[held] = -50
    node[held, np.array(known)[held]] = 50
    edges = [(i, i + 1) for i in found.chain] + found.skips
    if not edges:
        total = node
    else:
        pairs = np.array(edges)
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        half = len(pairs)
        reverse = np.concatenate([np.arange(half) + half, np.arange(half)])
        kind = np.tile(np.arange(half) >= len(found.chain), 2)
        potential = np.where(kind[:, None, None], field.skip, field.chain)
        order = np.argsort(source, kind="stable")
        edge = np.searchsorted(source[order], np.arange(size + 1))
        message, total = np.zeros((2 * half, LABELS)), node.copy()
        turns, open_ = np.zeros(2 * half, np.int64), np.arange(2 * half)
        while len(open_):
            rest = (total[source[open_]] - message[reverse[open_]])[:, :, None] + potential[open_]
            top = rest.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(rest - top).sum(axis=1))
            step = 0.5 * FADE ** np.maximum(0, turns[open_] - rounds)
            change = step[:, None] * (new - new.max(axis=1, keepdims=True) - message[open_])
            message[open_] += change
            turns[open_] += 1
            np.add.at(total, target[open_], change)
            moved = np.abs(change).max(axis=1) > TOLERANCE
            nodes = np.unique(target[open_[moved]])  # what they send next is out of date
            count = edge[nodes + 1] - edge[nodes]
            sent = order[np.arange(count.sum()) + np.repeat(edge[nodes] - np.cumsum(count) + count, count)]
            open_ = np.union1d(open_[moved], sent)
        total = node.copy()
        np.add.at(total, target, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field | None, sure: float = SURE) -> tuple[list, list]:
    """The base spans and all spans of a text."""
    base = base_spans(text)
    if field is None:
        return base, base
    found = tokens(text)
    if not found.start:
        return base, base
    known = silver(found, base)
    if all(known):
        return base, base
    p = beliefs(field, found, known)
    best = p.argmax(axis=1)
    added = [(found.start[i], int(best[i]) - 1, found.end[i]) for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= sure))
             if not known[i]]
    return base, sorted(base + added)


def fit(docs: DataFrame, text: str = "text") -> Field | None:
    """The field's weights from all texts."""
    def run(batches):
        counts: dict[tuple, int] = {}
        for batch in slices(batches, 1 << 21, "text"):
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                found = tokens(value)
                if not found.start:
                    continue
                label = silver(found, base_spans(value))
                linked, skip = set(found.chain), {}
                for a, b in found.skips:
                    skip[a], skip[b] = label[b], label[a]
                for i, shape in enumerate(found.features):
                    key = (*shape, label[i - 1] if i - 1 in linked else -1, label[i + 1] if i in linked else -1, skip.get(i, -1), label[i])
                    counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pa.record_batch([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(counts.values(), pa.int64())],
                                  ["pattern", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern array<int>, n long")
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return fit_patterns([(*row["pattern"], row["n"]) for row in rows])


SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
                             StructField("added", BooleanType())]))


def _column(found: list[tuple[list, list]]) -> pa.Array:
    rows = []
    for base, every in found:
        own = set(base)
        rows.append([{"kind": KINDS[k], "start": a, "end": b, "added": (a, k, b) not in own} for a, k, b in every])
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])))


def spans(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """(key, spans) of every row: kind, start, end in code points, and whether the field added it; by start, then kind."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([picked.schema["key"], StructField("spans", SPAN)])

    def run(batches):
        for batch in slices(batches, 1 << 21, "text"):
            found = [all_spans(x or "", field, sure) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), _column(found)], ["key", "spans"])

    return picked.mapInArrow(run, schema)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for begin, kind, end in found:
        if merged and begin < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([begin, kind, end])
    for begin, kind, end in merged:
        out += [text[at:begin], "[", KINDS[kind].upper(), "]"]
        at = end
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: Field | None, text: str = "text", sure: float = SURE) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in ``text`` replaced."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, 1 << 21, text):
            columns = list(batch.columns)
            values = [x and mask(x, all_spans(x, field, sure)[1]) for x in batch.column(place).to_pylist()]
            columns[place] = pa.array(values, batch.schema.field(place).type)
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
