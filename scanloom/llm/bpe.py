"""BPE encoding and decoding by a contiguous rank array.

A word's parts and the ranks of all pairs of neighbours stand in two short lists. Each
step scans the ranks for the least, joins that pair, deletes one boundary and looks up
the two ranks beside it. Words above ``SHORT`` bytes, where scanning would be slow, take
the same steps from a heap. Words do not touch across white space, so equal words are
looked up in a table of those met before, and so are equal runs between white space; a run that
is one word stands there once. The table keeps the last one to two times ``KEPT`` of them.

The vocabulary is a file of the ``tokenizers`` format with NFC, lower-casing, a split
into letters, single digits and other characters, byte-level pieces, a mark at the end of a
word, and special tokens found in the raw text. Decoding joins the pieces of the ids by a
blank, which is what such a file without a decoder asks for.

Defined results: null counts as an empty text, which has no ids and decodes to an empty
text. Rows are encoded one by one: repeated rows and rows without an id are kept, extra
columns stay out of the way.
"""
from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .words import slices

SHORT = 128
KEPT = 200_000
#: A vocabulary file is sent to every worker, so its size has a limit.
FILE_LIMIT = 64 << 20
#: The split of a normal text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
NEVER = 1 << 30


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict(zip(shown, map(chr, shown)))
    rest = (chr(256 + i) for i in range(256))
    return [names.get(b) or next(rest) for b in range(256)]


class Known(dict):
    """Results by word or run; ``before`` holds those of the generation before."""

    def __init__(self, find):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= SHORT:
            if len(self) >= KEPT:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Coder:
    def __init__(self, content: bytes):
        file = json.loads(content)
        vocabulary, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"] or ""
        self.pieces = {i: piece for piece, i in vocabulary.items()}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.pieces |= {i: piece for piece, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = _byte_characters()
        self.inner = [vocabulary.get(name) for name in names]
        self.final = [vocabulary.get(name + suffix) for name in names]
        self.ranks, self.joined = {}, []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.joined.append(vocabulary[left + right])
        self.chunks = Known(self.chunk)

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        rank_of, joined = self.ranks.get, self.joined
        ranks = [rank_of(left << 32 | right, NEVER) for left, right in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = joined[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 32 | parts[at + 1], NEVER)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        rank_of, joined, size = self.ranks.get, self.joined, len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank, i) for i in range(size - 1) if (rank := rank_of(parts[i] << 32 | parts[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            to = after[at]
            if parts[at] < 0 or to >= size or rank_of(parts[at] << 32 | parts[to], NEVER) != rank:
                continue
            parts[at], parts[to] = joined[rank], -1
            after[at] = after[to]
            if after[at] < size:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < size:
                    rank = rank_of(parts[left] << 32 | parts[after[left]], NEVER)
                    if rank < NEVER:
                        heapq.heappush(heap, (rank, left))
        return [part for part in parts if part >= 0]

    def chunk(self, chunk: str) -> bytes:
        """The ids of a run without white space, as 32-bit numbers."""
        found = WORD.findall(chunk)
        if found == [chunk]:
            return array("i", self.word(chunk)).tobytes()
        return b"".join(map(self.chunks.__getitem__, found))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case goes letter by letter, without a final sigma
        # The file separators are no white space here, but they are to split().
        found = text.lower().split() if not re.search("[\x1c-\x1f]", text) else regex.split(r"\s+", text.lower())
        return b"".join(map(self.chunks.__getitem__, found))

    def forget(self) -> None:
        """Empty the table: workers are used again for other tasks, which need the memory."""
        self.chunks.clear()
        self.chunks.before = {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text), np.int32).tolist()

    def coded(self, text: str) -> bytes:
        """The ids of a text, as 32-bit numbers."""
        if "<|" not in text and all(x.startswith("<|") for x in self.special):
            return self._plain(text)
        parts = self.split.split(text) if self.special else [text]
        return b"".join(np.int32(self.special[part]).tobytes() if at % 2 else self._plain(part) for at, part in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))

    @cached_property
    def listed(self) -> pa.Array:
        """The pieces in the order of their ids."""
        return pa.array(map(self.pieces.get, range(max(self.pieces) + 1)), pa.string())

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """:meth:`decode` of each row of ids that :meth:`coded` gave."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.listed.take(ids.values)), " ")


@lru_cache(1)
def coder(content: bytes) -> Coder:
    return Coder(content)


def _sent(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        content = file.read(FILE_LIMIT + 1)
    if len(content) > FILE_LIMIT:
        raise ValueError(f"{path}: a vocabulary above {FILE_LIMIT} bytes is not sent to the workers")
    return docs.sparkSession.sparkContext.broadcast(content)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False, keep=()) -> DataFrame:
    """``key``, the columns ``keep`` and ``ids`` of every row; with ``decoded`` also the text decoded from the ids."""
    file = _sent(docs, path)
    carried = 1 + len(keep)
    picked = docs.select(*(F.col(name).alias(f"c{i}") for i, name in enumerate([key, *keep])), F.col(text).alias("text"))
    schema = StructType([*picked.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())),
                         *[StructField("decoded", StringType())] * decoded])

    def run(batches):
        tool = coder(file.value)
        for batch in slices(batches, 1 << 20):
            ids = [tool.coded(x or "") for x in batch.column(carried).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            columns = [*batch.columns[:carried], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if decoded:
                columns.append(tool.decoded(columns[-1]))
            yield pa.record_batch(columns, schema.names)
        tool.forget()

    return picked.mapInArrow(run, schema).withColumnsRenamed({f"c{i}": name for i, name in enumerate([key, *keep])})


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` of every row; null ids count as none."""
    file = _sent(encoded, path)

    def run(batches):
        tool = coder(file.value)
        for batch in batches:
            texts = [tool.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["key", "decoded"])

    picked = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    schema = f"key {picked.schema['key'].dataType.simpleString()}, decoded string"
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)
