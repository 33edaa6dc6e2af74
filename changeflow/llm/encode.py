"""Problem 6: encoding a corpus with a public tokenizer, by content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so, so that equal
passages of different documents give equal chunks. Documents that share passages are
brought together (by the least hash of their lines), and a task encodes each distinct
chunk that it meets once. A document's ids are its chunks' ids, repaired at every join:
the text from the last safe boundary before the join to the first one after it is
encoded anew. Only texts move, once, and ids are never shuffled.

A safe boundary is a place where the tokenizer's splitter ends a piece whatever
comes before or after: a space or line feed after a visible character, or a letter
after a punctuation mark or symbol that isn't an apostrophe. Between two safe
boundaries encoding depends on nothing outside, so the repaired ids are exactly
those of the whole text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import spread, task_count

TOKENIZER = "byte_bpe_50k.tiktoken"
AVERAGE_BITS, LEAST, WINDOW_STEPS = 9, 128, 5
_CODERS: dict[tuple[str | None, str], object] = {}


def coder(vocabulary: str | None = None, name: str = TOKENIZER):  # noqa: ANN201
    """The tokenizer of a ``.tiktoken`` file, loaded once in a worker; ``vocabulary``: its folder, else where it is installed."""
    if (vocabulary, name) not in _CODERS:
        import public_tokenizers
        import tiktoken

        path = f"{vocabulary}/{name}" if vocabulary else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[vocabulary, name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[vocabulary, name]


def cuts(text: str) -> list[int]:
    """Ends of the text's chunks: where the hash of the last 32 characters has its low bits unset, ``LEAST`` apart at least."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for step in range(WINDOW_STEPS):
        w = 1 << step
        h[w:] = h[w:] + h[:-w] * np.uint32(0x01000193**w & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    out, last = [], 0
    for i in np.flatnonzero((h & np.uint32((1 << AVERAGE_BITS) - 1)) == 0).tolist():
        if i + 1 - last >= LEAST and i + 1 < n:
            out.append(i + 1)
            last = i + 1
    return [*out, n]


def safe(text: str, b: int) -> bool:
    """Whether the splitter ends a piece before ``text[b]``, whatever lies outside of the two characters there."""
    before = unicodedata.category(text[b - 1])
    if text[b] in " \n":
        return before[0] in "LNPS"
    return before[0] in "PS" and text[b - 1] != "'" and unicodedata.category(text[b])[0] == "L"


def ends(text: str) -> tuple[int, int]:
    """First and last safe boundary within a chunk; (0, 0) if there is none."""
    n = len(text)
    for first in range(1, n):
        if safe(text, first):
            return first, next(b for b in range(n - 1, 0, -1) if safe(text, b))
    return 0, 0


#: Characters of distinct chunks that a task keeps with their ids; beyond it forgets them all and begins anew.
MOST_KEPT = 8_000_000
#: Ids in one batch of results.
BATCH_IDS = 2_000_000
#: Shorter lines say nothing about what a text shares with others.
LEAST_LINE = 40

#: Ids before a chunk's first safe boundary, between it and the last, and after that; the text of the two ends.
Coded = tuple[np.ndarray, np.ndarray, np.ndarray, str, str]


class ChunkCoder:
    """Encodes whole texts, each distinct chunk once."""

    def __init__(self, enc, most: int = MOST_KEPT) -> None:  # noqa: ANN001
        self.enc, self.most, self.kept, self.filled = enc, most, {}, 0
        self.chunks, self.coded = 0, 0  # met, and encoded

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.enc.encode_ordinary(text), np.int32)

    def chunk(self, text: str) -> Coded | None:
        """A chunk in three parts; None if it has no safe boundary."""
        self.chunks += 1
        if text in self.kept:
            return self.kept[text]
        self.coded += 1
        if self.filled + len(text) > self.most:
            self.kept, self.filled = {}, 0
        first, last = ends(text)
        out = None
        if first:
            head, tail = text[:first], text[last:]
            out = self.ids(head), self.ids(text[first:last]), self.ids(tail), head, tail
        self.kept[text] = out
        self.filled += len(text)
        return out

    def encode(self, text: str) -> list[np.ndarray]:
        """The ids of a text, in parts."""
        out: list[np.ndarray] = []
        open_: list[str] = []  # text since the last safe boundary
        tail: np.ndarray | None = None  # its ids, if it is one chunk's end
        at = 0
        for end in cuts(text):
            piece = text[at:end]
            at = end
            part = self.chunk(piece)
            if part is None:  # nothing is certain until a safe boundary comes
                open_.append(piece)
                tail = None
                continue
            out.append(self.ids("".join(open_) + part[3]) if open_ else part[0])
            out.append(part[1])
            open_, tail = [part[4]], part[2]
        if open_:
            out.append(self.ids("".join(open_)) if tail is None else tail)
        return out


def route_key(text: Column) -> Column:
    """The least hash of a text's longer lines, else of the whole text: texts that share most lines mostly share it."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= LEAST_LINE)
    return F.coalesce(F.array_min(F.transform(lines, lambda x: F.xxhash64(x))), F.xxhash64(text))


def together(slim: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with similar texts next to each other, in tasks of equal size.

    Ranges of (route, id, input split) are cut by their sizes, so a page with a third of
    all revisions, or a text with as many copies, is many tasks; rows that are equal in
    every column are told apart by the split that they come from.
    """
    keyed = slim.withColumns({"_route": route_key(F.col(text)), "_tie": F.xxhash64(doc_id), "_split": F.spark_partition_id()})
    by = ["_route", "_tie", "_split"]
    return keyed.repartitionByRange(task_count(slim), *by).sortWithinPartitions(*by).drop(*by)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SIZES = pa.schema([("doc_id", pa.int64()), ("size", pa.int64())])


def _id_batch(ids: list[int | None], rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    lengths = [sum(map(len, r)) for r in rows]
    parts = [p for r in rows for p in r]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], schema=_IDS)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` (list of int) of every row: ids of the whole text, no special tokens added or read.

    A null or empty text has an empty list; a text of any length is encoded whole; a row
    that occurs twice, or a null id, gives its rows as they come. Other columns are not read.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder_ = ChunkCoder(coder(vocabulary, tokenizer))
        for batch in it:
            held_ids: list[int | None] = []
            held: list[list[np.ndarray]] = []
            filled = 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = coder_.encode(t) if t else []
                n = sum(map(len, parts))
                if held and filled + n > BATCH_IDS:
                    yield _id_batch(held_ids, held)
                    held_ids, held, filled = [], [], 0
                held_ids.append(d)
                held.append(parts)
                filled += n
            if held:
                yield _id_batch(held_ids, held)

    return together(slim).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, size``: how many ids :func:`encode` gives each row; counted on the whole texts, as a number needs no chunks put together."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(vocabulary, tokenizer)
        for batch in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], schema=_SIZES)

    return spread(slim).mapInArrow(run, "doc_id bigint, size bigint")
