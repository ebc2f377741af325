"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Method. The symbols are words, numbered by the benchmark's vocabulary (0: a word
that no item has). The patterns are the windows of the items: 8 consecutive
words, or the whole of a shorter item. Patterns of one length m share a scanner:
its shift table says for each block of two symbols how far a window that ends
there can move on before it may match (a block in no pattern: m - 1, a symbol
in no pattern: m), and where the shift is zero the bucket of that suffix block
lists the patterns, which are compared word for word. Positions of a text that
cannot end a match are thus never looked at.

A scanner is three arrays: the shift table, addressed by a hash of the block (blocks
that share a place keep the smaller shift, which is safe), the head of each suffix
hash's bucket, and the patterns' symbols in bucket order, some 45 bytes a window. The
benchmark is dealt into blocks of at most ``block_bytes`` of item text, one in the
usual case; the driver holds one at a time, and a Python worker builds a block's index
once and keeps the last one only. Each further block is a pass of its own over the
documents, written before the next, so a task's memory is bounded at any benchmark
size. There is no shuffle.

Defined results: a null text, or one without words, has no words and no hits; a
null item or one without words matches nothing; items with equal texts are all
reported; repeated items count once per item id, a null item id is left out;
repeated documents keep a row each; empty tables work on either side.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from velora.llm.common import fresh_name, id_and_text, map_batches, release, texts_utf8, written

WINDOW = 8
#: Item text in one index, which takes some 40 times that while a Python worker builds it.
BLOCK_BYTES = 4 << 20
#: Odd factors of the tables' hash; products with symbols stay under 2**63.
MIX, MIX_BEFORE = 0x9E3779B1, 0x85EBCA6B
#: A text's bytes: A-Z lower-cased, what is no word character made a space. Bytes from 128 on are word characters.
_TO_WORDS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORDS = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, lower-cased in A-Z."""
    return text.translate(_TO_WORDS).split()


class Scanner:
    """Wu-Manber tables for patterns of one length; symbols are numbered from 1."""

    def __init__(self, patterns: np.ndarray, items: list[int]) -> None:
        """patterns: a row of symbols each, repeats allowed; items: the item of each."""
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        most = self.length - self.block + 1
        bits = max(10, (8 * len(patterns)).bit_length())
        self.mask = (1 << min(bits, 26)) - 1
        shift = np.full(self.mask + 1, most, np.uint8 if most < 256 else np.int32)
        for end in range(self.block, self.length + 1):
            np.minimum.at(shift, self._places(patterns, end), self.length - end)
        suffix = self._places(patterns, self.length)
        order = np.lexsort((*patterns.T, suffix))
        patterns, suffix, items = patterns[order], suffix[order], np.asarray(items, np.int32)[order]
        # equal patterns follow each other: a row for each, and the run of its items
        first = np.append(True, (np.diff(patterns, axis=0) != 0).any(1)) if len(patterns) else np.zeros(0, bool)
        rows = np.flatnonzero(first)
        self.own = array("I", [*rows.tolist(), len(patterns)])
        self.items = array("i", items.tolist())
        self.flat = np.ascontiguousarray(patterns[rows], np.int32).tobytes()
        places, counts = np.unique(suffix[rows], return_counts=True)
        # only places of shift zero have a bucket
        self.places, self.starts = array("q", places.tolist()), array("I", [*(np.cumsum(counts) - counts).tolist(), len(rows)])
        self.shift = shift.tobytes() if shift.dtype == np.uint8 else array("i", shift.tolist())

    def _places(self, ids: np.ndarray, end: int) -> np.ndarray:
        """Where the block of symbols up to end stands in the tables."""
        place = ids[:, end - 1].astype(np.int64) * MIX
        if self.block == 2:
            place ^= ids[:, end - 2].astype(np.int64) * MIX_BEFORE
        return (place >> 5) & self.mask

    def bucket(self, place: int) -> range:
        """The rows of patterns whose suffix block stands at a place."""
        k = bisect_left(self.places, place)
        return range(self.starts[k], self.starts[k + 1]) if k < len(self.places) and self.places[k] == place else range(0)

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, row) of each occurrence, ascending."""
        length, two, mask, shift = self.length, self.block == 2, self.mask, self.shift
        last, n, width = length - 1, len(ids), 4 * length
        raw = b""
        while last < n:
            symbol = ids[last]
            if not symbol:
                last += length
                continue
            place = ((symbol * MIX ^ ids[last - 1] * MIX_BEFORE if two else symbol * MIX) >> 5) & mask
            move = shift[place]
            if move:
                last += move
                continue
            start = last - length + 1
            raw = raw or array("i", ids).tobytes()
            found = raw[4 * start : 4 * start + width]
            for row in self.bucket(place):
                if self.flat[width * row : width * (row + 1)] == found:
                    yield start, row
                    break
            last += 1


class Index:
    """The scanners of a block of items, one for each pattern length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        for item, text in items:
            ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)), np.int32)
            if not len(ids):
                continue
            size = min(window, len(ids))
            windows, owners = by_length.setdefault(size, ([], []))
            windows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owners += [len(self.names)] * (len(ids) - size + 1)
            self.names.append(item)
        self.scanners = [Scanner(np.concatenate(by_length[k][0]), by_length[k][1]) for k in sorted(by_length)]

    def scan(self, text: bytes) -> tuple[int, bytearray | None, set[str]]:
        """Number of words; a mark for each word if any is hit; the items that occur."""
        words = words_of(text)
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        hit, found = None, set()
        for scanner in self.scanners:
            for start, row in scanner.find(ids):
                hit = hit or bytearray(len(ids))
                hit[start : start + scanner.length] = b"\x01" * scanner.length
                found.update(self.names[k] for k in scanner.items[scanner.own[row] : scanner.own[row + 1]])
        return len(ids), hit, found


#: A Python worker keeps the index that it used last.
_INDEX: dict[tuple[str, int], Index] = {}


def index_of(key: str, block: Callable[[], list[tuple[str, bytes]]], window: int) -> Index:
    """The index of a block, built where this worker doesn't have it."""
    if (key, window) not in _INDEX:
        _INDEX.clear()
        _INDEX[key, window] = Index(block(), window)
    return _INDEX[key, window]


def runs(hit: bytes) -> list[tuple[int, int]]:
    """Start and end of each run of marked words."""
    return [m.span() for m in re.finditer(rb"\x01+", bytes(hit))]


def without_words(text: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    at = [m.span() for m in _WORDS.finditer(text.translate(_TO_WORDS))]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, text[last:]])


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items with words in blocks of bounded size, one after the other; one empty block if there are none."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct().orderBy("item", "text")
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = row.text.encode()
        if size and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, text))
        size += len(text)
    yield block


def _scanned(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, text_col: str, item_col: str, item_text_col: str, finish: Callable[[pa.RecordBatch, list[bytes], list[set[str]], list[bytes | None]], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """finish(batch of docs, texts, items found, marked words) of all documents.

    Each block of the benchmark but the last hands on what it found in two columns.
    """
    width, at = len(docs.columns), docs.columns.index(text_col)
    found_col, marks_col = fresh_name(docs, "found"), fresh_name(docs, "marks")
    between = StructType(docs.schema.fields + [StructField(found_col, ArrayType(StringType())), StructField(marks_col, BinaryType())])
    out = docs
    blocks = item_blocks(items, item_col, item_text_col, block_bytes)
    block = next(blocks)
    first = True
    while block is not None:
        following = next(blocks, None)
        sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batch: pa.RecordBatch, sent=sent, key=key, first=first, last=following is None) -> pa.RecordBatch:
            index = index_of(key, lambda: sent.value, window)
            texts = list(texts_utf8(batch.column(at)))
            known = [set() for _ in texts] if first else [set(x) for x in batch.column(width).to_pylist()]
            marks = [None] * len(texts) if first else batch.column(width + 1).to_pylist()
            for k, text in enumerate(texts):
                _, hit, new = index.scan(text)
                known[k] |= new
                if hit:
                    marks[k] = bytes(hit if marks[k] is None else map(or_, hit, marks[k]))
            own = batch.select(list(range(width)))
            if last:
                return finish(own, texts, known, marks)
            columns = [*own.columns, pa.array(map(sorted, known), pa.list_(pa.string())), pa.array(marks, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [*own.schema.names, found_col, marks_col])

        before = out
        out = map_batches(out, run, schema if following is None else between)
        if following is not None:
            out = written(out, "decontamination-pass")
            if not first:
                release(before)
        block, first = following, False
    return out


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    min_items: int = 2,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (hit word runs), contaminated per document."""
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(batch: pa.RecordBatch, texts: list[bytes], known: list[set[str]], marks: list[bytes | None]) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b} for a, b in runs(m)] if m else [] for m in marks]
        columns = [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([sum(m) if m else 0 for m in marks], pa.int64()), pa.array(map(sorted, known), pa.list_(pa.string())), pa.array(spans, spans_kind), pa.array([len(x) >= min_items for x in known])]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, contaminated boolean"
    return _scanned(id_and_text(docs, id_col, text_col), items, window, block_bytes, "text", item_col, item_text_col, finish, schema)


def items_digest(items: list[str]) -> str:
    """SHA-256 of the sorted item ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents with all their columns, decontaminated.

    Documents with min_items items or more go; of the others, the words that a
    window hits are cut out of the text, and n_chars is brought up to date where
    that happens.
    """
    at, count_at = docs.columns.index(text_col), docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None

    def finish(batch: pa.RecordBatch, texts: list[bytes], known: list[set[str]], marks: list[bytes | None]) -> pa.RecordBatch:
        keep = pa.array([len(x) < min_items for x in known], pa.bool_())
        cut = [k for k, m in enumerate(marks) if m is not None and len(known[k]) < min_items]
        if cut:
            columns = list(batch.columns)
            for k in cut:
                texts[k] = without_words(texts[k], runs(marks[k]))
            whole = [t if v.is_valid else None for t, v in zip(texts, columns[at])]
            columns[at] = pa.array(whole, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type)
            if count_at is not None:
                sizes = columns[count_at].to_pylist()
                for k in cut:
                    sizes[k] = len(texts[k].decode())
                columns[count_at] = pa.array(sizes, batch.schema.field(count_at).type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return batch.filter(keep)

    return _scanned(docs, items, window, block_bytes, text_col, item_col, item_text_col, finish, docs.schema)
