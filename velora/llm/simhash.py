"""SimHash near-duplicate detection with a segment-popcount embedding.

Method. A text's fingerprint has a bit set where more than half of the 64-bit
hashes of its word shingles have it. A fingerprint is embedded as the bit counts
of its 32 segments of two bits. Moving one bit changes one count by one, so the
Manhattan distance of two embeddings is a lower bound of their Hamming distance.
The range join under Manhattan distance d runs on a grid: the segments form
d + 3 groups, two fingerprints within d agree in all counts of at least three
groups, and so they share a cell of at least one of the grids that each span
three groups (20 grids for d = 3). Inside a cell, the Manhattan bound over all
segments and then the exact Hamming distance decide.

Scale. Only distinct fingerprints are joined; copies are counted once. A cell
never gives out its pairs: each task keeps a cell's links as a spanning forest
and emits an edge per fingerprint at most. A crowded cell (found on a hash
sample of the fingerprints, which decides how to run, not what is found) is cut
into blocks, and every pair of blocks is a task's own group, so no group grows
without bound. Components come from hooking and pointer jumping on the edges.
Texts are read once, and what is shuffled is some 20 x 16 bytes for each distinct
fingerprint.

A cell of three groups is one of some 2**24, so that cells stay small up to about
10**9 distinct fingerprints (60 to a cell and grid); beyond that, meet=4 (35 grids,
2**27 cells) or 5 (56 grids, 2**30) buys smaller cells for more rows.

Defined results: null or empty text, or one without words: fingerprint zero,
linked like any other. A null doc_id is the smallest id of its component only if
all are null. Repeated rows keep a row each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import UPPER, id_and_text, map_batches, release, texts_utf8, written
from velora.llm.components import components

SEED = 42
SEGMENTS, SEGMENT_BITS = 32, 2
#: Fingerprints of a cell that one group holds; and the share of fingerprints looked at to find larger cells.
CELL_ROWS, LOOK = 2048, 64
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of a UTF-8 text's word shingles, A-Z lower-cased, repeats included; big-endian."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, ">u8")
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return np.frombuffer(digest(joined, SEED), ">u8")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = (ends - 1)[words - 1 :].tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), ">u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Each bit is set where more than half of the hashes have it."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a text; zero without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every row, written to the shared folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(text, words) for text in texts_utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return written(map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long"), "fingerprints")


def _grids(max_bits: int, meet: int) -> list[int]:
    """A mask of the bits that each grid spans: meet of max_bits + meet groups of segments."""
    groups = max_bits + meet
    edges = [round(k * SEGMENTS / groups) for k in range(groups + 1)]
    masks = [sum(((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, meet)]


def _cells(fps: DataFrame, max_bits: int, meet: int) -> DataFrame:
    """fp, cell: a row for each grid."""
    grids = _grids(max_bits, meet)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        # the count of each two-bit segment, in place
        counts = (fp & np.uint64(0x5555555555555555)) + ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
        cells = []
        for k, mask in enumerate(grids):
            c = (counts & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)
            c ^= c >> np.uint64(29)
            c *= np.uint64(0xBF58476D1CE4E5B9)
            cells.append(c ^ (c >> np.uint64(32)))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(fp.view(np.int64), len(grids))), pa.array(np.concatenate(cells).view(np.int64))], ["fp", "cell"])

    return map_batches(fps.select("fp"), run, "fp long, cell long")


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of segment bit counts."""
    low = np.uint64(0x5555555555555555)
    x, y = (a & low) + ((a >> np.uint64(1)) & low), (b & low) + ((b >> np.uint64(1)) & low)
    # counts of 0 to 2: segments that differ by one differ in the low bit, by two in the high bit only
    differ = x ^ y
    return np.bitwise_count(differ & low).astype(np.int64) + 2 * np.bitwise_count((differ >> np.uint64(1)) & ~differ & low).astype(np.int64)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of fingerprints are within max_bits: the Manhattan bound first, then exactly."""
    near = np.flatnonzero(_manhattan(a, b) <= max_bits)
    return near[np.bitwise_count(a[near] ^ b[near]) <= max_bits]


def _flood(fp: np.ndarray, max_bits: int, direct: bool = False) -> np.ndarray:
    """For each of a large group's distinct fingerprints, in ascending order (signed), the smallest of its component.

    If direct, the one within max_bits from which it was reached, instead.
    """
    out, bits = fp.copy(), fp.view(np.uint64)
    rest = np.arange(len(fp))
    while len(rest):
        root, front, rest = fp[rest[0]], rest[:1], rest[1:]
        while len(front):
            if not direct:
                out[front] = root
            new = np.zeros(len(rest), bool)
            for f in front:
                left = np.flatnonzero(~new)
                reached = left[_near(bits[rest[left]], np.broadcast_to(bits[f], len(left)), max_bits)]
                new[reached] = True
                if direct:
                    out[rest[reached]] = fp[f]
            front, rest = rest[new], rest[~new]
    return out


def _forest(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest of its component in the group) of all groups [start, end).

    If direct, both ends of every edge are within max_bits.
    """
    sizes, bits = ends - starts, fp.view(np.uint64)
    a_out, b_out = [], []
    for s, e in zip(starts[sizes > 64].tolist(), ends[sizes > 64].tolist()):
        group = np.unique(fp[s:e])
        root = _flood(group, max_bits, direct)
        a_out.append(group[group != root])
        b_out.append(root[group != root])
    small = (sizes > 1) & (sizes <= 64)
    starts, ends = starts[small], ends[small]
    stop = np.repeat(ends, ends - starts)
    at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(starts) else np.empty(0, np.int64)
    pairs, step = [], 1
    while len(at):
        inside = at + step < stop
        at, stop = at[inside], stop[inside]
        near = at[_near(bits[at], bits[at + step], max_bits)]
        pairs.append((near, near + step))
        step += 1
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs))
        if direct:
            apart = fp[i] != fp[j]
            a_out.append(np.maximum(fp[i], fp[j])[apart])
            b_out.append(np.minimum(fp[i], fp[j])[apart])
            i = i[:0]
        # the least label of linked rows spreads until nothing changes; labels are ranks by value
        label = np.argsort(np.argsort(fp, kind="stable"), kind="stable")
        while len(i):
            least = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            if (label == before).all():
                break
        by_rank = np.sort(fp, kind="stable")
        moved = np.flatnonzero(by_rank[label] != fp)
        a_out.append(fp[moved])
        b_out.append(by_rank[label[moved]])
    none = np.empty(0, fp.dtype)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def _dealt(cells: DataFrame) -> DataFrame:
    """The cells' rows (fp, cell) by groups (cell, part), sorted by these; a crowded cell has several parts."""
    looked = cells.where(F.pmod(F.xxhash64("fp"), F.lit(LOOK)) == 0)
    crowded = looked.groupBy(F.col("cell").alias("full")).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS // LOOK).select("full", F.ceil(F.col("n") * 2 * LOOK / CELL_ROWS).cast("int").alias("blocks"))
    crowded = written(crowded, "crowded-cells")
    if crowded.isEmpty():
        dealt = cells.select("fp", "cell", F.lit(0).alias("part"))
    else:
        own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks")).cast("int")
        pair = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
        parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
        dealt = cells.join(crowded, cells.cell == crowded.full, "left").select("fp", "cell", F.explode(parts).alias("part"))
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")


def by_groups(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns (cell, part first) of whole groups, with the groups' starts and ends."""
    kept: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = columns(batch)
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        if kept is None or not len(kept[0]):
            continue
        edge = np.flatnonzero((np.diff(kept[0]) != 0) | (np.diff(kept[1]) != 0)) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(kept[0]))
        tail = len(kept[0]) if batch is None else int(starts[-1])
        if batch is not None:
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            yield [x[:tail] for x in kept], starts, ends
        kept = [x[tail:] for x in kept]


def links(fps: DataFrame, max_bits: int = 3, *, meet: int = 3, direct: bool = False) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) within max_bits; fewer than all pairs.

    meet is the number of groups that a grid's cell spans. If direct, both ends of
    every edge are within max_bits, and not just connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda batch: [batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_numpy()]
        for (_, _, fp), starts, ends in by_groups(batches, columns):
            a, b = _forest(fp, starts, ends, max_bits, direct)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _dealt(_cells(fps, max_bits, meet)).mapInArrow(run, "a long, b long")


def hex_of(fp: Column | str) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, *, words: int = 3, max_bits: int = 3, meet: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links lead to."""
    rows = fingerprints(docs, words, id_col, text_col)
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(links(fps, max_bits, meet=meet), "simhash").select(F.col("node").alias("fp"), "label")
    members = fps.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # written, so that both sides of the next join are plain exchanges and a very large component can be split
    smallest = written(members.groupBy("label").agg(F.min("least").alias("component_id")), "component-ids")
    of_fp = written(members.join(smallest, "label").select(F.col("fp").alias("known"), "label", "component_id"), "fingerprint-components")
    release(fps, smallest)
    return rows.join(of_fp, rows.fp == of_fp.known, "left").select("doc_id", "fp", "component_id")
