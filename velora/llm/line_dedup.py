"""Line dedup by pairwise alignment of overlapping documents.

Method. A document is the sequence of hashes of its lines (stripped; blank lines
don't count). Lines are hashed in runs: from each line on the fewest lines, and up to
each line the fewest lines, that have ``min_words`` words or more. The places
that have a run are counted. A rare run (RARE places at most) makes a
pair of each two documents that have it, a frequent one pairs each document with
the first that has it. Pairs are aligned by patience diff: lines that are unique in
both and shared, in longest increasing order, are anchors, and equal lines around
anchors and shared runs join them to blocks. Blocks of min_words words or more are
deleted from the later document. Documents with equal line sequences form a class
first; later members go whole.

What goes is thereby exactly what any earlier document has too: a common block of
min_words words is covered by the runs from its lines on and the runs up to its last
ones, and each of these is shared with the first document that has it, be it rare or
not. So frequent runs need no other pairs, and nothing is lost by them.

Scale. A frequent run gives one match per document, a rare one RARE at most. Long
documents are aligned in segments of 256 lines with a margin on either side that no
run exceeds, so a pair's rows are bounded. Copies are one row per class before
anything is joined; joins on hot runs or documents can be split. Texts themselves
are shuffled once, at the end, to meet what is to be cut.

Defined results: null or empty texts, and those of blank lines only, have
nothing to delete. Rows with one doc_id and equal text are one document: they
keep or lose the same lines. Documents with one doc_id and different texts are
ordered by their hashes; a null doc_id comes first. Lines that repeat inside one
document stay. Copies of fewer than min_words words stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.common import NULL_ID, fresh_name, id_and_text, map_batches, release, texts_utf8, written

MIN_WORDS = 20
#: A rare run stands in so many places at most.
RARE = 4
#: Lines that are aligned at a time, with so many (no run has more than its words) on either side.
SEGMENT, MARGIN = 256, 64


def lines_of(text: bytes) -> tuple[list[int], list[int]]:
    """Hashes (signed) and word counts of the lines that aren't blank."""
    kept = [s for line in text.split(b"\n") if (s := line.strip())]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in kept), np.uint64, len(kept)).view(np.int64).tolist()
    return hashes, [len(s.split()) for s in kept]


def runs_of(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, hash) of the shortest runs of min_words words from each line on and up to each line."""
    raw = np.array(hashes, np.int64).tobytes()
    spans: dict[tuple[int, int], None] = {}
    end = total = 0
    for start in range(len(hashes)):
        while total < min_words and end < len(hashes):
            total += words[end]
            end += 1
        if total < min_words:
            break
        spans[start, end] = None
        total -= words[start]
    start = total = 0
    for end in range(1, len(hashes) + 1):
        total += words[end - 1]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            spans[start, end] = None
    return [(a, int(np.uint64(xxhash.xxh64_intdigest(raw[8 * a : 8 * b], 1)).astype(np.int64))) for a, b in spans]


def patience_anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Lines unique in both, in the longest order that both have: (position in a, in b)."""
    in_a, in_b = Counter(a), Counter(b)
    where = {h: i for i, h in enumerate(a) if in_a[h] == 1}
    shared = [(where[h], j) for j, h in enumerate(b) if in_b[h] == 1 and h in where]
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(shared):
        at = bisect_left(tops, i)
        tops[at : at + 1] = [i]
        piles[at : at + 1] = [k]
        back.append(piles[at - 1] if at else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(shared[k])
        k = back[k]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, lines) around the anchors and seeds (positions in a, in b)."""
    out: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}  # per diagonal, how far b is covered
    for i, j in sorted({*patience_anchors(a, b), *seeds}, key=lambda x: x[1]):
        if a[i] != b[j] or seen.get(i - j, -1) > j:
            continue
        start, end = 0, 1
        while i + start > 0 and j + start > 0 and a[i + start - 1] == b[j + start - 1]:
            start -= 1
        while i + end < len(a) and j + end < len(b) and a[i + end] == b[j + end]:
            end += 1
        seen[i - j] = j + end
        out.append((i + start, j + start, end - start))
    return out


def _sketches(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, class, hashes, words, starts, runs of every row; the last two belong together."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_utf8(batch.column(1)):
            hashes, words = lines_of(text)
            runs = runs_of(hashes, words, min_words)
            rows.append((xxhash.xxh3_128_digest(np.array(hashes, np.int64).tobytes()), hashes, words, [r[0] for r in runs], [r[1] for r in runs]))
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ["doc_id", "text_hash", "class", "hashes", "words", "starts", "runs"]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    texts = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(map_batches(texts, run, "doc_id long, text_hash long, class binary, hashes array<long>, words array<int>, starts array<int>, runs array<long>"), "line-sketches")


def _aligned(pairs: DataFrame, min_words: int, margin: int) -> DataFrame:
    """class, cut (line numbers) of aligned segments."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        classes, cuts = [], []
        for row in batch.to_pylist():
            a0, b0 = (max(0, row[k] * SEGMENT - margin) for k in ("first_segment", "segment"))
            seeds = [(s["first_at"] - a0, s["at"] - b0) for s in row["seeds"]]
            words = row["words"]
            cut: set[int] = set()
            for _, j, n in common_blocks(row["first_hashes"], row["hashes"], seeds):
                if sum(words[j : j + n]) >= min_words:
                    cut.update(range(b0 + j, b0 + j + n))
            if cut:
                classes.append(row["class"])
                cuts.append(sorted(cut))
        return pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))], ["class", "cut"]) if classes else None

    return map_batches(pairs, run, "class binary, cut array<int>")


def matched_runs(classes: DataFrame, rare: int = RARE) -> DataFrame:
    """class, at, first_class, first_at: where a class has a run that earlier classes have too.

    Of a run that at most rare classes have, every earlier class; of others the first.
    """
    runs = classes.select("rep", "class", F.explode(F.arrays_zip("starts", "runs")).alias("r")).select("rep", "class", F.col("r.starts").alias("at"), F.col("r.runs").alias("run"))
    counts = runs.groupBy(F.col("run").alias("counted")).agg(F.count("*").alias("n"), F.min(F.struct("rep", "class", "at")).alias("first"), F.max(F.struct("rep", "class")).alias("last"))
    counts = counts.where((F.col("first.rep") != F.col("last.rep")) | (F.col("first.class") != F.col("last.class"))).drop("last")
    shared = written(runs.join(counts, runs.run == counts.counted).select("run", "n", "rep", "class", "at", "first"), "shared-runs")
    often = shared.where(F.col("n") > rare).select("class", "at", F.col("first.class").alias("first_class"), F.col("first.at").alias("first_at"))
    few = shared.where(F.col("n") <= rare).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("rep", "class", "at"))).alias("all"))
    few = few.select(F.posexplode("all").alias("k", "me"), "all").where("k > 0").select("me", F.explode(F.expr("slice(all, 1, k)")).alias("e"))
    few = few.select(F.col("me.class").alias("class"), F.col("me.at").alias("at"), F.col("e.class").alias("first_class"), F.col("e.at").alias("first_at"))
    return often.unionByName(few).where("class <> first_class")


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, whole, cut of the documents that lose lines.

    cut numbers the lines that aren't blank, from 0; whole: all of them go.
    """
    margin = max(MARGIN, min_words)
    sketches = _sketches(docs, min_words, id_col, text_col)
    classes = sketches.groupBy("class").agg(F.min(F.struct("doc_id", "hashes", "words", "starts", "runs")).alias("m")).select("class", F.col("m.doc_id").alias("rep"), "m.hashes", "m.words", "m.starts", "m.runs")
    classes = written(classes, "line-classes")

    segment = lambda c: F.floor(F.col(c) / SEGMENT).cast("int")
    pairs = matched_runs(classes, rare).groupBy("class", segment("at").alias("segment"), "first_class", segment("first_at").alias("first_segment")).agg(F.collect_list(F.struct("at", "first_at")).alias("seeds"))

    cuts = F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / SEGMENT).cast("int"))
    segments = classes.where("size(hashes) > 0").select("class", "hashes", "words", F.explode(cuts).alias("segment"))
    begin = F.greatest(F.lit(0), F.col("segment") * SEGMENT - margin)
    part = lambda c: F.slice(c, begin + 1, (F.col("segment") + 1) * SEGMENT + margin - begin)
    segments = segments.select("class", "segment", part("hashes").alias("hashes"), part("words").alias("words"))
    first_segments = segments.select(F.col("class").alias("c1"), F.col("segment").alias("s1"), F.col("hashes").alias("first_hashes"))
    second_segments = segments.select(F.col("class").alias("c2"), F.col("segment").alias("s2"), "hashes", "words")
    paired = pairs.join(first_segments, (F.col("first_class") == F.col("c1")) & (F.col("first_segment") == F.col("s1"))).drop("c1", "s1")
    paired = paired.join(second_segments, (F.col("class") == F.col("c2")) & (F.col("segment") == F.col("s2"))).select("class", "segment", "first_segment", "seeds", "first_hashes", "hashes", "words")
    cut = _aligned(paired, min_words, margin).groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
    cut = written(cut, "line-cuts").withColumnRenamed("class", "cut_class")

    fates = classes.select(F.col("class").alias("of_class"), "rep", (F.aggregate("words", F.lit(0), lambda s, x: s + x) >= min_words).alias("long"))
    # written, so that both sides of the next join are plain exchanges and a class of very many copies can be split
    fates = written(fates.join(cut, F.col("of_class") == F.col("cut_class"), "left").select("of_class", "rep", "long", "cut"), "line-fates")
    release(classes)
    members = sketches.select("doc_id", "text_hash", "class")
    found = members.join(fates, F.col("class") == F.col("of_class")).select("doc_id", "text_hash", (F.col("long") & (F.col("doc_id") != F.col("rep"))).alias("whole"), "cut")
    return found.where("whole or cut is not null").dropDuplicates(["doc_id", "text_hash"])


def without_lines(text: bytes, whole: bool, cut: list[int] | None) -> tuple[bytes, int]:
    """The text without the lines that go, and how many went."""
    out, k, gone = [], 0, set(cut or ())
    lines = text.split(b"\n")
    for line in lines:
        blank = not line.strip()
        if blank or not whole and k not in gone:
            out.append(line)
        k += not blank
    if not any(line.strip() for line in out):
        return b"", len(lines)
    return b"\n".join(out), len(lines) - len(out)


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", counts: bool = False) -> DataFrame:
    """The documents, with all their columns, without repeated lines.

    n_chars is brought up to date where it is a column. drop_emptied leaves out
    documents that lost everything; counts adds n_lines and n_cut.
    """
    fates = repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    names = {c: fresh_name(docs, f"fate_{c}") for c in fates.columns}
    fates = fates.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)) == F.col(names["doc_id"])) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(names["text_hash"]))
    joined = docs.join(fates, same, "left").select(*(docs[f"`{c}`"] for c in docs.columns), names["whole"], names["cut"])
    at, width = docs.columns.index(text_col), len(docs.columns)
    count_at = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None
    schema = docs.schema
    if counts:
        schema = schema.add("n_lines", "long").add("n_cut", "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, keep = list(batch.columns[:width]), [True] * batch.num_rows
        texts, n_lines, n_cut = [], [], []
        lengths = columns[count_at].to_pylist() if count_at is not None else None
        for k, (text, whole, cut) in enumerate(zip(columns[at].cast(pa.large_binary()), batch.column(width), batch.column(width + 1))):
            text, gone = text.as_py(), 0
            n_lines.append(0 if text is None else text.count(b"\n") + 1)
            if whole.is_valid:
                text, gone = without_lines(text, whole.as_py(), cut.as_py())
                keep[k] = bool(text)
                if lengths is not None:
                    lengths[k] = len(text.decode())
            texts.append(text)
            n_cut.append(gone)
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type)
        if lengths is not None:
            columns[count_at] = pa.array(lengths, batch.schema.field(count_at).type)
        fields = [batch.schema.field(k) for k in range(width)]
        if counts:
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_cut, pa.int64())]
            fields += [pa.field("n_lines", pa.int64()), pa.field("n_cut", pa.int64())]
        out = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
        return out.filter(pa.array(keep)) if drop_emptied else out

    return map_batches(joined, run, schema)
