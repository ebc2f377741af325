"""Near-duplicate texts: what SimHash links, completed to all pairs that share 0.8 of their shingles.

Two texts are near-duplicates if they share SIMILAR (0.8) or more of all their
distinct word shingles, exactly; groups are chains of such pairs. Candidates come
three ways, and every one is verified by both texts' whole shingle sets.

1. Fingerprints of the distinct shingles, linked by the segment-popcount grids of
   ``simhash`` (Manhattan bound, then exact distance): close copies.
2. A prefix join for pairs whose bits differ more. Shingles have one order, by hash,
   with frequent ones last. Two similar sets of sizes x and y share at least
   o = 4(x + y)/9 members, and the first m of those in order stand among the first
   x - 4x/5 + m of either set. So sets meet at the shingles of such a prefix, pairs
   are counted, and only those with m common ones or more, m growing with the size,
   go on: an exact rule that a quoted passage doesn't pass.
3. Sets whose prefixes reach frequent shingles, that is texts nearly all of which is
   in many others, would crowd the cells. They form families, texts linked by the
   frequent shingles of their prefixes, and meet there: first each with its nearest
   ones, so that large groups grow together in a number of pairs that is linear,
   then every pair from different groups.

Sketches (how many of a set's shingles fall to each of 128 numbers) differ by no
more than the sets do, and leave out pairs of 2 and 3 before any text is fetched.

Scale. What is shuffled of a set is some 0.23 of its shingles in 2, packed by task
and bucket; copies of a set are left out where a task has seen them. Families are
dealt in parts: the rows of the largest group once each, the others to all parts. So
a group that holds a third of all texts costs rows in proportion; a family of many
texts that are all alike but under 0.8 costs its square in sketch comparisons, as
nothing cheaper is exact. Texts are shuffled for verified pairs only: a bitmap of
fixed size spares the rest the join. Constants below decide how to run, not what is
found. Nothing but the list of frequent shingles (HOT_ROWS) reaches the driver.

Defined results: texts without words are one group; null is empty. The document with
the smallest doc_id stays (null first; of equal ids that with the smaller text hash);
of repeated rows (equal id and text) one stays, an arbitrary one if other columns
differ. Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import NULL_ID, fresh_name, id_and_text, map_batches, marked, release, release_memory, slices, texts_utf8, written
from velora.llm.components import components
from velora.llm.simhash import by_groups, fingerprint_of, links, shingle_hashes

#: Texts are near-duplicates if they share this part of all their distinct shingles, as a fraction.
SIMILAR = (4, 5)
#: The share of texts looked at for frequent shingles, how many of these must have one, and how many are kept.
LOOK, HOT, HOT_ROWS = 64, 2, 1 << 17
#: Of so many members of a set one more common shingle is asked for.
COMMON = 32
#: Counts of a sketch.
SKETCH = 128
#: Prefix entries that a task packs at a time, and shingles for each bucket.
PACK, BUCKET = 1 << 20, 1 << 20
#: Rows of a family in one part; nearest ones that are tried first, and rounds of it.
FAMILY_ROWS, NEAREST, ROUNDS = 1024, 2, 2


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share SIMILAR of their members or more."""
    part, whole = SIMILAR
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * whole >= (len(a) + len(b) - both) * part


def sketch_of(shingles: np.ndarray) -> bytes:
    """How many of the shingles fall to each of SKETCH numbers, 255 at most."""
    return np.minimum(np.bincount((shingles >> np.uint64(32)) % np.uint64(SKETCH), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def most_apart(sizes: np.ndarray) -> np.ndarray:
    """How many members two similar sets can have that aren't in both, by the sum of their sizes."""
    part, whole = SIMILAR
    return sizes * (whole - part) // (whole + part)


class Frequent:
    """Shingles that many texts have, with their rank in the order of frequency."""

    def __init__(self, by_count: np.ndarray) -> None:
        """by_count: the most frequent one last."""
        self.rank = np.argsort(by_count, kind="stable").astype(np.int32)
        self.hashes = by_count[self.rank]

    def ranks(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles are frequent, and the ranks of those, ascending."""
        if not len(self.hashes):
            return np.zeros(len(shingles), bool), np.empty(0, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        has = self.hashes[at] == shingles
        return has, np.sort(self.rank[at[has]])

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """The other shingles in a set's prefix, how many a similar set must have of them too, and ranks of frequent ones in it.

        Without frequent ones a similar set has at least that many, if its own number is no less.
        """
        part, whole = SIMILAR
        n = len(shingles)
        least = n - -(-n * part // whole)
        has, ranks = self.ranks(shingles)
        others = shingles[~has]
        if len(others) > least:
            common = min(max(1, n // COMMON), len(others) - least)
            return others[: least + common], common, ranks[:0]
        return others, 1, ranks[: least + 1 - len(others)] if n else ranks[:0]


def frequent_shingles(docs: DataFrame, words: int, id_col: str, text_col: str) -> Frequent:
    """From a hash sample of the distinct texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text, words) for text in texts_utf8(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    sample = id_and_text(docs, id_col, text_col).select("text").where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0).dropDuplicates()
    counts = map_batches(sample, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    found = counts.orderBy(F.desc("n"), "shingle").limit(HOT_ROWS).toArrow()["shingle"].to_numpy()
    return Frequent(found[::-1].astype(np.int64).view(np.uint64))


def set_rows(docs: DataFrame, frequent: Frequent, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, set, fp, size, sketch, ranks of every row, written: set is a hash of all distinct shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps, sizes, sketches, ranks = [], [], [], [], []
        for text in texts_utf8(batch.column(1)):
            shingles = shingle_set(text, words)
            keys.append(xxhash.xxh64_intdigest(shingles.tobytes()))
            fps.append(fingerprint_of(shingles.astype(">u8")))
            sizes.append(len(shingles))
            sketches.append(sketch_of(shingles))
            ranks.append(sent.value.prefix(shingles)[2])
        columns = [batch.column(0), batch.column(2), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(ranks, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set", "fp", "size", "sketch", "ranks"])

    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return written(map_batches(texts, run, "doc_id long, text_hash long, set long, fp long, size int, sketch binary, ranks array<int>"), "set-rows")


# 2: the prefix join


def _packed(cells: np.ndarray, keys: np.ndarray, sizes: np.ndarray, common: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket, payload: the entries of each bucket, sorted by cell."""
    pack = zstandard.ZstdCompressor(level=1).compress
    bucket = (cells % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((cells, bucket))
    bucket, columns = bucket[order], [x[order] for x in (cells, keys, sizes, common)]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    payloads = [pack(b"".join(x[a:b].tobytes() for x in columns)) for a, b in zip(starts, [*starts[1:], len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _unpacked(payload: bytes) -> list[np.ndarray]:
    """Cells, keys, sizes, common of a payload."""
    raw = zstandard.decompress(payload)
    n = len(raw) // 24
    return [np.frombuffer(raw, kind, n, at * n) for kind, at in ((np.uint64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))]


def _prefixes(docs: DataFrame, frequent: Frequent, words: int, buckets: int, text_col: str) -> DataFrame:
    """bucket, payload rows of all texts' prefixes; a set that a task meets again is left out."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        entries = 0

        def flush() -> pa.RecordBatch:
            n = [len(h[0]) for h in held]
            column = lambda k, kind: np.repeat(np.array([h[k] for h in held], kind), n)
            return _packed(np.concatenate([h[0] for h in held]), column(1, np.uint64).view(np.int64), column(2, np.int32), column(3, np.int32), buckets)

        for whole in batches:
            for batch in slices(whole):
                for text in texts_utf8(batch.column(0)):
                    shingles = shingle_set(text, words)
                    key = xxhash.xxh64_intdigest(shingles.tobytes())
                    if key in seen:
                        continue
                    if len(seen) >= PACK:
                        seen.clear()
                    seen.add(key)
                    prefix, common, _ = sent.value.prefix(shingles)
                    if len(prefix):
                        held.append((prefix, key, len(shingles), common))
                        entries += len(prefix)
                    if entries > PACK:
                        yield flush()
                        held.clear()
                        entries = 0
        if held:
            yield flush()
        release_memory()

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, payload binary")


def _meetings(cells: np.ndarray, keys: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """a, b, n, least: how often two sets of a bucket meet, and how often similar ones do at least."""
    part, whole = SIMILAR
    order = np.lexsort((keys, sizes, cells))
    cells, keys, sizes, common = (x[order] for x in (cells, keys, sizes.astype(np.int64), common))
    first = np.append(True, (np.diff(cells) != 0) | (np.diff(keys) != 0))
    cells, keys, sizes, common = (x[first] for x in (cells, keys, sizes, common))
    edges = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
    stop = np.repeat(edges, np.diff(edges, prepend=0))
    at, step, held, rows = np.arange(len(cells)), 1, [], 0

    def counted() -> pa.RecordBatch:
        a, b, least = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        starts = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(np.diff(starts, append=len(a)).astype(np.int32)), pa.array(least[starts].astype(np.int32))], ["a", "b", "n", "least"])

    while len(at):
        at = at[at + step < stop[at]]
        # a cell is sorted by size, so that the next but one is too large where the next is
        at = at[sizes[at] * whole >= sizes[at + step] * part]
        if len(at):
            one, other = keys[at], keys[at + step]
            held.append((np.maximum(one, other), np.minimum(one, other), np.minimum(common[at], common[at + step])))
            rows += len(at)
        if rows > 2 * PACK:
            yield counted()
            held, rows = [], 0
        step += 1
    if held:
        yield counted()


def sharing(docs: DataFrame, frequent: Frequent, words: int, shingles: int, text_col: str) -> DataFrame:
    """Pairs (a, b) of all sets that can be similar by their prefixes without frequent shingles; shingles: how many there are."""
    buckets = max(1024, min(1 << 24, shingles // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != last and held:
                    yield from _meetings(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                last = bucket
                held.append(_unpacked(payload.as_py()))
        if held:
            yield from _meetings(*(np.concatenate(x) for x in zip(*held)))
        release_memory()

    packed = _prefixes(docs, frequent, words, buckets, text_col).repartition("bucket").sortWithinPartitions("bucket")
    met = packed.mapInArrow(run, "a long, b long, n int, least int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't differ too much."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set").alias(end), F.col("sketch").alias(f"sketch_{end}"), F.col("size").alias(f"size_{end}")), end)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for k in (2, 3))
        sizes = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
        out = batch.select([0, 1]).filter(pa.array(np.abs(x - y).sum(1) <= most_apart(sizes)))
        return out if out.num_rows else None

    return map_batches(pairs.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b"), run, "a long, b long")


# 3: families


def families(sets: DataFrame) -> DataFrame:
    """set, family, size, sketch of the sets that have frequent shingles in their prefixes, written."""
    hot = sets.where(F.size("ranks") > 0)
    steps = F.transform(F.sequence(F.lit(1), F.size("ranks") - 1), lambda k: F.struct(F.get("ranks", k - 1).cast("long").alias("a"), F.get("ranks", k).cast("long").alias("b")))
    edges = hot.where(F.size("ranks") > 1).select(F.explode(steps).alias("e")).select("e.a", "e.b").distinct()
    labels = components(edges, "families").select(F.col("node").alias("rank"), "label")
    own = hot.withColumn("first", F.get("ranks", F.lit(0)).cast("long"))
    named = own.join(labels, own["first"] == labels["rank"], "left").select("set", F.coalesce("label", "first").alias("family"), "size", "sketch")
    return written(named, "families")


def _apart(sketches: np.ndarray, sizes: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """By how much the sketches of others differ from that of k; where that or the sizes are too far apart, a very large number."""
    part, whole = SIMILAR
    far = np.abs(sketches[others] - sketches[k]).sum(1)
    small, large = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
    return np.where((small * whole >= large * part) & (far <= most_apart(small + large)), far, 1 << 30)


def _family_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    sketches = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [sketches, batch.column(6).to_numpy(zero_copy_only=False)]


def nearest_ones(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each set outside its family's largest group with the NEAREST others of other groups in its part."""
    major = _majors(members)
    dealt = members.join(major, "family").withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "set"), F.col("parts")).cast("int"))
    dealt = dealt.select("family", "part", "set", "label", "size", "sketch", (F.col("label") == F.col("major")).alias("in_major"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, keys, label, sizes, sketches, in_major), starts, ends in by_groups(batches, _family_columns):
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                group = np.arange(s, e)
                for k in group[~in_major[s:e]]:
                    others = group[label[s:e] != label[k]]
                    far = _apart(sketches, sizes.astype(np.int64), k, others)
                    for j in others[np.argsort(far, kind="stable")[:NEAREST]][np.sort(far)[:NEAREST] < 1 << 30]:
                        a.append(max(keys[k], keys[j]))
                        b.append(min(keys[k], keys[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("family", "part").sortWithinPartitions("family", "part", "set").mapInArrow(run, "a long, b long")


def _majors(members: DataFrame) -> DataFrame:
    """family, parts, major: the label of most members, of each family of more than one label."""
    counts = members.groupBy("family", "label").agg(F.count("*").alias("n"))
    whole = counts.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"))
    return whole.where("labels > 1").select("family", F.ceil(F.col("n") / FAMILY_ROWS).cast("int").alias("parts"), F.col("top.label").alias("major"))


def all_others(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of a family's sets in different groups whose sketches and sizes allow it.

    Sets of the largest group are in one part each, others in all.
    """
    major = _majors(members)
    own = F.pmod(F.xxhash64(F.lit(-1), "set"), F.col("parts")).cast("int")
    dealt = members.join(major, "family").withColumn("in_major", F.col("label") == F.col("major")).withColumn("own", own)
    to = F.when(F.col("in_major"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("part", F.explode(to)).select("family", "part", "set", "label", "size", "sketch", F.when(F.col("in_major"), -1).otherwise(F.col("own")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, part, keys, label, sizes, sketches, own), starts, ends in by_groups(batches, _family_columns):
            for s, e in zip(starts.tolist(), ends.tolist()):
                group = np.arange(s, e)
                for k in group[own[s:e] >= 0]:
                    # two sets outside the largest group meet in the part of the one with the smaller key
                    with_k = (label[s:e] != label[k]) & ((own[s:e] < 0) | (keys[s:e] > keys[k]) & (own[k] == part[s]))
                    others = group[with_k]
                    others = others[_apart(sketches, sizes.astype(np.int64), k, others) < 1 << 30]
                    if len(others):
                        one = np.full(len(others), keys[k])
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, keys[others])), pa.array(np.minimum(one, keys[others]))], ["a", "b"])

    return dealt.repartition("family", "part").sortWithinPartitions("family", "part", "set").mapInArrow(run, "a long, b long")


# All of it


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts' whole shingle sets are similar, written.

    sets(set, least_id, least_hash) tells a document that has the set.
    """
    pairs = written(pairs.distinct(), "candidate-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(sets.join(nodes, F.col("set") == F.col("node")).select("node", "least_id", "least_hash"), "candidate-nodes")
    texts = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = texts.where(marked(wanted.select("least_hash"), F.col("hash")))
    texts = texts.join(wanted, (F.col("id") == F.col("least_id")) & (F.col("hash") == F.col("least_hash"))).select("node", "text")
    # repeated rows have equal ids and texts; text hashes and ids that agree by chance don't
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, last, mine = [], None, None
        for a, one, other in zip(batch.column(0).to_pylist(), texts_utf8(batch.column(2)), texts_utf8(batch.column(3))):
            if a != last:
                last, mine = a, shingle_set(one, words)
            keep.append(similar(mine, shingle_set(other, words)))
        out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        return out if out.num_rows else None

    found = written(map_batches(both, run, "a long, b long"), "similar-pairs")
    release(pairs, wanted, texts)
    return found


def fingerprint_links(sets: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked: one for each set or link."""
    firsts = written(sets.groupBy("fp").agg(F.min("set").alias("first")), "set-fingerprints")
    equal = sets.join(firsts, "fp").where(F.col("set") != F.col("first")).select(F.col("set").alias("a"), F.col("first").alias("b"))
    linked = links(firsts.select("fp"), max_bits, direct=True)
    for end in ("a", "b"):
        linked = linked.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"set_{end}")), end)
    return equal.unionByName(linked.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their set, itself where it has none."""
    named = labels.select(F.col("node").alias("_set"), "label")
    return rows.join(named, rows["set"] == named["_set"], "left").drop("_set").withColumn("label", F.coalesce("label", "set"))


def similar_groups(docs: DataFrame, *, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, label of every row; rows have one label if a chain of similar texts leads from one to the other."""
    frequent = frequent_shingles(docs, words, id_col, text_col)
    rows = set_rows(docs, frequent, words, id_col, text_col)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_hash")).alias("w")
    sets = rows.groupBy("set").agg(least, *(F.first(c).alias(c) for c in ("fp", "size", "sketch", "ranks")))
    sets = written(sets.select("set", F.col("w.id").alias("least_id"), F.col("w.text_hash").alias("least_hash"), "fp", "size", "sketch", "ranks"), "distinct-sets")
    shingles = sets.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0

    check = lambda pairs: verified(pairs, sets, docs, words, id_col, text_col)
    found = check(fingerprint_links(sets, max_bits).unionByName(_alike(sharing(docs, frequent, words, shingles, text_col), sets)))
    labels = components(found, "similar")
    crowd = families(sets)
    if not crowd.isEmpty():
        for turn in range(ROUNDS + 1):
            members = written(_labelled(crowd, labels), "family-members")
            pairs = nearest_ones(members, turn) if turn < ROUNDS else all_others(members)
            more = check(pairs)
            release(members)
            if more.isEmpty():
                continue
            found = found.unionByName(more)
            labels = components(found, "similar")
    return _labelled(rows, labels).select("doc_id", "text_hash", "label")


def deduplicated(docs: DataFrame, *, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each near-duplicate group stays."""
    rows = similar_groups(docs, words=words, max_bits=max_bits, id_col=id_col, text_col=text_col)
    fates = written(rows.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_hash").agg(F.count("*").alias("n"), F.min("label").alias("label")), "near-groups")
    stay = fates.groupBy(F.col("label").alias("of")).agg(F.min(F.struct("id", "text_hash")).alias("w"))
    told = fates.join(stay, F.col("label") == F.col("of")).select("id", "text_hash", "n", ((F.col("id") == F.col("w.id")) & (F.col("text_hash") == F.col("w.text_hash"))).alias("stays"))
    # documents that go, and those of which repeats go; all others are kept where they are read
    told = written(told.where("not stays or n > 1").select("id", "text_hash", "stays"), "near-fates")
    names = {c: fresh_name(docs, c) for c in told.columns}
    told = told.select(*(F.col(c).alias(n) for c, n in names.items()))
    own_id, own_hash = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def looked(has: bool) -> DataFrame:
        hit: Column = marked(told.select(F.xxhash64(names["id"], names["text_hash"])), F.xxhash64(own_id, own_hash))
        return docs.where(hit if has else ~hit)

    joined = looked(True).join(told, (own_id == F.col(names["id"])) & (own_hash == F.col(names["text_hash"])), "left")
    untouched = joined.where(F.col(names["stays"]).isNull()).select(*columns)
    once = joined.where(names["stays"]).dropDuplicates([names["id"], names["text_hash"]]).select(*columns)
    return looked(False).select(*columns).unionByName(untouched).unionByName(once)
