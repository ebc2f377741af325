"""Token-id output as a content-addressed store.

Method. Every text is encoded, and the end id appended. A rolling polynomial
hash over the last 16 ids cuts the id stream of a document into chunks (on
average 512 ids, from 64 to 4096), so equal passages give equal chunks wherever
they stand. A chunk's address is the BLAKE2b digest of its little-endian ids.
The store has three tables of Parquet files:

``chunks``    address, n, payload: every distinct chunk once, as 16-bit ids if
              the vocabulary allows and 32-bit ids else, zstd-packed
``recipes``   doc_id, part, start, n_tokens, addresses, lengths, root: for each
              document the chunks that make it up, where it starts among its part's
              ids, and the Merkle root of its addresses; a part is a range of doc_id
              and a file, and parts and the rows in them are in ascending doc_id order
``manifest``  part, documents, tokens, offset, root: for each part where it starts in
              the stream of all ids, and the Merkle root over its documents' roots

Reading back unpacks every stored chunk, checks it against its address, joins
recipes with what the chunks hold, checks lengths and Merkle roots of documents, and
recomputes each part's root, documents and ids against the manifest, so that a lost or
exchanged recipe shows. A document's CRC-32 is put together from its chunks' CRCs, so
the ids themselves are never shuffled for it.

Scale: texts are encoded once, and the staged rows hold a chunk's payload only
where their task sees it first; so a chunk that a third of all documents have is
shuffled once per task. Parts are ranges of (doc_id, ids' hash, row), so that an id
that very many rows have, or none, is split too; their totals and roots, one row per
part, are all that reaches the driver. The join on the address is between rows of some
40 bytes and can be split if skewed. What was staged is removed at the end.

Defined results: a null text is empty, that is the end id alone. Documents with
one doc_id follow each other by the hash of their ids, null ids come first. An
empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.llm.common import SLICE, discard, gathered, id_and_text, no_cycles, release_memory, shared_folder, slices

WIDTH, MEAN, LEAST, MOST = 16, 512, 64, 4096
MULTIPLIER = 0x9E3779B1
DIGEST = 16
#: Distinct pieces that a worker keeps, those of its last batch that stay beyond that, and addresses; less costs time or payload only.
CACHE_WORDS, CACHE_PIECES, CACHED_LENGTH, CACHE_ADDRESSES = 500_000, 150_000, 16, 400_000
#: Pieces that go to the library as one string.
CALL = 1000
#: The byte-level split pattern, fixed by the tokenizer; for letters below U+0250 this is its \p{L}, \p{N} form.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
#: Texts with white space beside a space, or characters that the two forms, or their notions of white space, may class differently.
_UNSURE = "^ | $| [ \t\n\v\f\r\\x{a0}]|[\t\n\v\f\r\\x{a0}] |[\\x1c-\\x1f\\x{85}\\x{b2}\\x{b3}\\x{b9}\\x{bc}-\\x{be}\\x{250}-\\x{10ffff}]"
_NO_WORD = "^$|^[ \t\n\v\f\r\\x{a0}]"
#: What such a tokenizer's file says beside its vocabulary.
_KNOWN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False}}
_POLY = np.uint64(0xEDB88320)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(seen))}


def splits_as_known(tokenizer) -> bool:
    """Whether the tokenizer's pieces are those of the pattern above, over a plain byte-level vocabulary."""
    told = json.loads(tokenizer.to_str())
    fits = lambda part, want: part == want if not isinstance(want, dict) else isinstance(part, dict) and all(fits(part.get(k), v) for k, v in want.items())
    return fits(told, _KNOWN) and not told.get("truncation") and not told.get("padding") and not told["model"].get("ignore_merges")


class Encoder:
    """The tokenizers library over whole texts, each distinct piece encoded once.

    Where the tokenizer is of the known kind, its split pattern starts a piece at
    every single space between two other characters, and the library's model encodes
    pieces one by one. So texts are cut there; the distinct words of a batch are cut into
    pieces as one string, and pieces that aren't remembered go to the library's model as
    one string too, which it parts at the letters that stand for spaces. A text
    that has other white space beside a space, an added token's string, or characters
    for which the pattern above might differ from the tokenizer's goes to the library
    whole, and so does every text if the tokenizer is of another kind.
    """

    def __init__(self, path: str, end_id: int) -> None:
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known = splits_as_known(self.tokenizer)
        self.model = self.tokenizer.model
        # the library's own memory of words only costs time where no word comes twice
        getattr(self.model, "_resize_cache", lambda _: None)(0)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.unsure = "|".join([_UNSURE, *added])
        self.letters = byte_letters()
        # the same model behind a split at the letter that stands for a space; ids that begin with it begin a piece
        self.parts = Tokenizer(self.model)
        self.parts.pre_tokenizer = pre_tokenizers.Split(self.letters[32], "merged_with_next")
        vocabulary = self.tokenizer.get_vocab()
        self.heads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.heads[[k for token, k in vocabulary.items() if token.startswith(self.letters[32])]] = True
        self.pieces: dict[str, bytes] = {}
        self.end_id = end_id
        self.end = end_id.to_bytes(4, "little")
        self.wide = max(self.tokenizer.get_vocab_size(), end_id + 1) > 65536

    def _whole(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.end_id], "<u4")

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, little-endian."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the pieces, those behind a space by few calls."""
        out = [b"" if p[0] == " " else self._piece(p) for p in pieces]
        spaced = [k for k, p in enumerate(pieces) if p[0] == " "]
        for a in range(0, len(spaced), CALL):
            call = spaced[a : a + CALL]
            text = "".join([pieces[k] for k in call]).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            begins = (4 * np.flatnonzero(self.heads[ids])).tolist()
            if len(begins) == len(call):
                raw = ids.tobytes()
                told = [raw[a:b] for a, b in zip(begins, [*begins[1:], len(raw)])]
            else:  # a vocabulary without that letter
                told = [self._piece(pieces[k]) for k in call]
            for k, own in zip(call, told):
                out[k] = own
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the distinct pieces, from memory where they are there."""
        found = list(map(self.pieces.get, pieces))
        if None in found:
            new = [p for p, ids in zip(pieces, found) if ids is None]
            told = dict(zip(new, self._new(new)))
            found = [told[p] if ids is None else ids for p, ids in zip(pieces, found)]
            if len(self.pieces) + len(new) > CACHE_WORDS:
                # those that come first in a batch are mostly the frequent ones
                told, self.pieces = dict(zip(pieces[:CACHE_PIECES], found)), {}
            self.pieces.update((p, ids) for p, ids in told.items() if len(p) <= CACHED_LENGTH)
        return found

    def _words(self, words: pa.Array, heads: list[str]) -> list[bytes]:
        """Ids of each of the words behind a space, and of each of the heads, which have none before them."""
        # only heads begin with white space or are empty; as words they aren't used, and they would join their neighbour
        words = pc.if_else(pc.match_substring_regex(words, _NO_WORD), ".", words)
        pieces = _PIECES(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py())
        behind = len(pieces)
        begins = [behind] * len(heads)
        for k, head in enumerate(heads):
            begins[k] = len(pieces)
            pieces += _PIECES(head)
        listed = pa.array(pieces, pa.string())
        del pieces
        spaced = np.flatnonzero(pc.starts_with(listed.slice(0, behind), " ").to_numpy(zero_copy_only=False))
        coded = listed.dictionary_encode()
        del listed
        flat, ends = gathered(self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy())
        at = (4 * np.concatenate([[0], ends])[np.concatenate([spaced, begins])]).tolist()
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls, 32-bit, with the end id."""
        plain = pc.invert(pc.match_substring_regex(texts, self.unsure)) if self.known else pa.array([False] * len(texts))
        out: list[np.ndarray | None] = [None if p else self._whole(t.as_py()) for p, t in zip(plain.to_pylist(), texts)]
        lists = pc.split_pattern(texts.filter(plain), " ")
        if not len(lists):
            return out
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, values = offsets - offsets[0], lists.flatten()
        heads = values.take(pa.array(offsets[:-1])).to_pylist()
        coded = values.dictionary_encode()
        # of the words of a batch, with the texts' first words, which have no space before them, and the end id
        ids = [*self._words(coded.dictionary, heads), self.end]
        at = coded.indices.to_numpy().copy()
        at[offsets[:-1]] = len(ids) - 1 - len(heads) + np.arange(len(heads))
        at = np.insert(at, offsets[1:], len(ids) - 1)
        flat, ends = gathered(ids, at)
        bounds = ends[offsets[1:] + np.arange(len(heads))]
        encoded = iter(np.split(flat, bounds[:-1]))
        return [next(encoded) if x is None else x for x in out]


#: A Python worker runs many tasks; its encoder, with the words it knows, stays.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Behind which ids a rolling hash of the last 16 allows a cut."""
    h, k, power = ids.astype(np.uint32), 1, MULTIPLIER
    while k < WIDTH:
        h[k:] += h[:-k] * np.uint32(power)
        k, power = 2 * k, power * power % 2**32
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h * np.uint32(MULTIPLIER)) >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    """Where chunks of a text of n ids end, from its marks."""
    out, last = [], 0
    for end in (*marks, n):
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n > last:
            last = end
            out.append(end)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end, from a rolling hash of the last 16 ids."""
    return _ends(_marks(ids).tolist(), len(ids))


def cuts_of(texts: list[np.ndarray]) -> list[list[int]]:
    """cuts() of each text, hashed as one: what stands before a text reaches its first ids only, which are too few for a chunk."""
    if not texts:
        return []
    marks = _marks(np.concatenate(texts))
    bounds = np.cumsum([0, *map(len, texts)])
    at = np.searchsorted(marks, bounds, "right").tolist()
    return [_ends((marks[a:b] - start).tolist() if a < b else [], len(ids)) for a, b, start, ids in zip(at, at[1:], bounds, texts)]


def address(ids: np.ndarray) -> bytes:
    """A chunk's digest."""
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4"), digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary hash tree; an odd node goes up as it is, leaves and nodes are told apart."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [bytes(DIGEST)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Packer:
    """zstd with its working memory kept between chunks."""

    def __init__(self, wide: bool = False) -> None:
        self.kind = "<u4" if wide else "<u2"
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.decompress = zstandard.ZstdDecompressor().decompress

    def pack(self, ids: np.ndarray) -> bytes:
        return self.compress(ids.astype(self.kind).tobytes())

    def unpack(self, payload: bytes, n: int) -> np.ndarray:
        return unpack(payload, n, self.decompress)


def unpack(payload: bytes, n: int, decompress=zstandard.decompress) -> np.ndarray:
    raw = decompress(payload)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo CRC-32's."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    one = np.uint64(1)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, _POLY, np.uint64(0))
    return out


def shifted_crc(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to that of a whole in which some bytes stand behind it."""
    out = crc.astype(np.uint64)
    power = np.full(len(out), 1 << 23, np.uint64)  # x^8
    rest = behind.astype(np.uint64)
    while rest.any():
        odd = (rest & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], power[odd])
        power = np.full(len(out), _times(power[:1], power[:1])[0], np.uint64)
        rest = rest >> np.uint64(1)
    return out


def _staged(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, tie, n_tokens, addresses, lengths, root, fresh: payloads of addresses new to the task."""

    def lists(parts: list[list], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(tokenizer_path, end_id), set()
        pack = Packer(encoder.wide).pack
        with no_cycles():
            yield from stored(batches, encoder, seen, pack)
        release_memory()

    def stored(batches: Iterator[pa.RecordBatch], encoder: Encoder, seen: set[bytes], pack: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4 * SLICE):
                names, sizes, fresh, roots, totals = [], [], [], [], []
                encoded = encoder.encode(pc.fill_null(batch.column(1), ""))
                for ids, ends in zip(encoded, cuts_of(encoded)):
                    chunks = [ids[a:b] for a, b in zip([0, *ends], ends)]
                    own = list(map(address, chunks))
                    new = []
                    for name, chunk in zip(own, chunks):
                        if name not in seen:
                            if len(seen) > CACHE_ADDRESSES:
                                seen.clear()
                            seen.add(name)
                            new.append((name, len(chunk), pack(chunk)))
                    names.append(own)
                    sizes.append(list(map(len, chunks)))
                    fresh.append(new)
                    roots.append(merkle_root(own))
                    totals.append(len(ids))
                flat = [x for new in fresh for x in new]
                packs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.binary()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.binary())], ["address", "n", "payload"])
                ties = pa.array([int.from_bytes(r[:8], "big", signed=True) for r in roots], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ties, pa.array(totals, pa.int64()), lists(names, pa.array([x for own in names for x in own], pa.binary())), lists(sizes, pa.array([x for own in sizes for x in own], pa.int32())), pa.array(roots, pa.binary()), lists(fresh, packs)],
                    ["doc_id", "tie", "n_tokens", "addresses", "lengths", "root", "fresh"],
                )

    return docs.mapInArrow(run, "doc_id long, tie long, n_tokens long, addresses array<binary>, lengths array<int>, root binary, fresh array<struct<address: binary, n: int, payload: binary>>")


def _parts(recipes: DataFrame) -> DataFrame:
    """part, documents, tokens, root of the recipes' parts, recomputed from what they hold."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows come sorted by part and start; the tree needs its part's roots only
        part, roots, tokens, done = None, [], 0, []
        for batch in batches:
            for p, root, n in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and roots:
                    done.append((part, len(roots), tokens, merkle_root(roots)))
                    roots, tokens = [], 0
                part = p
                roots.append(root)
                tokens += n
        if roots:
            done.append((part, len(roots), tokens, merkle_root(roots)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], ["part", "documents", "tokens", "root"])

    ordered = recipes.select("part", "start", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "start")
    return ordered.select("part", "root", "n_tokens").mapInArrow(fold, "part int, documents long, tokens long, root binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, part_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode documents and write the store at path."""
    spark = docs.sparkSession
    staging = f"{path}/staging"
    _staged(id_and_text(docs, id_col, text_col), tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    packs = staged.select(F.explode("fresh").alias("f")).select("f.*")
    packs.groupBy("address").agg(F.first("n").alias("n"), F.first("payload").alias("payload")).write.option("compression", "uncompressed").parquet(f"{path}/chunks")

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), *batch.columns[2:]], ["doc_id", "part", "start", "n_tokens", "addresses", "lengths", "root"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = staged.agg(F.count("*")).first()[0]
    ranged = staged.select("doc_id", "n_tokens", "addresses", "lengths", "root", "tie", "row").repartitionByRange(max(1, rows // part_rows), *order).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", F.spark_partition_id().alias("part"), "n_tokens", "addresses", "lengths", "root")
    ranged.mapInArrow(started, "doc_id long, part int, start long, n_tokens long, addresses array<binary>, lengths array<int>, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")

    before, manifest = 0, []
    for r in sorted(_parts(spark.read.parquet(f"{path}/recipes")).collect(), key=lambda r: r.part):
        manifest.append((r.part, r.documents, r.tokens, before, r.root))
        before += r.tokens
    spark.createDataFrame(manifest, "part int, documents long, tokens long, offset long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    discard(spark, staging)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """part, offset, complete of every part of the manifest: whether its recipes are all there and as they were."""
    manifest = spark.read.parquet(f"{path}/manifest")
    now = _parts(spark.read.parquet(f"{path}/recipes")).select(F.col("part").alias("p"), F.col("documents").alias("d"), F.col("tokens").alias("t"), F.col("root").alias("r"))
    same = (F.col("documents") == F.col("d")) & (F.col("tokens") == F.col("t")) & (F.col("root") == F.col("r"))
    return manifest.join(now, F.col("part") == F.col("p"), "left").select("part", "offset", F.coalesce(same, F.lit(False)).alias("complete"))


def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """address, n, crc, sound of every stored chunk, from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Packer().unpack
        for batch in batches:
            rows = []
            for name, n, payload in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = unpack(payload.as_py(), n.as_py())
                rows.append((len(ids), zlib.crc32(ids.tobytes()), address(ids) == name.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], ["address", "held", "crc", "sound"])

    return spark.read.parquet(f"{path}/chunks").select("address", "n", "payload").mapInArrow(run, "address binary, held int, crc long, sound boolean")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of every document, from the stored files."""

    @F.pandas_udf("long")
    def part_crc(crc: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series(shifted_crc(crc.to_numpy(), behind.to_numpy()).astype(np.int64))

    @F.pandas_udf("boolean")
    def same_root(addresses: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle_root([bytes(x) for x in a]) == bytes(r) for a, r in zip(addresses, root)])

    @F.pandas_udf("array<long>")
    def bytes_behind(lengths: pd.Series) -> pd.Series:
        return pd.Series([4 * (np.sum(x) - np.cumsum(x, dtype=np.int64)) for x in lengths])

    recipes = spark.read.parquet(f"{path}/recipes").withColumns({"rooted": same_root("addresses", "root"), "behind": bytes_behind("lengths")})
    # a document has its end id at least, so that starts are unique
    steps = recipes.select("doc_id", "part", "start", "n_tokens", "rooted", F.explode(F.arrays_zip("addresses", "lengths", "behind")).alias("c"))
    steps = steps.select("doc_id", "part", "start", "n_tokens", "rooted", F.col("c.addresses").alias("address"), F.col("c.lengths").alias("length"), F.col("c.behind").alias("behind"))
    facts = chunk_facts(spark, path).withColumnRenamed("address", "stored")
    joined = steps.join(facts, steps.address == facts.stored, "left")
    told = joined.select("doc_id", "part", "start", "n_tokens", "rooted", "held", "sound", "length", part_crc("crc", "behind").alias("crc_part"))
    sound = F.every(F.coalesce(F.col("sound") & F.col("rooted") & (F.col("held") == F.col("length")), F.lit(False))) & (F.sum("held") == F.col("n_tokens"))
    whole = told.groupBy("doc_id", "part", "start", "n_tokens").agg(F.bit_xor("crc_part").alias("ids_crc32"), sound.alias("sound"))
    parts = audit(spark, path).withColumnRenamed("part", "of_part")
    return whole.join(parts, whole.part == parts.of_part, "left").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", (F.col("sound") & F.col("complete")).alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) of every document; for readers of whole documents. A lost or damaged chunk is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for n_tokens, cs in zip(frame["n_tokens"], frame["cs"]):
                chunks = sorted(((c["at"], bytes(c["address"]), unpack(bytes(c["payload"]), c["n"])) for c in cs if c["payload"] is not None), key=lambda c: c[0])
                if sum(len(x) for _, _, x in chunks) != n_tokens or any(address(x) != name for _, name, x in chunks):
                    raise ValueError("a chunk of the store is lost or damaged")
                out.append(np.concatenate([x for _, _, x in chunks]).astype(np.int64))
            frame["ids"] = out
            yield frame[["doc_id", "start", "ids"]]

    steps = spark.read.parquet(f"{path}/recipes").select("doc_id", "part", "start", "n_tokens", F.posexplode("addresses").alias("at", "address"))
    chunks = spark.read.parquet(f"{path}/chunks")
    whole = steps.join(chunks, "address", "left").groupBy("doc_id", "part", "start", "n_tokens").agg(F.collect_list(F.struct("at", "address", "n", "payload")).alias("cs"))
    offsets = spark.read.parquet(f"{path}/manifest").select(F.col("part").alias("of_part"), "offset")
    placed = whole.join(offsets, whole.part == offsets.of_part).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "cs")
    return placed.mapInPandas(run, "doc_id long, start long, ids array<long>")


def store_of(docs: DataFrame, tokenizer_path: str, *, end_id: int) -> str:
    """Write a store in the shared folder and give its path."""
    path = shared_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id=end_id)
    return path
