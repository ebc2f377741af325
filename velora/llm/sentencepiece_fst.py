"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Method. A model file is compiled into transducers. The normaliser's states are the
trie of the model's character map (leftmost longest match; other characters stand for
themselves), and it puts the space mark in front and in place of spaces. The lexicon
maps each piece's characters to its id: a trie with an arc back to the start for each
piece, whose weight is the negative score in a unigram model. Byte fallback maps a
character that no piece holds to the ids of its UTF-8 bytes, at a weight above every
piece's. They are composed with an input lazily, and encoding is the shortest path
through the composition in the tropical semiring (weights add along a path, the least
path wins), found best first; of equal weights the path that has come further is
followed first. It is one search for both kinds of model.

For a BPE model scores do not add up along a path; there pieces have weight 0, and the
composition has one more factor, an automaton over neighbouring pieces with weight 0
where merging the two pieces' characters by rank gives back just these two
pieces, and infinity elsewhere. Merges inside two neighbours never depend on
pieces further away until one crosses a boundary, so a path is free of infinite
weights if and only if it is the merge order's segmentation, and each prefix has
exactly one such path: the shortest path is the model's encoding. A pair's weight
is found by running both pieces' merges side by side and watching for a better
merge across, only when the search comes to it, and is remembered.

The composition of a text falls apart between words (no piece has the space mark
after another character), so the distinct words of a batch are composed one by one,
and frequent ones are remembered; both memories are bounded. Work is per row, without
a shuffle. A model with user-defined pieces is refused.

Defined results: a null or empty text has no ids; decoding null gives the empty
text. Ids outside the model decode to nothing. Repeated rows give equal rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from velora.llm.common import gathered, id_and_text, map_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Words and pairs that a worker remembers, and the longest word of these.
CACHE_WORDS, CACHE_PAIRS, CACHED_LENGTH = 300_000, 800_000, 12
#: In place of a piece: before the first one, and a character that no piece has.
NONE, FALLBACK = -2, -1
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array over UTF-8 bytes, then the replacements, each ended by a zero byte.

    A unit has its label in the low byte, a leaf mark in bit 8, and its offset from bit 10, shifted by 8 if bit 9 is set.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, labels = units & (1 << 31 | 255), np.arange(1, 256)
    rules, open_nodes = {}, [(int(offset[0]), b"")]
    while open_nodes:
        node, key = open_nodes.pop()
        at = node ^ labels
        for k in np.flatnonzero((at < len(units)) & (label[np.minimum(at, len(units) - 1)] == labels)).tolist():
            unit = int(at[k])
            below, longer = unit ^ int(offset[unit]), key + bytes([k + 1])
            open_nodes.append((below, longer))
            if units[unit] >> 8 & 1:
                start = int(units[below] & (1 << 31) - 1)
                rules[longer.decode()] = texts[start : texts.index(b"\0", start)].decode()
    return rules


class Normaliser:
    """The transducer from a text to the lexicon's characters."""

    def __init__(self, spec: dict[int, int | bytes]) -> None:
        self.dummy_prefix, self.squeeze, self.mark = (spec.get(k, 1) == 1 for k in (3, 4, 5))
        # a state has its arcs by character, and what it gives out or None
        self.start: dict[str, list] = {}
        for key, out in character_map(spec.get(2, b"")).items():
            arcs, state = self.start, [{}, None]
            for c in key:
                state = arcs.setdefault(c, [{}, None])
                arcs = state[0]
            state[1] = out

    def _mapped(self, text: str) -> str:
        """Through the character map: the longest match from the left, other characters as they are."""
        out, i = [], 0
        while i < len(text):
            state, j, best = self.start.get(text[i]), i + 1, (text[i], i + 1)
            while state is not None:
                if state[1] is not None:
                    best = state[1], j
                state, j = state[0].get(text[j]) if j < len(text) else None, j + 1
            out.append(best[0])
            i = best[1]
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.start:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.mark else text


class Model:
    """A compiled model."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or any(t == USER_DEFINED for _, _, t in self.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are compiled")
        self.normalise = Normaliser(normaliser)
        usable = [(i, p, s) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL]
        self.id_of = {p: i for i, p, _ in usable}
        self.score = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        # every path has the input's characters, so that a weight for each of them changes no order and makes all weights positive
        self.lift = max([0.0, *(s / len(p) for _, p, s in usable)])
        self.unknown_weight = 10.0 - min((s for _, _, s in usable), default=0.0)
        # the prefix automaton: a state has its arcs by character, and its piece or -1
        self.start: dict[str, list] = {}
        for i, p, _ in usable:
            arcs, state = self.start, [{}, -1]
            for c in p:
                state = arcs.setdefault(c, [{}, -1])
                arcs = state[0]
            state[1] = i
        self.separable = not any(SPACE in p.lstrip(SPACE) for _, p, _ in usable)
        # characters that some piece has next to each other; elsewhere a lattice falls apart too
        self.joined = {p[k : k + 2] for _, p, _ in usable for k in range(len(p) - 1)}
        self.text_of = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in self.pieces]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple[tuple, tuple] | None] = {}

    def _history(self, piece: int) -> tuple[tuple, tuple] | None:
        """How a piece's last and first symbols come about by merging its characters.

        Each as (score, symbol) events in merge order; a merge elsewhere in the
        piece has the symbol as it was. None if merging doesn't give the piece.
        """
        if piece not in self.histories:
            symbols = list(self.pieces[piece][0])
            first, last = [(0.0, symbols[0])], [(0.0, symbols[-1])]
            while len(symbols) > 1:
                scores = [self._merge_score(a + b) for a, b in zip(symbols, symbols[1:])]
                best = max(scores)
                if best == -np.inf:
                    break
                k = scores.index(best)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                first.append((best, symbols[0]))
                last.append((best, symbols[-1]))
            self.histories[piece] = (tuple(last), tuple(first)) if len(symbols) == 1 else None
        return self.histories[piece]

    def _merge_score(self, symbol: str) -> float:
        piece = self.id_of.get(symbol)
        return -np.inf if piece is None else self.score[piece]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces in a row gives these two pieces."""
        a, b = self._history(left), self._history(right)
        if a is None or b is None:
            return False
        a, b, i, j = a[0], b[1], 0, 0
        while True:
            across = self._merge_score(a[i][1] + b[j][1])
            mine = a[i + 1][0] if i + 1 < len(a) else -np.inf
            theirs = b[j + 1][0] if j + 1 < len(b) else -np.inf
            # of equal scores the leftmost merge comes first
            if across > -np.inf and across > mine and across >= theirs:
                return False
            if mine == theirs == -np.inf:
                return True
            if mine >= theirs:
                i += 1
            else:
                j += 1

    def _arcs(self, word: str, i: int) -> list[tuple[int, int]]:
        """The lattice's arcs from a position: (piece, end), shorter ones first; FALLBACK where no piece has the character."""
        out: list[tuple[int, int]] = []
        state, j, n = self.start.get(word[i]), i, len(word)
        if state is None or state[1] < 0:
            out.append((FALLBACK, i + 1))
        while state is not None:
            j += 1
            if state[1] >= 0:
                out.append((state[1], j))
            state = state[0].get(word[j]) if j < n else None
        return out

    def _fits(self, left: int, piece: int) -> bool:
        """Whether the arc of a piece behind another (below zero: behind none) has weight zero."""
        if piece < 0:
            return True
        if left < 0:
            return self._history(piece) is not None
        key = left << 20 | piece
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            fits = self.pairs[key] = self._stays_apart(left, piece)
        return fits

    def _least_path(self, word: str) -> list[tuple[int, int]]:
        """The path of least weight through the composition, as (piece, end), by best-first search.

        A state is a position, in a BPE model with the piece before it. Steps are
        queued by a weight that is no more than their own, which is found when it is
        their turn.
        """
        n, bpe, score, lift = len(word), self.bpe, self.score, self.lift
        steps: list[tuple[int, int, int]] = [(NONE, 0, -1)]  # piece, end, step before
        queue: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # weight, -end, step
        done: set[int | tuple[int, int]] = set()
        while True:
            weight, _, k = heappop(queue)
            piece, at, before = steps[k]
            state = (piece, at) if bpe else at
            if state in done or bpe and before >= 0 and not self._fits(steps[before][0], piece):
                continue
            if at == n:
                break
            done.add(state)
            for step, end in self._arcs(word, at):
                own = 0.0 if bpe else lift * (end - at) + (self.unknown_weight if step < 0 else -score[step])
                steps.append((step, end, k))
                heappush(queue, (weight + own, -end, len(steps) - 1))
        out = []
        while before >= 0:
            out.append((piece, at))
            piece, at, before = steps[before]
        return out[::-1]

    def shortest_path(self, word: str) -> list[int]:
        """The ids on the shortest path through a normalised word's lattice."""
        out: list[int] = []
        begin, last = 0, NONE
        for piece, end in self._least_path(word):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in word[begin:end].encode())
            elif last != FALLBACK:  # unknown characters in a row are one piece
                out.append(self.unknown)
            begin, last = end, piece
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, 32-bit."""
        normal = self.normalise(text)
        words = _WORDS.findall(normal) if self.separable else [normal] if normal else []
        return np.array([i for w in words for i in self.shortest_path(w)], "<u4")

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        known = self.normalise
        apart = self.separable and known.dummy_prefix and known.mark and not known.squeeze and not known.start
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}")) if apart else pa.array([False] * len(texts))
        out: list[np.ndarray | None] = [None if p else self.encode(t.as_py()) for p, t in zip(plain.to_pylist(), texts)]
        lists = pc.split_pattern(texts.filter(plain), " ")
        if not len(lists):
            return out
        coded = lists.flatten().dictionary_encode()
        ids = [self._word(w) for w in coded.dictionary.to_pylist()]
        flat, ends = gathered(ids, coded.indices.to_numpy())
        offsets = lists.offsets.to_numpy()
        encoded = iter(np.split(flat, ends[offsets[1:-1] - offsets[0] - 1]))
        return [next(encoded) if x is None else x for x in out]

    def _word(self, key: str) -> bytes:
        """The ids of a word without spaces, behind the space mark."""
        found = self.words.get(key)
        if found is None:
            word, joined = SPACE + key, self.joined
            # without byte fallback, unknown characters on both sides of a cut would be one piece
            cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined] if self.bytes else []
            if cuts:
                found = b"".join([self._part(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)])])
            else:
                found = self._part(word)
            if len(key) <= CACHED_LENGTH:
                if len(self.words) > CACHE_WORDS:
                    self.words.clear()
                self.words[key] = found
        return found

    def _part(self, part: str) -> bytes:
        """The ids of a part of a normalised word that no cut runs through."""
        found = self.parts.get(part)
        if found is None:
            found = np.array(self.shortest_path(part), "<u4").tobytes()
            if len(part) <= CACHED_LENGTH:
                if len(self.parts) > CACHE_WORDS:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse transducer."""
        size = len(self.text_of)
        raw = b"".join([self.text_of[i] for i in ids.tolist() if 0 <= i < size])
        text = raw.decode(errors="replace")
        return text[1:] if self.normalise.dummy_prefix and text[:1] == " " else text


#: Compiled models stay with their Python worker.
_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    """The compiled model of a file that every executor has, as installed vocabularies are."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


def _list_array(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    ids = np.concatenate([np.empty(0, "<u4"), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def _decoded(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """doc_id, ids, n_tokens, ids_crc32, text of a batch of doc_id, ids."""
    texts, sums, sizes = [], [], []
    for value in batch.column(1):
        ids = np.asarray(value.values.to_numpy(zero_copy_only=False), "<u4") if value.is_valid else np.empty(0, "<u4")
        texts.append(model.decode(ids))
        sums.append(zlib.crc32(ids.tobytes()))
        sizes.append(len(ids))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "ids_crc32", "text"])


def _encoded(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """doc_id, ids of a batch of doc_id, text."""
    return pa.RecordBatch.from_arrays([batch.column(0), _list_array(model.encode_batch(pc.fill_null(batch.column(1), "")))], ["doc_id", "ids"])


DECODED = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, text string"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    return map_batches(id_and_text(docs, id_col, text_col), lambda batch: _encoded(batch, model_of(model_path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, text of rows of doc_id, ids: the text is decoded from the ids."""
    return map_batches(encoded.select("doc_id", "ids"), lambda batch: _decoded(batch, model_of(model_path)), DECODED)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task needs one Python worker instead of two."""
    return map_batches(id_and_text(docs, id_col, text_col), lambda batch: _decoded(_encoded(batch, model_of(model_path)), model_of(model_path)), DECODED)
