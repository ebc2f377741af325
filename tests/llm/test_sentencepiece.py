import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from velora.llm import sentencepiece_fst as fst

PATH = P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "日本語 text 🎉🎉", "a▁b ▁", "\n\n x\ty", "aaaaaaaaaaaa    aaaa", "The  quick <0x41> <s> brown", "hello world " * 2000, "̀x", "a\u0000b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    random.seed(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz    .,ABéß\n-'1"
    return ODD + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 150))) for _ in range(800)]


def test_encoding_and_decoding_are_the_librarys(library, monkeypatch):
    model = fst.model_of(PATH)
    for t in texts():
        ids = model.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert model.decode(ids) == library.decode(ids.tolist()), t


def test_batches_are_the_librarys(library):
    some = texts()
    assert [x.tolist() for x in fst.model_of(PATH).encode_batch(pa.array(some))] == library.encode(some)
    assert fst.model_of(PATH).encode_batch(pa.array([], pa.string())) == []
    assert [x.tolist() for x in fst.model_of(PATH).encode_batch(pa.array(["", "  "]))] == library.encode(["", "  "])


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_normaliser_is_the_librarys(rule):
    known = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(fst._fields(known.serialized_normalizer_spec()))
    normalise = fst.Normaliser(spec)
    rng = random.Random(3)
    letters = [chr(c) for r in [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2460, 0x2500), (0x3040, 0x3100), (0xAC00, 0xAC40), (0xFB00, 0xFB07), (0xFF01, 0xFFA0)] for c in range(*r)] + [" "] * 300
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert normalise(text) == known.normalize(text), text


def test_small_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(fst, "CACHE_WORDS", 3)
    monkeypatch.setattr(fst, "CACHE_PAIRS", 3)
    model = fst.Model(open(PATH, "rb").read())
    assert [model.encode(t).tolist() for t in texts()[:200]] == library.encode(texts()[:200])


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram(pieces):
    import struct

    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t)) for p, s, t in pieces)
    return body + field(2, varint(3 << 3) + varint(1)) + field(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0))


def test_unigram_path_is_the_least(library):
    random.seed(1)
    pieces = [("<unk>", 0, 2)] + [("▁" * random.randint(0, 1) + "".join(random.choice("abc") for _ in range(random.randint(1, 4))), -random.random() * 9, 1) for _ in range(40)] + [(c, -9.5, 1) for c in "abc▁"]
    pieces = list({p: (p, s, t) for p, s, t in pieces}.values())
    model = fst.Model(unigram(pieces))
    score = {p: s for p, s, t in pieces if t == 1}
    for _ in range(60):
        word = "".join(random.choice("abc") for _ in range(random.randint(1, 9)))
        text = "▁" + word
        best = [0.0] + [float("inf")] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in score:
                    best[j] = min(best[j], best[i] - score[text[i:j]])
        got = [model.pieces[i][0] for i in model.encode(word)]
        assert "".join(got) == text and abs(-sum(score[p] for p in got) - best[-1]) < 1e-4
    assert model.encode("axxb").tolist().count(0) == 1


def test_defined_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "a b", 3), (3, "a b", 3), (None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = fst.round_trip(docs, PATH).collect()
    assert sorted(((r.doc_id, r.text, r.n_tokens == len(r.ids)) for r in out), key=str) == sorted([(1, "", True), (2, "", True), (3, "a b", True), (3, "a b", True), (None, "c", True)], key=str)
    assert sorted(map(str, out)) == sorted(map(str, fst.decode(fst.encode(docs, PATH), PATH).collect()))
    assert fst.round_trip(docs.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert fst.decode(nothing, PATH).first().text == ""
