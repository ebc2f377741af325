import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from velora.llm import token_store as ts

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", " a ", "\n a", "a\tb c", "it's <|endoftext|> b", "é  \n\nb c\n d", "1 ² ½a", "a_b c_ _d", "don't you'll 12a", "日本 語", "a\x1cb c", "x\n", "\n\n\n", "a b c", "long " * 4000, "🎉 🎉🎉"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=200):
    random.seed(4)
    alphabet = "abcdeéß   .,'!\n0123_"
    return ODD + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 400))) for _ in range(n)]


def test_encoder_is_the_library(library):
    encoder = ts.Encoder(PATH, 2)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array(texts()))] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts()]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(ts, "CACHE_WORDS", 5)
    monkeypatch.setattr(ts, "CACHE_PIECES", 3)
    encoder = ts.Encoder(PATH, 2)
    for t in texts(40):
        assert encoder.encode(pa.array([t]))[0].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_encoder_over_all_letters(library):
    random.seed(6)
    letters = [chr(c) for c in range(1, 0x250)] + list(" \n.,'") * 40
    some = ["".join(random.choice(letters) for _ in range(60)) for _ in range(1500)]
    got = ts.Encoder(PATH, 2).encode(pa.array(some))
    assert [x.tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]


def test_new_words_go_to_the_library_together(library):
    random.seed(8)
    words = ["".join(random.choice("abcdeéß,.'0") for _ in range(random.randint(1, 9))) for _ in range(3000)]
    some = [" ".join(words[k : k + 100]) for k in range(0, 3000, 100)]
    encoder, alone = ts.Encoder(PATH, 2), []
    piece = encoder._piece
    encoder._piece = lambda p: alone.append(p) or piece(p)
    assert [x.tolist() for x in encoder.encode(pa.array(some))] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]
    assert not [p for p in alone if p.startswith(" ")]


def test_other_vocabularies_of_the_known_kind(tmp_path):
    letters = {c: k for k, c in enumerate(ts.byte_letters().values())}
    some = ["x \xa0 \xa0b", "a\xa0 b", "a \xa0b \xa0", "\xa0 a", "ab b a ab", "ab\n ab"]
    # one that merges a no-break space with a space behind it, and one that has no letter for a space
    for k, (vocab, merges) in enumerate(((letters | {"łĠ": 256}, [("ł", "Ġ")]), ({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))):
        other = Tokenizer(models.BPE(vocab, merges))
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        other.save(f"{tmp_path}/{k}.json")
        encoder = ts.Encoder(f"{tmp_path}/{k}.json", 2)
        assert encoder.known
        assert [x.tolist() for x in encoder.encode(pa.array(some))] == [[*other.encode(t, add_special_tokens=False).ids, 2] for t in some]


def test_other_tokenizers_get_whole_texts(tmp_path, library):
    digits, lower, clip = (Tokenizer.from_file(PATH) for _ in range(3))
    digits.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    lower.normalizer = normalizers.Lowercase()
    clip.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    for k, other in enumerate((digits, lower, clip)):
        other.save(f"{tmp_path}/{k}.json")
    for path in [*(f"{tmp_path}/{k}.json" for k in range(3)), P.path("word_bpe_49k.json")]:
        encoder, other = ts.Encoder(path, 2), Tokenizer.from_file(path)
        assert not encoder.known
        some = [*texts(30), "In 2024 The 12345 WORDS"]
        assert [x.tolist() for x in encoder.encode(pa.array(some))] == [[*other.encode(t, add_special_tokens=False).ids, 2] for t in some]
    assert ts.Encoder(PATH, 2).known


def test_cuts_are_local_and_bounded():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = ts.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= ts.MOST and (sizes[:-1] >= ts.LEAST).all()
    chunks = lambda x: {ts.address(x[a:b]) for a, b in zip([0, *ts.cuts(x)], ts.cuts(x))}
    moved = np.concatenate([rng.integers(0, 50_000, 777).astype("<u4"), ids])
    assert len(chunks(ids) & chunks(moved)) > 0.9 * len(chunks(ids))
    assert ts.cuts(np.zeros(10_000, "<u4"))[-1] == 10_000
    assert ts.cuts(np.zeros(1, "<u4")) == [1]


def test_cuts_of_many_texts_are_those_of_each_and_none_is_empty():
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 50_000, n).astype("<u4") for n in [1, 63, 64, 65, *rng.integers(1, 3000, 2000), 20_000]] + [np.zeros(9000, "<u4")]
    ends = [ts.cuts(x) for x in some]
    assert all(e[-1] == len(x) and np.diff([0, *e]).min() > 0 for x, e in zip(some, ends))
    assert ts.cuts_of(some) == ends and ts.cuts_of([]) == []


def test_crcs_are_put_together():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 7, 4096, 12, 100_000)]
    behind = np.array([sum(map(len, parts[k + 1 :])) for k in range(len(parts))])
    whole = np.bitwise_xor.reduce(ts.shifted_crc(np.array([zlib.crc32(p) for p in parts]), behind))
    assert int(whole) == zlib.crc32(b"".join(parts))


def test_merkle_roots_tell_order_and_content():
    a, b, c = (bytes([k]) * 16 for k in range(3))
    assert len({ts.merkle_root(x) for x in ([], [a], [a, b], [b, a], [a, b, c], [a, b, c, c])}) == 6


def test_store_round_trip(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(60))] + [(5000, None), (5001, "same text again " * 400), (5002, "same text again " * 400), (7, "other text with a known id"), (None, "no id"), (5003, "x"), (5003, "x")]
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, start int, address string")
    path = f"file://{tmp_path}/store"
    ts.write(docs, path, PATH, end_id=2, part_rows=20)
    got = ts.read_back(spark, path).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    encoded = sorted(((-1 if i is None else i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted(list(r.ids) for r in ts.reconstruct(spark, path).collect()) == sorted(x for _, x in encoded)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(m.documents for m in manifest) == len(rows) and sum(m.tokens for m in manifest) == before


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here"), (2, "and others there")], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    ts.write(docs, path, PATH, end_id=2)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    payloads = [chunks[1].payload, *[c.payload for c in chunks[1:]]]
    spark.createDataFrame([(c.address, c.n, p) for c, p in zip(chunks, payloads)], "address binary, n int, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert sorted(r.verified for r in ts.read_back(spark, path).collect()) == [False, True]
    with pytest.raises(Exception, match="lost or damaged"):
        ts.reconstruct(spark, path).collect()


def test_recipes_are_ascending_in_many_files_and_hot_ids_are_split(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(1200)] + [(600, "hot")] * 500 + [(None, f"none {i}") for i in range(300)]
    random.seed(9)
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/store"
    ts.write(docs, path, PATH, end_id=2, part_rows=100)
    recipes = spark.read.parquet(f"{path}/recipes").withColumn("file", ts.F.input_file_name())
    files = {}
    for r in recipes.collect():
        files.setdefault(r.file, []).append((r.start, -1 if r.doc_id is None else r.doc_id, r.part))
    assert len(files) > 10 and max(map(len, files.values())) < 400
    ordered = [i for name in sorted(files) for _, i, _ in sorted(files[name])]
    assert ordered == sorted(-1 if i is None else i for i, _ in rows)
    got = ts.read_back(spark, path).collect()
    assert all(r.verified for r in got) and len({r.start for r in got}) == len(rows)
    starts = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert starts == sorted(starts)
    assert not (tmp_path / "store" / "staging").exists()


def test_lost_and_exchanged_recipes_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(40)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    ts.write(docs, path, PATH, end_id=2, part_rows=10)
    whole = spark.read.parquet(f"{path}/recipes").collect()
    fields = "doc_id long, part int, start long, n_tokens long, addresses array<binary>, lengths array<int>, root binary"
    put = lambda rows: spark.createDataFrame([tuple(r) for r in rows], fields).write.mode("overwrite").parquet(f"{path}/recipes")
    part_of = {r.doc_id: r.part for r in whole}
    put([r for r in whole if r.doc_id != 7])
    assert {r.doc_id: r.verified for r in ts.read_back(spark, path).collect()} == {i: part_of[i] != part_of[7] for i in range(40) if i != 7}
    # a recipe in another's place, with a root of its own that fits
    other = next(r for r in whole if r.doc_id == 8)
    put([type(r)(**{**r.asDict(), "addresses": other.addresses, "root": other.root}) if r.doc_id == 7 else r for r in whole])
    assert {r.doc_id for r in ts.read_back(spark, path).collect() if not r.verified} == {i for i in range(40) if part_of[i] == part_of[7]}
    put([r for r in whole if r.part != part_of[7]])
    assert {r.part for r in ts.audit(spark, path).collect() if not r.complete} == {part_of[7]}


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=2)
    assert ts.read_back(spark, path).count() == 0
