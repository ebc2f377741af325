import random
import re

import numpy as np
import xxhash

from velora.llm import near_texts, simhash
from velora.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_brute_force():
    random.seed(3)
    for text in ["", "a", "A b", "a b c", "É À ß a B", "x\x0by\x0cz w", *(" ".join(random.choice("ab cd EF gé".split()) for _ in range(random.randint(1, 60))) for _ in range(50))]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components_on_paths_stars_and_loops(spark):
    random.seed(5)
    path = list(range(200))
    random.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (6001, 6000), (6000, 6001), (6001, 6002)]
    pairs += [(random.randint(7000, 7400), random.randint(7000, 7400)) for _ in range(300)]
    nodes = {x for p in pairs for x in p}
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    got = {n: n for n in nodes} | {r.node: r.label for r in found}
    assert got == brute_components(pairs, nodes)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(spark, fps, max_bits=3, meet=3):
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(frame, max_bits, meet=meet).collect()]
    signed = {int(np.uint64(f).astype(np.int64)) for f in fps}
    want = [(a, b) for a in signed for b in signed if a < b and (a % 2**64 ^ b % 2**64).bit_count() <= max_bits]
    assert all((a % 2**64 ^ b % 2**64) != 0 for a, b in edges)
    return brute_components(edges, signed), brute_components(want, signed)


def test_links_connect_what_is_near_and_nothing_else(spark):
    random.seed(7)
    fps = []
    for _ in range(60):
        base = random.getrandbits(64)
        for _ in range(6):
            fps.append(base)
            base ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 5)))
    for meet in (3, 5):
        got, want = linked(spark, fps, meet=meet)
        assert got == want


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 64)
    monkeypatch.setattr(simhash, "LOOK", 4)
    random.seed(9)
    base = random.getrandbits(64)
    fps = [base ^ sum(1 << b for b in random.sample(range(0, 24), random.randint(0, 6))) for _ in range(700)]
    got, want = linked(spark, fps)
    assert got == want


def test_defined_cases(spark):
    rows = [(5, None, "x", 1), (3, "", "x", 1), (None, "a b c d", "x", 1), (9, "A b c d", "y", 2), (9, "A b c d", "y", 2), (2, "long " * 5000, "z", 3), (None, "quite other words here", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 9), (9, 9), (9, 9), (2, 2), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert docs.select(simhash.hex_of(simhash.F.lit(-1).cast("long")).alias("h")).first().h == "f" * 16


def replaced(text, spots, tag):
    words = text.split()
    for n, k in enumerate(spots):
        words[k] = f"{tag}{n}"
    return " ".join(words)


def around_the_limit():
    """Texts whose pairs share from some 0.6 to 0.95 of their shingles, short ones at exactly 0.8, and pairs that quote one passage."""
    rng = random.Random(12)
    texts = []
    for k in range(40):
        base = " ".join(f"w{k}x{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 240])))
        texts.append(base)
        n = len(base.split())
        for c in range(4):
            texts.append(replaced(base, rng.sample(range(n), max(1, round(n * rng.uniform(0.01, 0.05)))), f"r{k}c{c}x"))
    for k in range(10):
        words = [f"e{k}x{n}" for n in range(13)]
        # 9 shingles, of which the longer text has all: 8 of 10, 9 of 12 and 9 of 11 are shared
        texts += [" ".join(words), " ".join(words[1:] + ["end"]), " ".join(words + ["a", "b", "c"]), " ".join(words + [f"q{k}", "z"])]
    passage = " ".join(f"quoted{n}" for n in range(120))
    texts += [f"{passage} " + " ".join(f"own{k}x{n}" for n in range(m)) for k, m in enumerate([25, 30, 40, 60, 12, 14])]
    return texts


def brute_shingles(text, words=5):
    w = text.split()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}


def brute_groups(texts):
    sets = [brute_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs, brute_components(pairs, range(len(texts)))


def found_groups(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_texts.similar_groups(docs, **how).collect()
    least = {}
    for r in rows:
        least[r.label] = min(r.doc_id, least.get(r.label, r.doc_id))
    return {r.doc_id: least[r.label] for r in rows}


def test_groups_around_the_limit_match_brute_force(spark):
    texts = around_the_limit()
    pairs, want = brute_groups(texts)
    assert len(pairs) > 60
    assert found_groups(spark, texts) == want
    kept = near_texts.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_pairs_are_found_in_families_and_parts_too(spark, monkeypatch):
    texts = around_the_limit()
    want = brute_groups(texts)[1]
    # shingles of two or more texts are frequent, so that groups are families; these have several parts
    monkeypatch.setattr(near_texts, "LOOK", 1)
    monkeypatch.setattr(near_texts, "HOT", 1)
    monkeypatch.setattr(near_texts, "FAMILY_ROWS", 3)
    assert found_groups(spark, texts, max_bits=0) == want
    # without tries of nearest ones; and with very few frequent shingles, so that both ways meet
    monkeypatch.setattr(near_texts, "ROUNDS", 0)
    assert found_groups(spark, texts, max_bits=0) == want
    monkeypatch.setattr(near_texts, "HOT_ROWS", 300)
    assert found_groups(spark, texts) == want


def test_a_large_group_of_near_copies_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "LOOK", 2)
    monkeypatch.setattr(near_texts, "FAMILY_ROWS", 40)
    rng = random.Random(31)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(150))
    near = [replaced(base, rng.sample(range(150), rng.choice([1, 2, 3])), f"n{k}x") for k in range(150)]
    far = [replaced(base, rng.sample(range(150), 12), f"f{k}x") for k in range(60)]
    texts = near + far
    assert found_groups(spark, texts) == brute_groups(texts)[1]


def test_planted_near_copies_are_caught(spark):
    """Recall over some hundred pairs from 0.8 to 0.9, and none under 0.8."""
    rng = random.Random(33)
    texts = []
    for k in range(220):
        base = " ".join(f"b{k}x{rng.randrange(3000)}" for _ in range(rng.choice([80, 200, 500])))
        n = len(base.split())
        texts += [base, replaced(base, rng.sample(range(n), max(1, round(n * rng.uniform(0.015, 0.03)))), f"c{k}x")]
    pairs, want = brute_groups(texts)
    assert len(pairs) > 100 and len(pairs) < 220
    assert found_groups(spark, texts) == want


def test_texts_under_the_limit_stay_however_near_their_bits(spark):
    rng = random.Random(21)
    texts, near = [], 0
    for k in range(60):
        passage = [f"p{k}x{rng.randrange(10**6)}" for _ in range(180)]
        pair = [" ".join(passage + [f"o{k}x{side}x{n}" for n in range(25)]) for side in (0, 1)]
        one, other = (brute_shingles(t) for t in pair)
        assert 0.7 < len(one & other) / len(one | other) < 0.8
        x, y = (simhash.fingerprint(t.encode(), 5) for t in pair)
        near += (x ^ y).bit_count() <= 10
        texts += pair
    assert near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_texts.deduplicated(docs, max_bits=10).count() == len(texts)
