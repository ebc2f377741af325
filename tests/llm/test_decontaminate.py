import hashlib
import random
import re

import pytest

from velora.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=8):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[k : k + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def corpus(seed, n=120):
    random.seed(seed)
    some = "the of a and Über word2 naïve X y zebra q 12".split()
    text = lambda k: random.choice([" ", ", ", "\n"]).join(random.choice(some) for _ in range(k))
    items = [(i, text(random.choice([1, 2, 5, 8, 9, 14]))) for i in range(12)] + [(50, ""), (51, None), (52, "!!!"), (1, "repeated id of an item")]
    docs = [(i, text(random.randint(0, 60)) + random.choice(["", " ... " + (items[random.randrange(12)][1] or "")])) for i in range(n)]
    return docs + [(900, None), (901, ""), (901, ""), (None, "the of"), (902, "the " * 3000)], items


@pytest.mark.parametrize("block_bytes", [32_000_000, 40])
def test_search_matches_brute_force(spark, block_bytes):
    docs, items = corpus(1)
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.search(d, b, block_bytes=block_bytes).collect()
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want
    assert all(r.contaminated == (len(r["items"]) >= 2) for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_long_windows_and_items_digest(spark):
    random.seed(2)
    item = " ".join(f"w{random.randrange(40)}" for _ in range(30))
    docs = [(k, " ".join(f"w{random.randrange(40)}" for _ in range(20)) + " " + " ".join(item.split()[k : k + 9]) + " end") for k in range(20)]
    got = dc.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in got} == {i: (brute(t, [(3, item)])[1:]) for i, t in docs}
    assert dc.items_digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.search(d.limit(0), b).count() == 0
    assert dc.search(d, b.limit(0)).first().n_hit == 0
    assert dc.clean(d, b.limit(0)).collect() == d.collect()


@pytest.mark.parametrize("block_bytes", [32_000_000, 60])
def test_clean_drops_two_and_cuts_one(spark, block_bytes):
    a, b = "one two three four five six seven eight nine", "alpha beta gamma delta eps zeta eta theta"
    docs = [(1, f"Start. {a.upper()}; end É", 5), (2, f"{a} {b}", 5), (3, "clean text", 5), (None, None, None), (4, b, 5)]
    got = dc.clean(spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, a), (2, b)], "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "Start. ; end É", 14), (3, "clean text", 5), (None, None, None), (4, "", 0)], key=str)


def test_an_index_is_small_and_other_columns_are_kept(spark):
    random.seed(5)
    vocabulary = [f"word{k}" for k in range(50_000)]
    items = [(str(k), " ".join(random.choices(vocabulary, k=200)).encode()) for k in range(1500)]
    index = dc.Index(items)
    (scanner,) = index.scanners
    size = len(scanner.flat) + len(scanner.shift) + sum(x.itemsize * len(x) for x in (scanner.own, scanner.items, scanner.places, scanner.starts))
    windows = 1500 * 193
    assert size < 100 * windows
    text = b"before " + b" ".join(items[7][1].split()[20:40]) + b" after"
    n, hit, found = index.scan(text)
    assert (n, found, dc.runs(hit)) == (22, {"7"}, [(1, 21)])
    d = spark.createDataFrame([(1, "x", "a b c"), (1, "y", None)], "key long, found string, marks string")
    b = spark.createDataFrame([(4, "b"), (None, "c")], "name long, words string")
    got = dc.clean(d, b, min_items=3, id_col="key", text_col="marks", item_col="name", item_text_col="words", block_bytes=1)
    assert sorted(map(tuple, got.collect())) == [(1, "x", "a  c"), (1, "y", None)]
