import math
import random
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from velora.llm import line_dedup as ld
from velora.llm import near_texts, quality, toxicity

WORDS = "the house of river and stone was by green light in water under old trees with many small birds that sing all day".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# Toxicity


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(rng, rng.randint(20, 120)).split()
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (None, "you idiot moron scum", "en", "s"), (5002, "plain " * 30_000, "en", "s")]
    labels += [(7000, 1, 1), (None, 1, 1), (12, None, None), (13, 1, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(toxic_tables):
    docs, labels = toxic_tables
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.98
    assert next(r for r in got if r.doc_id is None).predicted == 1 and next(r for r in got if r.doc_id == 5002).predicted == 0


def test_toxicity_does_not_learn_from_the_held_out_fold(spark, toxic_tables):
    docs, labels = toxic_tables
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.is_held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


def test_models_without_labels(spark, toxic_tables):
    docs, labels = toxic_tables
    none = labels.limit(0)
    assert {(r.score < 1e-200, r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {(True, 0)}
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0 and doc_id < 3"))).collect()} == {round(0.5 / (labels.where("toxic = 0 and doc_id < 3").where(~toxicity.is_held_out(labels.doc_id)).count() + 1), 6)}
    assert {round(r.evidence, 6) for r in quality.classify(docs.selectExpr("doc_id", "text", "label as lang", "score as source"), none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def brute_scores(rows, labels):
    """The same classifier, stated over Python sets of columns."""
    known = {i: t for i, _, t in labels if i is not None and t in (0, 1) and crc32(str(i).encode()) % 5}
    text_of = {}
    for i, text, *_ in rows:
        if i in known:
            text_of.setdefault(i, text)
    sets = {i: set(toxicity.ngrams(text_of[i] or "").tolist()) for i in known if i in text_of}
    size = {c: sum(known[i] == c for i in sets) for c in (0, 1)}
    count = {}
    for i, s in sets.items():
        for f in s:
            pair = count.setdefault(f, [0, 0])
            pair[known[i]] += 1
    ratio = {f: math.log((p + 1) / (size[1] + 2)) - math.log((q + 1) / (size[0] + 2)) for f, (q, p) in count.items() if p + q >= 3}
    return sets, ratio, size


def test_toxicity_against_a_brute_force_fit(spark):
    rng = random.Random(14)
    rows = [(i, " ".join([prose(rng, rng.randint(5, 15)), "idiot" if i % 4 == 0 else ""])) for i in range(60)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:7] + rows[:7], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table, columns=None)
    sets, ratio, size = brute_scores(rows, labels)
    # the driver's fit, by plain gradient steps over dense rows
    names = sorted(f for f in ratio if ratio[f])
    x = np.array([[ratio[f] if f in s else 0.0 for f in names] for s in sets.values()])
    y = np.array([dict((i, t) for i, _, t in labels)[i] for i in sets], float)
    theta, b, m, v, mb, vb = np.zeros(len(names)), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, 401):
        g = (1 / (1 + np.exp(-(x @ theta + b))) - y) / len(y)
        grad, gb = x.T @ g + 1e-3 * theta, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        theta, b = theta - rate * m / (np.sqrt(v) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
    weights = dict(zip(names, theta * np.array([ratio[f] for f in names])))
    for r in toxicity.score(docs, model).collect():
        own = set(toxicity.ngrams(dict(rows)[r.doc_id]).tolist())
        assert abs(r.score - 1 / (1 + math.exp(-(b + sum(weights.get(f, 0.0) for f in own))))) < 1e-4


def test_samples_are_bounded_whatever_is_repeated(spark):
    rows = [(1, "the same words")] * 3000 + [(2, "you idiot")] * 500 + [(3, "some other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    once = docs.dropDuplicates()
    a, b = toxicity.fit(docs, labels, min_count=1), toxicity.fit(once, labels, min_count=1)
    assert (a.weights == b.weights).all() and a.intercept == b.intercept
    c, d = quality.fit(docs, labels, max_train=3), quality.fit(once, labels, max_train=3)
    assert (c.weights == d.weights).all() and c.intercept == d.intercept


# Quality


@pytest.fixture(scope="module")
def quality_tables(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        text = prose(rng, rng.randint(30, 90)) if good else rng.choice(["The " * 60, " | ".join(rng.choice(WORDS) for _ in range(40)), prose(rng, 40).upper().replace(" ", "!! ")])
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 20}", len(text), "extra"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(9000, None, None, None, None, None), (9001, "", "en", "hot", 0, None), (1, rows[1][1], "en", "hot", 1, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, site_n string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_its_filter(quality_tables):
    docs, labels = quality_tables
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(r.keep == (r.doc_id % 5 != 0) for r in got if r.doc_id < 600)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_quality_against_brute_force(quality_tables):
    """Posteriors and scores level by level in Python, from the evidence of each row."""
    docs, labels = quality_tables
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.source, r.lang, float(model.evidence(quality.features((r.text or "").encode())[None])[0])) for r in docs.collect()]
    mean = sum(e for *_, e in rows) / len(rows)
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    want = []
    for i, host, path, own in rows:
        of_host, of_path = [e for _, h, _, e in rows if h == host], [e for _, h, p, e in rows if (h, p) == (host, path)]
        host_rate = (sum(of_host) + 20 * mean) / (len(of_host) + 20)
        path_rate = (sum(of_path) - own + 20 * host_rate) / (len(of_path) - 1 + 20)
        want.append((str(i), round(own, 5), round(1 / (1 + math.exp(-(odds(own) + 0.5 * (odds(path_rate) - odds(mean))))), 5)))
    got = [(str(r.doc_id), round(r.evidence, 5), round(r.score, 5)) for r in quality.classify(docs, labels).collect()]
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 2e-5 and abs(x[2] - y[2]) < 2e-5


def test_quality_ties_and_long_texts(spark, quality_tables):
    docs, labels = quality_tables
    long = spark.createDataFrame([(20_000, prose(random.Random(1), 200_000), "en", "hot", 1, None), (20_001, "w " * 300_000, "en", "hot", 1, None)], docs.schema)
    got = {r.doc_id: r for r in quality.classify(docs.unionByName(long), labels).collect()}
    assert got[20_000].doc_id and 0 <= got[20_001].score <= 1
    # a score at the threshold is kept
    edge = got[3].score
    assert next(r for r in quality.classify(docs.unionByName(long), labels, min_score=edge).collect() if r.doc_id == 3).keep


def test_sites_shrink_towards_their_hosts(spark):
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.1)] + [("b", None, 0.2)] * 50
    sites = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), 20.0).collect()}
    overall = (180 + 0.1 + 10) / 251
    assert abs(sites["a", "x"].global_rate - overall) < 1e-9 and len(sites) == 3
    assert abs(sites["a", "y"].host_rate - (180.1 + 20 * overall) / 221) < 1e-9 and sites["b", None].n == 50


# Lines


def common_parts(a, b, words, least):
    """Positions in b of all maximal runs of lines, of least words or more, that a has too."""
    out, open_runs = set(), {}
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j]:
                open_runs[i, j] = open_runs.get((i - 1, j - 1), 0) + 1
                if (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]) and sum(words[j + 1 - open_runs[i, j] : j + 1]) >= least:
                    out |= set(range(j + 1 - open_runs[i, j], j + 1))
    return out


def covered(rows, least=20):
    """By brute force over all pairs: the lines of each document that an earlier one has too."""
    out, earlier = {}, []
    for key in sorted({(i, t) for i, t in rows}, key=lambda r: -(2**63) if r[0] is None else r[0]):
        lines = [x.strip() for x in (key[1] or "").split("\n") if x.strip()]
        words = [len(x.split()) for x in lines]
        have = set(lines)
        out[key] = (set().union(*(common_parts(a, lines, words, least) for a, held in earlier if held & have)), lines)
        earlier.append((lines, have))
    return out


def test_repeated_passages_go_from_the_later_document(spark):
    rng = random.Random(3)
    shared = [[prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = []
    for i in range(150):
        lines = [prose(rng, rng.randint(1, 25)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
        rows.append((i, "\n".join(lines)))
    rows += [(500 + k, rows[5][1]) for k in range(30)] + [(0, rows[0][1])] + [(700, None), (701, ""), (702, "\n \n"), (None, rows[9][1])]
    rows += [(800, "\n".join(f"line {k} " + prose(rng, 8) for k in range(900)))]
    rows += [(801, "\n".join(["first"] + rows[-1][1].split("\n")[200:700] + ["last"]))]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, cut int, n_chars string").drop("n_chars")
    want = covered(rows)
    got = ld.dedup_lines(docs, counts=True).collect()
    assert len(got) == len(rows)
    inputs = {}
    for i, t in rows:
        inputs.setdefault(i, t)
    for r in got:
        hit, lines = want[r.doc_id, inputs[r.doc_id]]
        assert [x.strip() for x in (r.text or "").split("\n") if x.strip()] == [x for k, x in enumerate(lines) if k not in hit]
        if not hit:
            assert r.text == inputs[r.doc_id] and r.n_cut == 0
    assert next(r for r in got if r.doc_id == 801).text == "first\nlast"
    assert all(r.text == "" or not inputs[r.doc_id].strip() for r in got if r.doc_id is not None and 500 <= r.doc_id < 530)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_blocks_of_any_earlier_document_go(spark):
    a, b, c = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a0", "b1 b2 b3 b4 b5 b6 b7 b8 b9 b0", "c1 c2 c3 c4 c5"
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"two\n{a}\n{b}\n{c}"), (3, f"three\n{a}\n{b}\n{c}\nend"), (4, f"{c}\n{a}\n{b}")], "doc_id long, text string")
    for rare in (0, 4):
        fates = {r.doc_id: r.cut and sorted(r.cut) for r in ld.repeated_lines(docs, rare=rare).collect()}
        assert fates == {2: [1, 2], 3: [1, 2, 3], 4: [1, 2]}
    # without the first document the others lose what the second has
    fates = {r.doc_id: sorted(r.cut) for r in ld.repeated_lines(docs.where("doc_id > 1")).collect()}
    assert fates == {3: [1, 2, 3], 4: [1, 2]}


def test_blocks_for_any_number_of_words(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5]))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([3, 40, 400])))) for i in range(25)]
    rows += [(100, "\n".join(f"w{k}" for k in range(700))), (101, "\n".join(["x", *(f"w{k}" for k in range(100, 600)), "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (4, 90):
        want = {key[0]: hit for key, (hit, lines) in covered(rows, least).items() if hit}
        got = {r.doc_id: set(range(len([x for x in dict(rows)[r.doc_id].split("\n") if x.strip()]))) if r.whole else set(r.cut) for r in ld.repeated_lines(docs, min_words=least).collect()}
        assert got == want


def test_short_repeats_stay_and_copies_drop(spark):
    docs = spark.createDataFrame([(1, "And so.\nThe end.", 16), (2, "And so.\nOther words.", 20), (3, "w " * 30, 60), (4, "w " * 30, 60), (5, "x\n" + "w " * 30, 9)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in ld.dedup_lines(docs, drop_emptied=True).collect()}
    assert got == {1: ("And so.\nThe end.", 16), 2: ("And so.\nOther words.", 20), 3: ("w " * 30, 60), 5: ("x", 1)}


def test_patience_anchors_and_blocks():
    a, b = [1, 2, 3, 4, 5, 9, 9], [7, 1, 2, 8, 4, 5, 9]
    assert ld.patience_anchors(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert ld.common_blocks(a, b, []) == [(0, 1, 2), (3, 4, 3)]
    # the seed finds what repeats and has no anchors
    assert (0, 1, 2) in ld.common_blocks([1, 1, 2], [2, 1, 1], [(0, 1)])
    assert ld.patience_anchors([], [1]) == []


# Near-duplicates in the pipeline


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    base = [prose(random.Random(100 + k), 400).replace("the", f"the{k}").replace("of", f"of{k}").replace("and", f"and{k}") for k in range(25)]
    rows = []
    for k, text in enumerate(base):
        rows.append((k, text))
        for c in range(4):
            words = text.split()
            for _ in range(c):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((1000 + 10 * k + c, " ".join(words)))
    rows += [(3, base[3]), (None, None), (None, ""), (5000, ""), (7, prose(rng, 200))]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, label string, stay_id long")
    kept = near_texts.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == sorted([*range(25), 7, None], key=str)
    assert near_texts.deduplicated(docs.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, quality_tables, tmp_path):
    """Every stage in plain Python over the rows that the stage before left."""
    import public_tokenizers
    import sentencepiece
    from test_decontaminate import brute as brute_items
    from test_simhash import brute_groups

    from velora.llm import decontaminate as dc

    docs, labels = quality_tables
    rng = random.Random(16)
    item, other = (" ".join(f"{w}{x}{k}" for k, w in enumerate(WORDS)) for x in "ab")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect() if r.doc_id is not None and r.doc_id < 9000 and r.n_chars != 1]
    passage = "\n".join(prose(rng, 25) for _ in range(3))
    for k in range(6):
        rows += [(3000 + k, "\n".join([prose(rng, 30), passage, prose(rng, 30)]), "en", "hot", 5), (3100 + k, prose(rng, 30) + " " + item + (" " + other if k % 2 else ""), "en", "hot", 5)]
    for k in range(5):
        base = prose(rng, 150)
        words = base.split()
        words[70] = "changed"
        rows += [(3200 + k, base, "en", "hot", 5), (3300 + k, " ".join(words), "en", "hot", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    spark.createDataFrame([(*r, "x") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, item), (2, other)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    own = {r[0]: float(model.evidence(quality.features(r[1].encode())[None])[0]) for r in rows}
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    mean, left = sum(own.values()) / len(own), {}
    for i, text, lang, host, _ in rows:
        of_host, of_path = [own[r[0]] for r in rows if r[3] == host], [own[r[0]] for r in rows if (r[3], r[2]) == (host, lang)]
        host_rate = (sum(of_host) + 20 * mean) / (len(of_host) + 20)
        path_rate = (sum(of_path) - own[i] + 20 * host_rate) / (len(of_path) - 1 + 20)
        if odds(own[i]) + 0.5 * (odds(path_rate) - odds(mean)) >= 0:
            left[i] = text
    cut = {}
    for (i, text), (hit, _) in covered(list(left.items())).items():
        kept, k = [], 0
        for line in text.split("\n"):
            kept += [line] if not line.strip() or k not in hit else []
            k += bool(line.strip())
        if not hit or any(x.strip() for x in kept):
            cut[i] = "\n".join(kept)
    ids = sorted(cut)
    label = brute_groups([cut[i] for i in ids])[1]
    once = {i: cut[i] for k, i in enumerate(ids) if label[k] == k}
    clean = {}
    for i, text in once.items():
        if len(brute_items(text, items)[2]) < 2:
            hit = dc.Index([(str(k), t.encode()) for k, t in items]).scan(text.encode())[1]
            clean[i] = dc.without_words(text.encode(), dc.runs(hit)).decode() if hit else text
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (list(r.ids), r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in clean.items()}
    assert 0 < len(clean) < len(once) < len(cut) <= len(left) < len(rows)


def test_pipeline_over_empty_tables(spark, quality_tables, tmp_path):
    docs, labels = quality_tables
    docs.drop("site_n").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_over_a_small_corpus(spark, quality_tables, tmp_path):
    docs, labels = quality_tables
    docs, labels = docs.drop("site_n"), labels
    rng = random.Random(6)
    item = " ".join(f"{w}{k}" for k, w in enumerate(WORDS))
    more = [(20_000, "\n".join([prose(rng, 40), item, prose(rng, 40)]), "en", "hot", 1), (20_001, prose(rng, 80) + " " + item + " " + item.replace("the", "thy"), "en", "hot", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, item.replace("the", "thy"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in frame.collect()}
    assert not {i for i in ids if i < 600 and i % 5 == 0}
    assert len([i for i in ids if i < 600]) > 470
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == ids and len(out) == len(ids)
    assert all(len(r.ids) == r.n_tokens for r in out.values())
    assert all(item not in r.text for r in out.values())
