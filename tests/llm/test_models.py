"""Language identification, quality classifier and near duplicates against brute force and held-out labels."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import classifier, langid, minhash, queries
from tests.llm import fixtures


def listed(rows):
    return sorted(rows, key=str)


def near_by_brute_force(rows, threshold=0.8):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return listed((r[0], least(groups[root(i)]), len(groups[root(i)])) for i, r in enumerate(rows))


def test_near_duplicates(spark, tmp_path):
    folder = fixtures.saved(spark, tmp_path, fixtures.documents(spark, clashing=True))
    got = listed((r["doc_id"], r["class_id"], r["class_size"]) for r in queries.op1_near_duplicates(spark, folder).collect())
    assert got == near_by_brute_force([(r[0], r[1]) for r in fixtures.rows()])
    assert minhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_chain_and_star(spark):
    """A chain of near copies whose ends are far apart, and a group around one text, are one class each."""
    base = fixtures.prose("en", 300, "chain").split()
    texts, cur = [], base[:]
    for k in range(8):
        texts.append(" ".join(cur))
        cur[k * 30 : k * 30 + 5] = [f"q{k}{i}" for i in range(5)]
    star = fixtures.prose("de", 200, "star")
    texts += [star] + [fixtures.edited(star, 3, k) for k in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = listed((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicates(df).collect())
    assert got == near_by_brute_force(rows)
    kept = minhash.drop_near_copies(df)
    assert kept.count() == len({c for _, c, _ in got})


def test_repeated_lines(spark):
    """Near copies of which each repeats a line of its own many times are found like any others."""
    rows = []
    for k in range(30):
        shared = " ".join(f"w{k}x{i}" for i in range(184))
        for side in "ab":
            rows.append((len(rows), shared + f" {' '.join(f'{side}{k}y{i}' for i in range(16))}" * 30))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_brute_force(rows)
    assert {size for *_, size in want} == {2}
    assert listed((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicates(df).collect()) == want


def test_recall(spark):
    """All rows against all: pairs of different texts at 0.8 or more are in one class, and share a bucket."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sets, label = {}, {r["doc_id"]: r["class_id"] for r in queries.op1_near_duplicates(spark, folder).collect()}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    bands = {}
    for r in minhash.sketch(docs).select("node", "bands").collect():
        bands[bytes(r["node"])] = set(r["bands"] or [])
    node = {r[0]: bytes(r[1]) for r in docs.select("doc_id", minhash.node_of(F.coalesce("text", F.lit("")))).collect()}
    pairs = [(q, d) for q in sets for d in sets if q < d and sets[q] != sets[d] and 5 * min(len(sets[q]), len(sets[d])) >= 4 * max(len(sets[q]), len(sets[d]))]
    pairs = [(q, d) for q, d in pairs if len(sets[q] & sets[d]) >= 0.8 * len(sets[q] | sets[d])]
    assert pairs and all(label[q] == label[d] for q, d in pairs)
    assert np.mean([bool(bands[node[q]] & bands[node[d]]) for q, d in pairs]) >= 0.9


def test_signatures_estimate_probability_jaccard():
    def both(a, b):
        keys = sorted(set(a) | set(b))
        hashed = {k: np.uint64(zlib.crc32(str(k).encode()) * 2**12 + 5) for k in keys}
        rows = sorted((d << minhash.BITS | int(hashed[k]), w) for d, bag in enumerate((a, b)) for k, w in bag.items())
        return minhash.signatures(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float), 2, 2000)

    a = {k: 1.0 + k % 3 for k in range(60)}
    b = {k: 1.0 + k % 2 for k in range(20, 90)}
    regs = both(a, b)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))
    assert abs((regs[0] == regs[1]).mean() - exact) < 0.04
    assert (both(a, a)[0] == both(a, a)[1]).all()


def phrases_by_hand(text, sample):
    """Longest-match phrases of a text in a sample by substring search."""
    squeeze = lambda s: "".join(c if c.isalpha() else " " for c in s.lower())
    def runs(s):
        out = []
        for c in squeeze(s):
            if c != " " or not out or out[-1] != " ":
                out.append(c)
        return "".join(out)

    body, base, count, at = runs(text), runs(sample), 0, 0
    while at < len(body):
        n = 1
        while at + n < len(body) and body[at : at + n + 1] in base:
            n += 1
        count += 1
        at += n
    return count, len(body), math.log2(max(2, len(base)))


@pytest.mark.parametrize("segment", [3, 7, 256])
def test_phrases_like_substring_search(segment, monkeypatch):
    """Phrases are the same to the last one however a text is cut into segments, also where phrases are longer than these."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    samples = {k: fixtures.prose(k, 150, "sample") for k in fixtures.WORDS}
    model = langid.LanguageModel(tuple(sorted(samples)), tuple(samples[k] for k in sorted(samples)))
    texts = [fixtures.prose(k, 130, f"t{i}") for i, k in enumerate(["en", "de", "fr"])] + ["", "12 3", "x", "Ünknown ж letters, MIXED  case"]
    texts += [samples["en"][40:700] + samples["de"][:300] + samples["en"] * 2, samples["fr"]]
    parser = langid._Parser(model)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found, sizes, lettered = parser.phrases(points, offsets)
    assert lettered.tolist() == [True, True, True, False, False, True, True, True, True]
    for j, text in enumerate(texts):
        for k, lang in enumerate(model.languages):
            if lettered[j]:
                count, size, bits = phrases_by_hand(text, samples[lang])
                assert (sizes[j], found[k, j]) == (size, count) and parser.bits[k] == pytest.approx(bits)


def test_choice_and_score_by_hand():
    samples = {k: fixtures.prose(k, 150, "sample") for k in fixtures.WORDS}
    model = langid.LanguageModel(tuple(sorted(samples)), tuple(samples[k] for k in sorted(samples)))
    texts = [fixtures.prose(k, 40, f"c{k}") for k in fixtures.WORDS] + ["der the le"]
    raw = [t.encode() for t in texts]
    lang, score = langid._predicted(model, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for t, l, x in zip(texts, lang, score, strict=True):
        entropy = {k: n * bits / size for k in samples for n, size, bits in [phrases_by_hand(t, samples[k])]}
        weight = {k: e**-4 for k, e in entropy.items()}
        assert l == min(sorted(entropy), key=entropy.get) and x == pytest.approx(weight[l] / sum(weight.values()))


def test_op2(spark, tmp_path, sf):
    folder = fixtures.saved(spark, tmp_path, fixtures.documents(spark, clashing=True))
    got = queries.op2_language_id(spark, folder).collect()
    assert len(got) == len(fixtures.rows())
    by_id = {r["doc_id"]: r for r in got}
    for k in (130, 131, 132, 133):
        assert by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert np.mean([by_id[i]["lang_pred"] == r[2] for i, r in enumerate(fixtures.rows()[:36])]) == 1
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op2_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.95
    nothing = queries.op2_language_id(spark, fixtures.saved(spark, tmp_path / "e", fixtures.empty(spark)))
    assert nothing.count() == 0
    untaught = langid.predict(fixtures.documents(spark), langid.LanguageModel((), ()))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}


def test_op6(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op6_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.95
    docs = fixtures.documents(spark, clashing=True)
    known = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = classifier.fit(docs, known, F.lit(True), steps=2)
    rows = classifier.score(docs, model).collect()
    assert len(rows) == len(fixtures.rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert classifier.fit(docs, known.limit(0), F.lit(True)) is None
    assert {r["score"] for r in classifier.score(docs, None).collect()} == {0.5}
    assert classifier.score(fixtures.empty(spark), model).count() == 0


def test_score_is_mean_of_vectors():
    """Scores from one number for each bucket equal those from the averaged vectors."""
    texts = [fixtures.prose("en", 30, 1), "Thing Thing Thing", "x", ""]
    every = b"".join(t.encode() for t in texts)
    found = classifier.bags(np.frombuffer(every, np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))), 1 << 10)
    model = classifier.train(found, [1, 0, 1, 0], steps=2, buckets=1 << 10)
    value, bias = model.collapsed()
    for t, (used, weight) in zip(texts, found, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        z = (model.vectors[used] * weight[:, None]).sum(axis=0) @ model.output + model.bias
        assert classifier.log_odds(raw, np.array([0, len(raw)]), value, bias)[0] == pytest.approx(z[1] - z[0], abs=1e-4)


def test_bag_by_hand():
    """Two words' features, hashed, and their weights in the mean of means."""
    (used, weight), = classifier.bags(np.frombuffer("né né".encode(), np.uint8), np.array([0, 6]), classifier.BUCKETS)
    # Each word: itself and " né " as 3-grams " né" and "né " and one 4-gram; the second also a bigram: 4 and 5 features.
    assert len(used) == 5 and sorted(weight.round(6)) == sorted([round(1 / 10, 6)] + [round(1 / 8 + 1 / 10, 6)] * 4)


def test_training_separates():
    """Gradient descent from the definition, by finite differences, and labels that words decide are learned."""
    rng = np.random.default_rng(0)
    documents = [(np.sort(rng.choice(64, 5, replace=False)), np.full(5, 0.2)) for _ in range(40)]
    labels = [int(b[0][0] < 6) for b in documents]
    one = classifier.train(documents[:1], labels[:1], buckets=64, dimension=3, steps=1, rate=1e-3, batch=1)
    start = np.random.default_rng(7)
    vectors, output = start.normal(0, 0.1, (64, 3)), start.normal(0, 0.1, (3, 2))

    def loss(v):
        z = (v[documents[0][0]] * documents[0][1][:, None]).sum(axis=0) @ output
        return np.log(np.exp(z).sum()) - z[labels[0]]

    at = int(documents[0][0][2])
    moved = vectors.copy()
    moved[at, 1] += 1e-6
    assert (vectors - one.vectors)[at, 1] / 1e-3 == pytest.approx((loss(moved) - loss(vectors)) / 1e-6, rel=1e-3)
    model = classifier.train(documents, labels, buckets=64, dimension=3, steps=600)
    value, bias = model.collapsed()
    assert np.mean([(value[b] * w).sum() + bias > 0 for b, w in documents] == np.array(labels, bool)) > 0.95


def test_grams_stay_in_words():
    """Features of a text do not depend on its neighbours in the batch."""
    value = np.random.default_rng(0).normal(size=1 << 12).astype(np.float32)
    texts = ["one two", "", "three", " four  five ", "é" * 3, "two"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    together = classifier.log_odds(raw, offsets, value, 0.5)
    for t, z in zip(texts, together, strict=True):
        one = np.frombuffer(t.encode(), np.uint8)
        assert classifier.log_odds(one, np.array([0, len(one)]), value, 0.5)[0] == pytest.approx(z, abs=1e-5)
