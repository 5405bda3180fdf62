"""Near duplicates where many texts resemble each other just below the threshold, and words that collide modulo 2**64."""

import collections
import random

import numpy as np

from turnloom.llm import _arrow, ctw, minhash_forest


def template_texts(n=800, size=100, changed=4, seed=7):
    """One template with a few words replaced at random places: most pairs at 0.72-0.79, some above 0.8."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(size)]
    out = {}
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), changed):
            words[at] = f"u{i}x{at}"
        out[i] = " ".join(words)
    return out


def brute(texts):
    sets = {i: set(zip(w, w[1:])) for i, w in ((i, t.split()) for i, t in texts.items())}
    number = {s: k for k, s in enumerate(set().union(*sets.values()))}
    matrix = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in sets.items():
        matrix[i, [number[x] for x in s]] = 1
    shared = (matrix @ matrix.T).astype(int)
    sizes = np.array([len(sets[i]) for i in range(len(sets))])
    linked = 100 * shared >= 80 * (sizes[:, None] + sizes[None, :] - shared)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = list(zip(*np.nonzero(np.triu(linked, 1))))
    for a, b in links:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], len(links)


def test_dense_region_is_compared_whole(spark):
    texts = template_texts()
    want, links = brute(texts)
    assert links > 300 and len(set(want)) > 100
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6), words=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_dense_region_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 60)
    monkeypatch.setattr(minhash_forest, "COLUMNS", 64)
    texts = template_texts(400, seed=8)
    want, _ = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_alike_modulo_two_to_the_64(spark):
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} {other} {one}"), (2, f"{other} {one} {other}"), (3, one), (4, other)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(table, words=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    known = {r["doc_id"]: r["n_known"] for r in ctw.score_training_split(spark.createDataFrame([(1, one), (2, f"{other} {one}")], "doc_id long, text string"), 7, 2).collect()}
    assert set(known) == {1, 2}


def test_fingerprints_tell_words_apart_and_know_them_again():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    hashes, starts, ends, counts = _arrow.WordHasher()(data, np.array([0, len(data)]))
    assert counts.tolist() == [len(words)]
    seen = collections.defaultdict(set)
    for h, w in zip(hashes.tolist(), words):
        seen[h].add(w)
    assert len(seen) == len(set(words)) and all(len(v) == 1 for v in seen.values())


def test_fingerprints_over_long_chunks(monkeypatch):
    data = np.frombuffer(b"alpha beta alpha " * 4000, dtype=np.uint8)
    whole = _arrow.WordHasher()(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(_arrow, "SUMMED", 1000)
    assert (_arrow.WordHasher()(data, np.array([0, len(data)]))[0] == whole).all() and len(set(whole.tolist())) == 2
