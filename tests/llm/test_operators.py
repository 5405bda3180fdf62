"""The operators of turnloom.llm on small tables, against brute force where there is one."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from turnloom.llm import ann_bits, bpe, ctw, exact_dedup, hyperlang, minhash_forest, packing, pii, quality, toxicity

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LONG = " ".join(f"w{k}" for k in range(3000))
ROWS = [(1, "The cat sat on the mat today", "en"), (2, "the cat sat on the mat today", "en"), (3, None, "en"), (4, "", None), (5, "Der Hund läuft über die Straße", "de"), (6, LONG, "en"), (7, LONG, "en"), (8, "one", None), (8, "one", None), (None, "no id here", "en"), (9, " \t\n", "de"), (10, "  two  spaces\n\nhere ", None), (11, "数字 123 ½ 😀 don't", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, "x") for i, t, g in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_duplicates(docs, empty):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["text_sha256"]].append(r)
    for sha, group in groups.items():
        assert sum(r["kept"] for r in group) == 1 and all(r["group_size"] == len(group) for r in group)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["keep_id"] == 7 and by_id[3]["keep_id"] == 4 and not by_id[3]["kept"]
    assert by_id[7]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("heavy", [1, 3])
def test_exact_duplicates_by_ordinary_shuffle(spark, monkeypatch, heavy):
    """Few digests count as heavy, so most groups, ties in size included, meet in the shuffle."""
    monkeypatch.setattr(exact_dedup, "HEAVY_DIGESTS", heavy)
    texts = {k: f"text {k % 7}" for k in range(70)} | {k: f"own {k // 2}" for k in range(100, 140)} | {200: None, 201: ""}
    last, sizes = {}, collections.Counter(t or "" for t in texts.values())
    for k, t in sorted(texts.items()):
        last[t or ""] = k
    for r in exact_dedup.exact_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["keep_id"], r["group_size"], r["kept"]) == (last[t], sizes[t], r["doc_id"] == last[t])


def test_stages_keep_columns_of_any_name(spark):
    rows = [(k, f"some words that are alike in text {k % 3} and go on for a while to be long", 1, 2, 3, 4.0, "z") for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __doc int, __digest int, doc__ int, `a b-c.d` double, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    for out in (exact_dedup.drop_exact_duplicates(table), minhash_forest.drop_near_duplicates(table), quality.drop_low_quality(table, labels, threshold=0.0), pii.pseudonymised(table).select(*[f"`{c}`" for c in table.columns])):
        assert out.columns == table.columns
        assert all((r["__doc"], r["__digest"], r["doc__"], r["a b-c.d"], r["score"]) == (1, 2, 3, 4.0, "z") for r in out.collect())
    empty = table.limit(0)
    for out in (exact_dedup.drop_exact_duplicates(empty), minhash_forest.drop_near_duplicates(empty), quality.drop_low_quality(empty, labels), pii.pseudonymised(empty)):
        assert out.count() == 0


def brute_components(texts, words):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_match_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts = {}
    for base in range(12):
        words = [f"v{rng.integers(400)}" for _ in range(120)]
        for copy in range(8):
            own = list(words)
            for _ in range(int(rng.integers(0, 12))):
                own[int(rng.integers(len(own)))] = f"n{rng.integers(10**6)}"
            texts[base * 8 + copy] = " ".join(own)
    for words in (2, 5):
        table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(table, words=words).collect()}
        assert got == brute_components(texts, words)
    rows = {r["doc_id"]: r for r in minhash_forest.near_duplicates(docs, words=2).collect()}
    assert rows[2]["component_id"] == 1 and rows[7]["component_id"] == 6 and rows[3]["n_shingles"] == 0
    assert rows[9]["component_id"] == 9 and rows[None]["component_id"] is None and rows[None]["kept"]
    assert minhash_forest.near_duplicates(empty).count() == 0


def test_context_tree_scores(docs, empty):
    rows = ctw.score_training_split(docs).collect()
    assert len(rows) == len(ROWS)
    counts = collections.Counter()
    for i, t, _ in ROWS:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().translate(LOWER).split(), None])
    n, v = sum(counts.values()), len(counts)
    by_id = {r["doc_id"]: r for r in rows}
    for i, t, _ in ROWS:
        tokens = [*(t or "").encode().translate(LOWER).split(), None]
        r = by_id[i]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), n, sum(counts[w] > 0 for w in tokens))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0
    assert ctw.score_training_split(empty).count() == 0


def test_context_tree_probabilities_sum_to_one():
    tree = ctw.ContextTree([{0: (np.array([97, 98]), np.array([5.0, 3.0]))}, {97: (np.array([98]), np.array([3.0]))}])
    assert np.allclose((10.0 ** tree.table[[1, tree.n]].astype(float)).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("head", [1 << 20, 256])
def test_context_tree_keeps_rare_contexts(spark, monkeypatch, head):
    """Scores equal those of a tree of all seen contexts, in a corpus where most contexts hold less than a 16,384th of the bytes."""
    monkeypatch.setattr(ctw, "BASE_GRAMS", head, raising=False)
    monkeypatch.setattr(ctw, "WEIGHED", 500, raising=False)
    rng = np.random.default_rng(4)
    common = [f"w{k}" for k in range(30)]
    texts = {k: " ".join([*rng.choice(common, 400).tolist(), *("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(20))]) for k in range(60)}
    padded = {k: bytes(ctw.DEPTH) + t.encode() + b"\0" for k, t in texts.items()}
    seen = [collections.defaultdict(collections.Counter) for _ in range(ctw.DEPTH + 1)]
    for k, t in padded.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for i in range(ctw.DEPTH, len(t)):
                for d in range(ctw.DEPTH + 1):
                    seen[d][int.from_bytes(t[i - d : i])][t[i]] += 1
    assert sum(len(t) - ctw.DEPTH for t in padded.values()) > 3 * 16384
    tree = ctw.ContextTree([{c: (np.array(sorted(n)), np.array([float(n[b]) for b in sorted(n)])) for c, n in level.items()} for level in seen])
    rows = ctw.score_training_split(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert any(r["held_out"] for r in rows) and len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r["score"], float(tree.costs(np.frombuffer(padded[r["doc_id"]], np.uint8), ctw.DEPTH).astype(float).sum()), rel_tol=1e-5)


def test_languages(spark, docs, empty):
    english, german = "the thing that is with this ", "der und die nicht ein schön über "
    rows = [(k, (english if k % 2 else german) * 3, "en" if k % 2 else "de") for k in range(60)] + [(100, None, "en"), (101, "123 !", "en")]
    got = {r["doc_id"]: r for r in hyperlang.identify_training_split(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") and 0 <= got[k]["score"] <= 1 for k in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert hyperlang.identify_training_split(docs).count() == len(ROWS) and hyperlang.identify_training_split(empty).count() == 0


def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    texts, sequences = {i: t for i, t, _ in ROWS if i not in (None, 8)}, collections.defaultdict(list)
    texts |= {20: "a <|endoftext|> b", 21: "<|endoftext|>", 22: "x<|endoftext|><|endoftext|> y <|endoftex|>", 23: "z" * 200_000}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(20, "doc_id")
    rows = packing.pack(table, JSON, PATTERN).collect()
    for i, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, JSON, PATTERN).count() == 0


def test_packing_merges_many_tasks_in_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 3)
    table = spark.range(0, 4000, numPartitions=40).select(F.col("id").alias("doc_id"), F.expr("repeat('one two ', cast(id % 90 as int))").alias("text"))
    pieces = packing.pack(table, JSON, PATTERN)
    rows = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in pieces.collect()}
    again = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in packing.pack(table, JSON, PATTERN).collect()}
    assert rows == again
    got = packing.padding(pieces).first()
    lengths = collections.Counter()
    for length, _, sequence, _ in rows.values():
        lengths[sequence] += length
    assert got["tokens"] == sum(lengths.values()) and got["sequences"] == len(lengths)
    assert got["padded"] == sum(1024 - n for n in lengths.values() if n & (n - 1)) <= 40 / packing.MERGE * 1024


def test_byte_bpe(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t or "" for i, t, _ in ROWS}
    for r in bpe.encode_digests(docs, RANKS, PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_digests(empty, RANKS, PATTERN).count() == 0


def test_byte_bpe_keeps_words_out_of_the_driver_and_of_rows(docs, monkeypatch):
    def refused(self):
        raise AssertionError("words came to the driver")

    monkeypatch.setattr(type(docs), "toArrow", refused)
    rows = bpe.encoded(docs, RANKS, PATTERN)
    assert rows.count() == docs.count()
    plan = rows._jdf.queryExecution().optimizedPlan()
    outputs = [plan.p(i).output().mkString(",") for i in range(20) if plan.p(i) is not None]
    assert outputs and not any("doc_id#" in x and "known#" in x for x in outputs)


def test_byte_bpe_of_long_words(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(letters), n)) for n in (bpe.BLOCK, bpe.BLOCK + 1, 385, 3000) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "a", "äöß", "文字数")] + ["".join(rng.choice(list("etaoinshrdlu"), 30_000))]
    for r in bpe.encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    with pytest.raises(ValueError):
        bpe.Fold({"a": 0, "b": 1, "abc": 2})


def test_nearest_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(400, 16))]
    rows = list(enumerate(vectors)) + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1101, [None] * 16), (1150, [1.0])]
    got = ann_bits.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 400, 50):
        cosine = unit @ unit[q]
        cosine[q] = -9
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(math.isclose(r["score"], cosine[r["vec_id"]], rel_tol=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-cosine)[:5].tolist()))
    assert hits >= 0.9 * 40 and {r["query_id"] for r in got} == set(range(0, 400, 50))
    assert ann_bits.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def rewritten(text, make):
    """The surrogates of one text by plain Python."""
    out, at = [], 0
    for kind, b, e in pii.entities(text or ""):
        out += [text[at:b], pii.dressed(kind, text[b:e], make(kind, pii.canonical(kind, text[b:e])))]
        at = e
    return text if text is None else "".join([*out, text[at:]])


def test_surrogates(spark, docs, empty):
    text = "Mail a.b@x.org or A.B@x.org, call +1 (415) 555-0100, from 10.1.2.3; card 4111111111111111, password=0123456789abcdef. Frau Anna Müller came; Müller left."
    table = spark.createDataFrame([(1, text, "x", 7, "p"), (2, "a.b@x.org again", "y", 8, "q"), (3, "clean 1.2.3 text 4111111111111112", "z", 9, "r"), (4, None, None, None, None)], "doc_id long, text string, row string, n_email int, `a b.c-d` string")
    out = pii.pseudonymised(table)
    assert out.columns[:5] == table.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[1]["row"], got[1]["n_email"], got[1]["a b.c-d"]) == ("x", 7, "p")
    assert (got[1]["n_email_"], got[1]["n_phone"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_secret"], got[1]["n_name"]) == (2, 1, 1, 1, 1, 3)
    for gone in ("a.b@x", "555-0100", "10.1.2.3", "4111111111111111", "0123456789abcdef", "Anna", "Müller"):
        assert gone not in got[1]["text"]
    assert "Frau " in got[1]["text"] and got[2]["text"].split(" ")[0] in got[1]["text"]
    assert got[3]["text"] == "clean 1.2.3 text 4111111111111112" and got[4]["text"] is None
    assert pii.pseudonymised(docs).count() == len(ROWS) and pii.pseudonymised(empty).count() == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_surrogates_are_distinct_coreferent_and_valid():
    rng = np.random.default_rng(8)
    make = pii.Surrogates("surrogates-1")
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    ibans = [f"{c}{pii.right_check(c, b):02d}{b}" for c in ("DE", "FR") for b in (digits(18) for _ in range(150))]
    made = {
        "email": [f"{u}{k}@{d}.org" for u in "abc" for k in range(100) for d in ("x", "mail7.example")],
        "phone": [f"+1415555{k:04d}" for k in range(300)] + [f"+44207946{k:04d}" for k in range(300)] + [f"0151{k:07d}" for k in range(100)],
        "ip": [f"10.0.{a}.{b}" for a in range(20) for b in range(30)] + [pii.canonical("ip", f"2001:db8::{k:x}") for k in range(1, 300)],
        "ssn": [f"{k:03d}45{6000 + k}" for k in range(1, 400)],
        "iban": ibans,
        "name": [n.lower() for names in pii.GIVEN.values() for n in names] + [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "xyz"],
        "secret": [f"AKIA{k:016d}" for k in range(100)] + [f"{k:032x}" for k in range(100)],
    }
    for kind, values in made.items():
        surrogates = [make(kind, v) for v in values]
        assert len(set(surrogates)) == len(set(values)) and not any(a == b for a, b in zip(values, surrogates, strict=True)), kind
    assert all(mod97(make("iban", v)) == 1 for v in ibans) and mod97(make("iban", "DE00370400440532013000")) != 1
    assert len({make("email", f"{u}@corp.example.com").split("@")[1] for u in ("ann", "bob", "eve")}) == 1
    for kind, mentions in (("phone", ("+44 20 7946 0018", "+442079460018", "+44-20-7946-0018")), ("phone", ("+1 (415) 555-0100", "415-555-0100", "415 555 0100", "(415) 555-0100")), ("iban", ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432")), ("card", ("4111 1111 1111 1111", "4111111111111111")), ("name", ("Müller", "MÜLLER"))):
        assert len({pii.canonical(kind, m) for m in mentions}) == 1
        shown = [pii.dressed(kind, m, make(kind, pii.canonical(kind, m))) for m in mentions]
        assert all(len(a) == len(b) and all(x == y or x.isalnum() for x, y in zip(a, b, strict=True)) for a, b in zip(mentions, shown, strict=True))
    assert pii.luhn([c for c in make("card", "4111111111111111")])


@pytest.mark.parametrize("kind,text", [("phone", "ring 415 555 0100 now"), ("phone", "0151 23456789"), ("phone", "(415) 555-0100"), ("phone", "+33 1 42 68 53 00"), ("ssn", "SSN 123-45-6789."), ("ip", "at 2001:db8::8a2e:370:7334, ok"), ("ip", "8.8.8.8"), ("secret", "my password is hunter2x"), ("secret", 'token = "f3ef4d6b2755a36d7d9c25bd72"'), ("iban", "DE89 3704 0044 0532 0130 00"), ("name", "mr. Smith"), ("email", "x.y+z@a-b.co.uk")])
def test_entities_found(kind, text):
    assert [k for k, _, _ in pii.entities(text)] == [kind]


@pytest.mark.parametrize("text", ["at 12:30:45 on 2024-01-02", "version 1.2.3.4.5", "4111111111111112", "the token is gone", "MR and no name", "1 234 567 and 10:20", "", "abcdef"])
def test_clean_texts_stay(text):
    assert pii.entities(text) == []


def test_colliding_surrogates_are_made_anew(spark, monkeypatch):
    """With surrogates that depend on the last digit only, all entities still end up apart."""
    original = pii.Surrogates.card
    monkeypatch.setattr(pii.Surrogates, "card", lambda self, e, tweak: original(self, e[:12] + "0000", tweak) if tweak == "card0" else original(self, e, tweak))
    cards = [c for k in range(400) if pii.luhn([*(c := f"411111111111{k:04d}")])]
    table = spark.createDataFrame([(k, f"card {c}.") for k, c in enumerate(cards)], "doc_id long, text string")
    settled = pii.settled(table.select("text"), "key").collect()
    assert len({r["surrogate"] for r in settled}) == len(cards) == len(settled) and any(r["attempt"] for r in settled)
    texts = [r["text"] for r in pii.pseudonymised(table, "key").collect()]
    assert len(set(texts)) == len(cards)


def labelled(spark, n, good, bad):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 else good, 30).tolist())) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, docs, empty):
    good = [f"word{k}" for k in range(50)]
    table, labels = labelled(spark, 400, good, [*good[:40], "VILE!!", "vilest!!", "vilely!!", "SCUM!!"])
    for rows in (quality.quality_split(table, labels).collect(), toxicity.toxicity_split(table, labels).collect()):
        held = [r for r in rows if r["held_out"]]
        assert held and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    scores = {r["doc_id"]: r for r in quality.quality_split(table, labels).collect()}
    assert np.mean([(s["predicted"] == 1) == (k % 4 != 0) for k, s in scores.items() if s["held_out"]]) > 0.9
    scores = {r["doc_id"]: r for r in toxicity.toxicity_split(table, labels).collect()}
    assert np.mean([(s["predicted"] == 1) == (k % 4 == 0) for k, s in scores.items() if s["held_out"]]) > 0.9
    nothing = labels.limit(0)
    for split in (quality.quality_split, toxicity.toxicity_split):
        assert split(docs, nothing).count() == len(ROWS) and split(empty, nothing).count() == 0


def test_label_model_finds_rates_of_correlated_voters():
    """Two voters that copy each other count once; the rates come out of the votes alone."""
    rng = np.random.default_rng(9)
    n, truth = 40_000, None
    truth = rng.random(n) < 0.2
    vote = lambda hit, false: np.where(truth, rng.random(n) < hit, rng.random(n) < false)
    first = vote(0.8, 0.05)
    columns = [first, first ^ (rng.random(n) < 0.02), vote(0.7, 0.1), vote(0.6, 0.02), vote(0.75, 0.05)]
    votes = np.stack(columns, axis=1).astype(np.uint8)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(patterns, counts, 0.1)
    assert abs(model.prior - 0.2) < 0.02
    assert np.allclose(model.alone[1][[0, 2, 3, 4]], [0.8, 0.7, 0.6, 0.75], atol=0.05)
    assert {0, 1} in [set(edge) for edge in model.tree]
    assert np.mean((model.posterior(patterns)[at.ravel()] > 0.5) == truth) > 0.95


@pytest.mark.parametrize("name,split,least", [("quality", lambda d, x: quality.quality_split(d, x, 5, 0), 0.99), ("toxic", lambda d, x: toxicity.toxicity_split(d, x, 4, 2), 0.95)])
def test_classifiers_on_held_out_documents(spark, name, split, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = split(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r[name] == y] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= least


def test_languages_match_brute_force(spark):
    """Predictions equal those of profiles bundled letter by letter in plain numpy."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()][:60]
    rows = [tuple(r) for r in rows] + [(10**6 + k, t, g) for k, (t, g) in enumerate([("Это простой русский текст о погоде", "ru"), ("Ένα απλό ελληνικό κείμενο", "el"), ("これは日本語の文です", "ja"), ("русский текст и погода", "ru"), ("το κείμενο είναι απλό", "el"), ("日本語の文", "ja")] * 4)]
    encoder = hyperlang.Encoder()

    def bundle(text):
        ids = [0, *(int(encoder.classes[ord(c)]) for c in text), 0]
        grams = [g for g in zip(ids, ids[1:], ids[2:], strict=False) if any(g)]
        return sum((np.roll(encoder.letters[a], 2).astype(int) * np.roll(encoder.letters[b], 1) * encoder.letters[c] for a, b, c in grams), np.zeros(hyperlang.DIMENSIONS, int))

    learned = {}
    for i, t, g in rows:
        if g is not None and t and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[g] = learned.get(g, 0) + bundle(t)
    names = sorted(learned)
    prototypes = np.array([learned[g] / np.linalg.norm(learned[g]) for g in names])
    got = {r["doc_id"]: r for r in hyperlang.identify_training_split(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, g in rows:
        own = bundle(t or "")
        if t and any(c.isalpha() for c in t):
            cosine = prototypes @ own / np.linalg.norm(own)
            assert got[i]["lang_pred"] == names[int(cosine.argmax())] and math.isclose(got[i]["score"], max(cosine.max(), 0), abs_tol=1e-5)
            assert i < 10**6 or got[i]["lang_pred"] == g


def test_quality_learns_from_every_feature(spark, monkeypatch):
    """Rows with thousands of distinct n-grams reach training whole."""
    rng, rows, fit = np.random.default_rng(6), [], quality.Embeddings.fit
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 20000)), "short one", ""]
    monkeypatch.setattr(quality.Embeddings, "fit", lambda self, got, labels: rows.extend(got) or fit(self, got, labels))
    quality.train_quality(spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, label int"))
    for text, row in zip(texts, rows, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        for (_, ids), (got, _) in zip(quality.Features().kinds(data, np.array([0, len(data)])), row, strict=True):
            assert np.array_equal(np.unique(ids), np.asarray(got))
    assert len(rows[0][1][0]) > 1500


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from turnloom.llm._tables import stash

    sf = "/root/testdata/sf0.001"
    kept = {"documents": spark.read.parquet(f"{sf}/documents.parquet")}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stash(stage(spark, list(kept.values())[-1], sf))
        if name != "packing":
            assert kept[name].columns == kept["documents"].columns
    texts = {k: {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()} for k, d in kept.items() if k != "packing"}
    scores = {r.doc_id: r.predicted for r in quality.quality_split(kept["documents"], spark.read.parquet(f"{sf}/labels.parquet"), 5, 0).collect()}
    assert set(texts["quality"]) == {d for d in texts["documents"] if scores[d] == 1}
    last = {}
    for d, t in sorted(texts["quality"].items()):
        last[t] = d
    assert set(texts["exact_dedup"]) == set(last.values())
    assert set(texts["near_dedup"]) == {d for d, (_, c) in brute_components(texts["exact_dedup"], 5).items() if d == c}
    make = pii.Surrogates(pii.DEFAULT_KEY)
    assert texts["pii"] == {d: rewritten(t, make) for d, t in texts["near_dedup"].items()}
    assert texts["pii"] != texts["near_dedup"]
    tokenizer = Tokenizer.from_file(JSON)
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in texts["pii"].items()}
    pieces = sorted(kept["packing"].collect(), key=lambda r: (r.doc_id, r.start))
    at = collections.Counter()
    for r in pieces:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(i) for d, i in ids.items()}


def test_vectors_of_extreme_length(spark):
    """Cosine does not depend on length: rows scaled far beyond what squares in double precision hold are found and find; ties go to smaller ids."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(150, (base[0] * 1e-200).tolist()), (201, (base[0] * 1e200).tolist()), (202, (base[1] * 1e-310).tolist()), (203, base[0].tolist()), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, None)]
    got = collections.defaultdict(list)
    for r in ann_bits.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    ids, whole = [], []
    for i, v in rows:
        if v is not None and np.isfinite(v).all() and np.any(v):
            v = np.array(v) / np.abs(v).max()
            ids.append(i)
            whole.append(v / np.linalg.norm(v))
    whole = np.array(whole)
    for q in (0, 50, 150):
        cosine = np.round(whole @ whole[ids.index(q)], 12)
        near = {i: c for i, c in zip(ids, cosine) if i != q}
        assert [near[i] for i in got[q]] == sorted(near.values(), reverse=True)[:5]
    assert set(got[0][:3]) == {150, 201, 203}
