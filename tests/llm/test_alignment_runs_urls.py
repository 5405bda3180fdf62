"""Periodic runs, tokenizer alignment and the URL filter, against brute force on small tables."""

import collections
import hashlib
import random
import zlib

import pytest

import public_tokenizers
from turnloom.llm import _tables, alignment, periodic, queries, urls

DOCS = "doc_id long, text string, lang string, n_runs string, copies int, groups string"
A, PATTERN, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{k % 977} x{k % 7}" for k in range(9000))
TEXTS = [
    "The cat sat on the mat today", "the cat  sat\n\non the mat", None, "", "Der Hund läuft über die Straße", " leading and trailing ", "x\u2581y has the mark", "数字 123 ½ 😀 don't", "<|endoftext|> </s> <0x41> plain",
    "tab\tand\u00a0no-break \u2003 wide\u0085line\u2028sep", "na na na na na na na", "a b a b a b a b c c c c c c d", LONG, LONG, "The cat sat on the mat today", "y" * 70000, "one\x00two", "nul \x1c sep \x1f", "ﬁ ligature e\u0301 combined \ufeff bom",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "clash", 1, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "The cat sat on the mat today", "en", "clash", 1, "clash")], DOCS).repartition(3)


def brute_runs(words, least, exponent):
    out, n = set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.add((start, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_tail(doc_id, words):
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (3, 3), (9, 5)])
def test_runs_of_words(least, exponent):
    rng = random.Random(least)
    for _ in range(600):
        words, size = [], rng.randint(0, 60)
        while len(words) < size:
            root = [rng.randint(1, 3) for _ in range(rng.randint(1, 6))]
            words += root * rng.randint(1, 6) if rng.random() < 0.4 else [rng.randint(1, 6)]
        want = brute_runs(words, least, exponent)
        assert periodic.document_runs([b"%d" % w for w in words], least, exponent) == want
        assert not words or periodic.runs_of(words, least, exponent) == want


def test_common_extension_over_many_blocks():
    rng = random.Random(5)
    words = [rng.randint(1, 2) for _ in range(1500)]
    tour, visit, order = periodic.SuffixTree(words).euler_tour()
    assert order == sorted(range(1501), key=lambda k: words[k:])
    i, j = (periodic.np.array([rng.randrange(1500) for _ in range(3000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    common = lambda a, b: next((k for k in range(1500) if a + k >= 1500 or b + k >= 1500 or words[a + k] != words[b + k]), 1500)
    assert periodic.CommonExtension(tour, visit)(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_run_digests(spark, docs):
    rng = random.Random(9)
    made = [(k, " ".join(rng.choice("ab") if k % 3 else f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 90)))) for k in range(100, 400)]
    table = docs.select("doc_id", "text", "lang", "n_runs").unionByName(spark.createDataFrame([(i, t, "en", "c") for i, t in made], "doc_id long, text string, lang string, n_runs string"))
    rows = periodic.run_digests(table).collect()
    texts = {**dict(enumerate(TEXTS)), **dict(made), None: TEXTS[0]}
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in table.select("doc_id").collect())
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(100, 400)) > 10
    for r in rows:
        words = brute_tail(r["doc_id"], (texts[r["doc_id"]] or "").encode().split())
        runs = brute_runs(words, 6, 4) if len(words) < 2000 else periodic.document_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None)) and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(b" ".join(w for k, w in enumerate(words) if k not in gone))


def test_runs_of_long_and_empty_tables(spark, docs):
    assert periodic.run_digests(docs.limit(0)).count() == 0
    text = " ".join(["head", *[f"t{k}" for k in range(5000)] * 5, "x"])
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(1, 25000, 5000)] and row["n_words"] == 25002
    assert row["collapsed"] == " ".join(["head", *[f"t{k}" for k in range(5000)], "x"])


def brute_alignment(rows):
    """Whole texts through both libraries, with offsets as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found, count = {}, collections.Counter()
    for i, text in rows:
        text = text or ""
        if text not in found:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(byte_of[c] for c in a.id_to_token(k)) for k in x]
            yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode() for k in y]
            if not text or b"".join(xb) != b" " + text.encode() or b"".join(yb) != b" " + text.encode():
                x, y, xb, yb = [], [], [], []
            ends_x, ends_y = ([sum(map(len, part[: k + 1])) for k in range(len(part))] if len(part) < 3000 else running(part) for part in (xb, yb))
            both, groups, links = sorted(set(ends_x) & set(ends_y)), [], []
            at_x, at_y = {e: k for k, e in enumerate(ends_x)}, {e: k for k, e in enumerate(ends_y)}
            i0 = j0 = 0
            for e in both:
                i1, j1 = at_x[e] + 1, at_y[e] + 1
                groups.append(",".join(map(str, x[i0:i1])) + "|" + ",".join(map(str, y[j0:j1])))
                links.append((x[i1 - 1], y[j1 - 1]))
                i0, j0 = i1, j1
            found[text] = len(x), len(y), ";".join(groups), links
        count.update(found[text][3])
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for i, text in rows:
        x, y, groups, links = found[text or ""]
        out.append((i, x, y, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha(groups) if groups else ""))
    return sorted(out, key=repr)


def running(parts):
    total, out = 0, []
    for p in parts:
        total += len(p)
        out.append(total)
    return out


@pytest.mark.parametrize("limit,hot", [(500_000, 256), (40, 4), (0, 1)])
def test_alignment_matches_whole_texts(spark, docs, monkeypatch, limit, hot):
    """With few or no pairs in the broadcast, and few texts, the shuffled joins do the work."""
    monkeypatch.setattr(alignment.link_measures, "__defaults__", (limit,))
    monkeypatch.setattr(_tables, "HOT", hot)
    rng = random.Random(3)
    odd = ["a", "the", "naïve", "\n", "\t", "  ", " ", "\u00a0", "don't", "1234", "…", "😀", "Straße", "\u2029", "ing", "(", "Ω", "\x1d"]
    made = [(k, "".join(rng.choice(odd) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40)))) for k in range(100, 300)]
    table = docs.select("doc_id", "text", "copies", "groups").unionByName(spark.createDataFrame([(i, t, 1, "c") for i, t in made], "doc_id long, text string, copies int, groups string"))
    got = alignment.alignment_digests(table, A, PATTERN, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_of_an_empty_table(docs):
    assert alignment.align(docs.limit(0), A, PATTERN, B).count() == 0
    only_nulls = docs.where("text IS NULL")
    assert [tuple(r)[1:] for r in alignment.align(only_nulls, A, PATTERN, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + tail
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[2], rule[3] if rule else "allow"


URLS = [
    None, "", "no scheme.net/", "http://a.net", "http://a.net/", "HTTPS://A.Example.NET/en/x?q=/fr/", "http://example.net/en", "http://example.net/en/#t", "x://badexample.net/en/", "http://www.example.com/de/1", "http://example.com/fr/", "http://b.org/fr/9?x#y", "http://org/fr/",
    "http://u@c.org:80/fr/", "a://b://c.net/", "http://?x.net/", "http://#", "http://.net/", "http://x..net//", "http://Ä.NET/ü", "http://" + "l." * 3000 + "net/" + "p" * 50000, "http://evil.test/a/b", "http://evil.test/a", "http://deep.evil.test/a/b/c",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("evil.test", "/a/b", "block"), ("EVIL.test", "/a", "allow"), ("test", "", "block")]


@pytest.mark.parametrize("blocks,hot", [(1 << 20, 256), (1, 1)])
def test_url_verdicts(spark, monkeypatch, blocks, hot):
    """Also with one block for all keys, so that the exact join has false positives to remove, and without broadcast keys."""
    monkeypatch.setattr(urls, "BLOCKS", blocks)
    monkeypatch.setattr(_tables, "HOT", hot)
    more = [(f"h{k}.test", f"/{k % 7}", "block" if k % 2 else "allow") for k in range(200)]
    rules = spark.createDataFrame([(*r, "x") for r in RULES + more + [(None, "/", "block"), ("", "/", "block"), ("net", "/", "allow")]], "host string, path string, verdict string, rule string")
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS + [f"http://s.h{k}.test/{k % 9}/x" for k in range(300)])] + [(0, None, "x", "y"), (None, "http://a.net/", "x", "y"), (4, "http://a.net/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(map(tuple, urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    want = sorted(((i, *brute_verdict(u, [(h.lower(), p, v) for h, p, v in RULES + more])) for i, u, _, _ in rows), key=repr)
    assert got == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert all(r["verdict"] == "allow" and r["rule"] is None for r in urls.judge(pages, rules.limit(0)).collect())


def test_url_filter_stays_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urls.judge(pages, spark.sql(urls.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {"op11_periodic_runs", "op12_alignment", "op13_url_filter"} <= set(queries.QUERIES)
