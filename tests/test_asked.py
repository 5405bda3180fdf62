"""Questions parsed, against plain Python."""

import datetime
import math
import re

from pyspark.sql import functions as F

from turnloom.functions import asked

TEXTS = [
    None, "", "   ", "What did Anna say yesterday?", "Show me the image", "who", "whoever came", "What was on 2024-02-30 today", "on 2024-03-05", "at 0000-01-01", "last week and this week", "THIS MONTH", "last month's notes", "déyesterday", "yesterdayé", "verify it", "everify details", "exactly, the detail",
    "the cat is an animal", "What", "find", "findings are few", "how many Cats and Dogs did Bob and Eve see", "Please list all The Names", "name all", "Compare Ann Bob Cy Dee Eve Fay because when hear", " ".join(["Word"] * 200), "a　b\x85c Élan ñandú", "x-y_z, (abc) 日本語の that", "hear the video", "today today  today", "The the THE end",
]
TODAY = datetime.date(2024, 3, 1)


def parsed(text):
    text = text or ""
    low, day = text.lower(), datetime.timedelta(days=1)
    monday, month = TODAY - day * TODAY.weekday(), TODAY.replace(day=1)
    ranges = {"yesterday": (TODAY - day, 1), "today": (TODAY, 1), "last week": (monday - 7 * day, 7), "this week": (monday, 7), "last month": (month - 30 * day, 30), "this month": (month, 30)}
    found, temporal = (None, None), False
    for phrase, (first, days) in ranges.items():
        if re.search(rf"\b{phrase}\b", low):
            found, temporal = (first, first + days * day), True
            break
    else:
        if m := re.search(r"\b(\d{4}-\d{2}-\d{2})\b", low):
            temporal = True
            try:
                first = datetime.datetime.strptime(m[1], "%Y-%m-%d").date()
                found = (first, first + day)
            except ValueError:
                pass
    hints = [m for m, words in asked.MODALITIES.items() if any(w in low for w in words)]
    evidence = bool(re.search(r"\b(show me|prove|everify|exactly|specifically|details?)\b", low))
    rest = re.sub(r"\b(yesterday|today|last week|this week|last month|this month|\d{4}-\d{2}-\d{2})\b", "", text, flags=re.I)
    return {
        "temporal": temporal, "first": found[0], "until": found[1], "hints": hints, "depth": "evidence" if evidence else "details" if hints else "summary", "cleaned": " ".join(rest.split()),
        "factual": bool(re.match(r"(what|who|where|when|how|why)\b", low)), "k": 5 if evidence else 20 if temporal else 10, "modality": hints[0] if len(hints) == 1 else None,
    }


def variants(text):
    text = text or ""
    out = [text]
    out += [text[len(p) :].strip() for p in ("what", "who", "where", "when", "how", "why", "show me", "find") if text.lower().startswith(p)]
    plain = " ".join(re.sub(r"\b(the|a|an|is|are|was|were|do|does|did)\b", "", text.lower()).split())
    out += [plain] if plain != text.lower() else []
    return list(dict.fromkeys([out[0], *(v for v in out[1:] if v)]))


def features(text):
    text = text or ""
    low, words = text.lower(), text.split()
    modal, temporal, reasoning, entity = (any(w in low for w in ws) for ws in asked.KINDS.values())
    names = sum(1 for i, w in enumerate(words) if i and w[0].isupper() and len(w) > 1)
    kind = "cross_modal" if modal else "temporal" if temporal else "reasoning" if reasoning else "entity_centric" if entity else "factual"
    return kind, names, temporal, min(1.0, 0.2 * len(words) / 30 + 0.3 * reasoning + 0.2 * names / 5 + 0.15 * temporal + 0.15 * modal), len(words)


def wanted(text, category):
    text = text or ""
    low, k = text.lower(), asked.RESULTS.get(category, 20)
    k = max(k, 35) if any(w in low for w in asked.LISTS) else k
    k = max(k, 30) if "how many" in low else k
    return max(k, 25) if sum(w[0].isupper() and w.lower() not in asked.NO_NAMES for w in text.split()) >= 3 else k


def test_every_rule(spark):
    q, today = F.col("q"), F.lit(TODAY)
    df = spark.createDataFrame([(i, t, c) for i, t in enumerate(TEXTS) for c in ("MR", "FR", None)], "i int, q string, c string")
    when, plan = asked.time_range(q, today), asked.strategy(q, today)
    rows = df.select("i", "c", when.alias("w"), plan.alias("s"), asked.modality_hints(q).alias("hints"), asked.cleaned(q).alias("cleaned"), asked.factual(q).alias("factual"), asked.tags(q).alias("tags"), asked.variants(q).alias("v"), asked.features(q).alias("f"), asked.results_wanted(q, F.col("c")).alias("k")).collect()
    assert len(rows) == 3 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.i]
        want = parsed(text)
        assert (r.w.temporal, r.w.first, r.w.until, r.hints, r.cleaned, r.factual) == tuple(want[n] for n in ("temporal", "first", "until", "hints", "cleaned", "factual")), text
        assert (r.s.k, r.s.modality, r.s.first, r.s.depth, r.s.expand) == (want["k"], want["modality"], want["first"], want["depth"], want["depth"] != "summary"), text
        bare = [re.sub(r"[^\w]", "", w) for w in (text or "").lower().split()]
        assert r.tags == [w for w in bare if len(w) > 2 and w not in ("the", "and", "for", "with", "that")][:5], text
        assert r.v == variants(text), text
        kind, names, temporal, complexity, words = features(text)
        assert (r.f.kind, r.f.names, r.f.temporal, r.f.words) == (kind, names, temporal, words) and math.isclose(r.f.complexity, complexity, abs_tol=1e-12), text
        assert r.k == wanted(text, r.c), text


def test_experiences_equal_a_loop_over_all(spark):
    """Ties, a kind that no experience has, several experiences of one complexity, and no experiences at all."""
    now = datetime.datetime(2024, 2, 1)
    past = [(i, "ab"[i % 2], (i * 7 % 5) / 4, now - datetime.timedelta(days=i * 3 % 11), (i % 4) / 4) for i in range(60)] + [(60, "a", 0.5, None, 0.5)]
    questions = [(j, k, c / 8) for j, (k, c) in enumerate((k, c) for k in "abz" for c in range(9))]
    old = spark.createDataFrame(past, "experience long, kind string, complexity double, asked timestamp, quality double")
    new = spark.createDataFrame(questions, "id long, kind string, complexity double")
    got = {}
    for r in sorted(asked.experiences(new, old, F.lit(now), 4).collect(), key=lambda r: r.rnk):
        got.setdefault(r.id, []).append((r.experience, r.score))
    for j, kind, c in questions:
        own = [p for p in past if p[1] == kind] or past
        scored = sorted((-round(0.5 * math.exp(-0.1 * (now - t).days) + 0.3 * (1 - abs(pc - c)) + 0.2 * quality, 9), i) for i, _, pc, t, quality in own if t)
        assert [i for i, _ in got[j]] == [i for _, i in scored[:4]]
    assert asked.experiences(new, old.limit(0), F.lit(now)).count() == 0
