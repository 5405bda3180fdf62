"""Toxicity by weak supervision.

Many simple voters look at each text. Lexicon voters: one for each of FOLDS disjoint
parts of the labelled rows, with the words that mark toxic texts in that part alone, so
that it errs by itself; one for word beginnings; one for each list of insults in
ADDRESSES' languages. Pattern voters: entries that are dense, that repeat, that stand
near a second-person pronoun, and words masked by stars. A voter says toxic or is
silent; how much its silence speaks for a clean text is estimated too.

A generative label model explains the votes: within either class they follow a tree of
pairwise dependencies (Chow-Liu: the spanning tree with the most mutual information), so
correlated voters don't count twice. Expectation-maximisation estimates the rates of the
votes, alone and along the tree, and the share of toxic texts, from the votes of all
documents. Its posterior labels train a linear classifier (logistic regression on which
lexicon entries a text holds, numpy stochastic gradient descent), whose log odds are
calibrated on the training labels.

At scale: labels are learned from at most LABELLED rows, those with the smallest hash of
their id, so the ids that are broadcast stay bounded. Word and beginning counts by label
and part are summed in Spark and the LEXICON strongest are kept. Votes are counted over
all documents; as each voter votes or is silent there are 2 ** voters patterns at most,
and all of them reach the driver. The classifier is fitted on at most TRAIN_ROWS
labelled rows.

Defined cases: null or empty text has no features; all voters are silent, and the score
is that of the bias. Without toxic labels the lexicons are
empty and scores stay near the prior. A null id is scored and never learned from. An id
with several labels counts with the largest, and of several texts with one id the least
is learned from. Labels, lang, source and ids are never inputs of a score.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Tally, WordHasher, signed, text_chunks
from ._tables import crc_mod, stash

#: Entries of the learned lexicon; disjoint parts of the labelled rows; rows the classifier is fitted on; labelled rows learned from.
LEXICON, FOLDS, TRAIN_ROWS, LABELLED = 4096, 3, 12000, 40000
#: Lengths of word beginnings in bytes; standard deviations by which an entry's toxic texts must exceed chance; share of its texts that must be toxic; toxic texts of a part that support it there; words between an entry and a pronoun.
PREFIXES, SURE, SHARE, SUPPORT, NEAR = (4, 5, 6, 7, 8), 5.0, 0.8, 2, 3
EPOCHS, RATE, SEED = 6, 0.3, 11
#: Common insults by language.
INSULTS = {
    "en": ("idiot", "stupid", "moron", "dumb", "loser", "scum", "bastard", "bitch", "asshole", "jerk"),
    "de": ("idiot", "dumm", "blöd", "depp", "trottel", "arschloch", "dreckskerl", "mistkerl", "schlampe", "versager"),
    "fr": ("idiot", "stupide", "imbécile", "crétin", "connard", "salaud", "abruti", "débile", "ordure", "minable"),
    "es": ("idiota", "estúpido", "imbécil", "tonto", "cabrón", "pendejo", "basura", "cretino", "inútil", "payaso"),
}
#: Second-person words by language.
ADDRESSES = {"en": ("you", "your", "you're", "u", "ur"), "de": ("du", "dich", "dir", "dein", "deine", "ihr", "euch"), "fr": ("tu", "toi", "te", "ton", "vous", "votre"), "es": ("tú", "ti", "usted", "ustedes", "eres", "tuyo")}


class Words:
    """Fingerprints of the words of a chunk, without marks at either end, and of their beginnings."""

    def __init__(self):
        self.hasher = WordHasher()
        letters = np.zeros(256, dtype=bool)
        letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        # Anything but letters and digits parts words here.
        self.hasher.word = letters

    def __call__(self, data, offsets):
        hashes, starts, ends, counts = self.hasher(data, offsets)
        doc = np.repeat(np.arange(len(counts)), counts)
        folded = self.hasher.fold[data].astype(np.uint64)
        # Keys of beginnings are odd, those of words even.
        keys, docs = [hashes & ~np.uint64(1)], [doc]
        code = np.zeros(len(starts), dtype=np.uint64)
        for k in range(max(PREFIXES)):
            at = np.minimum(starts + k, max(len(data) - 1, 0))
            code = (code << np.uint64(8)) | (folded[at] if len(data) else code)
            if k + 1 in PREFIXES:
                fits = ends - starts >= k + 1
                value = (code[fits] ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
                keys.append((value ^ (value >> np.uint64(29))) | np.uint64(1))
                docs.append(doc[fits])
        return np.concatenate(docs), np.concatenate(keys)


def distinct(doc, keys):
    """Each document's keys once."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[first], keys[first]


def _evidence(batches):
    """(key, part, label, n): documents of each label and part that hold the key."""
    import pyarrow as pa

    words, tallies = Words(), [Tally() for _ in range(2 * FOLDS)]
    for batch in batches:
        group = np.asarray(batch.column(1)) + 2 * np.asarray(batch.column(2))
        for first, _, data, offsets in text_chunks(batch.column(0)):
            doc, keys = distinct(*words(data, offsets))
            own = group[first + doc]
            for g, tally in enumerate(tallies):
                tally.add(keys[own == g])
    for g, tally in enumerate(tallies):
        keys, counts = tally.fold()
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(signed(part)), pa.array(np.full(len(part), g // 2, np.int32)), pa.array(np.full(len(part), g % 2, np.int32)), pa.array(counts[k : k + 100_000].astype(np.int64))], ["key", "part", "label", "n"])


def learn_lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the words and beginnings that mark toxic texts, and a bit for each part in which they do."""
    rows = labelled.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int").alias("part"))
    counts = rows.mapInArrow(_evidence, "key long, part int, label int, n long").groupBy("key", "part").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n"))
    prior = labelled.agg(F.avg("label").alias("p")).first()["p"] or 0.0
    here = (F.col("toxic") >= SUPPORT) & (F.col("toxic") >= SHARE * F.col("n"))
    entries = counts.groupBy("key").agg(F.sum(F.when(here, F.pow(F.lit(2), F.col("part"))).otherwise(0)).cast("long").alias("parts"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    excess = F.col("toxic") - prior * F.col("n")
    entries = entries.where((F.col("toxic") >= SHARE * F.col("n")) & (excess > 0) & (excess * excess >= SURE**2 * prior * (1 - prior) * F.col("n"))).withColumn("weight", F.col("toxic") - 5 * (F.col("n") - F.col("toxic")))
    top = sorted((r["key"] % 2**64, r["parts"]) for r in entries.orderBy(F.desc("weight"), "key").limit(LEXICON).collect())
    return np.array([k for k, _ in top], dtype=np.uint64), np.array([p for _, p in top], dtype=np.int64)


class Ballot:
    """Votes of all voters for the texts of a chunk, as 0 and 1."""

    NAMES = [*(f"words of part {k}" for k in range(FOLDS)), "beginnings", *(f"insults {g}" for g in INSULTS), "dense", "repeated", "addressed", "masked"]

    def __init__(self, lexicon):
        (self.lexicon, self.parts), self.words = lexicon, Words()
        known = lambda listed: np.unique(self.words(*joined(listed))[1][: len(listed)])
        self.insults = [known(w) for w in INSULTS.values()]
        self.address = known(sorted({w for ws in ADDRESSES.values() for w in ws if "'" not in w}))

    def __call__(self, data, offsets):
        n = len(offsets) - 1
        doc, keys = self.words(data, offsets)
        votes = np.zeros((n, len(self.NAMES)), dtype=np.uint8)
        hit, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
            hit = self.lexicon[at] == keys
        word = (keys & np.uint64(1)) == 0
        whole = hit & word
        for k in range(FOLDS):
            votes[doc[whole][(self.parts[at[whole]] >> k) & 1 == 1], k] = 1
        votes[doc[hit & ~word], FOLDS] = 1
        own, own_doc = keys[word], doc[word]
        marked = whole[word]
        for k, listed in enumerate(self.insults):
            found = np.isin(own, listed)
            votes[own_doc[found], FOLDS + 1 + k] = 1
            marked |= found
        col = FOLDS + 1 + len(self.insults)
        size = np.bincount(own_doc, minlength=n)
        some = np.bincount(own_doc[marked], minlength=n)
        votes[some >= 0.01 * np.maximum(size, 100), col] = 1
        pairs = np.sort(own_doc[marked].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ own[marked])
        again = np.isin(own_doc[marked].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ own[marked], pairs[1:][pairs[1:] == pairs[:-1]])
        votes[own_doc[marked][again], col + 1] = 1
        ends = np.cumsum(size)
        seen = np.concatenate([[0], np.cumsum(np.isin(own, self.address))])
        place = np.flatnonzero(marked)
        near = seen[np.minimum(place + NEAR + 1, ends[own_doc[place]])] - seen[np.maximum(place - NEAR, ends[own_doc[place]] - size[own_doc[place]])]
        votes[own_doc[place][near > 0], col + 2] = 1
        votes[masked(data, offsets), col + 3] = 1
        return votes, distinct(doc[hit], at[hit])


def joined(words):
    """(bytes, offsets) of a list of words as one text."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return data, np.array([0, len(data)])


def masked(data, offsets):
    """The texts with a word of letters around one to three stars."""
    letter = (data | 32) - np.uint8(97) < 26
    star = data == 42
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for k in (1, 2, 3):
        if len(data) > k + 1:
            i = np.flatnonzero(letter[: -k - 1] & letter[k + 1 :] & star[1:-k])
            for j in range(2, k + 1):
                i = i[star[i + j]]
            found.append(doc[i[doc[i] == doc[i + k + 1]]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _patterns(model):
    def run(batches):
        import pyarrow as pa

        ballot, tally = Ballot(model.value), {}
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                rows, counts = np.unique(ballot(data, offsets)[0], axis=0, return_counts=True)
                for row, count in zip(rows, counts.tolist(), strict=True):
                    tally[row.tobytes()] = tally.get(row.tobytes(), 0) + count
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["votes", "n"])

    return run


class LabelModel:
    """Class-conditional votes along a tree of pairs, and the share of toxic texts, by expectation-maximisation."""

    def __init__(self, votes, counts, prior):
        n, m = counts.astype(float), votes.shape[1]
        said = votes.sum(axis=1)
        # To begin with every voter speaks on three toxic texts in ten and on three clean ones in a hundred.
        odds = np.log(prior / (1 - prior)) + said * np.log(0.3 / 0.03) + (m - said) * np.log(0.7 / 0.97)
        posterior = 1 / (1 + np.exp(-odds))
        self.prior = prior
        for _ in range(100):
            self.fit(votes.astype(float), n, posterior, m)
            fresh = self.posterior(votes)
            if np.abs(fresh - posterior).max() < 1e-6:
                break
            posterior = fresh

    def fit(self, votes, n, posterior, m):
        self.alone, self.both = np.zeros((2, m)), np.zeros((2, m, m, 2, 2))
        gain = np.zeros((m, m))
        for y, p in ((0, 1 - posterior), (1, posterior)):
            w = p * n
            total = w.sum() + 2.0
            self.alone[y] = (w @ votes + 1.0) / total
            a = self.alone[y]
            together = ((votes * w[:, None]).T @ votes + a[:, None] * a * 2.0) / total
            joint = np.empty((m, m, 2, 2))
            joint[..., 1, 1] = together
            joint[..., 1, 0] = a[:, None] - together
            joint[..., 0, 1] = a[None, :] - together
            joint[..., 0, 0] = 1 - a[:, None] - a[None, :] + together
            self.both[y] = joint = np.clip(joint, 1e-9, 1)
            single = np.stack([1 - a, a], axis=-1)
            gain += w.sum() / n.sum() * (joint * (np.log(joint) - np.log(single[:, None, :, None]) - np.log(single[None, :, None, :]))).sum(axis=(2, 3))
        self.prior = float(np.clip((posterior * n).sum() / n.sum(), 0.001, 0.5))
        # Prim's spanning tree with the largest gains.
        self.tree, inside = [], [0]
        while len(inside) < m:
            out = [j for j in range(m) if j not in inside]
            _, i, j = max((gain[i, j], -i, -j) for i in inside for j in out)
            self.tree.append((-i, -j))
            inside.append(-j)

    def posterior(self, votes):
        v = votes.astype(int)
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for y, sign in ((1, 1), (0, -1)):
            single = np.log(np.stack([1 - self.alone[y], self.alone[y]], axis=-1))
            odds += sign * single[0, v[:, 0]]
            for i, j in self.tree:
                odds += sign * (np.log(self.both[y][i, j][v[:, i], v[:, j]]) - single[i, v[:, i]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _training_rows(model):
    def run(batches):
        import pyarrow as pa

        ballot = Ballot(model.value)
        for batch in batches:
            votes, ids = [], []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                own, (doc, keys) = ballot(data, offsets)
                votes += [r.tobytes() for r in own]
                ids += np.split(keys.astype(np.int32), np.cumsum(np.bincount(doc, minlength=len(own)))[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(votes, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "votes", "ids"])

    return run


def fit_linear(rows, targets, size):
    """Logistic regression on the lexicon entries that a text holds: their weights, and the bias."""
    weights, bias = np.zeros(size), float(np.log(max(targets.mean(), 1e-3) / max(1 - targets.mean(), 1e-3))) if len(targets) else 0.0
    rng, steps, done = np.random.default_rng(SEED), max(EPOCHS * len(rows), 1), 0
    squares = np.full(size, 1.0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            odds = bias + weights[ids].sum()
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - targets[i]
            rate = RATE * (1 - done / steps)
            done += 1
            squares[ids] += error * error
            weights[ids] -= rate * error / np.sqrt(squares[ids])
            bias -= 0.02 * rate * error
    return weights, bias


def calibrate(odds, labels):
    """Slope and offset of log odds that fit the labels (Platt's scaling by Newton steps)."""
    slope, offset = 1.0, 0.0
    if len(set(labels.tolist())) < 2:
        return slope, offset
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - labels) * odds).sum() + 1e-3 * (slope - 1), (p - labels).sum()])
        h = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        slope, offset = slope - change[0], offset - change[1]
        if np.abs(change).max() < 1e-8:
            break
    return float(slope), float(offset)


def train_toxicity(rows: DataFrame, labels: DataFrame, learn, label_col: str = "toxic"):
    """(lexicon, weights, bias) of the linear classifier, from all rows (doc_id, text) and the labels that may be learned from."""
    context = rows.sparkSession.sparkContext
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null").where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = stash(known.orderBy(*order).limit(LABELLED))
    labelled = stash(rows.where(learn).join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    lexicon = context.broadcast(learn_lexicon(labelled))
    entries = len(lexicon.value[0])
    seen = rows.select("text").mapInArrow(_patterns(lexicon), "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    prior = labelled.agg(F.avg("label").alias("p")).first()["p"]
    if not seen:
        return lexicon, np.zeros(entries), -3.0
    votes = np.array([np.frombuffer(r["votes"], np.uint8) for r in seen]).reshape(len(seen), len(Ballot.NAMES))
    judge = LabelModel(votes, np.array([r["n"] for r in seen]), float(np.clip(0.05 if prior is None else prior, 0.001, 0.5)))
    sample = labelled.orderBy(*order).limit(TRAIN_ROWS).select("text", "label", "doc_id")
    table = sample.mapInArrow(_training_rows(lexicon), "doc_id long, label int, votes binary, ids array<int>").toArrow().sort_by([("doc_id", "ascending")])
    own = np.array([np.frombuffer(v.as_py(), np.uint8) for v in table.column("votes")], dtype=np.uint8).reshape(len(table), len(Ballot.NAMES))
    features = [np.asarray(x.values) for x in table.column("ids")]
    truth = np.array(table.column("label").to_pylist(), dtype=int)
    weights, bias = fit_linear(features, judge.posterior(own), entries)
    odds = np.array([bias + weights[ids].sum() for ids in features])
    slope, offset = calibrate(odds, truth)
    return lexicon, slope * weights, slope * bias + offset


def _score(lexicon, model):
    def run(batches):
        import pyarrow as pa

        weights, bias = model.value
        ballot = Ballot(lexicon.value)
        for batch in batches:
            scores = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                _, (doc, ids) = ballot(data, offsets)
                odds = bias + np.bincount(doc, weights=weights[ids.astype(np.int64)], minlength=len(offsets) - 1)
                scores.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score, predicted. ``learn`` says by doc_id which rows may be learned from."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    lexicon, *fitted = train_toxicity(rows, labels, F.lit(True) if learn is None else learn, label_col)
    model = docs.sparkSession.sparkContext.broadcast(tuple(fitted))
    return rows.mapInArrow(_score(lexicon, model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_split(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    held = crc_mod(F.col("doc_id"), modulus) == remainder
    return score_toxicity(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")
