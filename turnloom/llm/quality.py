"""Quality classifier: supervised subword embeddings.

Every word (with its case), every pair of neighbouring words and every character n-gram
of NGRAMS bytes is hashed to one of BUCKETS vectors, in a table for each of the three. A
document is the average of its vectors in each table, side by side; a softmax layer
turns that into class probabilities. Vectors and layer are trained together by plain
numpy stochastic gradient descent.

Labels are learned from at most TRAIN_ROWS labelled rows, those with the smallest
hash of their id; the executors turn them into hashed feature counts, and all of a
row's features reach the driver, compressed, to be unpacked one row at a time. There
are at most 3 * BUCKETS of them a row, so what the driver holds is bounded
whatever the size of the corpus. Training and scoring read whole texts.

Defined cases: null or empty text has no features and gets the score of the bias
alone. An id with several labels counts with the largest; of several training texts
with one id the least is learned from. Without labels, or with one class only, the score is the share of label 1 (0.5
without labels). Rows repeated with one id are scored one by one. A null id is scored
and never learned from. Labels, lang, source and ids are never inputs of a score.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import WordHasher, mix64, text_chunks
from ._tables import crc_mod

#: Rows of the training sample; hash buckets; length of the vectors; n-gram lengths in bytes.
TRAIN_ROWS, BUCKETS, WIDTH, NGRAMS = 6000, 1 << 16, 8, (2, 3, 4)
EPOCHS, RATE, SEED = 8, 0.5, 5
COLUMNS = ("words", "word_counts", "grams", "gram_counts", "pairs", "pair_counts")


class Features:
    """Hashed feature ids of the words and n-grams of a chunk. Make one per task."""

    def __init__(self):
        self.hasher = WordHasher(lower=False)

    def kinds(self, data, offsets):
        """The features of each table in turn."""
        self.hashes, _, _, counts = self.hasher(data, offsets)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        return self.words(data, offsets), self.grams(data, offsets), self.pairs()

    def words(self, data, offsets):
        """(document index, bucket) of every word."""
        return self.doc, (self.hashes >> np.uint64(48)).astype(np.int64) % BUCKETS

    def pairs(self):
        """(document index, bucket) of every two neighbouring words of one text; a word and itself are one pair, whichever word."""
        whole = self.doc[:-1] == self.doc[1:]
        mixed = mix64(self.hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.hashes[1:])
        mixed[self.hashes[:-1] == self.hashes[1:]] = 0
        return self.doc[:-1][whole], (mixed >> np.uint64(48)).astype(np.int64)[whole] % BUCKETS

    def grams(self, data, offsets):
        """(document index, bucket) of every n-gram that lies in one text."""
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        code = np.zeros(len(data), dtype=np.uint64)
        docs, ids = [], []
        for k in range(max(NGRAMS)):
            code = (code << np.uint64(8)) | np.concatenate([data[k:], np.zeros(min(k, len(data)), np.uint8)]).astype(np.uint64)
            if k + 1 in NGRAMS and len(data) > k:
                whole = doc[: len(doc) - k] == doc[k:]
                mixed = (code[: len(doc) - k] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                docs.append(doc[: len(doc) - k][whole])
                ids.append((mixed >> np.uint64(48)).astype(np.int64)[whole] % BUCKETS)
        empty = np.zeros(0, np.int64)
        return (np.concatenate(docs), np.concatenate(ids)) if docs else (empty, empty)


def _sample_features(batches):
    """(doc_id, label, then ids and counts of each kind of feature as packed integers) of each training row."""
    import pyarrow as pa

    features = Features()

    def counted(ids):
        ids, counts = np.unique(ids, return_counts=True)
        steps = np.diff(ids, prepend=0)
        return zlib.compress(steps.astype("<u2").tobytes(), 1), zlib.compress(counts.astype("<u4").tobytes(), 1)

    for batch in batches:
        out = [[] for _ in range(6)]
        for _, _, data, offsets in text_chunks(batch.column(0)):
            for kind, (doc, ids) in enumerate(features.kinds(data, offsets)):
                order = np.argsort(doc, kind="stable")
                for part in np.split(ids[order], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))[:-1]):
                    got, counts = counted(part)
                    out[2 * kind].append(got)
                    out[2 * kind + 1].append(counts)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *[pa.array(x, pa.binary()) for x in out]], ["doc_id", "label", *COLUMNS])


class Rows:
    """Training rows as they came, unpacked one by one: (ids, counts) of each kind of feature."""

    def __init__(self, columns, order):
        self.columns, self.order = columns, order

    def __len__(self):
        return len(self.order)

    def __getitem__(self, i):
        steps, counts = ([np.frombuffer(zlib.decompress(c[self.order[i]].as_buffer()), kind) for c in self.columns[k::2]] for k, kind in ((0, "<u2"), (1, "<u4")))
        return [(np.cumsum(x, dtype=np.int64), y) for x, y in zip(steps, counts, strict=True)]


class Embeddings:
    """Vectors of three kinds of features with a softmax over two classes."""

    def __init__(self, share=0.5):
        rng = np.random.default_rng(SEED)
        self.vectors = [rng.normal(0, 0.1, (BUCKETS, WIDTH)) for _ in range(3)]
        self.layer = np.zeros((3 * WIDTH, 2))
        share = min(max(share, 0.01), 0.99)
        self.bias = np.array([np.log(1 - share), np.log(share)])

    def fit(self, rows, labels):
        """rows: per document (ids, counts) of each kind; a document averages over its counts."""
        rng = np.random.default_rng(SEED)
        self.layer = rng.normal(0, 0.1, self.layer.shape)
        steps, done = EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                rate = RATE * (1 - done / steps)
                done += 1
                row = [(ids, (counts / max(counts.sum(), 1)).astype(np.float32)) for ids, counts in rows[i]]
                hidden = np.concatenate([w @ v[ids] if len(ids) else np.zeros(WIDTH) for v, (ids, w) in zip(self.vectors, row, strict=True)])
                logits = hidden @ self.layer + self.bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[labels[i]] -= 1
                back = self.layer @ error
                self.layer -= rate * np.outer(hidden, error)
                self.bias -= rate * error
                for k, (ids, w) in enumerate(row):
                    if len(ids):
                        # Each vector is stepped by its share of the average; the square root speeds up rare ones.
                        self.vectors[k][ids] -= rate * np.sqrt(w)[:, None] * back[k * WIDTH : (k + 1) * WIDTH]
        return self

    def weights(self):
        """Per kind, the pull of each bucket on the log odds of class 1; and the bias of the log odds."""
        pull = self.layer[:, 1] - self.layer[:, 0]
        return [(v @ pull[k * WIDTH : (k + 1) * WIDTH]).astype(np.float32) for k, v in enumerate(self.vectors)], float(self.bias[1] - self.bias[0])


def train_quality(labelled: DataFrame) -> tuple[list[np.ndarray], float]:
    """Fit on rows (doc_id, text, label) and return what scoring needs."""
    sample = labelled.where("doc_id is not null and label is not null").select("text", F.col("label").cast("int"), "doc_id")
    table = sample.mapInArrow(_sample_features, "doc_id long, label int, " + ", ".join(f"{c} binary" for c in COLUMNS)).toArrow()
    order = np.argsort(np.asarray(table.column("doc_id")), kind="stable")
    labels = np.asarray(table.column("label")).astype(int)[order]
    share = float(labels.mean()) if len(labels) else 0.5
    model = Embeddings(share)
    if len(set(labels.tolist())) == 2:
        model.fit(Rows([table.column(c) for c in COLUMNS], order), labels)
    return model.weights()


def _score(model):
    def run(batches):
        import pyarrow as pa

        tables, bias = model.value
        features = Features()
        for batch in batches:
            scores = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                odds = np.full(n, bias)
                for table, (doc, ids) in zip(tables, features.kinds(data, offsets), strict=True):
                    count = np.bincount(doc, minlength=n)
                    odds += np.bincount(doc, weights=table[ids], minlength=n) / np.maximum(count, 1)
                scores.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], score], ["doc_id", *batch.schema.names[2:], "score"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, learn) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from; the few labels that count are joined by id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").where(learn)
    picked = known.where(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score, predicted. ``learn`` says by doc_id which rows may be learned from."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train_quality(labelled_rows(rows, labels, label_col, F.lit(True) if learn is None else learn)))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_split(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    held = crc_mod(F.col("doc_id"), modulus) == remainder
    return score_quality(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` at least, with all their columns."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train_quality(labelled_rows(rows, labels, "quality", F.lit(True) if learn is None else learn)))
    names = docs.columns
    packed = docs.select(F.lit(0).alias("k"), docs[text_col].cast("string").alias("t"), F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    scored = packed.mapInArrow(_score(model), T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("row", packed.schema["row"].dataType), T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") >= threshold).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
