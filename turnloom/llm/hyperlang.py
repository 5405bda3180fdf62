"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram is bound by
multiplying the vectors of its letters, each permuted (rotated) by its place; a
document bundles its trigram vectors by adding them; a language prototype bundles all
training documents of that language. A document gets the language whose prototype
has the largest cosine with its own vector.

Letters are any characters that Unicode counts as letters, lower-cased; anything else
is a gap between words and has a class of its own. Letters beyond a-z share OTHERS
classes by code point (more than an alphabet has, so that the letters of one script
mostly differ), so the number of trigrams is bounded and the table of their
vectors is built inside each task from a seed. Prototypes are summed in Spark and
collected: languages x DIMENSIONS numbers.

Defined cases: null text, or text without a letter, is "und" with score 0, as is
every text if nothing was learned. Rows with null lang are not learned from. Equal
cosines go to the language that sorts first. Repeated rows count as often as they
occur. A null id is predicted too. Other columns are never read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Tally, text_chunks
from ._tables import crc_mod

#: Length of the vectors; classes of letters beyond a-z; seed of the random vectors.
DIMENSIONS, OTHERS, SEED = 512, 101, 17
CLASSES = 27 + OTHERS


class Encoder:
    """Text to trigram counts and vectors. Make one per task."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        letters = rng.integers(0, 2, (CLASSES, DIMENSIONS)).astype(np.int8) * 2 - 1
        first, middle = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        pairs = (first[:, None, :] * middle[None, :, :]).reshape(-1, DIMENSIONS)
        self.pairs, self.letters = pairs, letters
        self.bound = np.zeros((1024, DIMENSIONS), dtype=np.float32)
        self.slot = np.full(CLASSES**3, -1, dtype=np.int32)
        self.used = 0
        classes = np.zeros(0x110000, dtype=np.int16)
        for point in range(0x110000):
            if (point < 0xD800 or point > 0xDFFF) and chr(point).isalpha():
                low = ord(chr(point).lower()[0])
                classes[point] = low - 96 if 97 <= low <= 122 else 27 + low * 40503 % 65537 % OTHERS
        self.classes = classes

    def trigrams(self, data):
        """Distinct trigram codes of one text (UTF-8 bytes) and their counts; None if it has no letter."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        ids = np.zeros(len(points) + 2, dtype=np.int32)
        ids[1:-1] = self.classes[points]
        if not ids.any():
            return None
        codes = (ids[:-2] * CLASSES + ids[1:-1]) * CLASSES + ids[2:]
        codes.sort()
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        keys, counts = codes[heads], np.diff(np.concatenate([heads, [len(codes)]]))
        return (keys[1:], counts[1:]) if keys[0] == 0 else (keys, counts)

    def vector(self, keys, counts):
        at = self.slot[keys]
        fresh = keys[at < 0]
        if len(fresh):
            while self.used + len(fresh) > len(self.bound):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            self.bound[self.used : self.used + len(fresh)] = self.pairs[fresh // CLASSES] * self.letters[fresh % CLASSES]
            self.slot[fresh] = np.arange(self.used, self.used + len(fresh))
            self.used += len(fresh)
            at = self.slot[keys]
        return counts.astype(np.float32) @ self.bound[at]


def _bundle(batches):
    """(lang, place, value): the summed vectors of each language in this task."""
    import pyarrow as pa

    encoder, sums = Encoder(), {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, _, data, offsets in text_chunks(batch.column(0)):
            for i in range(len(offsets) - 1):
                found = encoder.trigrams(data[offsets[i] : offsets[i + 1]])
                if found is not None:
                    sums.setdefault(langs[first + i], Tally(200_000)).add(*found)
    for lang, tally in sums.items():
        keys, counts = tally.fold()
        value = np.zeros(DIMENSIONS)
        for k in range(0, len(keys), 4096):
            part = keys[k : k + 4096]
            value += counts[k : k + 4096].astype(np.float64) @ (encoder.pairs[part // CLASSES] * encoder.letters[part % CLASSES])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(value)], ["lang", "place", "value"])


def _predict(model):
    def run(batches):
        import pyarrow as pa

        langs, prototypes = model.value
        encoder = Encoder()
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                for i in range(len(offsets) - 1):
                    found = encoder.trigrams(data[offsets[i] : offsets[i + 1]]) if langs else None
                    if found is None:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    own = encoder.vector(*found)
                    cosine = prototypes @ own / max(float(np.linalg.norm(own)), 1e-12)
                    best = int(cosine.argmax())
                    names.append(langs[best])
                    scores.append(float(min(max(cosine[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit prototypes, from rows (text, lang)."""
    sums = train.where("lang is not null").mapInArrow(_bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    table = sums.orderBy("lang", "place").toPandas()
    langs = sorted(table["lang"].unique().tolist())
    if not langs:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    matrix = table["value"].to_numpy().reshape(len(langs), DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return langs, (matrix / np.maximum(norms, 1e-12)).astype(np.float32)


def identify_languages(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Rows where ``held_out`` holds are not learned from."""
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), held.alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(language_prototypes(rows.where(~F.col("held_out")).select("text", "lang")))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_training_split(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    return identify_languages(docs, crc_mod(docs["doc_id"], modulus) == remainder)
