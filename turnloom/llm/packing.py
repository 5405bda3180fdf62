"""Packing token ids into fixed windows: bounded-space, online, best fit.

Each task reads its documents once and keeps OPEN windows open at most. A document's
whole windows go out at once; its remainder goes into the open window that it fills
best. When none can take it and no further window may be opened, the fullest one is
topped up with the head of the remainder and emitted, so nothing is padded there. At
the end each task's open windows are left over; their pieces, ids included (OPEN
windows per task, a bound), meet in groups of MERGE tasks, in the order of tasks and
places, and are packed once more by the same rule, then poured together, so that each
group pads its last window only. So no merging task reads more than MERGE * OPEN
windows, and the groups grow with the table.

A sequence may be shorter than the window without padding if its length is a power of
two; no use is made of that but for counting padding.

Ids are those of the tokenizers library with its defaults: an added token of the
vocabulary file that stands in a text gets its own id.

Defined cases: null text counts as empty; an empty text is its end id alone. Texts of
any length are read whole; parts over PART bytes are not remembered. A null id
is packed like any other. Repeated rows are packed one by one. An empty table gives an
empty result. Other columns are ignored.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import picked, stash

#: Ids of a window; windows open in one task; tasks whose leftovers are merged together; cached words of a task; their characters at most.
WINDOW, OPEN, MERGE, CACHE, PART = 1024, 64, 8, 400_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task int, place int"


def byte_ranks(path):
    """(pieces as bytes with their ids, added tokens with theirs) of a byte-level BPE file, where ids follow the order of merges."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    odd = [t["content"] for t in model["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"added tokens that take spaces or whole words are not supported: {odd}")
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(spare)}
    return {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in added}, added


class Parts(dict):
    """Ids of text parts that follow a space, as bytes; None for a part that must not be cut off there."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part):
        ids = self.encode(" " + part) if part and part.strip() == part else None
        if len(part) <= PART:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Text to ids (little-endian unsigned 32-bit) with the given vocabulary file. Make one per task.

    A text is cut before single spaces that stand between other characters; no token
    crosses such a place, so each part can be encoded by itself and remembered. A text
    with any other space, or with an added token, is encoded whole.
    """

    def __init__(self, path, pattern):
        import tiktoken

        ranks, self.added = byte_ranks(path)
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.known = Parts(self.whole)

    def whole(self, text):
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text):
        if not text:
            return b""
        if any(a in text for a in self.added):
            return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        head, *tail = text.split(" ")
        if not head or head.strip() != head:
            return self.whole(text)
        try:
            return self.whole(head) + b"".join(map(self.known.__getitem__, tail))
        except TypeError:
            return self.whole(text)


class Packer:
    """Windows of one task. Pieces are (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, first_id, window, open_windows):
        self.window, self.limit, self.next = window, open_windows, first_id
        self.open = []  # [used, pieces]
        self.out = []

    def emit(self, pieces):
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, None, None, None))
            offset += n
        self.next += 1

    def add(self, doc, start, ids, total):
        n = len(ids) // 4
        while n >= self.window:
            self.emit([(doc, start, ids[: 4 * self.window], total)])
            start, ids, n = start + self.window, ids[4 * self.window :], n - self.window
        while n:
            room = [(self.window - w[0], i) for i, w in enumerate(self.open) if w[0] + n <= self.window]
            if room:
                at = min(room)[1]
                self.put(at, doc, start, ids, n, total)
                return
            if len(self.open) < self.limit:
                self.open.append([n, [(doc, start, ids, total)]])
                return
            at = max(range(len(self.open)), key=lambda i: self.open[i][0])
            m = self.window - self.open[at][0]
            self.put(at, doc, start, ids[: 4 * m], m, total)
            start, ids, n = start + m, ids[4 * m :], n - m

    def put(self, at, doc, start, ids, n, total):
        window = self.open[at]
        window[0] += n
        window[1].append((doc, start, ids, total))
        if window[0] == self.window:
            self.emit(window[1])
            del self.open[at]

    def leftovers(self, task):
        """Pieces of the windows still open, with their ids, task and place, and no sequence yet."""
        pieces = [p for _, own in self.open for p in own]
        for place, (doc, start, ids, total) in enumerate(pieces):
            self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids, task, place))
        self.open = []

    def pour(self):
        """Fill the fullest windows from the emptiest; the last one is emitted as it is."""
        self.open.sort(key=lambda w: w[0])
        while len(self.open) > 1:
            for piece in self.open.pop(0)[1]:
                doc, start, ids, total = piece
                while ids and self.open:
                    at = len(self.open) - 1
                    m = min(self.window - self.open[at][0], len(ids) // 4)
                    self.put(at, doc, start, ids[: 4 * m], m, total)
                    start, ids = start + m, ids[4 * m :]
                if ids:
                    self.open.append([len(ids) // 4, [(doc, start, ids, total)]])
        for _, pieces in self.open:
            self.emit(pieces)
        self.open = []

    def batch(self):
        import pyarrow as pa

        kinds = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.out, strict=True)) or [[] for _ in names]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _pack(path, pattern, end_id, window, open_windows):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, packer = Encoder(path, pattern), Packer(task << 40, window, open_windows)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.out) > 20_000:
                    yield packer.batch()
        packer.leftovers(task)
        yield packer.batch()

    return run


def _merge(window, open_windows):
    def run(batches):
        import itertools

        rows = (row for batch in batches for row in batch.to_pylist())
        for group, own in itertools.groupby(rows, key=lambda r: r["task"] // MERGE):
            packer = Packer((1 << 62) + (group << 40), window, open_windows)
            for row in own:
                packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            packer.pour()
            yield packer.batch()

    return run


def pack(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary``: a byte-level BPE file that every executor can read at this path;
    ``pattern`` splits texts before its merges.
    """
    rows = picked(docs, id_col, text_col)
    packed = stash(rows.mapInArrow(_pack(vocabulary, pattern, end_id, window, open_windows), PIECES))
    left = packed.where("sequence_id is null").select("doc_id", "start", "ids", "doc_tokens", "task", "place")
    # Whole groups of MERGE tasks meet in one partition; the order of their pieces is that of tasks and places.
    group = F.floor(F.col("task") / MERGE)
    grouped = left.repartition(group).sortWithinPartitions("task", "place")
    merged = grouped.mapInArrow(_merge(window, open_windows), PIECES)
    return packed.where("sequence_id is not null").unionByName(merged).drop("ids", "task", "place")


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequences, tokens and padded: how many ids of padding the sequences need."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(window - F.col("n"))).alias("padded"))
