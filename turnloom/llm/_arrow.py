"""Vectorised text helpers used inside Python tasks.

Texts are read straight out of Arrow buffers as byte arrays. Words are runs of
bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; each gets a 64-bit fingerprint
computed for a whole chunk at once: two polynomials over its bytes, modulo two primes
below 2**31 and at fixed bases drawn at random, then a finalising mix. Words of n bytes
that were not made with the bases in mind share both with probability about
(n / 2**31)**2.
"""

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer text is one chunk of its own.
CHUNK_BYTES = 2_000_000
#: Primes and bases of the two polynomials; places whose terms are summed before the next remainder is taken.
LANES = ((2147483647, 1103515249), (2147483629, 1566083941))
SUMMED = 1 << 22


def text_chunks(column, limit=CHUNK_BYTES):
    """Split an Arrow string column into runs of whole texts.

    Yields ``(first, last, data, offsets)``: the row range, its bytes as uint8, and
    ``last - first + 1`` offsets into them. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        start, end = int(offsets[first]), int(offsets[last])
        yield first, last, whole[start:end], offsets[first : last + 1] - start
        first = last


def mix64(x):
    """Finalising mix of uint64 values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Fingerprints of all words of a chunk. Make one per task; it keeps the powers of BASE."""

    def __init__(self, lower=True):
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[65:91] += 32
        self.fold = table
        space = np.zeros(256, dtype=bool)
        space[[32, *range(9, 14)]] = True
        self.word = ~space
        self.tables = [(np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))] * 2

    def powers(self, lane, n):
        """Powers of the lane's base and of its inverse, at least n of each."""
        prime, base = LANES[lane]
        if len(self.tables[lane][0]) < n:
            n = max(n, 1 << 16)
            grown = []
            for b in (base, pow(base, -1, prime)):
                out = np.ones(1, dtype=np.uint64)
                while len(out) < n:
                    out = np.concatenate([out, out * np.uint64(pow(b, len(out), prime)) % np.uint64(prime)])
                grown.append(out)
            self.tables[lane] = tuple(grown)
        return self.tables[lane]

    def polynomial(self, lane, data, starts, ends):
        """The lane's polynomial over the bytes of each word, counted from its own start."""
        prime = np.uint64(LANES[lane][0])
        power, inverse = self.powers(lane, len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        for k in range(0, len(data), SUMMED):
            part = (data[k : k + SUMMED].astype(np.uint64) + np.uint64(1)) * power[k : k + SUMMED][: len(data) - k]
            total[k + 1 : k + SUMMED + 1] = (np.cumsum(part) + total[k]) % prime
        return (total[ends] + prime - total[starts]) % prime * inverse[starts] % prime

    def __call__(self, data, offsets):
        """``(hashes, starts, ends, words per document)`` of the words, in order."""
        data = self.fold[data]
        n = len(data)
        word = self.word[data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = word
        before[offsets] = False
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = word
        after[offsets] = False
        starts = np.flatnonzero(word & ~before[:n])
        ends = np.flatnonzero(word & ~after[1:]) + 1
        hashes = mix64((self.polynomial(0, data, starts, ends) << np.uint64(32)) | self.polynomial(1, data, starts, ends))
        counts = np.diff(np.searchsorted(starts, offsets))
        return hashes, starts, ends, counts


def signed(x):
    """uint64 values as the int64 values that a Spark long can hold."""
    return x.view(np.int64)


def merge_counts(keys, counts):
    """Sum the counts of equal keys; returns sorted distinct keys and their sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


class Tally:
    """Counts of 64-bit keys over one task, folded together whenever the parts grow large."""

    def __init__(self, limit=4_000_000):
        self.keys, self.counts, self.held, self.limit = [], [], 0, limit

    def add(self, keys, counts=None):
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.limit:
            self.fold()
            self.limit = max(self.limit, 2 * self.held)

    def fold(self):
        if self.keys:
            keys, counts = merge_counts(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
            return keys, counts
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
