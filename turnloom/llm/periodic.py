"""Periodic runs of words: suffix trees, constant-time common extensions, Lyndon roots.

A run is a stretch of words with smallest period q that no neighbouring word extends
keeping that period. Every run of two periods or more has a Lyndon root that is the
longest Lyndon word at its place, under the order of words or its reverse; so two
candidates a place name all runs. Each candidate is extended to the right in the tree
of the document and to the left in the tree of its reversal. Both trees come from
Ukkonen's algorithm; the longest common extension of two suffixes is the depth of
their leaves' lowest common ancestor, a range minimum over an Euler tour.

Before that, words that no wanted run can hold are put together: in a run of
``exponent`` periods every three words in a row recur, so a stretch of words whose
triples are too rare in the document becomes one word of its own. That shortens the
trees and changes no run, since a run never crosses a word that stands only once.

Documents are read once and stay in the tasks that read them; there is no shuffle. A
task needs memory in proportion to its longest document.

Defined cases: null text has no words and no runs. Texts of any length are read whole.
Repeated rows and null ids are treated row by row. An empty table gives an empty
result. Other columns are ignored.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import picked

#: Least words of a run and least number of its periods.
WORDS, EXPONENT = 6, 4
#: Entries of the Euler tour that make a block, and bytes of text handled at once inside a task.
BLOCK, CHUNK = 16, 4_000_000
RUNS = "doc_id long, n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string"


class SuffixTree:
    """Suffix tree of a list of positive integers, by Ukkonen's algorithm; 0 ends the text.

    ``first`` and ``last`` bound the label of the edge into a node, ``child`` leads from
    ``node * width + word`` to the node below.
    """

    def __init__(self, words):
        text = self.text = [*words, 0]
        n, width = len(text), max(text) + 1
        first, last, link, child, leaves = [0], [0], [0], {}, []
        node = edge = length = remaining = 0
        for i, word in enumerate(text):
            remaining += 1
            pending = 0
            while remaining:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    size = min(last[below], i + 1) - first[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if text[first[below] + length] == word:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    middle = len(first)
                    first.append(first[below])
                    last.append(first[below] + length)
                    link.append(0)
                    child[key] = middle
                    first[below] += length
                    child[middle * width + text[first[below]]] = below
                    child[middle * width + word] = len(first)
                    if pending:
                        link[pending] = middle
                    pending = middle
                leaves.append(len(first))
                first.append(i)
                last.append(n)
                link.append(0)
                remaining -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remaining + 1
        self.first, self.last, self.leaves = first, last, leaves
        self.below = [() if end == n else [] for end in last]
        for key in sorted(child):
            self.below[key // width].append(child[key])

    def suffixes(self):
        """The suffix that ends in each node, or -1."""
        suffix = [-1] * len(self.first)
        for k, leaf in enumerate(self.leaves):
            suffix[leaf] = k
        return suffix

    def euler_tour(self):
        """(depth in words at each visit, each suffix's first visit, suffixes in order)."""
        first, last, children = self.first, self.last, self.below
        depth, suffix = [0] * len(first), self.suffixes()
        tour, visit, order, stack = [], [0] * len(self.leaves), [], [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            here, k = depth[node], suffix[node]
            if k >= 0:
                visit[k] = len(tour)
                order.append(k)
            else:
                for below in reversed(children[node]):
                    depth[below] = here + last[below] - first[below]
                    stack.append(~node)
                    stack.append(below)
            tour.append(here)
        return tour, visit, order

    def reversed_order(self):
        """Suffixes in the order where larger words come first, but the end of the text before them all."""
        suffix, order, stack = self.suffixes(), [], [0]
        while stack:
            node = stack.pop()
            below = self.below[node]
            if suffix[node] >= 0:
                order.append(suffix[node])
            elif self.text[self.first[below[0]]] == 0:
                stack += below[1:]
                stack.append(below[0])
            else:
                stack += below
        return order


class CommonExtension:
    """Longest common prefixes of suffixes in constant time: minima over the Euler tour.

    Minima from both ends of each block of visits, and a sparse table over whole blocks.
    """

    def __init__(self, tour, visit):
        depth = np.full(-(-len(tour) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        depth[: len(tour)] = tour
        blocks = depth.reshape(-1, BLOCK)
        self.depth, self.visit = depth, np.array(visit)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            half, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(half[:-step], half[step:]))

    def __call__(self, i, j):
        """Words that the suffixes from i and from j (arrays, i != j) have in common."""
        low, high = np.minimum(self.visit[i], self.visit[j]), np.maximum(self.visit[i], self.visit[j])
        least = np.minimum(self.tail[low], self.head[high])
        a, b = low // BLOCK + 1, high // BLOCK
        inside = a > b
        for k in range(BLOCK):
            at = low[inside] + k
            value = np.where(at <= high[inside], self.depth[np.minimum(at, high[inside])], np.iinfo(np.int32).max)
            least[inside] = value if k == 0 else np.minimum(least[inside], value)
        between = np.flatnonzero(a < b)
        level = np.frexp(b[between] - a[between])[1] - 1
        for k in np.unique(level):
            at = between[level == k]
            least[at] = np.minimum(least[at], np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << int(k))]))
        return least


def lyndon_lengths(order, n):
    """Length of the longest Lyndon word at each place, from the order of the suffixes: up to the next smaller one."""
    rank = [0] * (n + 1)
    for k, at in enumerate(order):
        rank[at] = k
    smaller = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        mine, j = rank[i], i + 1
        while rank[j] > mine:
            j = smaller[j]
        smaller[i] = j
    return np.array(smaller[:n]) - np.arange(n)


def runs_of(words, least_words=WORDS, exponent=EXPONENT):
    """Runs of a list of positive integers: sorted (start, length, period) of at least ``exponent`` periods (two or more)."""
    n = len(words)
    tree = SuffixTree(words)
    tour, visit, order = tree.euler_tour()
    start, period = [], []
    for way in (order, tree.reversed_order()):
        lengths = lyndon_lengths(way, n)
        start.append(np.flatnonzero(lengths * exponent <= n))
        period.append(lengths[start[-1]])
    del tree
    start, period = np.unique(np.stack([np.concatenate(start), np.concatenate(period)]), axis=1)
    more = CommonExtension(tour, visit)(start, start + period)
    # The first such root of a run begins within its first period, so this much follows it.
    rooted = more >= (exponent - 2) * period
    start, period, more = start[rooted].astype(np.int64), period[rooted].astype(np.int64), more[rooted].astype(np.int64)
    if not len(start):
        return []
    tour, visit, _ = SuffixTree(words[::-1]).euler_tour()
    before = CommonExtension(tour, visit)(n - start, n - start - period).astype(np.int64)
    length = before + period + more
    kept = length >= np.maximum(least_words, exponent * period)
    return sorted(set(zip((start - before)[kept].tolist(), length[kept].tolist(), period[kept].tolist())))


def shortened(words, least_words=WORDS, exponent=EXPONENT):
    """(words as positive integers, their places) with every stretch that no run touches put together to one word.

    A run of period q holds each of its triples exponent - 1 times (q > 1) or, of one
    word alone, as often as it has triples. Counted again among what is left, twice.
    """
    need = min(exponent - 1, max(exponent, least_words) - 2)
    known = defaultdict(count(1).__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    places = np.arange(len(words))
    if need < 2 or least_words < 3:
        return ids.tolist(), places.tolist()
    for _ in range(2):
        if len(ids) < least_words:
            return [], []
        width = int(ids.max()) + 1
        pairs = ids[:-1] * width + ids[1:]
        if width > 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * width + ids[2:], return_inverse=True, return_counts=True)
        often = times[which] >= need
        if not often.any():
            return [], []
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(often) + k] |= often
        # Of each stretch that is not covered, the first word stays under a number of its own.
        kept = covered.copy()
        kept[1:] |= covered[:-1]
        kept[0] = True
        ids = np.where(covered, ids, 0)[kept]
        places = places[kept]
        own = np.flatnonzero(ids == 0)
        ids[own] = width + np.arange(len(own))
    return (np.unique(ids, return_inverse=True)[1] + 1).tolist(), places.tolist()


def document_runs(words, least_words=WORDS, exponent=EXPONENT):
    ids, places = shortened(words, least_words, exponent)
    return [(places[s], n, p) for s, n, p in runs_of(ids, least_words, exponent)] if len(ids) >= least_words else []


def collapsed(words, runs):
    """The words but for those that any run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, g in zip(words, gone) if not g)


def periodic_runs(docs: DataFrame, least_words: int = WORDS, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (sorted), and the text without the words that runs repeat."""

    def rows(ids, texts):
        counts, offsets, runs, kept = [], [0], [], []
        for text in texts:
            words = (text or b"").split()
            found = document_runs(words, least_words, exponent)
            counts.append(len(words))
            runs += found
            offsets.append(len(runs))
            kept.append(collapsed(words, found))
        fields = np.array(runs, np.int64).reshape(-1, 3).T
        entries = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def task(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            first = held = 0
            for k in range(len(texts)):
                held += len(texts[k].as_buffer() or b"")
                if held > CHUNK or k + 1 == len(texts):
                    yield rows(batch.column(0)[first : k + 1], texts[first : k + 1].to_pylist())
                    first, held = k + 1, 0

    return picked(docs, id_col, text_col).mapInArrow(task, RUNS)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of one document in ten repeat with a period drawn from its id.

    With h the CRC-32 of the id, g = floor(h / 10) and n words: if h % 10 = 0, the words
    from place a = g % n repeat the first 1 + floor((n - a) / (3 + g % 8)) of them.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = picked(docs).withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))})
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", F.slice("words", 1, F.col("a")), tail)).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: the number of runs, the one of the greatest exponent, and digests of all runs and of what is kept."""
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),"
        " (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return (
        periodic_runs(with_periodic_tails(docs))
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
            F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
            F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
