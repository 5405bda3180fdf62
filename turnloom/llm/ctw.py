"""Context-tree weighting language model over bytes.

Each byte is decomposed into eight binary decisions. For every decision there is a
context tree over the preceding bytes, up to DEPTH of them; each node holds a
Krichevsky-Trofimov estimate, and the weighted probability of a node mixes its own
estimate with that of its children, half and half, at every depth:
Pw = 1/2 KT + 1/2 prod Pw(child). Scoring mixes the estimates along a path with the
posterior weights of that recursion, and gives log10 probability and bits per byte.

At scale: one pass counts (DEPTH+1)-grams of bytes and words of all texts, summed by
key in Spark. Every context that was seen is a node: the grams stay in a Spark table,
dealt by their TOP newest bytes of context, so that a task holds whole subtrees. A first
pass weighs those up to depth TOP, whose nodes (at most 255 * 256**TOP, whatever the size
of the corpus) the driver joins up to the root; a second gives each gram that any text
has its cost. The costs of the BASE_GRAMS most frequent grams are broadcast, the others
meet theirs in a shuffle. The unigram base needs the count of every word: the BASE_WORDS
most frequent words (bounded) are broadcast, the others meet their counts in a shuffle
by word.

Defined cases: null text counts as empty; an empty text still has its end token and
end byte. Without any training text all counts are zero, so every byte has
probability 1/256. Rows repeated with one id are scored one by one. A null id is
scored too. Bytes above 0x7F are ordinary symbols. Other columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Tally, WordHasher, signed, text_chunks
from ._tables import crc_mod, picked, stash

#: Bytes of context; bytes of context that a task's subtrees share; most grams whose costs, and words whose counts, are broadcast.
DEPTH, TOP, BASE_GRAMS, BASE_WORDS = 4, 2, 1 << 20, 1 << 19
#: Places of the hashed table of broadcast grams, as a power of two; grams that a task weighs at once, but for larger subtrees.
PLACES, WEIGHED = 19, 100_000
#: Bytes of text handled at once, and counts held before they are folded: only memory depends on them.
CHUNK, HELD = 500_000, 1_000_000


def _count(batches):
    """(kind, key, n): kind 0 words by fingerprint, kind 1 grams of DEPTH + 1 bytes, newest byte lowest, both of training texts; kind 2 grams of the others."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tallies, hasher = [Tally(HELD) for _ in range(3)], WordHasher()
    for batch in batches:
        for kind, part in ((1, batch.filter(pc.invert(batch.column(1)))), (2, batch.filter(batch.column(1)))):
            for _, _, data, offsets in text_chunks(part.column(0), CHUNK):
                if kind == 1:
                    tallies[0].add(hasher(data, offsets)[0])
                tallies[kind].add(gram_codes(*padded(hasher.fold[data], offsets)))
    for kind, tally in enumerate(tallies):
        keys, counts = tally.fold()
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(signed(part)), pa.array(counts[k : k + 100_000].astype(np.int64))], ["kind", "key", "n"])


def padded(data, offsets):
    """The texts of a chunk behind DEPTH zero bytes each, with one zero byte as end; and where each text starts."""
    n = len(offsets) - 1
    gap = DEPTH + 1
    begin = offsets[:-1] + gap * np.arange(n) + DEPTH
    body = np.zeros(len(data) + gap * n, dtype=np.uint8)
    body[np.arange(len(data)) + np.repeat(begin - offsets[:-1], np.diff(offsets))] = data
    return body, begin


def gram_codes(body, begin):
    """Codes of all grams whose newest byte belongs to a text or is its end byte."""
    valid = np.ones(len(body), dtype=bool)
    valid[begin[:, None] - 1 - np.arange(DEPTH)] = False
    code = np.zeros(len(body) - DEPTH, dtype=np.uint64)
    for k in range(DEPTH + 1):
        code = (code << np.uint64(8)) | body[k : k + len(code)].astype(np.uint64)
    return code[valid[DEPTH:]]


def log_kt(zeros, ones):
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_gamma(x):
    """Stirling's series after moving the argument up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def bit_counts(counts):
    """Zeros and ones seen at each of the 255 binary decisions, from counts (..., 256) of bytes."""
    zeros, ones = np.zeros((*counts.shape[:-1], 256)), np.zeros((*counts.shape[:-1], 256))
    for level in range(8):
        half = counts.reshape(*counts.shape[:-1], 1 << level, 2, 1 << (7 - level)).sum(axis=-1)
        at = np.arange(1 << level, 2 << level)
        zeros[..., at], ones[..., at] = half[..., 0], half[..., 1]
    return zeros, ones


class ContextTree:
    """The whole model in memory, for small corpora: what the tables of ``gram_costs`` must equal.

    Nodes by depth; child[node, byte] is the child's node, or -1 for the rest child of that node.
    """

    def __init__(self, levels):
        """levels[d]: dict from a context (an int, newest byte lowest) to its counts of next bytes."""
        nodes, self.order = [], []
        for depth, level in enumerate(levels):
            for context in sorted(level):
                nodes.append((depth, context, level[context]))
        index = {(d, c): i for i, (d, c, _) in enumerate(nodes)}
        n = len(nodes)
        counts = np.zeros((n, 256))
        self.child = np.full((n, 256), -1, dtype=np.int32)
        parents = np.full(n, -1)
        for i, (d, c, own) in enumerate(nodes):
            counts[i, own[0]] = own[1]
            if d:
                parents[i] = index[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
                self.child[parents[i], c >> 8 * (d - 1)] = i
        depth = np.array([d for d, _, _ in nodes])
        rest = counts.copy()
        np.subtract.at(rest, parents[parents >= 0], counts[parents >= 0])
        zeros, ones = bit_counts(counts)
        rest_zeros, rest_ones = bit_counts(np.maximum(rest, 0))
        kt, rest_kt = log_kt(zeros, ones), log_kt(rest_zeros, rest_ones)
        weighted, own_share = kt.copy(), np.ones_like(kt)
        for d in range(len(levels) - 2, -1, -1):
            at = np.flatnonzero(depth == d)
            below = rest_kt[at].copy()
            place = np.full(n, -1)
            place[at] = np.arange(len(at))
            kids = np.flatnonzero(depth == d + 1)
            np.add.at(below, place[parents[kids]], weighted[kids])
            weighted[at] = np.logaddexp(kt[at], below) - np.log(2)
            own_share[at] = np.exp(kt[at] - np.log(2) - weighted[at])
        ones_rate = (ones + 0.5) / (zeros + ones + 1.0)
        rest_rate = (rest_ones + 0.5) / (rest_zeros + rest_ones + 1.0)
        # From the root down: what the nodes above contribute, and the share left for those below.
        above, left = np.zeros((n, 256)), np.ones((n, 256))
        for d in range(len(levels)):
            at = np.flatnonzero(depth == d)
            if d:
                above[at], left[at] = mixed[parents[at] - low], remain[parents[at] - low]
            low = at[0] if len(at) else 0
            mixed = above[at] + left[at] * own_share[at] * ones_rate[at]
            remain = left[at] * (1 - own_share[at])
        full = np.where((depth == len(levels) - 1)[:, None], above + left * ones_rate, 0)
        inner = depth < len(levels) - 1
        rest_full = above + left * (own_share * ones_rate + (1 - own_share) * rest_rate)
        # Row i < n: a path that ends in node i at the last depth; row n + i: one that ends in the rest child of node i.
        self.n = n
        self.table = np.concatenate([self.byte_costs(full), self.byte_costs(np.where(inner[:, None], rest_full, 0.5))]).astype(np.float32)

    @staticmethod
    def byte_costs(ones):
        """log10 probability of each byte from the probabilities of a one at the 255 decisions."""
        ones = np.clip(ones, 1e-12, 1 - 1e-12)
        out = np.zeros((len(ones), 256))
        byte = np.arange(256)
        for level in range(8):
            at = (1 << level) | (byte >> (8 - level))
            bit = (byte >> (7 - level)) & 1
            out += np.where(bit, np.log10(ones[:, at]), np.log10(1 - ones[:, at]))
        return out

    def costs(self, body, depth):
        """log10 probability of every byte of ``body`` from index ``depth`` on."""
        m = len(body) - depth
        node = np.zeros(m, dtype=np.int32)
        row = np.full(m, -1, dtype=np.int32)
        for k in range(1, depth + 1):
            down = self.child[node, body[depth - k : depth - k + m]]
            row = np.where((down < 0) & (row < 0), self.n + node, row)
            node = np.where(row < 0, down, node)
        row = np.where(row < 0, node, row)
        return self.table[row, body[depth:]]


def decisions(keys, depth):
    """Nodes (a context of ``depth`` bytes, then one of 255 decisions as lowest byte) of the eight decisions of each gram, and the bits decided; level by level."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    byte = (keys & np.uint64(255)).astype(np.int64)
    nodes = [(context << np.uint64(8)) | ((1 << level) | (byte >> (8 - level))).astype(np.uint64) for level in range(8)]
    return np.concatenate(nodes), np.concatenate([(byte >> (7 - level)) & 1 for level in range(8)])


def leaves(keys, counts, depth):
    """(nodes, zeros, ones, weighted, share) at the last depth, then the node and the bit of each decision of each gram."""
    codes, bits = decisions(keys, depth)
    nodes, at = np.unique(codes, return_inverse=True)
    seen = np.tile(counts.astype(float), 8)
    zeros, ones = (np.bincount(at, weights=seen * (bits == bit), minlength=len(nodes)) for bit in (0, 1))
    return (nodes, zeros, ones, log_kt(zeros, ones), np.ones(len(nodes))), at, bits


def lifted(level, depth):
    """The level above one at ``depth``, and the parent there of each node; nodes never seen weigh nothing."""
    nodes, at = np.unique(level[0] & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
    zeros, ones, below = (np.bincount(at, weights=v, minlength=len(nodes)) for v in level[1:4])
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) - np.log(2)
    return (nodes, zeros, ones, weighted, np.exp(own - np.log(2) - weighted)), at


def climbed(level, depth, end):
    """Levels from ``depth`` to ``end``, and for each but the last the parents of its nodes."""
    levels, parents = [level], []
    for d in range(depth, end, -1):
        level, at = lifted(level, d)
        levels.append(level)
        parents.append(at)
    return levels, parents


def descended(levels, parents, above, left):
    """From the last level down to the first: what the nodes above contribute there, and the share left to it."""
    for (_, zeros, ones, _, share), at in zip(levels[:0:-1], parents[::-1], strict=True):
        rate = (ones + 0.5) / (zeros + ones + 1.0)
        above, left = (above + left * share * rate)[at], (left * (1 - share))[at]
    return above, left


def whole_subtrees(batches, top):
    """Columns (uint64 keys first) of batches sorted by the ``top`` newest bytes of context, cut only between these."""
    held, count = [], 0
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        count += len(batch)
        if count >= WEIGHED:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            group = (columns[0].view(np.uint64) >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)
            cut = len(group) - int(np.argmax(group[::-1] != group[-1])) if group[0] != group[-1] else 0
            if cut:
                yield [columns[0][:cut].view(np.uint64), *[c[:cut] for c in columns[1:]]]
            held, count = [[c[cut:] for c in columns]], len(group) - cut
    if count:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield [columns[0].view(np.uint64), *columns[1:]]


def _weigh(depth, top):
    """(node, zeros, ones, weighted) of every node at depth ``top``."""

    def run(batches):
        import pyarrow as pa

        for keys, counts in whole_subtrees(batches, top):
            levels, _ = climbed(leaves(keys, counts, depth)[0], depth, top)
            nodes, zeros, ones, weighted, _ = levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), *map(pa.array, (zeros, ones, weighted))], ["node", "zeros", "ones", "weighted"])

    return run


def _price(trunk, depth, top):
    """(key, m, cost) of every gram: log10 probability of its newest byte after the others."""

    def run(batches):
        import pyarrow as pa

        nodes, above, left = trunk.value
        for keys, counts, m in whole_subtrees(batches, top):
            leaf, at, bits = leaves(keys, counts, depth)
            levels, parents = climbed(leaf, depth, top)
            place = np.searchsorted(nodes, levels[-1][0])
            over, share = descended(levels, parents, above[place], left[place])
            one = np.clip(over + share * (leaf[2] + 0.5) / (leaf[1] + leaf[2] + 1.0), 1e-12, 1 - 1e-12)[at]
            cost = np.log10(np.where(bits, one, 1 - one)).reshape(8, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(m), pa.array(cost.astype(np.float32))], ["key", "m", "cost"])

    return run


def gram_costs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, m, cost) of rows (key, n, m): grams seen n times in training texts, and m times in any."""
    top = min(TOP, depth)
    group = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * top) - 1)
    dealt = grams.withColumn("group", group).repartition("group").sortWithinPartitions("group")
    table = dealt.select("key", "n").mapInArrow(_weigh(depth, top), "node long, zeros double, ones double, weighted double").toArrow()
    nodes, zeros, ones, weighted = (np.asarray(c) for c in table.columns)
    order = np.argsort(nodes)
    level = (nodes[order].astype(np.uint64), zeros[order], ones[order], weighted[order], None)
    levels, parents = climbed(level, top, 0)
    above, left = descended(levels, parents, np.zeros(len(levels[-1][0])), np.ones(len(levels[-1][0])))
    trunk = grams.sparkSession.sparkContext.broadcast((level[0], above, left))
    return stash(dealt.select("key", "n", "m").mapInArrow(_price(trunk, depth, top), "key long, m long, cost float"))


def split_head(table: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest counts, ``most`` at most, and the others: cut at a power of 2**(1/4) of the count."""
    step = F.floor(F.log2(count) * 4)
    least, held = None, 0
    for row in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        held += row["rows"]
        if held > most:
            break
        least = row["step"]
    return (table.where(step >= F.lit(least)), table.where(step < F.lit(least))) if least is not None else (table.limit(0), table)


class FrequentGrams:
    """Costs of the broadcast grams: the more frequent gram has each hashed place, the others are searched for."""

    def __init__(self, keys, costs):
        """Keys by rising count, with their costs."""
        order = np.argsort(keys)
        self.sorted, self.sorted_costs = keys[order], costs[order]
        self.keys, self.costs = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.float32)
        self.keys[0] = 1  # place 0 is that of gram 0
        place = self.place(keys)
        self.keys[place], self.costs[place] = keys, costs

    @staticmethod
    def place(keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)

    def __call__(self, grams):
        """The cost of each gram, and which are not among the broadcast ones."""
        place = self.place(grams)
        costs, missed = self.costs[place].astype(np.float64), np.flatnonzero(self.keys[place] != grams)
        unknown = np.zeros(len(grams), dtype=bool)
        if len(missed):
            unknown[missed] = True
            if len(self.sorted):
                at = np.minimum(np.searchsorted(self.sorted, grams[missed]), len(self.sorted) - 1)
                found = self.sorted[at] == grams[missed]
                costs[missed[found]], unknown[missed[found]] = self.sorted_costs[at[found]], False
        return costs, unknown


def _score(costs, frequent):
    def run(batches):
        import pyarrow as pa

        grams, (keys, counts), hasher = FrequentGrams(*costs.value), frequent.value, WordHasher()
        for batch in batches:
            n_tokens, found, dense, log_p, size, rare, rare_grams = [], [], [], [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column(1), CHUNK):
                hashes, _, _, words = hasher(data, offsets)
                n = len(offsets) - 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[at] == hashes
                else:
                    at, hit = np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
                doc = np.repeat(np.arange(n), words)
                found.append(np.bincount(doc[hit], minlength=n))
                dense.append(np.bincount(doc[hit], weights=np.log10(counts[at[hit]] + 1.0), minlength=n))
                n_tokens.append(words + 1)
                missed, ends = hashes[~hit], np.cumsum(np.bincount(doc[~hit], minlength=n))
                rare += [signed(x) for x in np.split(missed, ends[:-1])] if n else []
                codes = gram_codes(*padded(hasher.fold[data], offsets))
                cost, unknown = grams(codes)
                doc = np.repeat(np.arange(n), np.diff(offsets) + 1)
                log_p.append(np.bincount(doc, weights=np.where(unknown, 0, cost), minlength=n))
                rare_grams += [signed(x) for x in np.split(codes[unknown], np.cumsum(np.bincount(doc[unknown], minlength=n))[:-1])]
                size.append(np.diff(offsets))
            join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind)) if parts else pa.array([], pa.from_numpy_dtype(kind))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, rare_grams)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), join(n_tokens, np.int64), join(found, np.int64), join(dense, np.float64), join(log_p, np.float64), join(size, np.int64), *lists, batch.column(3)],
                ["doc_id", "held_out", "n_tokens", "n_found", "dense", "score", "n_bytes", "rare", "rare_grams", "row"],
            )

    return run


def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out``: a boolean column of ``docs``; rows where it holds are not learned from.
    Letters A-Z are lower-cased for both scores.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), held.alias("held_out"))
    train = rows.where(~F.col("held_out"))
    tallies = stash(rows.select("text", "held_out").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = tallies.where("kind = 0").select("key", "n")
    grams = tallies.where("kind > 0").groupBy("key").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m"))
    stats = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    ends = train.count()
    train_tokens, types = (stats["tokens"] or 0) + ends, stats["types"] + (1 if ends else 0)
    common_grams, other_grams = split_head(gram_costs(grams, depth), "m", BASE_GRAMS)
    top = common_grams.toArrow()
    order = np.argsort(np.asarray(top.column("m")), kind="stable")
    costs = spark.sparkContext.broadcast((np.asarray(top.column("key")).astype(np.int64).view(np.uint64)[order], np.asarray(top.column("cost")).astype(np.float32)[order]))
    common_words, other_words = split_head(words, "n", BASE_WORDS)
    top = common_words.toArrow()
    keys, counts = np.asarray(top.column("key")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.float64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], counts[order]))
    parts = stash(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(costs, frequent), "doc_id long, held_out boolean, n_tokens long, n_found long, dense double, score double, n_bytes long, rare array<long>, rare_grams array<long>, row long"))
    seldom = parts.select("row", F.explode("rare").alias("key")).join(other_words, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("sparse"))
    seldom_grams = parts.select("row", F.explode("rare_grams").alias("key")).join(other_grams, "key").groupBy("row").agg(F.sum(F.col("cost").cast("double")).alias("sparse_cost"))
    whole = parts.drop("rare", "rare_grams").join(seldom, "row", "left").join(seldom_grams, "row", "left").withColumn("score", F.col("score") + F.coalesce("sparse_cost", F.lit(0.0)))
    denominator = F.log10(F.lit(float(train_tokens + types + 1)))
    end = F.log10(F.lit(float(ends + 1)))
    more = F.coalesce("more", F.lit(0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_found") + more + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("dense") + F.coalesce("sparse", F.lit(0.0)) + end - F.col("n_tokens") * denominator).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def score_training_split(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Scores of all documents, learning from those whose id's CRC-32 has another remainder."""
    return score_documents(docs, crc_mod(docs["doc_id"], modulus) == remainder)

