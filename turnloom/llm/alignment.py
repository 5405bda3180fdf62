"""Alignment of two tokenizers' tokens over the same bytes, each distinct text once.

Documents are shuffled by their full text and counted, so copies are tokenised and
aligned once. A byte-level BPE (A) reads a space and the text; a sentence-piece BPE (B)
reads the text and adds that space itself. Offsets where tokens of both end cut the
tokens into groups; the two tokens that end there are linked. Links of a text are
counted by id pair; over the corpus each count weighs as many times as the text occurs.

A text is cut before single spaces between other characters. No token of either
tokenizer crosses such a place (checked on B's pieces when they are loaded), so the
units between are aligned one by one and remembered within a task.

Pair counts meet texts again in a join: pairs above a count that at most PAIRS of them
reach are broadcast, the rarer ones are shuffled. Measures are joined to ids by the
digest of the text; texts that more than one row in 256 holds are broadcast there.

Defined cases: null and empty texts, and texts whose joined token bytes differ from
space and text on either side, have no tokens: zeros and empty groups. Texts of any
length are read whole. Rows repeated with the same id, and null ids, are kept row by
row. An empty table gives an empty result. Other columns are ignored.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import join_unique, picked, stash
from .packing import byte_ranks

#: Pairs that are broadcast at most; units remembered in a task; characters of a unit that is remembered; units tokenised at once.
PAIRS, CACHE, UNIT, AT_ONCE = 500_000, 150_000, 64, 20_000
#: Bytes of text handled at once inside a task.
CHUNK = 1_000_000
ALIGNED = "text_sha256 string, copies long, n_a long, n_b long, groups string, links array<struct<a:int, b:int, n:int>>"


class Tokens:
    """Ids of texts by both tokenizers, and the bytes of each id. Make one per task."""

    def __init__(self, a_path, pattern, b_path):
        import sentencepiece
        import tiktoken

        ranks, _ = byte_ranks(a_path)
        self.a_path, self.whole = a_path, None
        self.short = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: piece for piece, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that hold a space after another character are not supported")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def a(self, unit):
        """Short units by ranks; long ones by a tokenizer whose time does not grow with the square of a word."""
        if len(unit) <= UNIT:
            return self.short.encode_ordinary(" " + unit)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.a_path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(" " + unit, add_special_tokens=False).ids

    def __call__(self, units):
        """Ids by A and by B of each unit, as two lists of lists."""
        return list(map(self.a, units)), self.b.encode(units, num_threads=1)


class Flat:
    """The token lists of one tokenizer laid end to end: ids, sizes in bytes, and the tokens that each unit begins with."""

    def __init__(self, lists, sizes):
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64)
        self.sizes = sizes[self.ids]
        self.first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])

    def unit_sizes(self):
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return ends[self.first[1:]] - ends[self.first[:-1]]


def aligned_units(a, b):
    """(groups as text, linked pairs as bytes) per unit, of two Flat lists of tokens over the same bytes."""
    a_ends, b_ends = np.cumsum(a.sizes), np.cumsum(b.sizes)
    both, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    pairs = (a.ids[a_at] << 32) | b.ids[b_at]
    # Tokens in the order of the text that names them: by group, those of A first.
    a_last, b_last = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    a_last[a_at] = b_last[b_at] = True
    names = [f"{i}{'|' if last else ','}" for i, last in zip(a.ids.tolist(), a_last.tolist())]
    names += [f"{i}{';' if last else ','}" for i, last in zip(b.ids.tolist(), b_last.tolist())]
    group = np.concatenate([2 * np.searchsorted(both, a_ends), 2 * np.searchsorted(both, b_ends) + 1])
    names = [names[k] for k in np.argsort(group, kind="stable").tolist()]
    token_cuts, pair_cuts = (a.first + b.first).tolist(), np.searchsorted(a_at, a.first)
    raw, pair_cuts = pairs.astype("<i8").tobytes(), (8 * pair_cuts).tolist()
    for k in range(len(a.first) - 1):
        yield "".join(names[token_cuts[k] : token_cuts[k + 1]])[:-1], raw[pair_cuts[k] : pair_cuts[k + 1]]


class Aligner:
    """A text's tokens of A and B, groups, and the counts of its linked pairs; units are remembered from chunk to chunk."""

    CUT = re.compile(r"(?<=\S) (?=\S)")
    NONE = 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __init__(self, a_path, pattern, b_path):
        self.tokens, self.known = Tokens(a_path, pattern, b_path), {}
        self.a_sizes = np.array([len(self.tokens.a_bytes.get(i, b"")) for i in range(max(self.tokens.a_bytes) + 1)])
        self.b_sizes = np.array(list(map(len, self.tokens.b_bytes)))

    def learn(self, units):
        """(tokens of A, tokens of B, groups, pairs as bytes) of each unit, or None where bytes differ."""
        a, b = self.tokens(units)
        wholes = [b" " + u.encode() for u in units]
        sizes = np.fromiter(map(len, wholes), np.int64, len(wholes))
        fits = (Flat(a, self.a_sizes).unit_sizes() == sizes) & (Flat(b, self.b_sizes).unit_sizes() == sizes)
        for k in np.flatnonzero(fits).tolist():
            fits[k] = b"".join([self.tokens.a_bytes[x] for x in a[k]]) == wholes[k] and b"".join([self.tokens.b_bytes[x] for x in b[k]]) == wholes[k]
        for k in np.flatnonzero(~fits).tolist():
            self.known[units[k]] = None
        kept = np.flatnonzero(fits).tolist()
        a, b = [a[k] for k in kept], [b[k] for k in kept]
        for k, x, y, (groups, pairs) in zip(kept, a, b, aligned_units(Flat(a, self.a_sizes), Flat(b, self.b_sizes))):
            self.known[units[k]] = len(x), len(y), groups, pairs

    def measure(self, parts):
        found = list(map(self.known.__getitem__, parts))
        if None in found:
            return self.NONE
        a, b, groups, pairs = zip(*found)
        keys, counts = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
        return sum(a), sum(b), ";".join(groups), keys, counts

    def __call__(self, texts):
        cut = [self.CUT.split(t) if t else None for t in texts]
        units = set()
        for parts in cut:
            units.update(parts or ())
        new = list(units - self.known.keys())
        for k in range(0, len(new), AT_ONCE):
            self.learn(new[k : k + AT_ONCE])
        out = [self.measure(parts) if parts else self.NONE for parts in cut]
        # Where memory is full, only short units of this chunk stay: those in use.
        keep = len(self.known) <= CACHE
        self.known = {u: e for u, e in self.known.items() if len(u) <= UNIT and (keep or u in units)}
        return out


def align_texts(texts: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Rows (text, copies) to ALIGNED: both tokenizers' counts, the groups, and how often each pair is linked."""

    def rows(aligner, shas, copies, texts):
        a, b, groups, keys, counts = zip(*aligner(texts))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        fields = [pa.array(x.astype(np.int32)) for x in (keys >> 32, keys & 0xFFFFFFFF, counts)]
        links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["a", "b", "n"]))
        return pa.RecordBatch.from_arrays([shas, copies, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(groups, pa.string()), links], ["text_sha256", "copies", "n_a", "n_b", "groups", "links"])

    def task(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(a_path, pattern, b_path)
            texts, first, held = batch.column(2), 0, 0
            for k in range(len(texts)):
                held += len(texts[k].as_buffer() or b"")
                if held > CHUNK or k + 1 == len(texts):
                    yield rows(aligner, batch.column(0)[first : k + 1], batch.column(1)[first : k + 1], texts[first : k + 1].to_pylist())
                    first, held = k + 1, 0

    return texts.select("text_sha256", "copies", "text").mapInArrow(task, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, links (how often the pair is linked in the corpus), best (whether no pair of that b has more)."""
    links = aligned.select("copies", F.explode("links").alias("x")).select("x.a", "x.b", (F.col("x.n") * F.col("copies")).alias("n"))
    counts = stash(links.groupBy("a", "b").agg(F.sum("n").alias("links")))
    # One row per id of B's vocabulary, which bounds the broadcast.
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    return stash(counts.join(F.broadcast(highest), "b").select("a", "b", "links", (F.col("links") == F.col("highest")).alias("best")))


def link_measures(aligned: DataFrame, pairs: DataFrame, limit: int = PAIRS) -> DataFrame:
    """text_sha256, n_best, count_sum: sums over the links of each text that has any."""
    # A pair linked 2**k times or more, k the least for which at most ``limit`` pairs are: an exact bound of the broadcast.
    sizes = pairs.groupBy(F.floor(F.log2("links")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()
    cut, held = 1 << 62, 0
    for r in sizes:
        held += r["count"]
        if held > limit:
            break
        cut = 1 << r["k"]
    links = aligned.select("text_sha256", F.explode("links").alias("x")).select("text_sha256", "x.a", "x.b", "x.n")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")]
    out = links.join(F.broadcast(pairs.where(F.col("links") >= cut)), ["a", "b"]).groupBy("text_sha256").agg(*sums)
    if held > limit:
        rare = links.join(F.broadcast(pairs.where(F.col("links") >= cut).select("a", "b")), ["a", "b"], "left_anti").join(pairs.where(F.col("links") < cut), ["a", "b"])
        out = out.unionByName(rare.groupBy("text_sha256").agg(*sums)).groupBy("text_sha256").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, groups=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` may be a function from the column of groups (text) to another column that
    is kept in its place.
    """
    rows = picked(docs, id_col, text_col)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    texts = rows.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies", sha)
    aligned = align_texts(texts, a_path, pattern, b_path)
    aligned = stash(aligned.withColumn("groups", groups(F.col("groups"))) if groups else aligned)
    measures = link_measures(aligned.select("text_sha256", "links"), pair_counts(aligned))
    n_groups = F.expr("aggregate(links, 0L, (s, x) -> s + x.n)")
    by_text = stash(aligned.select("text_sha256", "copies", "n_a", "n_b", n_groups.alias("n_groups"), "groups").join(measures, "text_sha256", "left"))
    ids = stash(rows.select("doc_id", sha))
    joined = join_unique(ids, by_text, ["text_sha256"], "copies")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")}
    return joined.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero["n_best"], zero["count_sum"], "groups")


def alignment_digests(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """``align`` with the SHA-256 of the groups in their place; empty without tokens."""
    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g.cast("binary"), 256))
    return align(docs, a_path, pattern, b_path, groups=digest).withColumnRenamed("groups", "groups_sha256")
