"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut by the tokenizer's pattern. A word is folded: its bytes are pieces, and
step by step the pair of neighbours with the lowest rank is merged (the first of equal
pairs), each step looking up only the two pairs that changed. Ranks are a literal: an
array of short texts, by hash, that list pairs of pieces. Decoding looks every id
up in a literal array of pieces and concatenates them.

At scale: words are counted over the whole corpus, and each of the WORDS most frequent
distinct words (a fixed bound) is folded once; Spark gathers their ids into one
array of small maps, by hash, which the words of every row are looked up in. Rarer words
are folded where they stand. So the corpus is never shuffled by word
position: only word counts are, which partial aggregation shrinks first.

A word longer than BLOCK bytes is folded in blocks that overlap by half. Wherever two
neighbouring blocks share a piece, what precedes it in the one and follows it in the
other is the encoding of both together, because in a trained vocabulary pieces that
stay apart as a pair stay apart in any text. Blocks that share no piece (not seen in
practice) leave the word to one fold over all of it, whose time grows with the square.

Defined cases: null text counts as empty; empty text has no ids, and both digests are
those of the empty string. A null id gives a row too, and repeated rows give one each.
A word that is itself in the vocabulary is one id. Other columns are ignored. Every
piece of the vocabulary must be what its own bytes merge into, as training makes it;
other rank files are refused.
"""

import base64
import json

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import picked, stash

#: Most distinct words folded ahead; texts that the rank literal is dealt into, and maps of the words; bytes folded as one.
WORDS, RANK_BUCKETS, WORD_BUCKETS, BLOCK = 3 << 18, 1 << 15, 1 << 18, 256
#: No rank. Marks at both ends of a word; in place of a rank where a pair never merges; more pairs than any word has.
NONE, MARK, NEVER, MOST = 2**31 - 1, "\u0800", "\U0010ffff", 2**30
LATIN = "".join(map(chr, range(256)))
#: A piece as a character: its id past this one, leaving out the surrogates.
FIRST = 0x1000


def read_ranks(path: str) -> dict[str, int]:
    """Rank by piece (Latin-1 text) from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}


def bucketed(pairs: dict, buckets: int):
    """A literal array of texts; ``,`` and a pair and its rank lie in the text numbered by the pair's hash, after NEVER."""
    texts = [NEVER] * buckets
    for pair, rank in pairs.items():
        number = xxhash.xxh64_intdigest(pair.encode(), seed=42)
        texts[(number - (number >> 63 << 64)) % buckets] += "," + pair + rank
    return F.from_json(F.lit(json.dumps(texts, ensure_ascii=False)), "array<string>")


def numbered(array, key, buckets):
    return F.get(array, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def looked_up(maps, key, buckets):
    return F.try_element_at(numbered(maps, key, buckets), key)


def let(value, alike, body):
    """``body(value)`` with the value computed once; ``alike`` is any column of the result's type."""
    return F.aggregate(F.array(value), alike, lambda _, v: body(v))


def unreachable(ranks: dict[str, int]) -> list[str]:
    """Pieces that merging their own bytes doesn't give."""
    found = []
    for piece in ranks:
        parts = list(piece)
        while len(parts) > 1:
            low, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if low == NONE:
                found.append(piece)
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return found


def character(i):
    """The character of an id."""
    return chr(FIRST + i + 0x800 * (FIRST + i >= 0xD800))


class Fold:
    """The BPE of one word as a column expression.

    A piece is one character, and so is a rank (that of the merged piece), so a pair of
    neighbours is a text of three: what it merges into, left and right. A word's pairs
    form an array; the least text is the pair to merge, and a step replaces three pairs
    by two. Marks stand before the first and after the last piece.
    """

    def __init__(self, ranks):
        odd = unreachable(ranks)
        if odd:
            raise ValueError(f"{len(odd)} pieces are not what their bytes merge into, such as {odd[0]!r}")
        self.bytes = "".join(character(ranks[b]) for b in LATIN)
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pair = character(left) + character(right)
                    pairs[pair] = character(rank)
        self.pairs = bucketed(pairs, RANK_BUCKETS)
        sizes = [0] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        self.sizes = F.from_json(F.lit(json.dumps(sizes)), "array<int>")

    def ranked(self, pair):
        # What follows the pair in its text; the whole text, which begins with NEVER, if the pair is not in it.
        return F.concat(F.substring(F.call_function("substring_index", numbered(self.pairs, pair, RANK_BUCKETS), F.concat(F.lit(","), pair), F.lit(-1)), 1, 1), pair)

    def step(self, pairs, _):
        def merge(low):
            def at(k):
                new = F.substring(low, 1, 1)
                before = F.concat(F.substring(F.get(pairs, k - 2), 2, 1), new)
                after = F.concat(new, F.substring(F.get(pairs, k), 3, 1))

                return F.flatten(F.array(F.slice(pairs, F.lit(1), k - 2), F.transform(F.array(before, after), self.ranked), F.slice(pairs, k + 2, F.lit(MOST))))

            return F.when(low >= NEVER, pairs).otherwise(let(F.find_in_set(low, F.array_join(pairs, ",")), pairs, at))

        return let(F.array_min(pairs), pairs, merge)

    def folded(self, raw):
        """Ids of a byte string (Latin-1 text)."""
        marked = F.concat(F.lit(MARK), F.translate(raw, LATIN, self.bytes), F.lit(MARK))
        pairs = F.transform(F.regexp_extract_all(marked, F.lit("(?s)(?=(..))"), F.lit(1)), self.ranked)
        code = lambda x: F.ascii(F.substring(x, 2, 1)) - FIRST
        ids = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 1), lambda x: F.when(code(x) + FIRST < 0xD800, code(x)).otherwise(code(x) - 0x800))
        return F.aggregate(F.sequence(F.lit(1), F.length(raw)), pairs, self.step, ids)

    def placed(self, ids, begin):
        """Each id with the byte it begins at, as place * 2**32 + id."""
        start = F.struct(begin.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda s, i: F.struct((s["at"] + F.get(self.sizes, i)).alias("at"), F.array_append(s["out"], F.shiftleft(s["at"], 32) + i).alias("out"))
        return F.aggregate(ids, start, step, lambda s: s["out"])

    def joined(self, blocks, half):
        """Ids of a byte string from those of its blocks, which overlap by half; null if two neighbours share no piece."""
        none = F.array().cast("array<int>")
        placed = F.transform(blocks, lambda ids, j: self.placed(ids, j * half))

        def cut(placed):
            shared = F.transform(F.sequence(F.lit(1), F.size(placed) - 1), lambda j: F.array_min(F.array_intersect(F.get(placed, j - 1), F.get(placed, j))))

            def at(shared):
                own = lambda b, j: F.filter(b, lambda x: (x >= F.coalesce(F.get(shared, j - 1), F.lit(0))) & (x < F.coalesce(F.get(shared, j), F.lit(2**62))))
                ids = F.transform(F.flatten(F.transform(placed, own)), lambda x: x.bitwiseAND(F.lit(2**32 - 1)).cast("int"))
                return F.when(~F.exists(shared, lambda x: x.isNull()), ids)

            return let(shared, none, at)

        return let(placed, none, cut)

    def __call__(self, word):
        """Ids of a word of text: in blocks of BLOCK bytes, or else as one block."""
        none = F.array().cast("array<int>")

        def of_bytes(raw):
            def tried(ids, size):
                half = F.shiftright(size, 1)
                begins = F.sequence(F.lit(0), F.greatest(F.length(raw) - half - 1, F.lit(0)), half)
                blocks = F.transform(begins, lambda b: self.folded(F.substring(raw, b + 1, size)))
                merged = let(blocks, none, lambda blocks: F.when(F.size(blocks) == 1, F.get(blocks, F.lit(0))).otherwise(self.joined(blocks, half)))
                return F.when(ids.isNotNull(), ids).otherwise(merged)

            return F.aggregate(F.array(F.lit(BLOCK), F.lit(MOST)), F.lit(None).cast("array<int>"), tried)

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), none, of_bytes)


def frequent_words(texts: DataFrame, limit: int = WORDS) -> DataFrame:
    """(word): the most frequent words, as many whole classes of counts as fit the limit."""
    counts = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    classed = stash(counts.withColumn("step", F.floor(F.log2("n") * 8)))
    least, held = None, 0
    for row in classed.groupBy("step").agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect():
        held += row["m"]
        if held > limit:
            break
        least = row["step"]
    chosen = classed.where(F.col("step") >= F.lit(least)) if least is not None else classed.limit(0)
    return chosen.select("word")


def gathered(table: DataFrame, buckets: int) -> DataFrame:
    """One row and column: the ids of a table of (word, ids) as an array of maps, as ``looked_up`` reads it."""
    entries = table.select(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"), F.struct("word", "ids").alias("entry"))
    every = entries.unionByName(table.sparkSession.range(buckets).select(F.col("id").alias("bucket")), allowMissingColumns=True)
    maps = every.groupBy("bucket").agg(F.collect_list("entry").alias("entries"))
    return maps.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "entries"))), lambda x: F.map_from_entries(x["entries"])).alias("known"))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded binary."""
    ranks = read_ranks(ranks_path)
    fold = Fold(ranks)
    cut = "(?U)" + pattern
    texts = picked(docs, id_col, text_col).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(cut), F.lit(0)).alias("words"))
    chosen = frequent_words(texts)
    table = gathered(chosen.select("word", fold(F.col("word")).alias("ids")), WORD_BUCKETS)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")
    # A subquery may not stand inside transform as written. It is named once, so the optimizer puts it there and no row holds it.
    held = texts.select("doc_id", "words", table.scalar().alias("known"))
    ids = F.flatten(F.transform("words", lambda w: F.coalesce(looked_up(F.col("known"), w, WORD_BUCKETS), fold(w))))
    decoded = F.encode(F.array_join(F.transform("ids", lambda i: F.get(vocabulary, i)), ""), "ISO-8859-1")
    return held.select("doc_id", ids.alias("ids")).withColumn("decoded", decoded)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""
    rows = encoded(docs, ranks_path, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
