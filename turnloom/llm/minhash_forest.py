"""Near-duplicate classes: MinHash signatures in an LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit fingerprints) and a MinHash
   signature. Texts with equal sets are one class from here on, shown by their
   smallest id, so copies never form pairs.
2. The forest: every tree sorts the signatures by its own order of hashes. The table
   is range-partitioned by (tree, sort key), so a dense region spreads over tasks.
   Sorted neighbours are candidates if their common prefix has DEPTH hashes at least;
   as the nearest rows come first, the prefix that a candidate must share deepens by
   itself where a region is dense. Each row also meets the head of its region.
3. Candidates are confirmed on full sets in two rounds: one pair per row first, which
   gathers most classes; then all pairs whose ends are still apart. Ends that are
   already connected need no further check, since only the classes are returned.
4. After that the forest is walked again over the components found: rows next to each
   other that belong to different components are new candidates, until a walk adds
   no link.
5. A walk compares a row with few others of its region, so a region of more than
   COVERED rows that still holds several components is compared whole: its rows are
   dealt into blocks, every two blocks meet in a task of their own, and the sizes of all
   intersections come from products of their incidence matrices. A pair is looked at in
   the first tree only that puts it into one region. What a task returns are links that
   join components, fewer than it has rows, never all pairs. With that, every pair that
   shares the first DEPTH hashes of any tree is either compared or connected: a link at
   exactly 0.8 is missed by all trees with probability below 0.0001, in dense regions too.

Defined cases: text that is null, empty or without words has no shingles, links with
nothing and is kept. A text with fewer words than a shingle is one shingle. Rows
repeated with one id form one class; where their texts differ the least is compared. A null id is kept, with a null component. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import WordHasher, mix64, text_chunks
from ._tables import picked, stash, unused

#: Hashes of a signature; trees of the forest, each with its own order; hashes that neighbours share at least.
HASHES, TREES, DEPTH = 80, 20, 4
#: Nearest earlier rows of a tree that a row is compared with.
NEIGHBOURS = 2
#: Bytes of a shingle's fingerprint.
SET_BYTES = 8
#: Rows of a region that the walk compares completely; rows and shingles of a block of a crowded region; shingles multiplied at once.
COVERED, BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = NEIGHBOURS + 1, 512, 400_000, 4096


def shingle_sets(hasher, data, offsets, words):
    """Yield the sorted distinct shingle fingerprints of each text of a chunk."""
    import numpy as np

    hashes, _, _, counts = hasher(data, offsets)
    ends = np.cumsum(counts)
    rolled = hashes.copy()
    for k in range(1, words):
        rolled[: len(hashes) - k] = mix64(rolled[: len(hashes) - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:])
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        begin = end - count
        if count >= words:
            yield np.unique(rolled[begin : end - words + 1])
        elif count:
            one = hashes[begin:begin + 1]
            for h in hashes[begin + 1 : end]:
                one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + h)
            yield mix64(one + np.uint64(count))
        else:
            yield hashes[:0]


def _signatures(words):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20240229)
        factors = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hasher = WordHasher()
        for batch in batches:
            ids, sizes, keys, sigs = batch.column(0), [], [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                for own in shingle_sets(hasher, data, offsets, words):
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
                    for k in range(0, len(own), 4096):
                        low = np.minimum(low, (own[k : k + 4096, None] * factors).min(axis=0))
                    sigs.append(mix64(low).astype(">u2").tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return run


def _tree_rows(batches):
    """(tree, near, far, doc_id): a tree's first four hashes in one long, its next four in another."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(n, HASHES).astype(np.uint64)
        shift = np.array([48, 32, 16, 0], dtype=np.uint64)
        near, far = [], []
        for tree in range(TREES):
            at = (np.arange(2 * DEPTH) + tree * DEPTH) % HASHES
            part = sig[:, at]
            near.append((part[:, :4] << shift).sum(axis=1, dtype=np.uint64))
            far.append((part[:, 4:] << shift).sum(axis=1, dtype=np.uint64))
        ids = np.tile(np.asarray(batch.column(0)), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array(np.concatenate(near).view(np.int64)), pa.array(np.concatenate(far).view(np.int64)), pa.array(ids)], ["tree", "near", "far", "doc_id"])


def _walk(batches):
    """Candidate pairs among sorted forest rows (tree, near, far, doc_id, comp).

    A row meets its nearest earlier rows of the same region whose component differs,
    and the head of the region. The first and last rows of the partition are returned
    too (part is set there), so that regions cut by a partition border join up.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, seen, held, head, count = TaskContext.get().partitionId(), [], None, None, 0
    names = ["a", "b", "part", "seq", "tree", "near", "comp"]

    def table(a, b, at, seq, tree, near, comp):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(at, pa.int32()), pa.array(seq, pa.int64()), pa.array(tree, pa.int32()), pa.array(near, pa.int64()), pa.array(comp, pa.int64())], names)

    tail = None
    for batch in batches:
        if not len(batch):
            continue
        now = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 3, 4)])
        if len(seen) == 0 and tail is None:
            first = now[:, : NEIGHBOURS + 1]
            seen.append((first, np.arange(first.shape[1])))
        rows = now if held is None else np.concatenate([held, now], axis=1)
        old = rows.shape[1] - now.shape[1]
        tree, near, ids, comp = rows
        new_region = np.concatenate([[True], (tree[1:] != tree[:-1]) | (near[1:] != near[:-1])])
        if old:
            new_region[0] = False
        run = np.maximum.accumulate(np.where(new_region, np.arange(len(ids)), -1))
        heads = np.where(run >= 0, ids[np.maximum(run, 0)], head if head is not None else ids[0])
        head_comps = np.where(run >= 0, comp[np.maximum(run, 0)], held_comp if held is not None else comp[0])
        a, b = [], []
        for k in range(1, NEIGHBOURS + 1):
            i = np.arange(max(old, k), len(ids))
            ok = (tree[i] == tree[i - k]) & (near[i] == near[i - k]) & (comp[i] != comp[i - k])
            a.append(ids[i - k][ok])
            b.append(ids[i][ok])
        i = np.arange(old, len(ids))
        same = np.concatenate([[False], ~new_region[1:] & (comp[1:] == comp[:-1])])
        other = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))[i] - 1
        ok = (other >= 0) & (tree[i] == tree[other]) & (near[i] == near[other]) & (comp[i] != comp[other])
        a.append(ids[other][ok])
        b.append(ids[i][ok])
        ok = (heads[i] != ids[i]) & (head_comps[i] != comp[i])
        a.append(heads[i][ok])
        b.append(ids[i][ok])
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        m = len(low)
        if m:
            none = pa.nulls(m)
            yield table(low, high, none, none, none, none, none)
        head, held_comp = int(heads[-1]), int(head_comps[-1])
        keep = min(NEIGHBOURS, rows.shape[1])
        held, count = rows[:, -keep:], count + now.shape[1]
        tail = held
    if tail is not None:
        first, at = seen[0]
        tree, near, ids, comp = np.concatenate([first, tail], axis=1)
        seq = np.concatenate([at, count + np.arange(tail.shape[1])])
        m = len(ids)
        yield table(ids, pa.nulls(m), np.full(m, part, np.int32), seq, tree.astype(np.int32), near, comp)


def candidate_pairs(forest: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of neighbours in the forest rows (tree, near, far, doc_id, comp)."""
    order = ["tree", "near", "far", "doc_id"]
    walked = stash(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, "a long, b long, part int, seq long, tree int, near long, comp long"))
    inner = walked.where("part is null").select("a", "b")
    border = Window.partitionBy("tree", "near").orderBy("part", "seq")
    ends = walked.where("part is not null")
    across = None
    for k in range(1, NEIGHBOURS + 1):
        met = ends.select(F.lag("a", k).over(border).alias("x"), F.lag("comp", k).over(border).alias("xc"), F.col("a").alias("y"), F.col("comp").alias("yc")).where("x <> y and xc <> yc").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        across = met if across is None else across.unionByName(met)
    return inner.unionByName(across).distinct()


def _sets(words):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            out = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                for own in shingle_sets(hasher, data, offsets, words):
                    out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "members"])

    return run


def _confirm(percent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            left, right, good = batch.column(2), batch.column(3), np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                x, y = left[i].as_py(), right[i].as_py()
                n, m = len(x) // SET_BYTES, len(y) // SET_BYTES
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= percent * (n + m - shared)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    right = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "members": "right"}).hint("merge"), "b")
    both = right.join(sets.withColumnsRenamed({"doc_id": "a", "members": "left"}).hint("merge"), "a").select("a", "b", "left", "right")
    return stash(both.mapInArrow(_confirm(percent), "a long, b long"))


def shared_counts(sets):
    """Sizes of the intersections of all pairs of sets (sorted distinct numbers), as a matrix."""
    import numpy as np

    sizes = np.array(list(map(len, sets)))
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    rows, column = rows[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[rows[low:high], column[low:high] - first] = 1
        out += part @ part.T
    return out


def _compare(percent):
    """Links among the rows of two blocks of a region: (i, j, tree, block, doc_id, comp, nears, members) to (a, b)."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        tree, i, j = (table.column(c)[0].as_py() for c in ("tree", "i", "j"))
        ids, comp, block = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "comp", "block"))
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if (comp == comp[0]).all():
            return none
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        nears = np.frombuffer(b"".join(table.column("nears").to_pylist()), np.int64).reshape(len(ids), TREES)
        sizes = np.array(list(map(len, sets)), dtype=np.int64)
        shared = shared_counts(sets).astype(np.int64)
        good = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        good &= comp[:, None] != comp[None, :]
        if i != j:
            good &= block[:, None] != block[None, :]
        for earlier in range(tree):
            good &= nears[:, None, earlier] != nears[None, :, earlier]
        root, out = {}, []

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(*np.nonzero(np.triu(good, 1))):
            u, v = find(int(comp[x])), find(int(comp[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())}) if out else none

    return run


def _nears(batches):
    """(doc_id, nears): a row's region in every tree."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = len(batch)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(n, HASHES).astype(np.uint64)
        shift, nears = np.array([48, 32, 16, 0], dtype=np.uint64), np.zeros((n, TREES), np.int64)
        for tree in range(TREES):
            nears[:, tree] = (sig[:, (np.arange(DEPTH) + tree * DEPTH) % HASHES] << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in nears], pa.binary())], ["doc_id", "nears"])


def crowded_links(forest: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components inside regions that a walk can't compare completely.

    ``forest``: tree, near, doc_id, comp; ``classes``: doc_id, n_shingles, signature; ``rows``: doc_id, text.
    """
    spread = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    regions = forest.join(classes.select("doc_id", "n_shingles"), "doc_id").groupBy("tree", "near").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    crowded = stash(regions.where((F.col("rows") > COVERED) & (F.col("low") != F.col("high"))).select("tree", "near", spread.alias("blocks")))
    if crowded.isEmpty():
        return forest.sparkSession.createDataFrame([], "a long, b long")
    placed = stash(forest.join(crowded, ["tree", "near"]).select("tree", "near", "doc_id", "comp", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")))
    wanted = classes.join(placed.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = rows.join(wanted.select("doc_id").hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = stash(texts.mapInArrow(_sets(words), "doc_id long, members binary").join(wanted.select("doc_id", "signature").mapInArrow(_nears, "doc_id long, nears binary"), "doc_id"))
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    meeting = placed.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return meeting.join(sets, "doc_id").groupBy("tree", "near", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a < b), root its smallest reachable node.

    Each round hangs every node below its smallest neighbour, follows the pointers to
    their ends and keeps only edges between different roots; a few rounds suffice.
    """
    spark, out = edges.sparkSession, None
    current = edges.select("a", "b")
    while True:
        parent = stash(current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        if parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = stash(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            parent = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        if out is None:
            out = parent
        else:
            onward = out.join(parent.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            out = stash(onward.unionByName(parent.join(out, "node", "left_anti")))
        current = relabelled(current, parent)
    return spark.createDataFrame([], "node long, root long") if out is None else out


def relabelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs between different roots, as distinct pairs of roots."""
    left = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left")
    both = left.join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return stash(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    left = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left")
    both = left.join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles (words lower-cased in A-Z); component_id is the smallest
    id reachable over links.
    """
    rows = picked(docs, id_col, text_col)
    signed = stash(rows.mapInArrow(_signatures(words), "doc_id long, n_shingles long, set_key binary, signature binary"))
    usable = signed.where("set_key is not null and doc_id is not null")
    classes = stash(usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first"), F.count("*").alias("size")).select("set_key", "first.*", "size"))
    forest = stash(classes.select("doc_id", "signature").mapInArrow(_tree_rows, "tree int, near long, far long, doc_id long"))
    found = stash(candidate_pairs(forest.withColumn("comp", F.col("doc_id"))))
    needed = found.select(F.col("a").alias("doc_id")).unionByName(found.select(F.col("b").alias("doc_id"))).distinct()
    named = rows.join(needed.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = stash(named.mapInArrow(_sets(words), "doc_id long, members binary"))
    links = confirmed(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent)
    roots = components(links)
    links = links.unionByName(confirmed(stash(apart(found, roots)), sets, percent))
    roots = stash(components(links))
    tried = found
    while True:
        placed = needed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("comp"))
        more = stash(candidate_pairs(forest.join(placed, "doc_id")).join(tried, ["a", "b"], "left_anti"))
        linked = confirmed(more, sets, percent)
        if linked.isEmpty():
            break
        links, tried = links.unionByName(linked), tried.unionByName(more)
        roots = stash(components(links))
    placed = classes.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("comp"))
    inside = stash(crowded_links(forest.select("tree", "near", "doc_id").join(placed, "doc_id"), classes, rows, words, percent))
    if not inside.isEmpty():
        roots = stash(components(links.unionByName(inside)))
    owner = signed.join(classes.where("size > 1").select("set_key", F.col("doc_id").alias("rep")), "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    done = owner.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left")
    result = done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Of rows with one id any one stays; rows without an id all stay. Columns of any name
    pass through.
    """
    doc, own = unused(docs, "doc__"), unused(docs, "own__")
    kept = near_duplicates(docs, id_col, text_col, words, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(own))
    tagged = docs.select("*", docs[id_col].cast("long").alias(doc))
    stay = tagged.where(F.col(doc).isNotNull()).join(kept, F.col(doc) == F.col(own), "left_semi").dropDuplicates([doc])
    return stay.unionByName(tagged.where(F.col(doc).isNull())).drop(doc)
