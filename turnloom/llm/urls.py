"""URL filter: a blocked Bloom filter of listed canonical URLs ahead of an exact hash join (DataFrame operations only).

A rule is a canonical prefix, host and path, with a verdict. It fits its host and all
subdomains where the URL's path starts with the rule's; of the rules that fit, the
longest (host and path together, then the longer host) decides. So a URL is looked up
under every suffix of its host at a dot, with every beginning of its path that is as
long as some listed path.

The filter is a table of blocks of 256 bits. A key sets one bit in each of the four
words of its block, so one row answers a key. Keys that the filter can't exclude meet
the list in an exact hash join, which removes false positives. The filter has at most
BLOCKS blocks, so its broadcast is bounded; a longer list makes it less selective,
never wrong. A URL that no rule fits is not listed, and allowed.

Verdicts are found once per URL of host and path. URLs and rules that more than one
row in HOT shares travel in a broadcast (at most HOT of them), the others in an
ordinary shuffle.

Defined cases: a null URL or one without ``://`` has empty host and path, and no rule
fits it. Repeated rows and null ids are kept row by row. Of equal rules with different
verdicts, block wins. Rules whose host is null or empty fit nothing; a null path is
empty. An empty list allows all; an empty table gives an empty result. Extra columns
of pages and rules are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import join_unique, stash

#: Bits that the filter has for a key, bits of a block and blocks at most (32 MB of bits).
BITS_PER_KEY, BLOCK_BITS, BLOCKS = 16, 256, 1 << 20
#: Words of a block, 64 bits each.
WORDS = ("w0", "w1", "w2", "w3")
#: The rules that the registered query judges by.
RULES = """
    SELECT * FROM VALUES
        ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    AS rules (host, path, verdict)
"""


def host_and_path(url):
    """Two columns: the host in lower case (A-Z), and the path up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"`{url}`")))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(rules: DataFrame) -> DataFrame:
    """rule_host, rule_path, verdict, size: one row per listed prefix."""
    lower = F.translate(rules["host"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rules.select(lower.alias("rule_host"), F.coalesce(rules["path"].cast("string"), F.lit("")).alias("rule_path"), rules["verdict"].cast("string").alias("verdict"))
    return rows.where("rule_host <> ''").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))


def place(blocks):
    """The block of a key (column ``h``, a 64-bit hash) and its bit in each word, by name."""
    bits = {w: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {6 * k}) & 63 AS INT))") for k, w in enumerate(WORDS)}
    return {"block": F.pmod(F.shiftrightunsigned("h", 24), F.lit(blocks))} | bits


def key_hash(host, path):
    return F.xxhash64(host, path)


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter: one row per block that holds a key."""
    keys = rules.select(key_hash("rule_host", "rule_path").alias("h")).select(*[c.alias(n) for n, c in place(blocks).items()])
    return keys.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible_hits(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates (rule_host, rule_path and others) that the filter can't exclude."""
    probe = {f"{n}_": c for n, c in place(blocks).items()}
    keyed = candidates.withColumn("h", key_hash("rule_host", "rule_path")).withColumns(probe)
    holds = [F.col(w).bitwiseAND(F.col(f"{w}_")) == F.col(f"{w}_") for w in WORDS]
    hits = keyed.join(F.broadcast(bloom), F.col("block_") == F.col("block"))
    for h in holds:
        hits = hits.where(h)
    return hits.select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict."""
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    host, path = host_and_path("url")
    urls = stash(urls.select("page_id", host.alias("host"), path.alias("path")))
    listed = stash(canonical(rules))
    facts = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    blocks = min(BLOCKS, max(1, -(-facts["n"] * BITS_PER_KEY // BLOCK_BITS)))

    lengths = F.lit(facts["lengths"]).cast("array<int>")
    labels = F.split("host", r"\.")
    # No listed host has more labels than this, so longer suffixes need no look.
    deepest = f"transform(sequence(1, least(size(labels), {facts['labels'] or 1})), k -> concat_ws('.', slice(labels, -k, k)))"
    distinct = stash(urls.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages")))
    suffixes = distinct.select("host", "path", labels.alias("labels")).select("host", "path", F.explode(F.expr(deepest)).alias("rule_host"))
    candidates = suffixes.withColumn("cut", F.explode(lengths)).where("cut <= length(path)").select("host", "path", "rule_host", F.expr("substring(path, 1, cut)").alias("rule_path"))
    hits = stash(possible_hits(candidates, bloom_blocks(listed, blocks), blocks))
    counted = hits.groupBy("rule_host", "rule_path").agg(F.count("*").alias("hits")).join(listed, ["rule_host", "rule_path"])
    exact = join_unique(hits, counted, ["rule_host", "rule_path"], "hits")
    longest = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = exact.groupBy("host", "path").agg(F.max(longest).alias("best"))
    judged = stash(distinct.join(best, ["host", "path"], "left").select("host", "path", "pages", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))
    found = join_unique(urls.where("host <> ''"), judged, ["host", "path"], "pages")
    none = urls.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return found.select("page_id", "host", "path", "rule", "verdict").unionByName(none)
