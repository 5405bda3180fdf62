"""Queries written once and rendered for Spark SQL and for DuckDB, which checks them.

A few constructs differ between the two; ``render`` fills them in:
``{words(x)}`` lower-case words of a text, ``{explode(x)}`` a lateral row per element
(column ``tok``), ``{posexplode(x)}`` with its place from 0 (``pos``), ``{size(x)}``, ``{distinct(x)}`` and ``{common(x;y)}`` on arrays,
``{collect(x;o)}`` an array of x in the order o, ``{epoch(ts)}`` whole seconds,
``{days(a;b)}`` whole days from a to b.
"""

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Ranges of Chinese, Japanese and Korean characters.
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
METRIC_CJK = "\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af"
#: White space of all scripts, as a class for both engines.
SPACE = r"\s\x0b\x1c-\x1f\x85\pZ"
#: construct: (Spark, DuckDB), $1 and $2 standing for its arguments.
DIALECTS = {
    "words": ("regexp_extract_all(lower($1), '[a-z0-9]+', 0)", "regexp_extract_all(lower($1), '[a-z0-9]+')"),
    "tokens": ("regexp_extract_all(lower($1), \"[a-z0-9][a-z0-9']*\", 0)", "regexp_extract_all(lower($1), '[a-z0-9][a-z0-9\'\']*')"),
    "names": ("regexp_extract_all($1, '[A-Z][a-z]+( [A-Z][a-z]+)?', 0)", "regexp_extract_all($1, '[A-Z][a-z]+( [A-Z][a-z]+)?')"),
    "sentences": ("regexp_extract_all($1, '[^.!?]+[.!?]*', 0)", "regexp_extract_all($1, '[^.!?]+[.!?]*')"),
    "without": ("filter($1, x -> x NOT IN ($2))", "list_filter($1, lambda x: x NOT IN ($2))"),
    "among": ("filter($1, x -> x IN ($2))", "list_filter($1, lambda x: x IN ($2))"),
    "ending": ("filter($1, x -> x LIKE '%$2' OR x LIKE '%$3')", "list_filter($1, lambda x: x LIKE '%$2' OR x LIKE '%$3')"),
    "longer": ("filter($1, x -> length(x) > $2)", "list_filter($1, lambda x: length(x) > $2)"),
    "sorted": ("array_sort($1)", "list_sort($1)"),
    "hosts": ("regexp_extract_all($1, 'https?://[a-z0-9.]+', 0)", "regexp_extract_all($1, 'https?://[a-z0-9.]+')"),
    "nth": ("try_element_at($1, $2)", "list_extract($1, $2)"),
    "lines": ("split($1, chr(10))", "string_split($1, chr(10))"),
    "places": ("LATERAL VIEW explode(sequence(1, $1)) t AS place", ", unnest(range(1, $1 + 1)) AS t(place)"),
    "explode": ("LATERAL VIEW explode($1) t AS tok", ", unnest($1) AS t(tok)"),
    "size": ("size($1)", "len($1)"),
    "distinct": ("array_distinct($1)", "list_distinct($1)"),
    "common": ("size(array_intersect($1, $2))", "len(list_intersect($1, $2))"),
    "collect": ("transform(array_sort(collect_list(struct($2 AS o, $1 AS v))), s -> s.v)", "list($1 ORDER BY $2)"),
    "joined": ("array_join($1, '$2')", "array_to_string($1, '$2')"),
    "epoch": ("CAST(unix_timestamp(CAST($1 AS timestamp)) AS bigint)", "CAST(floor(epoch($1)) AS bigint)"),
    "days": ("datediff($2, $1)", "date_diff('day', CAST($1 AS date), CAST($2 AS date))"),
    "json_int": ("CAST(get_json_object($1, '$.$2') AS bigint)", "CAST(json_extract($1, '$.$2') AS bigint)"),
    "sha256": ("sha2($1, 256)", "sha256($1)"),
    "bytes": ("encode($1, 'UTF-8')", "encode($1)"),
    "has": ("array_contains($1, '$2')", "list_contains($1, '$2')"),
    "head": ("slice($1, 1, $2)", "list_slice($1, 1, $2)"),
    "posexplode": ("LATERAL VIEW posexplode($1) t AS pos, tok", ", LATERAL (SELECT unnest($1) AS tok, generate_subscripts($1, 1) - 1 AS pos) t"),
    "squeeze": ("regexp_replace($1, '[ \\\\t\\\\r\\\\n]+', ' ')", "regexp_replace($1, '[ \\t\\r\\n]+', ' ', 'g')"),
    "sha1": ("sha1($1)", "sha1($1)"),
    "matches": ("($1 RLIKE '$2')", "regexp_matches($1, '$2')"),
    "replace": ("regexp_replace($1, '$2', '')", "regexp_replace($1, '$2', '', 'g')"),
    "split_ws": ("filter(split($1, '[ \t\n\r]+'), t -> t <> '')", "list_filter(string_split_regex($1, '[ \t\n\r]+'), lambda t: t <> '')"),
    "no_punctuation": ("regexp_replace(lower(coalesce($1, '')), '[\\\\pP$+<=>^`|~]', ' ')", "regexp_replace(lower(coalesce($1, '')), '[\\pP$+<=>^`|~]', ' ', 'g')"),
    "no_ascii_punctuation": ("regexp_replace($1, '[\\\\x21-\\\\x2f\\\\x3a-\\\\x40\\\\x5b-\\\\x60\\\\x7b-\\\\x7e]', '')", "regexp_replace($1, '[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]', '', 'g')"),
    "by_character": (f"flatten(transform($1, c -> CASE WHEN c RLIKE '[{CJK}]' THEN regexp_extract_all(c, '[a-z0-9]+|[{CJK}]', 0) ELSE array(c) END))", f"flatten(list_transform($1, lambda c: CASE WHEN regexp_matches(c, '[{CJK}]') THEN regexp_extract_all(c, '[a-z0-9]+|[{CJK}]') ELSE [c] END))"),
    "apostrophe_words": ("regexp_extract_all(lower(coalesce($1, '')), \"[a-z0-9']+\", 0)", "regexp_extract_all(lower(coalesce($1, '')), '[a-z0-9\'\']+')"),
    "fields": (f"filter(split($1, '[{SPACE}]+'), t -> t <> '')".replace("\\", "\\\\"), f"list_filter(string_split_regex($1, '[{SPACE}]+'), lambda t: t <> '')"),
    "ascii_spaced": (r"regexp_replace(lower(coalesce($1, '')), '[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]', ' ')", r"regexp_replace(lower(coalesce($1, '')), '[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]', ' ', 'g')"),
    # Neighbours share the character between them, so a second pass takes what the first had to leave.
    "no_words": (r"regexp_replace($1, '(?<![\\pL\\pN_])($2)(?![\\pL\\pN_])', ' ')", r"regexp_replace(regexp_replace($1, '(^|[^\pL\pN_])(?:$2)($|[^\pL\pN_])', '\1 \2', 'g'), '(^|[^\pL\pN_])(?:$2)($|[^\pL\pN_])', '\1 \2', 'g')"),
    "metric_fields": (f"(CASE WHEN $1 RLIKE '[{METRIC_CJK}]' THEN concat(regexp_extract_all($1, '[{METRIC_CJK}]', 0), regexp_extract_all($1, '[a-z0-9]+', 0)) ELSE {{fields($1)}} END)", f"(CASE WHEN regexp_matches($1, '[{METRIC_CJK}]') THEN list_concat(regexp_extract_all($1, '[{METRIC_CJK}]'), regexp_extract_all($1, '[a-z0-9]+')) ELSE {{fields($1)}} END)"),
    "at_second": ("timestamp_seconds($1)", "to_timestamp($1)::timestamp"),
    "quantile": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "named": ("filter($1, x -> lower(x) NOT IN ($2))", "list_filter($1, lambda x: lower(x) NOT IN ($2))"),
    "differing": ("filter($1, x -> x <> $2)", "list_filter($1, lambda x: x <> $2)"),
    "content": ("filter($1, x -> length(x) > 2 AND x NOT IN ($2))", "list_filter($1, lambda x: length(x) > 2 AND x NOT IN ($2))"),
    "at_least_4": ("array_distinct(filter($1, x -> length(x) >= 4))", "list_distinct(list_filter($1, lambda x: length(x) >= 4))"),
    "joined_lines": ("array_join($1, chr(10))", "array_to_string($1, chr(10))"),
    "times_beyond": ("filter($1, x -> NOT array_contains($2, x))", "list_filter($1, lambda x: NOT list_contains($2, x))"),
    "cut": ("split($1, chr(30))", "string_split($1, chr(30))"),
    "date_plus": ("date_add($1, CAST($2 AS int))", "CAST($1 + CAST($2 AS int) AS date)"),
    "iso": ("date_format($1, 'yyyy-MM-dd')", "strftime($1, '%Y-%m-%d')"),
    "long_date": ("date_format($1, 'MMMM d, yyyy')", "strftime($1, '%B %-d, %Y')"),
    "upto": ("LATERAL VIEW explode(CASE WHEN $1 <= $2 THEN sequence($1, $2) END) t AS place", ", LATERAL (SELECT unnest(range($1, $2 + 1)) AS place) t"),
    "inside": ("contains($1, $2)", "contains($1, $2)"),
    "begins": ("startswith($1, $2)", "starts_with($1, $2)"),
    "ends": ("endswith($1, $2)", "ends_with($1, $2)"),
    "short": ("(CASE WHEN length($1) <= $2 THEN $1 ELSE rtrim(substr($1, 1, $2 - 3)) || '...' END)", "(CASE WHEN length($1) <= $2 THEN $1 ELSE rtrim(substr($1, 1, $2 - 3)) || '...' END)"),
    "dot": ("aggregate(zip_with($1, $2, (x, y) -> CAST(x AS double) * CAST(y AS double)), CAST(0 AS double), (s, z) -> s + z)", "list_dot_product(CAST($1 AS double[]), CAST($2 AS double[]))"),
}

#: Regular expressions without braces, by name; ``{all_x(t)}`` gives all matches, ``{has_x(t)}`` whether there is one, ``{got_x(t)}`` the first group or ''.
PATTERNS = {
    "letter_beyond_ascii": "[\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufaff]",
    "entity": r"\b[A-Z][A-Za-z']+(?: +[A-Z][A-Za-z']+)?\b",
    "weekday": r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    "clock": r"\b([0-9][0-9]?:[0-9][0-9] *(?:a\.?m\.?|p\.?m\.?)?)\b",
    "number": r"\b[0-9]+\b",
    "at_place": r"\b(?:at|in|near|from|to) +[A-Z][A-Za-z']+",
    "liked": r"\b(?:love|loves|loved|like|likes|liked|enjoy|enjoys|enjoyed) +([a-z][a-z '-][a-z '-]+)",
    "stoked": r"\bstoked +for +([a-z][a-z '-][a-z '-]+)",
    "fan": r"\bfan +of +([a-z][a-z '-][a-z '-]+)",
    "favorite": r"\bfavorite +(?:is|are|was|were)? *([a-z][a-z '-][a-z '-]+)",
    "first_word": r"([a-z][a-z']*)",
    "habit_label": r"(?:^|[^\p{L}\p{N}_])(?:used to|would) +(?:rock|listen to|play|watch|read|visit|go to)? *(.+?)(?:[.!?]|$)",
    "liked_label": r"(?:^|[^\p{L}\p{N}_])(?:love|loves|loved|like|likes|liked|enjoy|enjoys|enjoyed) +(.+?)(?:[.!?]|$)",
    "stoked_label": r"(?:^|[^\p{L}\p{N}_])stoked +for +(.+?)(?:[.!?]|$)",
    "favorite_label": r"(?:^|[^\p{L}\p{N}_])favorite +(?:is|are|was|were)? *(.+?)(?:[.!?]|$)",
}


def _with_patterns():
    for name, pattern in PATTERNS.items():
        # Braces would end a construct's argument: they travel as <( and )> until the text is complete.
        safe = pattern.replace("{", "<(").replace("}", ")>")
        spark = "'" + safe.replace("\\", "\\\\").replace("'", "\\'") + "'"
        duck = "'" + safe.replace("'", "''") + "'"
        DIALECTS[f"all_{name}"] = (f"regexp_extract_all($1, {spark}, 0)", f"regexp_extract_all($1, {duck})")
        DIALECTS[f"has_{name}"] = (f"($1 RLIKE {spark})", f"regexp_matches($1, {duck})")
        DIALECTS[f"got_{name}"] = (f"regexp_extract($1, {spark}, 1)", f"regexp_extract($1, {duck}, 1)")
        DIALECTS[f"blank_{name}"] = (f"regexp_replace($1, {spark}, '_')", f"regexp_replace($1, {duck}, '_', 'g')")


_with_patterns()


def render(text: str, dialect: int) -> str:
    def fill(m):
        parts = [p.strip() or p for p in m[2].split(";")]
        out = DIALECTS[m[1]][dialect]
        for i, p in enumerate(parts, 1):
            out = out.replace(f"${i}", p)
        return out

    pattern = re.compile(r"\{(\w+)\(((?:[^{}])*)\)\}")
    while pattern.search(text):
        text = pattern.sub(fill, text)
    return text.replace("<(", "{").replace(")>", "}")


def tables_in(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", text)]


@dataclass(frozen=True)
class Query:
    """A named query. ``oracle`` is False where DuckDB can't check it."""

    name: str
    text: str
    oracle: bool = True

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in tables_in(self.text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(render(self.text, 0))


@dataclass(frozen=True)
class Step:
    """A named table of a plan, made from the tables before it.

    ``keep``: used more than once, so worth keeping. ``spark``: what Spark runs in place of
    ``text``, if anything; it may leave out rows that no query over these steps can meet.
    """

    name: str
    text: str
    keep: bool = False
    spark: str = ""

    def of(self, dialect: int) -> str:
        return self.text if dialect else self.spark or self.text


def needed(steps, text: str, dialect: int) -> list[Step]:
    """The steps that a text rests on in a dialect, directly or through others, in order."""
    wanted, out = set(re.findall(r"\w+", text)), []
    for step in reversed(steps):
        if step.name in wanted:
            out.append(step)
            wanted |= set(re.findall(r"\w+", step.of(dialect)))
    return out[::-1]


def kept(df: DataFrame) -> DataFrame:
    """Rows for several readers, written once to the folder that the cluster names in spark.checkpoint.dir.

    That ends their lineage and their plan: lost executors cost a reread. Only where the
    setting is absent and Spark runs in one JVM, as in tests, a local folder is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    path = f"{folder.rstrip('/')}/turnloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_steps(spark: SparkSession, steps, sources: dict[str, DataFrame], texts: dict[str, str]) -> dict[str, DataFrame]:
    """The rows of each text over the steps, which they share, each a DataFrame of its own; ``sources`` are tables that no step makes."""
    tables = dict(sources)

    def rows(sql):
        used = {name: f"{name}_{uuid.uuid4().hex}" for name in tables if re.search(rf"\b{name}\b", sql)}
        for name, view in used.items():
            tables[name].createOrReplaceTempView(view)
            # A table without an alias keeps its own name as one.
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b(?=\s*(?:$|\)|WHERE|JOIN|LEFT|ON|GROUP|UNION|ORDER|CROSS|LATERAL))", rf"\1 {view} {name}", sql)
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {view}", sql)
        df = spark.sql(sql)
        for view in used.values():
            spark.catalog.dropTempView(view)
        return df

    for step in needed(steps, " ".join(texts.values()), 0):
        if step.name not in tables:
            df = rows(render(step.of(0), 0))
            tables[step.name] = kept(df) if step.keep else df
    return {name: rows(render(text, 0)) for name, text in texts.items()}


@dataclass(frozen=True)
class Plan:
    """A query over steps: in Spark one DataFrame a step, for DuckDB one chain of named queries."""

    name: str
    steps: tuple
    text: str
    oracle: bool = True

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = tables_in(" ".join([self.text, *[s.of(0) for s in needed(self.steps, self.text, 0)]]))
        return run_steps(spark, self.steps, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in read}, {"rows": self.text})["rows"]

    def chained(self) -> str:
        return "WITH " + ",\n".join(f"{s.name} AS ({render(s.text, 1)})" for s in needed(self.steps, self.text, 1)) + "\n" + render(self.text, 1)


def collect(*modules) -> tuple[dict[str, Callable], dict[str, str]]:
    """All queries of the modules by name, and the DuckDB text of those it can check."""
    queries, oracles = {}, {}
    for module in modules:
        for q in module.QUERIES:
            queries[q.name] = q
            if q.oracle:
                oracles[q.name] = q.chained() if isinstance(q, Plan) else render(q.text, 1)
        for name, (build, oracle) in getattr(module, "BUILT", {}).items():
            queries[name] = build
            if oracle:
                oracles[name] = oracle
    return queries, oracles
