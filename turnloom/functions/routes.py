"""Questions and lines as they are routed: answer slots and their bonuses, budgets by family, speakers, redaction."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sql import Query

# Secrets and what replaces them, in order, and paths that name secrets.
SECRETS = [
    (r"(sk-[a-zA-Z0-9]{20,})", "[REDACTED_API_KEY]"),
    (r"(key-[a-zA-Z0-9]{20,})", "[REDACTED_KEY]"),
    (r"(token[\"\s:=]+[\"']?[a-zA-Z0-9_\-\.]{20,}[\"']?)", "[REDACTED_TOKEN]"),
    (r"(password[\"\s:=]+[\"']?[^\s\"']{4,}[\"']?)", "[REDACTED_PASSWORD]"),
    (r"(Bearer\s+[a-zA-Z0-9_\-\.]+)", "Bearer [REDACTED]"),
    (r"(Authorization[\"\s:]+[\"']?[^\s\"']+[\"']?)", "Authorization: [REDACTED]"),
    (r"([A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", "[REDACTED_JWT]"),
    (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/])", "[REDACTED_BASE64]"),
]
SECRET_PATHS = "([.]env|credentials|secret|secrets|password|token|[.]pem|[.]key|[.]p12|[.]pfx|id_rsa|id_dsa|[.]npmrc|[.]aws|[.]gcp|[.]azure)"

SLOT = """slot AS (SELECT conv_id, turn, text, CASE WHEN {matches(lower(text);^when)} OR contains(lower(text), ' what date') OR contains(lower(text), 'which date') THEN 'date/time' WHEN contains(lower(text), 'how long') THEN 'duration'
        WHEN contains(lower(text), 'how many') OR contains(lower(text), 'number of') THEN 'count' WHEN {matches(lower(text);^who)} THEN 'person/entity' WHEN {matches(lower(text);^where)} THEN 'location'
        WHEN {matches(lower(text);^(did |was |is ))} THEN 'yes/no' ELSE 'entity/attribute' END AS slot FROM conversations)"""
KID = "used to|as a kid|childhood"

QUERIES = [
    Query("o304_answer_slot", f"WITH {SLOT} SELECT conv_id, turn, slot FROM slot"),
    Query("o312_habit_asked", f"SELECT q.conv_id, q.turn, CASE WHEN {{matches(lower(q.text);({KID}|when he was a kid|when she was a kid|when they were kids))}} AND {{matches(lower(a.text);({KID}|when i was a kid|those were the days|back then))}} THEN 1 ELSE 0 END AS habit FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1"),
    Query("o317_speaker_line", """
        WITH l AS (SELECT doc_id, pos, tok AS line, CASE WHEN position(':' IN tok) > 0 THEN position(':' IN tok) ELSE position('：' IN tok) END AS at_ FROM documents {posexplode({lines(text)})})
        SELECT doc_id, pos, CASE WHEN at_ > 1 THEN trim(substr(line, 1, at_ - 1)) ELSE 'speaker' END AS speaker, CASE WHEN at_ > 0 THEN trim(substr(line, at_ + 1)) ELSE trim(line) END AS said FROM l"""),
    Query("o325_guard_tokens", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(greatest(1, floor((length(text) + 2) / 3.0)) AS bigint) END AS tokens_ FROM documents"),
    Query("o327_host_ids", "SELECT page_id, {joined({sorted({distinct({hosts(html)})})};,)} AS hosts FROM pages"),
    Query("o329_sensitive_paths", f"SELECT page_id, {{matches(lower(url);{SECRET_PATHS})}} AS sensitive FROM pages"),
    Query("o284_supported", """
        WITH p AS (SELECT u.conv_id, u.turn, {distinct({tokens(u.text)})} AS g, {distinct({tokens(a.text)})} AS s, u.text = a.text AS same_, contains(lower(a.text), 'not mentioned') AS refused FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')
        SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN refused ELSE same_ OR 4 * {common(g;s)} >= {size(g)} + {size(s)} END AS supported FROM p"""),
    Query("o285_evidence_in_context", "SELECT b.conv_id, count(*) AS evidence, count(CASE WHEN position(substr(b.text, 1, 120) IN c.context_) > 0 THEN 1 END) AS found FROM conversations b JOIN (SELECT conv_id, {joined({collect(text;turn)}; )} AS context_ FROM conversations WHERE role <> 'system' GROUP BY conv_id) c ON c.conv_id = b.conv_id GROUP BY b.conv_id"),
    Query("o292_index_tokens", "SELECT doc_id, {joined({longer({words(text)};1)}; )} AS tokens_ FROM documents"),
    Query("o293_stripped_tokens", "SELECT conv_id, turn, {joined({split_ws({no_punctuation(text)})}; )} AS tokens_ FROM conversations"),
    Query("o451_highest_redaction", "SELECT source, CASE max(CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS level_ FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source"),
    Query("o296_redundancy", """
        WITH s AS (SELECT conv_id, turn, {distinct({words(text)})} AS w FROM conversations),
        j AS (SELECT a.conv_id, a.turn, max(CAST({common(a.w;b.w)} AS double) / nullif({size(a.w)} + {size(b.w)} - {common(a.w;b.w)}, 0)) AS nearest FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.turn >= a.turn - 5 AND b.turn < a.turn GROUP BY a.conv_id, a.turn)
        SELECT conv_id, turn, CASE WHEN nearest > 8e-1 THEN 'REJECT' WHEN nearest > 5e-1 THEN 'UNCERTAIN' ELSE 'ACCEPT' END AS verdict FROM j"""),
]


def redacted(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with secrets in ``column`` replaced, and ``redaction`` partial or none; null becomes empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = text
    for pattern, put in SECRETS:
        out = F.regexp_replace(out, pattern, put)
    return df.withColumns({column: out, "redaction": F.when(out != text, "partial").otherwise("none")})


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("text_sha"), "redaction")


BUILT = {"o328_redacted": (redacted_documents, None)}
