"""Secret scan with multipart credential linking.

Base spans, which stand alone: a key word assigned a value of 12 characters or
more (``assign``), an access key identifier (``access``), a long run of
hexadecimal digits (``hex``).  Weak candidates, which mean nothing alone: a long
token of mixed characters (``weak_secret``), a named account or client
(``weak_id``), an address of a service (``endpoint``).

Every part plays a role: identifier, secret or endpoint.  A weak candidate is
reported only when a complementary part stands within its scope, ``SCOPE`` code
points either side: an identifier or an endpoint for a secret, a secret for the
other two.  A weak candidate that overlaps a base span is not reported again.
The scopes are found by an interval join: candidates and parts are dealt to
bins as wide as the scope, so a candidate meets the parts of its own and its
neighbouring bins only, and never all parts of a document.

Edge cases: a NULL text counts as empty and has no spans.  Rows are scanned one
by one, so that repeated rows, and rows with a NULL doc_id, give the same spans
each.  An empty table gives an empty result.  Extra columns are ignored.

Only DataFrame functions are used; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of
from .textspans import counted, listed, matches, spans

# ---- Fixed values: patterns of the base and weak parts, in their order of rank ----
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{20,}"
WEAK_ID = (r"(?i)(client_?id|access_?key_?id|account|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?"
           r"([A-Za-z0-9_.@-]{3,})")
ENDPOINT = r"(https?|jdbc:[a-z]+|mongodb|postgres|redis|amqp)://[^\x20\x09-\x0D\"'<>]+"
LEAST_ASSIGNED = 12
ROLES = {"assign": "S", "access": "I", "hex": "S", "weak_secret": "S", "weak_id": "I", "endpoint": "E"}
WEAK = ("weak_secret", "weak_id", "endpoint")
SCOPE = 200

# A run of hexadecimal digits of 16 and more is a whole maximal run, and an
# identifier of 18 and more a whole one, so the lengths are part of the patterns;
# a key word's short value uses up its match, so there the length is judged after.


def _mixed(token: Column) -> Column:
    return token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]")


def parts(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, weak``: the spans of each row, base and weak."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    for i, p in enumerate((ASSIGN, ACCESS, HEX, WEAK_SECRET, WEAK_ID, ENDPOINT)):
        found = found.withColumn(f"m{i}", matches(F.col("text"), p))
    text, m = F.col("text"), [F.col(f"m{i}") for i in range(6)]
    base = F.concat(
        spans(text, m[0], ASSIGN, "assign", 0, lambda v: F.length(v) >= LEAST_ASSIGNED, matches(text, ASSIGN, 2)),
        spans(text, m[1], ACCESS, "access", 1), spans(text, m[2], HEX, "hex", 2))
    weak = F.concat(spans(text, m[3], WEAK_SECRET, "weak_secret", 3, _mixed),
                    spans(text, m[4], WEAK_ID, "weak_id", 4), spans(text, m[5], ENDPOINT, "endpoint", 5))
    bare = "struct<start:int,rank:int,end:int,kind:string>"
    return found.select("row", "doc_id", *[F.transform(c, lambda s: s.dropFields("text")).cast(f"array<{bare}>")
                                           .alias(n) for c, n in ((base, "base"), (weak, "weak"))])


def _role(kind: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return mapping[F.col(kind)]


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, linked``: the weak candidates of a row that have a complement in scope."""
    some = found.where(F.size("weak") > 0)
    every = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    bins = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    there = every.select("row", F.explode(bins).alias("bin"), F.col("start").alias("ps"),
                         F.col("end").alias("pe"), F.col("kind").alias("pk"))
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    weak = every.where(F.col("kind").isin(*WEAK)).select("*", F.explode(reach).alias("bin"))
    near = weak.join(there, ["row", "bin"]).where(
        (F.col("ps") <= F.col("end") + scope) & (F.col("pe") >= F.col("start") - scope))
    roles = F.concat(_role("kind"), _role("pk"))
    judged = near.groupBy("row", "start", "rank", "end", "kind").agg(
        F.max(roles.isin("SI", "SE", "IS", "ES")).alias("complement"),
        F.max(~F.col("pk").isin(*WEAK) & (F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")))
        .alias("covered"))
    return (judged.where("complement AND NOT covered").groupBy("row")
            .agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("linked")))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, doc_id, base, linked``: base spans and the reported weak ones, per row."""
    found = materialise(docs.sparkSession, parts(docs), "secret_parts")
    return found.join(linked(found, scope), "row", "left")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans`` of every row."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    rows = scan(docs).withColumn("linked", F.coalesce("linked", empty))
    return rows.select(
        "doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.size("linked").cast("bigint").alias("n_linked"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "linked")).alias("spans"))


def _sql_spans(name: str, pattern: str, rank: int, where: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""{name}_m AS (
  SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS js,
         string_split_regex(t, '{p}') AS gs FROM d
), {name}_u AS (
  SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(js) AS j,
         unnest(gs[1:len(ms)]) AS g FROM {name}_m WHERE len(ms) > 0
), {name} AS (
  SELECT doc_id, e - length(m) AS s, {rank} AS r, e, '{name}' AS k FROM (
    SELECT doc_id, m, j, CAST(SUM(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e
    FROM {name}_u) WHERE {where}
)"""


# The same in DuckDB SQL (doc_id unique).
ORACLE_SQL = "WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), " + ", ".join([
    _sql_spans("assign", ASSIGN, 0, f"length(j) >= {LEAST_ASSIGNED}", 2), _sql_spans("access", ACCESS, 1, "TRUE"),
    _sql_spans("hex", HEX, 2, "TRUE"),
    _sql_spans("weak_secret", WEAK_SECRET, 3, "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') "
                                             "AND regexp_matches(m, '[0-9]')"),
    _sql_spans("weak_id", WEAK_ID, 4, "TRUE"), _sql_spans("endpoint", ENDPOINT, 5, "TRUE")]) + f""",
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
weak AS (SELECT * FROM weak_secret UNION ALL SELECT * FROM weak_id UNION ALL SELECT * FROM endpoint),
part AS (SELECT *, CASE WHEN k IN ('access', 'weak_id') THEN 'I' WHEN k = 'endpoint' THEN 'E' ELSE 'S' END AS role
         FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (
  SELECT w.* EXCLUDE (role) FROM part w WHERE w.r >= 3
    AND EXISTS (SELECT 1 FROM part p WHERE p.doc_id = w.doc_id AND p.s <= w.e + {SCOPE} AND p.e >= w.s - {SCOPE}
                AND w.role || p.role IN ('SI', 'SE', 'IS', 'ES'))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND b.e > w.s)
),
bl AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS x,
              COUNT(*) FILTER (k = 'assign') AS na, COUNT(*) FILTER (k = 'access') AS nc,
              COUNT(*) FILTER (k = 'hex') AS nh FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS x,
              COUNT(*) FILTER (r >= 3) AS nl
       FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(na, 0) AS n_assign, COALESCE(nc, 0) AS n_access, COALESCE(nh, 0) AS n_hex,
       COALESCE(nl, 0) AS n_linked, sha256(COALESCE(bl.x, '')) AS base_sha256, COALESCE(al.x, '') AS spans
FROM d LEFT JOIN bl ON bl.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id
"""
