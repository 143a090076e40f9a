"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they match.  Weak ones, such as a long
mixed string, a user name or an address, mean little alone: they are reported
only when a complementary part (identifier, secret, endpoint) that is not part
of themselves starts within ``scope`` characters of them in the same document.
Candidates alone are dealt by document and ordered by position; a range frame of the scope's width
around each of them is the interval join, so no pair is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize

SCOPE = 400

#: kind -> (pattern, role); the order of kinds breaks ties of position.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{20,}"
WEAK_ID = r"""(?i)(?:user_?name|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_secret": "secret", "weak_id": "id", "endpoint": "endpoint"}
#: Of two parts that overlap the one of lower rank stays: what is inside an address is no secret beside it.
RANKS = {"assign": 0, "access": 0, "hex": 0, "endpoint": 1, "weak_id": 2, "weak_secret": 3}
HITS = "array<struct<kind:int,pos:int,gap:int,size:int,keep:boolean>>"
SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _hits(text: Column, kind: str, pattern: str, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches in order, each with its size and what lies between it and the one before.

    ``keep`` decides by the text of ``group`` whether a match is reported.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    rows = F.arrays_zip(found.alias("m"), shown.alias("s"), gaps.alias("g"))
    hit = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (keep(x["s"]) if keep else F.lit(True)).alias("keep"))
    return F.when(text.rlike(pattern), F.transform(rows, hit)).otherwise(F.array().cast(HITS))


def _mixed(string: Column) -> Column:
    return string.rlike("[0-9]") & string.rlike("[A-Z]") & string.rlike("[a-z]")


def _key() -> list[Column]:
    """Two hashes that stand for a document: rows of equal id and text have equal spans."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2")]


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, hits of every row: the texts are read once, and no text goes further."""
    text = F.coalesce("text", F.lit(""))
    kinds = [_hits(text, "assign", ASSIGN, lambda s: F.length(s) >= 8, group=2), _hits(text, "access", ACCESS), _hits(text, "hex", HEX)]
    kinds += [_hits(text, "weak_secret", WEAK_SECRET, _mixed), _hits(text, "weak_id", WEAK_ID), _hits(text, "endpoint", ENDPOINT)]
    return docs.select("doc_id", *_key(), F.concat(*kinds).alias("hits"))


def _rank(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(RANKS[k]) for k in KINDS]), kind)


def candidates(found: DataFrame) -> DataFrame:
    """k1, k2, start, kind, stop of the parts that are kept; of those that overlap, the ones of lowest rank.

    Places are running sums over a document's matches, and overlaps are seen
    from the furthest end before and the nearest start after, so a text with
    many matches costs a sort.
    """
    hits = found.where(F.size("hits") > 0).select("k1", "k2", F.inline("hits")).dropDuplicates(["k1", "k2", "kind", "pos"])
    upto = W.partitionBy("k1", "k2", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hits.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("keep")
    placed = placed.select("k1", "k2", (F.col("stop") - F.col("size")).alias("start"), "kind", "stop", _rank(F.col("kind")).alias("rank"))
    ahead = W.partitionBy("k1", "k2").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("k1", "k2").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)
    lower = range(1, max(RANKS.values()) + 1)
    seen = placed.withColumns({f"_stop{r}": F.max(F.when(F.col("rank") < r, F.col("stop"))).over(ahead) for r in lower})
    seen = seen.withColumns({f"_start{r}": F.min(F.when(F.col("rank") < r, F.col("start"))).over(behind) for r in lower})
    touched = F.lit(False)
    for r in lower:
        touched = touched | ((F.col("rank") == r) & F.coalesce((F.col(f"_stop{r}") > F.col("start")) | (F.col(f"_start{r}") < F.col("stop")), F.lit(False)))
    return seen.where(~F.coalesce(touched, F.lit(False))).select("k1", "k2", "start", "kind", "stop")


def linked_spans(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """k1, k2, base, linked: strong spans, and the weak ones with complementary parts in scope.

    A weak secret needs an identifier or an endpoint, a weak identifier needs a
    secret, an endpoint needs both.
    """
    near = W.partitionBy("k1", "k2").orderBy("start").rangeBetween(-scope, scope)

    def role(name: str) -> Column:
        kinds = [k for k, kind in enumerate(KINDS) if ROLES[kind] == name]
        return F.max(F.col("kind").isin(kinds)).over(near)

    seen = parts.withColumns({"id": role("id"), "secret": role("secret"), "endpoint": role("endpoint")})
    kind, strong = F.col("kind"), F.col("kind").isin([k for k, name in enumerate(KINDS) if RANKS[name] == 0])
    linked = (
        F.when(kind == KINDS.index("weak_secret"), F.col("id") | F.col("endpoint"))
        .when(kind == KINDS.index("weak_id"), F.col("secret"))
        .when(kind == KINDS.index("endpoint"), F.col("id") & F.col("secret"))
    )
    span = F.struct("start", "kind", "stop")
    return seen.where(strong | linked).groupBy("k1", "k2").agg(F.collect_list(F.when(strong, span)).alias("base"), F.collect_list(F.when(~strong, span)).alias("linked"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text), in code points, ends exclusive.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the strong
    spans alone), spans (all of them as kind:start:end by start, then kind),
    n_linked.  Null and empty texts have none; equal rows have equal results
    each; a null doc_id is kept; other columns are ignored; no rows give none.
    """
    slim = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(matches(slim), "secrets")
    spans = materialize(linked_spans(candidates(found), scope), "spans")
    joined = found.select("doc_id", "k1", "k2").join(spans, ["k1", "k2"], "left")
    base, linked = (F.coalesce(c, F.array().cast(SPAN)) for c in ("base", "linked"))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.sort_array(base)), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(base, linked))).alias("spans"),
        F.size(linked).cast("long").alias("n_linked"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = (("assign", ASSIGN, "length(g) >= 8", 2), ("access", ACCESS, "true", 0), ("hex", HEX, "true", 0),
             ("weak_secret", WEAK_SECRET, "regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Z]') AND regexp_matches(g, '[a-z]')", 0),
             ("weak_id", WEAK_ID, "true", 0), ("endpoint", ENDPOINT, "true", 0))
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS kind, {quote(kind)} AS name, start, start + length(m) AS stop FROM (
        SELECT r, m, g, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT r, unnest(regexp_extract_all(x, {quote(pattern)})) AS m, unnest(regexp_extract_all(x, {quote(pattern)}, {group})) AS g,
                     unnest(list_slice(string_split_regex(x, {quote(pattern)}), 1, len(regexp_extract_all(x, {quote(pattern)})))) AS p,
                     unnest(range(len(regexp_extract_all(x, {quote(pattern)})))) AS i FROM t)
        WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {keep}"""
        for k, (kind, pattern, keep, group) in enumerate(parts)
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({found}),
o AS (SELECT *, CASE WHEN kind < 3 THEN 0 ELSE 6 - kind END AS rank FROM f),
q AS (SELECT * FROM o AS w WHERE rank = 0 OR NOT EXISTS (SELECT 1 FROM o AS v WHERE v.r = w.r AND v.rank < w.rank AND w.start < v.stop AND v.start < w.stop)),
s AS (SELECT *, max((kind IN (1, 4))::INT) OVER w AS has_id, max((kind IN (0, 2, 3))::INT) OVER w AS has_secret, max((kind = 5)::INT) OVER w AS has_end
      FROM q WINDOW w AS (PARTITION BY r ORDER BY start RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
a AS (SELECT r, kind, start, stop, concat(name, ':', start::BIGINT, ':', stop::BIGINT) AS listed FROM s
      WHERE kind < 3 OR (kind = 3 AND (has_id = 1 OR has_end = 1)) OR (kind = 4 AND has_secret = 1) OR (kind = 5 AND has_id = 1 AND has_secret = 1)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             count(*) FILTER (WHERE kind > 2) AS n_linked, string_agg(listed, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
             string_agg(listed, ',' ORDER BY start, kind) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM t LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
