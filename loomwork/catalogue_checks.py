"""Queries that check tables, logs and entries, and count what the checks find."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import parsing, text
from loomwork.operators import checks, tables
from loomwork.registry import query


@query("SELECT count(DISTINCT user_id) AS n FROM events WHERE event_type = 'error'")
def distinct_failed(t):
    return t.events.where("event_type = 'error'").agg(F.countDistinct("user_id").alias("n"))


@query("SELECT coalesce(quality::VARCHAR, 'none') AS version, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality")
def by_nullable_version(t):
    counted = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("version"), "n")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'P'")
def pending_sources(t):
    return t.orders.where("o_orderstatus = 'P'").agg(F.countDistinct("o_custkey").alias("n"))


@query("""WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_orderstatus, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3) AS detail FROM r GROUP BY o_orderstatus""")
def backlog_health(t):
    return tables.top_details(t.orders, "o_orderstatus", [F.desc("o_totalprice"), F.col("o_orderkey")], "o_orderkey")


@query("SELECT column_name, string_agg(value, ',' ORDER BY value) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS k FROM (SELECT DISTINCT column_name, value FROM (SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber FROM lineitem) UNPIVOT (value FOR column_name IN (l_returnflag, l_linestatus, l_linenumber)))) WHERE k <= 3 GROUP BY column_name")
def sample_values(t):
    return tables.sample_values(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT '_operation_id' AS column_name, true AS present, count(*) FILTER (WHERE quality IS NULL) AS nulls FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT '_source_file', true, count(*) FILTER (WHERE source IS NULL) FROM documents UNION ALL SELECT '_source_version', false, NULL UNION ALL SELECT '_source_row', true, 0")
def traceability(t):
    batch = t.documents.join(t.labels, "doc_id", "left").select(F.col("quality").alias("_operation_id"), F.col("source").alias("_source_file"), F.col("doc_id").alias("_source_row"))
    return tables.traceability(batch)


@query("SELECT source, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE lang = 'en') AS english, count(*) AS n FROM documents GROUP BY source")
def conversion_summary(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "en").alias("english"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, sum(length(props))::BIGINT AS size, max(ts) AS latest FROM events GROUP BY user_id")
def folder_sizes(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("size"), F.max("ts").alias("latest"))


@query("SELECT CASE WHEN p_name LIKE 'r%' THEN 'tools' WHEN p_name LIKE 's%' THEN 'flows' ELSE 'other' END AS bucket, count(*) FILTER (WHERE p_type = 'SMALL') AS small, count(*) FILTER (WHERE p_type = 'ECONOMY') AS economy FROM part GROUP BY 1")
def reference_buckets(t):
    name = F.col("p_name")
    bucket = F.when(name.startswith("r"), "tools").when(name.startswith("s"), "flows").otherwise("other")
    return t.part.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("p_type") == "SMALL").alias("small"), F.count_if(F.col("p_type") == "ECONOMY").alias("economy"))


@query("""SELECT 'WARN' AS severity, 'owner' AS "check", p_partkey::VARCHAR AS key, 'no p_name' AS message FROM part WHERE p_size = 50
    UNION ALL SELECT 'WARN', 'patterns', doc_id || ':' || i, 'licence' FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, '[Ll]icen[cs]e')
    UNION ALL SELECT 'WARN', 'patterns', doc_id || ':' || i, 'path' FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, 'https?://')""")
def tool_audit(t):
    """Entries without an owner, and lines that match a table of patterns."""
    owned = t.part.select("p_partkey", F.when(F.col("p_size") == 50, " ").otherwise(F.col("p_name")).alias("p_name"))
    return tables.audit(checks.required(owned, "p_partkey", ["p_name"], "owner"), checks.pattern_issues(t.documents, "doc_id", "text", {"licence": "[Ll]icen[cs]e", "path": "https?://"}))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '#[A-Z/0]+!?|=[A-Z]+')) AS kind FROM documents) GROUP BY kind")
def cell_errors(t):
    """Error marks and formulas by kind."""
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("#[A-Z/0]+!?|=[A-Z]+"), F.lit(0))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_type AS workflow, count(*) AS runs FROM events GROUP BY event_type")
def workflow_counters(t):
    return t.events.groupBy(F.col("event_type").alias("workflow")).agg(F.count("*").alias("runs"))


@query("SELECT page, y AS top, bottom FROM (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS bottom FROM (SELECT DISTINCT p_size AS page, p_partkey % 97 AS y FROM part)) WHERE bottom IS NOT NULL")
def row_bands(t):
    return tables.bands(t.part.select(F.col("p_size").alias("page"), (F.col("p_partkey") % 97).alias("y")))


@query("""WITH n AS (SELECT DISTINCT o_orderkey AS number FROM orders), g AS (SELECT number, lead(number) OVER (ORDER BY number) AS b FROM n)
    SELECT 'ERROR' AS severity, 'numbering' AS "check", (number + 1)::VARCHAR AS key, (b - number - 1)::VARCHAR || ' missing' AS message FROM g WHERE b - number > 1
    UNION ALL SELECT 'ERROR', 'numbering', o_orderkey::VARCHAR, count(*)::VARCHAR || ' times' FROM orders GROUP BY o_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'WARN', 'fields', o_orderkey::VARCHAR, 'no o_orderstatus' FROM orders WHERE trim(coalesce(o_orderstatus, '')) = ''""")
def decision_checks(t):
    """Numbers that are missing or stated twice, and blank fields."""
    return tables.audit(checks.numbering(t.orders, F.col("o_orderkey")), checks.required(t.orders, "o_orderkey", ["o_orderstatus"]))


@query("""SELECT 'ERROR' AS severity, 'dangling' AS "check", l_partkey::VARCHAR AS key, 'no such target_id' AS message FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
    UNION ALL SELECT 'ERROR', 'dangling', l_suppkey::VARCHAR, 'no such source_id' FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    UNION ALL SELECT 'WARN', 'duplicate', p_name || '/' || p_brand, count(*)::VARCHAR || ' rows' FROM part GROUP BY p_name, p_brand HAVING count(*) > 1
    UNION ALL SELECT 'WARN', 'fields', doc_id::VARCHAR, 'no text' FROM documents WHERE trim(coalesce(text, '')) = ''
    UNION ALL SELECT 'WARN', 'review', o_orderkey::VARCHAR, 'review date is past' FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'
    UNION ALL SELECT 'WARN', 'unembedded', doc_id::VARCHAR, 'no vector' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'ERROR', 'superseded', c_custkey::VARCHAR, 'superseded but active' FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def knowledge_validate(t):
    """The seven checks of a knowledge base as one table of issues."""
    edges = t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    dup = t.part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n > 1")
    late = t.orders.where("o_orderstatus = 'P' and o_orderdate < timestamp'1996-01-01'")
    bare = t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    old = t.customer.where("c_mktsegment <> 'BUILDING'").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return tables.audit(
        checks.dangling(edges, t.part.where("p_size > 1").select(F.col("p_partkey").alias("id")), "target_id"),
        checks.dangling(edges, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")), "source_id"),
        tables.issues(dup, "WARN", "duplicate", F.concat_ws("/", "p_name", "p_brand"), F.concat(F.col("n").cast("string"), F.lit(" rows"))),
        checks.required(t.documents, "doc_id", ["text"]),
        tables.issues(late, "WARN", "review", F.col("o_orderkey"), "review date is past"),
        tables.issues(bare, "WARN", "unembedded", F.col("doc_id"), "no vector"),
        tables.issues(old, "ERROR", "superseded", F.col("c_custkey"), "superseded but active"),
    )


@query("""WITH i AS (SELECT 'ERROR' AS s FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'WARN' FROM supplier WHERE s_acctbal < 0) SELECT s AS severity, count(*) AS n FROM i GROUP BY s""")
def health_report(t):
    found = tables.audit(tables.issues(t.customer.where("c_acctbal < 0"), "ERROR", "balance", F.col("c_custkey"), "below zero"), tables.issues(t.supplier.where("s_acctbal < 0"), "WARN", "balance", F.col("s_suppkey"), "below zero"))
    return checks.worst(found)


@query("""SELECT 'ERROR' AS severity, 'candidate' AS "check", p_partkey::VARCHAR AS key, 'not a name: ' || replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN '-' ELSE ' ' END) AS message FROM part WHERE NOT regexp_matches(replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN '-' ELSE ' ' END), '^[a-z0-9]+(-[a-z0-9]+)*$')""")
def candidate_names(t):
    name = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return checks.candidate_names(t.part, "p_partkey", name)


@query("""SELECT p_partkey, id, evidence, (length(lower(trim(evidence))) < 12 OR evidence IN ('ok done')) AS low FROM (
    SELECT p_partkey, 'a' AS id, p_name || ' checked; null rate 0%' AS evidence FROM part UNION ALL SELECT p_partkey, 'b', 'ok done' FROM part)""")
def checklist_answers(t):
    """Answers in map or list form, and which of them say nothing."""
    name = F.concat("p_name", F.lit(" checked; null rate 0%"))
    as_map = F.to_json(F.create_map(F.lit("a"), name, F.lit("b"), F.lit("ok done")))
    as_list = F.to_json(F.array(F.struct(F.lit("a").alias("id"), name.alias("evidence")), F.struct(F.lit("b").alias("id"), F.lit("ok done").alias("evidence"))))
    raw = F.when(F.col("p_partkey") % 2 == 0, as_map).otherwise(as_list)
    return t.part.select("p_partkey", F.inline(tables.responses(raw))).select("p_partkey", "id", "evidence", parsing.low_signal(F.col("evidence")).alias("low"))


@query("""SELECT CASE WHEN count(*) > 60 THEN 'ERROR' ELSE 'WARN' END AS severity, 'hygiene' AS "check", user_id::VARCHAR AS key, count(*)::VARCHAR || ' files' AS message FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id HAVING count(*) > 5""")
def temporary_files(t):
    files = t.events.select("user_id", F.concat(F.lit("tmp/"), "event_type", F.lit(".tmp")).alias("path"))
    return checks.too_many(files, F.col("user_id"), r"/(error|click)\.tmp$", 5, 60)


@query("""SELECT 'WARN' AS severity, 'headings' AS "check", doc_id::VARCHAR AS key, line AS message FROM (SELECT doc_id, '# ' || unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id, line HAVING count(*) > 1""")
def repeated_headings(t):
    files = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("# "), x)), "\n").alias("text"))
    return checks.repeated_headings(files, "doc_id", "text")


@query("""SELECT 'ERROR' AS severity, 'sections' AS "check", p_partkey::VARCHAR AS key, 'no Scope' AS message FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT 'ERROR', 'sections', p_partkey::VARCHAR, 'no Limits' FROM part WHERE p_size <= 25""")
def missing_sections(t):
    body = F.concat_ws("\n", F.lit("# Title"), F.when(F.col("p_type") == "SMALL", "## Scope"), F.when(F.col("p_size") > 25, "## Limits"))
    return checks.missing_sections(t.part.select("p_partkey", body.alias("text")), "p_partkey", "text", ["Scope", "Limits"])


@query("""SELECT 'ERROR' AS severity, 'checksum' AS "check", doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 THEN 'not read' ELSE 'another version' END AS message FROM documents WHERE text IS NOT NULL AND (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang <> 'en'))""")
def read_proofs(t):
    """Checksums of what was read against what was exported."""
    own = t.documents.where("text is not null")
    sha = F.when((F.col("doc_id") % 3 == 1) & (F.col("lang") != "en"), F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return checks.checksum_mismatch(own.where("doc_id % 3 <> 0").select("doc_id", sha.alias("sha")), own, "doc_id")


@query("""WITH m AS (SELECT l_suppkey AS k, max(l_shipdate) AS newest FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), e AS (SELECT l_suppkey AS k, max(l_shipdate) AS made FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT 'WARN' AS severity, 'freshness' AS "check", k::VARCHAR AS key, 'older than its source' AS message FROM e JOIN m USING (k) WHERE made < newest""")
def export_freshness(t):
    both = t.lineitem.where("l_returnflag in ('A', 'R')").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"), "l_returnflag")
    exports = both.where("l_returnflag = 'R'").groupBy("k").agg(F.max("at").alias("at"))
    return checks.too_old(exports, both.where("l_returnflag = 'A'"), "k")


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01' AS stale FROM orders WHERE o_orderstatus = 'P'")
def backlog_freshness(t):
    now = F.lit("1996-06-08").cast("timestamp")
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey", tables.stale(t.orders, "o_orderdate", now, 7).alias("stale"))


@query("""SELECT 'WARN' AS severity, 'length' AS "check", doc_id::VARCHAR AS key, len(string_split(text, chr(10)))::VARCHAR || ' lines' AS message FROM documents WHERE len(string_split(text, chr(10))) > 20""")
def long_memories(t):
    return checks.long_files(t.documents, "doc_id", "text", 20)


@query("SELECT doc_id, line, CASE WHEN regexp_matches(lower(line), 'block|cannot|must') THEN 'blocking' WHEN regexp_matches(lower(line), 'decide|choose|whether') THEN 'decision' WHEN regexp_matches(lower(line), 'data|missing|value') THEN 'data' ELSE 'other' END AS class FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line LIKE '%?%'")
def question_classes(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("?"))
    return lines.select("doc_id", "line", text.question_class(F.col("line")).alias("class"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END AS at FROM orders")
def parsed_times(t):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no time")
    return t.orders.select("o_orderkey", text.timestamp_or_null(raw).cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS slashed, strftime(o_orderdate, '%Y-%m-%d') AS dashed FROM orders")
def formatted_dates(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("slashed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dashed"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def text_checksums(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
