"""Queries over entries that carry JSON, nested definitions and files: registries, sidecars, contracts, exports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import entries, search, tables
from loomwork.registry import query


@query("SELECT DISTINCT n_name AS workflow, p_name AS agent FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL'")
def workflow_relations(t):
    """Which agents a workflow's nodes delegate to, from its nested definition."""
    nodes = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    defined = nodes.groupBy(F.col("n_name").alias("name")).agg(F.collect_set("l_partkey").alias("nodes"))
    agents = t.part.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("agent"))
    return entries.delegates(defined, agents)


@query("SELECT DISTINCT p.page_id, part.p_name AS tool FROM (SELECT page_id, unnest(regexp_extract_all(html, '[a-z]+ [a-z]+')) AS m FROM pages) p JOIN part ON p_name = m")
def agent_relations(t):
    """Names of registered tools that a text mentions."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    return entries.mentioned(t.pages, "page_id", "html", "[a-z]+ [a-z]+", names).select("page_id", F.col("name").alias("tool"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def eval_history(t):
    """A JSON map of each row, one row an entry; text that is no map has none."""
    return entries.map_entries(t.events, "event_id", "props").where("key = 'k'").select("event_id", F.col("value").cast("int").alias("k"))


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 1")
def custom_predicates(t):
    """Exclusions stated as SQL text, checked by Spark's own analysis."""
    kept = entries.excluded(t.orders, ["o_orderpriority = '1-URGENT'", "o_totalprice <= 1000"])
    return kept.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 40 ORDER BY p_size DESC, p_partkey")
def sheet_filter_sort(t):
    """A sheet filtered by a criterion and sorted by a column."""
    return t.part.where("p_size > 40").orderBy(F.desc("p_size"), "p_partkey").select("p_partkey", "p_brand", "p_size")


@query("SELECT vec_id FROM embeddings WHERE vec_id <> 0 AND vec_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_suppkey FROM lineitem WHERE l_partkey = 1)")
def unlinked_candidates(t):
    """Candidates without the node itself and those linked to it either way."""
    linked = t.lineitem.where("l_suppkey = 1").select(F.col("l_partkey").alias("vec_id")).union(t.lineitem.where("l_partkey = 1").select("l_suppkey"))
    return t.embeddings.where("vec_id <> 0").join(linked.distinct(), "vec_id", "left_anti").select("vec_id")


@query("SELECT query, vec_id, round(s, 4) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) <= 3")
def capability_search(t):
    found = search.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", k=3)
    return found.select("query", "vec_id", F.round("similarity", 4).alias("similarity"))


@query("SELECT n_name || chr(10) || coalesce(string_agg(s_name, chr(10) ORDER BY s_name), '') AS text FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def embed_texts(t):
    """An entity and its relations as the text to embed."""
    related = t.supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("names"))
    joined = t.nation.join(related, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select(F.concat(F.col("n_name"), F.lit("\n"), F.coalesce("names", F.lit(""))).alias("text"))


@query("SELECT r_name AS region, list(n_name ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def semantic_export(t):
    """Entities with their relations nested."""
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"))


@query("SELECT 'labels(doc_id, quality, toxic)' AS schema UNION ALL SELECT 'region(r_regionkey, r_name)'")
def compact_schema(t):
    return entries.compact_schema({"labels": t.labels, "region": t.region})


@query("""SELECT * FROM (SELECT 1 AS part, o_orderkey::VARCHAR AS line FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 24)
    UNION ALL SELECT * FROM (SELECT 2, p_name FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) ORDER BY n DESC, p_name LIMIT 12) UNION ALL SELECT 3, count(*)::VARCHAR FROM events""")
def session_context(t):
    """Several reports as one ordered bundle."""
    recent = t.orders.where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(24).select(F.col("o_orderkey").cast("string").alias("line"))
    targets = t.part.groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(12).select(F.col("p_name").alias("line"))
    return entries.bundle([recent, targets, t.events.agg(F.count("*").cast("string").alias("line"))])


@query("SELECT p_partkey, p_name AS scope, CASE WHEN p_size > 25 THEN p_brand END AS limits FROM part")
def state_sections(t):
    """Sections of a Markdown text as columns, null where one is missing."""
    body = F.concat_ws("\n", F.lit("# T"), F.lit("## Scope"), "p_name", F.when(F.col("p_size") > 25, F.concat(F.lit("## Limits\n"), "p_brand")))
    return t.part.select("p_partkey", entries.sections(body, ["Scope", "Limits"]).alias("s")).select("p_partkey", F.col("s.Scope").alias("scope"), F.col("s.Limits").alias("limits"))


@query("SELECT p_type AS type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type")
def store_index(t):
    """The index of a store, derived anew."""
    return t.part.groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT user_id, CASE WHEN n >= 60 THEN 'queue' WHEN recent THEN 'wait' ELSE 'none' END AS action FROM (SELECT user_id, count(*) AS n, max(event_type = 'error') AS recent FROM events GROUP BY user_id)")
def promotion_candidates(t):
    own = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("recent"))
    return own.select("user_id", F.when(F.col("n") >= 60, "queue").when(F.col("recent"), "wait").otherwise("none").alias("action"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'secret') OR contains(lower(text), 'password') THEN 'superseded' WHEN contains(text, 'and') THEN 'active' ELSE 'draft' END AS status, source <> 'source_01' AND contains(text, 'the') AS crosses FROM documents")
def detected_status(t):
    low = F.lower("text")
    status = F.when(low.contains("secret") | low.contains("password"), "superseded").when(F.col("text").contains("and"), "active").otherwise("draft")
    return t.documents.select("doc_id", status.alias("status"), ((F.col("source") != "source_01") & F.col("text").contains("the")).alias("crosses"))


@query("""SELECT 'ERROR' AS severity, 'contract' AS "check", p_partkey::VARCHAR AS key, 'no target.table' AS message FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 'ERROR', 'contract', p_partkey::VARCHAR, 'no batch' FROM part WHERE p_size > 45""")
def contract_audit(t):
    """Fields that a nested contract must have."""
    contract = F.to_json(F.struct(F.struct(F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("table")).alias("target"), F.when(F.col("p_size") <= 45, F.lit(1000)).alias("batch")))
    return entries.missing_paths(t.part.select("p_partkey", contract.alias("json")), "p_partkey", "json", ["target.table", "batch"], "contract")


@query("""SELECT 'ERROR' AS severity, 'artifact' AS "check", conv_id::VARCHAR AS key, 'no assistant' AS message FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'assistant')""")
def required_artifacts(t):
    """Entries none of whose outputs is of a required kind."""
    outputs = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("outputs"))
    return entries.without_output(outputs, "conv_id", "outputs", ["assistant"])


@query("SELECT conv_id, n, stated, n = stated AS same FROM (SELECT conv_id, count(*) AS n, max(turn) + 1 AS stated FROM conversations GROUP BY conv_id)")
def stated_counts(t):
    """What an entry says it has against what there is."""
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), (F.max("turn") + 1).alias("stated")).withColumn("same", F.col("n") == F.col("stated"))


@query("""SELECT 'WARN' AS severity, 'drift' AS "check", a.doc_id::VARCHAR AS key, 'texts differ' AS message FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.source = b.source AND a.text <> b.text""")
def copy_drift(t):
    """Texts that should be copies and are not."""
    one = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("a"))
    other = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), "source", F.sha2("text", 256).alias("b"))
    return tables.issues(one.join(other, ["doc_id", "source"]).where("a <> b"), "WARN", "drift", F.col("doc_id"), "texts differ")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'signup' QUALIFY place = 1")
def queue_heads(t):
    """The entry that has waited longest in each queue."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.where("event_type = 'signup'").select("user_id", "event_id", place.alias("place")).where("place = 1")
