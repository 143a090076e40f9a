"""Queries that keep and search a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import conflicts, graph, knowledge, search, tables
from loomwork.registry import NODES, query
from loomwork.sources import logs


@query("SELECT vec_id, embedding[1:4] AS head, len(embedding)::INT AS n FROM embeddings")
def vector_blobs(t):
    """Vectors to little-endian bytes and back."""
    packed = t.embeddings.select("vec_id", text.pack_floats(F.col("embedding")).alias("blob"))
    back = packed.select("vec_id", text.unpack_floats(F.col("blob")).alias("v"))
    return back.select("vec_id", F.slice("v", 1, 4).alias("head"), F.size("v").alias("n"))


@query("SELECT 'documents' AS table_name, count(*) AS n, 5 AS columns FROM documents UNION ALL SELECT 'labels', count(*), 3 FROM labels UNION ALL SELECT 'part', count(*), 6 FROM part UNION ALL SELECT 'region', count(*), 2 FROM region")
def table_catalog(t):
    """Rows and columns of each table; rows are counted by the scan, columns come from the schema."""
    return tables.table_counts({n: getattr(t, n) for n in ("documents", "labels", "part", "region")})


@query("SELECT 'supplier' AS table_name, s_nationkey AS station, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY ALL")
def station_row_counts(t):
    legs = {"supplier": t.supplier.select(F.col("s_nationkey").alias("station")), "customer": t.customer.select(F.col("c_nationkey").alias("station"))}
    return legs["supplier"].withColumn("table_name", F.lit("supplier")).unionByName(legs["customer"].withColumn("table_name", F.lit("customer"))).groupBy("table_name", "station").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'superseded' WHEN c_acctbal > 0 THEN 'active' ELSE 'stale' END AS status FROM customer")
def supersede_cascade(t):
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("stale").alias("status"))
    edges = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("target_id"), F.lit("supersedes").alias("relation"))
    return knowledge.superseded(nodes, edges)


@query("SELECT user_id, count(*) AS k, json_extract_string(props, '$.k') IS NOT NULL AS had FROM events GROUP BY user_id, had")
def usage_bumps(t):
    """A usage counter in a JSON column, raised by the events of each user."""
    counted = t.events.groupBy("user_id", F.get_json_object("props", "$.k").isNotNull().alias("had")).agg(F.count("*").alias("n"))
    meta = knowledge.bumped(F.lit('{"a": "x", "usage": "0"}'), "usage", F.col("n"))
    return counted.select("user_id", F.get_json_object(meta, "$.usage").cast("long").alias("k"), "had")


@query("SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id, 'affects' AS relation FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def guarded_edges(t):
    proposed = t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("affects").alias("relation"))
    return knowledge.guarded_edges(proposed, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("SELECT doc_id AS id, length(text)::INT AS size, doc_id IN (SELECT doc_id FROM labels) AS matched FROM documents")
def body_migration(t):
    found = knowledge.migrated(t.labels.select(F.col("doc_id").alias("id")), t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return found.select("id", F.length("body").alias("size"), "matched")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_brand || '/x' ELSE NULL END AS label FROM part")
def project_labels(t):
    k, b = F.col("p_partkey") % 4, F.col("p_brand")
    raw = F.when(k == 0, F.concat(F.lit(" ././projects/"), b, F.lit("/"))).when(k == 1, F.concat(F.lit("/"), b)).when(k == 2, F.concat(F.lit("projects/"), b, F.lit("/x"))).otherwise(" ")
    return t.part.select("p_partkey", knowledge.project_label(raw).alias("label"))


@query(f"WITH {NODES} SELECT id, target FROM nodes WHERE status = 'active' AND contains(lower(project), 'f') ORDER BY id")
def active_of_project(t):
    return t.nodes().where((F.col("status") == "active") & F.lower("project").contains("f")).select("id", "target").orderBy("id")


@query(f"WITH {NODES} SELECT id, status FROM nodes WHERE contains(target, 'the') OR node_type = 'source_03' OR list_contains(regexp_extract_all(summary, '[Ll]icen[cs]e'), 'license')")
def related_by_any(t):
    refs = F.regexp_extract_all("summary", F.lit("[Ll]icen[cs]e"), F.lit(0))
    return t.nodes().where(F.col("target").contains("the") | (F.col("node_type") == "source_03") | F.array_contains(refs, "license")).select("id", "status")


@query(f"WITH {NODES} SELECT id FROM nodes WHERE (project = 'de' OR contains(summary, 'mit')) AND status = 'active'")
def impacts_active(t):
    return t.nodes().where(((F.col("project") == "de") | F.col("summary").contains("mit")) & (F.col("status") == "active")).select("id")


@query("SELECT l_suppkey AS from_id, l_partkey AS to_id, l_returnflag AS relation_type FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey = 7 ORDER BY 1, 3, 2")
def relations_by_any(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation_type"))
    return rows.where(search.optional(from_id=7, to_id=None, relation_type="N")).orderBy("from_id", "relation_type", "to_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'open' END AS status FROM orders WHERE o_orderstatus IN ('P', 'O')")
def pending_actions(t):
    return t.orders.where("o_orderstatus in ('P', 'O')").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("open").alias("status"))


@query("SELECT page_id, word, n FROM (SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '[a-z0-9]+')) AS word FROM pages) GROUP BY ALL)")
def text_index(t):
    """The postings of a text index, rebuilt."""
    return search.postings(t.pages, "page_id", "html").select("page_id", F.col("term").alias("word"), F.col("tf").alias("n"))


PHRASES = ("er th", "on")


@query(f"""WITH c AS (SELECT doc_id, greatest(length(x) - 2, 0) AS n, {', '.join(f"(length(x) - length(replace(x, '{q}', ''))) / {len(q)} AS tf{k}" for k, q in enumerate(PHRASES))} FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in range(2))} FROM c)
    SELECT doc_id, round({' + '.join(f'greatest(ln((docs - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * n / mean))' for k in range(2))}, 6) AS score FROM c, s WHERE tf0 > 0 AND tf1 > 0""")
def trigram_search(t):
    """Phrases in any script, scored; the command's top-k is ``search.top_k``."""
    return search.phrase_bm25(t.documents, "doc_id", "text", PHRASES).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT DISTINCT p_name AS x FROM part), q AS (SELECT DISTINCT p_name || ' of ' || p_type AS y FROM part),
    s AS (SELECT x, y, list_filter(regexp_extract_all(lower(x), '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'and', 'for', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'with')) AS a, list_filter(regexp_extract_all(lower(y), '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'and', 'for', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'with')) AS b FROM p, q),
    j AS (SELECT x, y, len(list_intersect(a, b)) AS k, len(list_distinct(a)) + len(list_distinct(b)) - len(list_intersect(a, b)) AS u, contains(lower(y), lower(x)) OR contains(lower(x), lower(y)) AS inside FROM s)
    SELECT x, y, round_even(greatest(k / u::DOUBLE, CASE WHEN inside THEN 0.6 ELSE 0 END), 4) AS score FROM j WHERE k > 0 AND greatest(k / u::DOUBLE, CASE WHEN inside THEN 0.6 ELSE 0 END) >= 0.4""")
def conflict_floor(t):
    """Token Jaccard with the floor of 0.6 where one text contains the other."""
    one = t.part.select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    name = F.concat("p_name", F.lit(" of "), "p_type")
    found = conflicts.conflicts(one, t.part.select(name.alias("id"), name.alias("text")).distinct(), 0.4)
    return found.select(F.col("left_id").alias("x"), F.col("right_id").alias("y"), F.bround("score", 4).alias("score"))


@query("SELECT n_nationkey, n_name, r_name AS label FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def edge_labels(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.col("r_name").alias("label"))


@query("SELECT s_suppkey, count(DISTINCT l_orderkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey OR l_partkey = s_suppkey GROUP BY s_suppkey")
def or_join_sources(t):
    """A join on either of two columns as two equi joins."""
    legs = [t.lineitem.select(F.col(c).alias("s_suppkey"), "l_orderkey") for c in ("l_suppkey", "l_partkey")]
    met = legs[0].union(legs[1]).distinct().join(t.supplier.select("s_suppkey"), "s_suppkey", "left_semi")
    return met.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment <> 'BUILDING'")
def superseded_but_active(t):
    """Targets of a superseding edge whose status says otherwise."""
    edges = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_mktsegment <> 'BUILDING'").join(edges, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+:[A-Za-z0-9/]+')) AS full_ref, split_part(full_ref, ':', 1) AS ref FROM documents) WHERE ref NOT IN ('http', 'https')")
def missing_references(t):
    """Names before a colon that no registry knows."""
    refs = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+:[A-Za-z0-9/]+"), F.lit(0))).alias("r")).select("doc_id", F.substring_index("r", ":", 1).alias("ref")).distinct()
    known = t.spark.createDataFrame([("http",), ("https",)], "ref string")
    return refs.join(F.broadcast(known), "ref", "left_anti").select("doc_id", "ref")


@query("SELECT DISTINCT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE c_mktsegment = 'MACHINERY' OR o_orderstatus = 'P'")
def learning_of_project(t):
    refs = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    met = t.customer.join(refs, "c_custkey", "left").where("c_mktsegment = 'MACHINERY' or o_orderstatus = 'P'")
    return met.select("c_custkey", "c_name").distinct()


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def part_list_details(t):
    details = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    return t.orders.join(details, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT 'source' AS problem, l_suppkey AS key FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3) UNION SELECT 'target', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL') UNION SELECT 'repeated', l_suppkey FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey HAVING count(*) > 1)")
def referential_integrity(t):
    """Ends that no table has, and relations stated twice."""
    edges = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey")
    source = edges.join(t.supplier.where("s_nationkey <> 3"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select(F.lit("source").alias("problem"), F.col("l_suppkey").alias("key"))
    target = edges.join(t.part.where("p_type <> 'SMALL'"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("target").alias("problem"), F.col("l_partkey").alias("key"))
    twice = edges.groupBy("l_suppkey", "l_partkey", "l_orderkey").count().where("count > 1").select(F.lit("repeated").alias("problem"), F.col("l_suppkey").alias("key"))
    return source.union(target).union(twice).distinct()


@query("""WITH r AS (SELECT p_type AS id, CASE WHEN p_size > 48 THEN 'workflow' WHEN p_size > 45 AND p_type <> 'SMALL' THEN 'command' END AS kind, p_brand AS source FROM part)
    SELECT n_name AS id, CASE WHEN count(*) FILTER (WHERE kind = 'workflow') > 0 THEN 'workflow' WHEN count(*) FILTER (WHERE kind = 'command') > 0 THEN 'command' ELSE 'orphan' END AS activation,
    count(DISTINCT source) FILTER (WHERE kind = 'workflow')::INT AS n FROM (SELECT n_name FROM nation UNION SELECT DISTINCT p_type FROM part) LEFT JOIN r ON r.id = n_name GROUP BY n_name""")
def activation_status(t):
    entries = t.nation.select(F.col("n_name").alias("id")).union(t.part.select("p_type")).distinct()
    kind = F.when(F.col("p_size") > 48, "workflow").when((F.col("p_size") > 45) & (F.col("p_type") != "SMALL"), "command")
    found = knowledge.with_references(entries, t.part.select(F.col("p_type").alias("id"), kind.alias("kind"), F.col("p_brand").alias("source")))
    return found.select("id", "activation", F.coalesce(F.size("workflow_refs"), F.lit(0)).alias("n"))


@query("SELECT p_name AS path, CASE WHEN p_name = 'red bolt' THEN 'exact' WHEN p_name LIKE 'red%' THEN 'reds' WHEN contains(p_name, 'ring') THEN 'rings' END AS owner FROM (SELECT DISTINCT p_name FROM part)")
def manifest_defaults(t):
    exact = t.spark.createDataFrame([("red bolt", "exact")], "path string, owner string")
    return knowledge.manifest_entry(t.part.select(F.col("p_name").alias("path")).distinct(), F.broadcast(exact), [("^red", "reds"), ("ring", "rings")])


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\w-])and($|[^\w-])')")
def exact_tokens(t):
    return t.documents.where(knowledge.exact_token(F.col("text"), "and")).select("doc_id")


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'secret') OR contains(lower(text), 'password') AS related FROM documents")
def capability_related(t):
    return t.documents.select("doc_id", knowledge.mentions_any(F.col("text"), ["License", "secret", "password"]).alias("related"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'approved' WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'proposed' END AS status FROM orders")
def review_decisions(t):
    """Approvals without evidence and impact leave a review as it is."""
    reviews = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("proposed").alias("status"))
    said = t.orders.where("o_orderpriority in ('1-URGENT', '5-LOW')").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("approve"), F.when(F.col("o_totalprice") > 100000, "seen").otherwise(" ").alias("evidence"), F.lit("large").alias("impact"),
    )
    return knowledge.reviewed(reviews, said)


@query("""WITH a AS (SELECT user_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'purchase' AND value <= 80 AS good FROM events),
    f AS (SELECT node, min(seq) FILTER (WHERE good) AS first_ok, count(*) AS n FROM a GROUP BY node)
    SELECT node, coalesce(first_ok, n)::INT AS tries, CASE WHEN first_ok IS NOT NULL THEN 'done' WHEN n >= 3 THEN 'failed' ELSE 'retry' END AS state FROM f""")
def attempt_states(t):
    """Attempts of a node until the first success within its time limit."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    made = t.events.select(F.col("user_id").alias("node"), seq.alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("value").alias("seconds"), F.lit(80.0).alias("limit"))
    return knowledge.attempts(made).select("node", "tries", "state")


@query("SELECT user_id, max(ts) > (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS recent FROM events GROUP BY user_id")
def recent_work(t):
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(now)).select("user_id", (F.col("last") > F.col("now") - F.expr("interval 2 days")).alias("recent"))


@query("SELECT conv_id, count(*) AS reads, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id")
def read_counters(t):
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("reads"), F.min("turn").alias("first"))


@query("SELECT p_partkey, '{\"p_name\":\"' || p_name || '\",\"p_size\":\"' || p_size || '\"}' AS shown FROM part")
def shown_rows(t):
    return t.part.withColumn("none", F.lit(None).cast("string")).select("p_partkey", knowledge.row_json("p_name", "none", "p_size").alias("shown"))


@query("SELECT max(doc_id) + 1 AS next, printf('D-%03d', (max(doc_id) + 1)::INT) AS id FROM documents")
def next_ids(t):
    return tables.next_id(t.documents, F.format_string("D-%03d", "doc_id"), "D")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem), r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.v, depth + 1 FROM r JOIN e ON e.u = r.node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node ORDER BY depth, node")
def importer_closure(t):
    """Everything that imports a module, directly or not, with its depth."""
    edges = t.lineitem.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()
    return graph.depths(edges, t.spark.range(1, 2).select(F.col("id").alias("node")), 3).orderBy("depth", "node")


@query("""WITH d AS (SELECT o_custkey AS id, bool_and(o_orderstatus <> 'P') AS done FROM orders GROUP BY 1) SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND coalesce((SELECT done FROM d WHERE d.id = c_custkey), true)""")
def ready_nodes(t):
    """Pending entries all of whose dependencies are completed."""
    own = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_custkey", F.when(F.col("c_acctbal") < 0, "pending").otherwise("draft").alias("status"))
    needs = t.orders.groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("O"), "o_orderkey")).alias("depends_on"))
    nodes = own.join(needs, F.col("c_custkey") == F.col("o_custkey"), "left").select("id", "status", "depends_on")
    orders = t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.lit(None).cast("array<string>").alias("depends_on"))
    return graph.ready(nodes.union(orders)).select(F.substring("id", 2, 20).cast("long").alias("id"))


@query("SELECT doc_id, list_reduce(list_prepend('', list_filter(string_split(text, chr(10)), lambda l: l <> '')), lambda a, b: b) AS last_line, len(string_split(text, chr(10)))::INT AS n FROM documents WHERE text <> ''")
def last_lines(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t.documents.where("text <> ''").select("doc_id", F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")).alias("last_line"), F.size(F.split("text", "\n")).alias("n"))


@query("SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda w: lower(w))).list_sort() AS names FROM documents")
def distinct_mentions(t):
    found = F.transform(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), F.lower)
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(found)).alias("names"))


@query("SELECT page_id, tag, n FROM (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL) ORDER BY 1, 2")
def page_tags(t):
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n")).orderBy("page_id", "tag")


@query(r"SELECT doc_id, 'B' || i AS id, trim(regexp_replace(l, '^[ :-]*', '')) AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def text_blocks(t):
    """Lines as the headings of blocks, read as a block log is."""
    files = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("### B"), i, F.lit(" "), x)), "\n").alias("text"))
    return logs.blocks(files, r"B\d+", keep=("doc_id",)).select("doc_id", "id", "title")
