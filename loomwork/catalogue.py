"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import parsing, text
from loomwork.operators import graph, search, tables
from loomwork.sources.logs import page_links, referenced
from loomwork.registry import NODES, ORACLES, QUERIES, query
from loomwork.streaming import events as stream

FLAGSHIP = "hybrid_rrf"


# Filters and keyword searches


@query(f"WITH {NODES} SELECT node_type, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS n_active, max(id) AS newest FROM nodes GROUP BY node_type")
def catalog_by_type(t):
    return t.nodes().groupBy("node_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("n_active"), F.max("id").alias("newest"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_name ILIKE '%econ%' OR p_type ILIKE '%econ%'")
def keyword_search_ordered(t):
    return t.part.where(search.any_like(["p_name", "p_type"], ["ring", "econ"])).select("p_partkey", "p_name", "p_type").orderBy("p_partkey")


@query("""
    SELECT * FROM (SELECT 'part' AS table_name, p_partkey::VARCHAR AS id, substr(p_name, 1, 60) AS hit FROM part WHERE p_name ILIKE '%gear%' ORDER BY id, hit LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'customer', c_custkey::VARCHAR AS id, substr(c_mktsegment, 1, 60) AS hit FROM customer WHERE c_mktsegment ILIKE '%gear%' OR c_mktsegment ILIKE '%mach%' ORDER BY id, hit LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'conversations', conv_id::VARCHAR AS id, substr(text, 1, 60) AS hit FROM conversations WHERE text ILIKE '%gear%' OR text ILIKE '%mach%' ORDER BY id, hit LIMIT 30)""")
def cross_table_keyword(t):
    found = {"part": (t.part, "p_partkey", ["p_name"]), "customer": (t.customer, "c_custkey", ["c_mktsegment"]), "conversations": (t.conversations, "conv_id", ["text"])}
    return search.cross_table(found, ["gear", "mach"])


@query(f"WITH {NODES} SELECT id, status FROM nodes WHERE project = 'fr' OR contains(summary, 'fr') OR contains(summary, 'the and')")
def project_scope(t):
    return t.nodes().where(search.in_scope("fr", affects="summary") | F.col("summary").contains("the and")).select("id", "status")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k')::INT < 20")
def expired_ttl(t):
    return t.events.where((F.col("event_type") == "click") & (F.get_json_object("props", "$.k").try_cast("int") < 20)).select("event_id", "user_id")


@query("SELECT s_suppkey, p_partkey, n_name, p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) r JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = s_nationkey WHERE p_brand = 'Brand#3'")
def two_sided_relation_join(t):
    joined = t.relations().join(t.part.where("p_brand = 'Brand#3'"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "p_partkey", "n_name", "p_name")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment ILIKE '%build%' AND o_orderpriority = '1-URGENT'")
def param_doc_join(t):
    orders = t.orders.where("o_orderpriority = '1-URGENT'")
    return t.customer.where(search.any_like(["c_mktsegment"], ["build"])).join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


# Joins, set operations and aggregates


@query("SELECT p_partkey, count(*) AS degree FROM part JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON p_partkey = l_partkey WHERE p_name ILIKE '%ring%' GROUP BY 1 ORDER BY degree DESC, p_partkey LIMIT 20")
def entity_degree_top20(t):
    parts = t.part.where(search.any_like(["p_name"], ["ring"]))
    joined = parts.join(t.relations(), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_partkey").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "p_partkey").limit(20)


@query("SELECT n_name, p_type, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def graph_stats(t):
    stations = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return t.relations().join(stations, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("n_name", "p_type").agg(F.count("*").alias("n"))


STATION = "SELECT DISTINCT p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = "


@query(f"WITH a AS ({STATION} 1), b AS ({STATION} 2) SELECT coalesce(a.p_name, b.p_name) AS p_name, a.p_name IS NOT NULL AS first, b.p_name IS NOT NULL AS second FROM a FULL JOIN b ON a.p_name = b.p_name")
def station_compare(t):
    stations = t.supplier.where("s_nationkey in (1, 2)").select("s_suppkey", "s_nationkey")
    names = t.lineitem.join(stations, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return names.groupBy("p_name").agg(F.bool_or(F.col("s_nationkey") == 1).alias("first"), F.bool_or(F.col("s_nationkey") == 2).alias("second"))


@query("SELECT p_partkey, p_type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND l_returnflag = 'R')")
def coverage_gaps(t):
    covered = t.lineitem.where("l_returnflag = 'R'").join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return t.part.join(covered, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_type")


@query("SELECT DISTINCT 'out' AS direction, l_partkey AS other FROM lineitem WHERE l_suppkey = 5 UNION ALL SELECT DISTINCT 'in', l_suppkey FROM lineitem WHERE l_partkey = 5")
def related_in_out(t):
    out = t.lineitem.where("l_suppkey = 5").select(F.lit("out").alias("direction"), F.col("l_partkey").alias("other")).distinct()
    return out.unionByName(t.lineitem.where("l_partkey = 5").select(F.lit("in").alias("direction"), F.col("l_suppkey").alias("other")).distinct())


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def orphan_nodes(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def not_in_null_aware(t):
    """NOT IN as SQL means it: nothing if the list has a null, and a null key only against an empty list."""
    return tables.not_in(t.customer, "c_nationkey", t.supplier.where("s_acctbal > 9000"), "s_nationkey").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders a WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate)")
def superseded_without_successor(t):
    newest = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    return t.orders.where("o_orderstatus = 'P'").join(newest, "o_custkey").where("o_orderdate = newest").select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_brand, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_name, p_brand HAVING count(*) > 1")
def duplicate_targets(t):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return t.part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


@query(f"""WITH {NODES}, e AS (SELECT DISTINCT label::VARCHAR AS v, vec_id FROM embeddings)
    SELECT status, count(*) AS n, count(vec_id) AS embedded FROM nodes LEFT JOIN e ON vec_id = id GROUP BY status""")
def embedding_coverage(t):
    own = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(1).alias("e")).distinct()
    return t.nodes().join(own, "id", "left").groupBy("status").agg(F.count("*").alias("n"), F.count("e").alias("embedded"))


@query("""WITH m AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, bool_or(o_orderstatus = 'P') AS pending, bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1)
    SELECT urgent, pending, large, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM m WHERE urgent OR pending OR large GROUP BY ALL""")
def venn_three_sets(t):
    flags = {"urgent": F.col("o_orderpriority") == "1-URGENT", "pending": F.col("o_orderstatus") == "P", "large": F.col("o_totalprice") > 300000}
    member = t.orders.groupBy("o_custkey").agg(*[F.bool_or(v).alias(k) for k, v in flags.items()]).where("urgent or pending or large")
    counted = member.groupBy(*flags).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # seven rows at most
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / total, 4))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id HAVING count(*) >= 3")
def usage_counts_threshold(t):
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT l_suppkey, l_returnflag, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY ALL")
def lot_minmax_merge(t):
    """Statistics of each part file, then those of the lot: least of the least, most of the most."""
    part = F.least("l_linenumber", F.lit(3)).alias("part")
    each = t.lineitem.groupBy("l_suppkey", "l_returnflag", part).agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.count("*").alias("c"))
    return each.groupBy("l_suppkey", "l_returnflag").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.sum("c").alias("n"))


@query("SELECT l_orderkey, l_linenumber, item, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR item IN (l_quantity, l_extendedprice, l_discount, l_tax))")
def measurements_long(t):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], names, "item", "value").where("value is not null")


@query("SELECT p_brand, 'p_size' AS spec, coalesce(max(p_size) FILTER (WHERE p_type = 'ECONOMY')::VARCHAR, '-') AS economy, coalesce(max(p_size) FILTER (WHERE p_type = 'SMALL')::VARCHAR, '-') AS small FROM part GROUP BY p_brand")
def spec_matrix(t):
    wide = t.part.groupBy("p_brand").pivot("p_type", ["ECONOMY", "SMALL"]).agg(F.max("p_size").cast("string"))
    return wide.na.fill("-").select("p_brand", F.lit("p_size").alias("spec"), F.col("ECONOMY").alias("economy"), F.col("SMALL").alias("small"))


# Windows, order and gaps


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END, o_orderkey) AS turn FROM orders WHERE o_orderstatus = 'P' ORDER BY turn LIMIT 200")
def backlog_priority_list(t):
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(9), F.col("o_orderkey")]
    first = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority").orderBy(*order).limit(200)
    return first.withColumn("turn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders), a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, date_diff('microsecond', o_orderdate, now) / 86400000000.0 AS age FROM orders, n)
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'slow' END AS reason FROM a
    WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') OR (o_orderstatus = 'P' AND age > 3) OR (o_orderstatus = 'O' AND age > 7)""")
def backlog_reminders(t):
    now = t.orders.agg(F.max("o_orderdate").alias("now"))  # one row
    age = text.age_days(F.col("o_orderdate"), F.col("now"))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    blocked, slow = (F.col("o_orderstatus") == "P") & (age > 3), (F.col("o_orderstatus") == "O") & (age > 7)
    return t.orders.crossJoin(F.broadcast(now)).select("o_orderkey", F.when(urgent, "open").when(blocked, "blocked").when(slow, "slow").alias("reason")).where("reason is not null")


@query("SELECT event_id, user_id, from_status, event_type AS to_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events) WHERE from_status <> event_type")
def status_transitions(t):
    return tables.transitions(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "from_status", "to_status")


@query("""WITH l AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'failed' WHEN 'click' THEN 'overlap' WHEN 'error' THEN 'in_progress' WHEN 'signup' THEN 'proposed' ELSE 'accepted' END AS result,
          date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 86400000000.0 AS age FROM l)
    SELECT user_id, result, CASE result WHEN 'proposed' THEN true WHEN 'failed' THEN age < 30 WHEN 'overlap' THEN age < 7 WHEN 'in_progress' THEN age < 1 ELSE false END AS waits FROM r""")
def cooldown_filter(t):
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    last = tables.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).crossJoin(F.broadcast(now))
    kind = F.col("event_type")
    result = F.when(kind == "view", "failed").when(kind == "click", "overlap").when(kind == "error", "in_progress").when(kind == "signup", "proposed").otherwise("accepted")
    return last.select("user_id", result.alias("result"), tables.cooling(result, text.age_days(F.col("ts"), F.col("now"))).alias("waits"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_row_per_key(t):
    """Of rows that the SQL's order leaves equal, that of the least quantity."""
    return tables.latest(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")])


@query("SELECT o_custkey, a AS after, b AS before, b - a - 1 AS n FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b - a > 1")
def sequence_gaps(t):
    return tables.gaps(t.orders, ["o_custkey"], "o_orderkey")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), r AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS run FROM d)
    SELECT l_suppkey, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM r GROUP BY l_suppkey, run""")
def gap_islands(t):
    return tables.islands(t.lineitem, ["l_suppkey"], "l_orderkey")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), r AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS run FROM d),
    p AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey, run ORDER BY l_orderkey) - 1) // 2 AS piece FROM r)
    SELECT l_suppkey, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM p GROUP BY l_suppkey, run, piece""")
def consecutive_runs(t):
    return tables.islands(t.lineitem, ["l_suppkey"], "l_orderkey", longest=2)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def page_carry_forward(t):
    asked = t.conversations.withColumn("_asked", F.when(F.col("role") == "user", F.col("turn")))
    return asked.select("conv_id", "turn", tables.carried("_asked", ["conv_id"], ["turn"]).alias("asked_at"))


@query("SELECT conv_id, turn, length(text)::BIGINT AS size FROM conversations QUALIFY sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 1200")
def char_budget_cut(t):
    sized = t.conversations.withColumn("size", F.length("text").cast("long"))
    return sized.withColumn("fits", tables.within_budget(F.col("size") + 1, ["conv_id"], ["turn"], 1200)).where("fits").select("conv_id", "turn", "size")


# Quality checks


@query("SELECT column_name, null_rate, null_rate > 0.05 AS flagged FROM (SELECT avg((d.text IS NULL)::INT) AS text, avg((quality IS NULL)::INT) AS quality, avg((toxic IS NULL)::INT) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)) UNPIVOT (null_rate FOR column_name IN (text, quality, toxic))")
def null_rate(t):
    return tables.null_rates(t.documents.join(t.labels, "doc_id", "left").select("text", "quality", "toxic"))


@query("SELECT p_name, p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def full_row_duplicates(t):
    return tables.duplicates(t.part.select("p_name", "p_brand", "p_type"))


@query("""SELECT 'l_returnflag' AS column_name, min(l_returnflag) AS least, max(l_returnflag) AS most, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_linenumber', min(l_linenumber)::VARCHAR, max(l_linenumber)::VARCHAR, count(DISTINCT l_linenumber) FROM lineitem
    UNION ALL SELECT 'l_suppkey', min(l_suppkey)::VARCHAR, max(l_suppkey)::VARCHAR, count(DISTINCT l_suppkey) FROM lineitem""")
def value_domain(t):
    return tables.domains(t.lineitem, ["l_returnflag", "l_linenumber", "l_suppkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'red%' OR p_name ILIKE 'hot%'")
def exclusion_violations(t):
    return t.part.where(tables.excluded_by("p_name", ["red", "hot"]).isNotNull()).select("p_partkey", "p_name")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_name ILIKE 'red%' THEN 'red' WHEN p_name ILIKE 'hot%' THEN 'hot' END AS rule FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY p_partkey) AS k FROM e WHERE rule IS NOT NULL)
    SELECT rule, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (WHERE k <= 5) AS sample FROM r GROUP BY rule""")
def exclusion_summary(t):
    return tables.exclusion_summary(t.part, "p_partkey", tables.excluded_by("p_name", ["red", "hot"]))


@query("""SELECT 'ERROR' AS severity, 'orphan' AS "check", c_custkey::VARCHAR AS key, 'no finished order' AS message FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    UNION ALL SELECT 'WARN', 'duplicate', p_name || '/' || p_brand, count(*)::VARCHAR || ' rows' FROM part GROUP BY p_name, p_brand HAVING count(*) > 1
    UNION ALL SELECT 'WARN', 'stale', min(o_orderkey)::VARCHAR, 'oldest pending' FROM orders WHERE o_orderstatus = 'P'""")
def audit_issues(t):
    dup = t.part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n > 1")
    stale = t.orders.where("o_orderstatus = 'P'").agg(F.min("o_orderkey").alias("k"))
    return tables.audit(
        tables.issues(orphan_nodes(t), "ERROR", "orphan", F.col("c_custkey"), "no finished order"),
        tables.issues(dup, "WARN", "duplicate", F.concat_ws("/", "p_name", "p_brand"), F.concat(F.col("n").cast("string"), F.lit(" rows"))),
        tables.issues(stale, "WARN", "stale", F.col("k"), "oldest pending"),
    )


@query(f"SELECT coalesce(max(CASE severity WHEN 'ERROR' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END), 0)::INT AS exit_code FROM ({ORACLES['audit_issues']})")
def audit_exit_code(t):
    return tables.exit_code(audit_issues(t))


# Text, codes and descriptions

RULES = [("legal", "licen[cs]e|rights reserved"), ("table", r"\|"), ("shout", "[!%$#*]{3}"), ("number", "[0-9]{3}")]


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e|rights reserved') THEN 'legal' WHEN regexp_matches(text, '\|') THEN 'table' WHEN regexp_matches(text, '[!%$#*]{3}') THEN 'shout' WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' ELSE 'other' END AS content_type FROM documents")
def section_classification(t):
    return t.documents.select("doc_id", parsing.classify(F.col("text"), RULES, "other").alias("content_type"))


DIE = "CASE WHEN p_partkey % 4 = 0 THEN 'X/' || p_size || '/*' || (p_size + 2) || ' mil' WHEN p_partkey % 4 = 3 THEN 'X/' || (p_size + 10) || 'mil/Y' ELSE 'X' END"
RAW = "CASE WHEN p_partkey % 4 = 1 THEN p_size || ' x ' || (p_size + 1) WHEN p_partkey % 4 = 2 THEN ' ' || p_size || '.5 ' ELSE '-' END"


@query("""SELECT p_partkey, w AS width, l AS length, round(sqrt(w * w + l * l), 4) AS diagonal, p_size::DOUBLE AS thickness FROM (SELECT p_partkey, p_size,
    CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 ELSE p_size + 10 END::DOUBLE AS w,
    CASE p_partkey % 4 WHEN 0 THEN p_size + 2 WHEN 1 THEN p_size + 1 WHEN 2 THEN p_size + 0.5 ELSE p_size + 10 END::DOUBLE AS l FROM part)""")
def die_geometry(t):
    made = t.part.select("p_partkey", F.expr(DIE).alias("d"), F.expr(RAW).alias("r"), F.concat(F.lit("t="), "p_size", F.lit("um")).alias("t"))
    return made.select("p_partkey", parsing.die_geometry(F.col("d"), F.col("r"), F.col("t")).alias("g")).select("p_partkey", "g.*")


@query("""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'WIRE' ELSE 'CLIP' END AS kind, CASE WHEN p_type = 'SMALL' THEN p_size::VARCHAR ELSE '' END AS diameter,
    split_part(p_name, ' ', 1) AS metal, p_brand AS vendor, p_type <> 'SMALL' AS is_clip FROM part""")
def desc_struct(t):
    made = F.concat_ws("/", F.when(F.col("p_type") == "SMALL", "WIRE").otherwise("CLIP"), F.concat("p_size", F.lit(" mil")), F.substring_index("p_name", " ", 1), "p_brand")
    return t.part.select("p_partkey", parsing.wire_description(made).alias("w")).select("p_partkey", "w.*")


@query("""SELECT p_partkey, true AS success, 'package ' || split_part(p_name, ' ', 1)[1] AS package, CASE WHEN p_size < 25 THEN 'thin' ELSE 'UNKNOWN: B' END AS wire, CASE WHEN p_size < 25 THEN 5 ELSE 6 END - 1 AS n_errors FROM part""")
def code_parse(t):
    letter = F.upper(F.substring("p_name", 1, 1))
    code = F.concat_ws("-", F.concat(letter, F.lit("00000")), F.when(F.col("p_size") < 25, "a").otherwise("B"), F.lit("D1"), F.lit("L1"), F.lit("C001"), F.lit("v"))
    known = {f"{x}00000": f"package {x.lower()}" for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    parsed = parsing.six_segments(code, {"package": known, "wire": {"A": "thin"}})
    return t.part.select("p_partkey", parsed.alias("c")).select("p_partkey", "c.success", "c.package", "c.wire", F.size("c.errors").alias("n_errors"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 25 THEN 'medium' ELSE 'low' END AS label FROM part""")
def confidence_labels(t):
    return t.part.select("p_partkey", parsing.confidence_label((F.col("p_size") / 50).cast("string")).alias("label"))


@query("SELECT l_orderkey AS item, l_partkey AS sub, 'A' AS layer FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name LIKE 'red%' UNION ALL SELECT l_orderkey, l_partkey, 'B' FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL' AND p_size > 40")
def dual_layer_union(t):
    """Rows of either layer from one scan; a row of both comes twice."""
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    layers = F.array_compact(F.array(F.when(F.col("p_name").like("red%"), "A"), F.when((F.col("p_type") == "SMALL") & (F.col("p_size") > 40), "B")))
    return joined.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("sub"), F.explode(layers).alias("layer"))


@query("""WITH r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), m AS (SELECT a, b, unnest(generate_series(date_trunc('month', a), b - INTERVAL 1 DAY, INTERVAL 1 MONTH))::DATE AS s FROM r)
    SELECT greatest(s, a) AS start, least(last_day(s), (b - INTERVAL 1 DAY)::DATE) AS "end" FROM m""")
def date_chunks(t):
    span = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select(F.inline(text.date_chunks(F.col("a"), F.col("b"), None)))


@query("SELECT page_id, href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def references_from_html(t):
    return page_links(t.pages, "page_id", "html")


@query("SELECT l_orderkey AS source_id, unnest(list(DISTINCT l_partkey)) AS target_id, 'uses' AS relation FROM lineitem GROUP BY l_orderkey")
def json_array_edges(t):
    refs = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("refs"))
    return refs.select(F.col("l_orderkey").alias("source_id"), F.explode(F.from_json("refs", "array<bigint>")).alias("target_id"), F.lit("uses").alias("relation")).dropDuplicates()


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(t):
    """The first half of the log as a table, into which the second is merged."""
    half = t.events.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    order = [F.desc("ts"), F.desc("event_id")]
    old, new = (tables.latest(t.events.where(p), ["user_id"], order) for p in (F.col("event_id") <= half, F.col("event_id") > half))
    newest = tables.latest(old.unionByName(new), ["user_id"], order)
    return tables.upsert(old, newest, ["user_id"]).select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 5 AS page, p_partkey % 97 AS x0, p_partkey % 89 AS y0, p_partkey % 97 + 1 + p_size % 7 AS x1, p_partkey % 89 + 2 AS y1 FROM part)
    SELECT a.id AS a, b.id AS b, ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS area FROM r a JOIN r b ON a.page = b.page AND a.id < b.id
    WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def rectangle_overlaps(t):
    key = F.col("p_partkey")
    x, y = (key % 97).cast("double"), (key % 89).cast("double")
    rects = t.part.select(key.alias("id"), (F.col("p_size") % 5).alias("page"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("p_size") % 7).alias("x1"), (y + 2).alias("y1"))
    return tables.overlapping(rects, cell=8.0)


# Retrieval


COSINE = "list_cosine_similarity(a.embedding, b.embedding)"


@query("SELECT query, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10")
def cosine_topk(t):
    found = search.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", k=10)
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT a.vec_id AS query, b.vec_id, CASE WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4 THEN 'write' ELSE 'review' END AS action FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def cosine_threshold_pairs(t):
    found = search.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", least=0.3)
    return found.select("query", "vec_id", F.when(F.col("similarity") >= 0.4, "write").otherwise("review").alias("action"))


TOKENS = """list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'and', 'for', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'with')))"""


@query(f"""WITH b AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
    s AS (SELECT item_id, doc_id, len(list_intersect(b.t, d.t)) AS k, len(b.t) + len(d.t) AS n FROM b, d)
    SELECT item_id, doc_id, round_even(k / (n - k)::DOUBLE, 4) AS score FROM s WHERE k / (n - k)::DOUBLE >= 0.12""")
def jaccard_conflict(t):
    left = t.benchmark.select(F.col("item_id").alias("id"), "text")
    right = t.documents.select(F.col("doc_id").alias("id"), "text")
    found = search.similar_to_items(left, right, 0.12)
    return found.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), F.bround("score", 4).alias("score"))


@query(f"""WITH b AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS n FROM b a JOIN b ON a.item_id < b.item_id)
    SELECT a, b FROM s WHERE k / (n - k)::DOUBLE >= 0.08 AND (a + b) % 7 <> 0""")
def fuzzy_pairs_suppressed(t):
    """Pairs of alike items without those that an edge, either way round, marks as known."""
    items = t.benchmark.select(F.col("item_id").alias("id"), "text")
    found = search.similar_pairs(items, items, 0.08, ordered=True).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    known = t.benchmark.select(F.col("item_id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("r")).where("(x + r) % 7 = 0")
    marked = found.join(known.select(F.col("x").alias("a"), "r"), "a").where("b % 7 = r").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return search.unmarked(found, marked)


TERMS = ("the", "ing", "tion")
BM25 = f"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
    c AS (SELECT doc_id, len(ws) AS n, {', '.join(f"len(list_filter(ws, lambda x: x = '{q}')) AS tf{k}" for k, q in enumerate(TERMS))} FROM w),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in range(3))} FROM c),
    bm AS (SELECT doc_id, {' + '.join(f'greatest(ln((docs - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * n / mean))' for k in range(3))} AS score FROM c, s WHERE {' AND '.join(f'tf{k} > 0' for k in range(3))})"""


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25_topk(t):
    scored = search.bm25(t.documents, "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))
    return search.top_k(scored, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    dense AS (SELECT vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, q WHERE vec_id <> 0),
    a AS (SELECT doc_id, row_number() OVER (ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM dense WHERE sim >= 0.0),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
    u AS (SELECT * FROM a WHERE rank <= 30 UNION ALL SELECT * FROM b WHERE rank <= 30)
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY doc_id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, doc_id LIMIT 10""")
def hybrid_rrf(t):
    """Dense and keyword legs of three times the wanted rows, fused by rank."""
    near = search.nearest(t.embeddings.where("vec_id = 0"), t.embeddings, "vec_id", "embedding", least=0.0)
    dense = search.top_k(near.select(F.col("vec_id").alias("doc_id"), F.round("similarity", 9).alias("score")), "doc_id", 30)
    sparse = search.top_k(search.bm25(t.documents, "doc_id", "text", TERMS).withColumn("score", F.round("score", 9)), "doc_id", 30)
    return search.fuse([dense, sparse], "doc_id", 10).select("doc_id", F.round("score", 9).alias("score"))


# Graph

SPARSE = """s AS (SELECT DISTINCT 'S:' || l_suppkey AS u, 'P:' || l_partkey AS v FROM lineitem ), e AS (SELECT u, v FROM s UNION ALL SELECT v, u FROM s)"""


def _walk(start: str, most: int) -> str:
    return f"r(node, depth) AS (SELECT {start}, 0 UNION SELECT e.v, depth + 1 FROM r JOIN e ON e.u = r.node WHERE depth < {most})"


@query(f"WITH RECURSIVE {SPARSE}, {_walk('(SELECT min(u) FROM s)', 4)} SELECT node, min(depth) AS depth FROM r GROUP BY node")
def bfs_depth(t):
    edges = t.edges()
    start = edges.where("u like 'S:%'").agg(F.min("u").alias("node"))
    return graph.depths(edges, start, 4)


@query(f"WITH RECURSIVE {SPARSE}, {_walk('(SELECT min(u) FROM s)', 6)} SELECT min(depth) AS hops FROM r WHERE node = (SELECT max(u) FROM s)")
def shortest_path_len(t):
    edges = t.edges()
    ends = edges.where("u like 'S:%'").agg(F.min("u"), F.max("u")).first()
    return graph.path_length(edges, ends[0], ends[1], 6)


@query(f"WITH RECURSIVE {SPARSE}, {_walk('(SELECT min(u) FROM s)', 2)} SELECT DISTINCT node FROM r JOIN part ON node = 'P:' || p_partkey WHERE p_type = 'SMALL'")
def typed_reach(t):
    edges = t.edges()
    near = graph.depths(edges, edges.where("u like 'S:%'").agg(F.min("u").alias("node")), 2)
    small = t.part.where("p_type = 'SMALL'").select(F.concat(F.lit("P:"), "p_partkey").alias("node"))
    return near.join(small, "node", "left_semi").select("node")


@query(f"WITH {SPARSE} SELECT u AS node, count(*) AS degree FROM e GROUP BY u")
def node_degrees(t):
    return graph.degrees(t.edges().where("u like 'S:%'"))


# Event log


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(t):
    return stream.window_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t):
    found = stream.sessions(t.events)
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# Maintenance: proposals, migrations, freshness, evidence


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS urgent FROM orders")
def backlog_summary(t):
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    return t.orders.agg(F.count_if(status == "O").alias("open"), F.count_if(status == "P").alias("pending"), F.count_if(status == "F").alias("finished"), F.count_if(urgent & (status != "F")).alias("urgent"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def bounded_history(t):
    turn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("turn", turn).where("turn <= 3").select("user_id", "event_id", "ts")


@query("SELECT o_orderkey, pinned FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0 AS pinned, o_orderdate FROM orders WHERE o_orderstatus = 'P') ORDER BY pinned DESC, CASE WHEN pinned THEN o_orderkey END, o_orderdate DESC, o_orderkey LIMIT 24")
def pinned_then_recent(t):
    pinned = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 50 == 0)
    rows = t.orders.where("o_orderstatus = 'P'").withColumn("pinned", pinned)
    return rows.orderBy(F.desc("pinned"), F.when(F.col("pinned"), F.col("o_orderkey")), F.desc("o_orderdate"), "o_orderkey").limit(24).select("o_orderkey", "pinned")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_linestatus = 'F')
    SELECT coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, CASE WHEN b.u IS NULL THEN 'stale' ELSE 'new' END AS action FROM a FULL JOIN b ON a.u = b.u AND a.v = b.v WHERE a.u IS NULL OR b.u IS NULL""")
def relation_sync(t):
    """Registered relations that are gone and discovered ones that are new, from one pass over both."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("old"), F.bool_or(F.col("l_linestatus") == "F").alias("new"))
    return rows.where("old <> new").select("u", "v", F.when(F.col("old"), "stale").otherwise("new").alias("action"))


@query("SELECT l_partkey AS id, l_suppkey AS other, CASE WHEN s >= 0.95 THEN 'approved' WHEN s >= 0.9 THEN 'review' ELSE 'rejected' END AS action FROM (SELECT l_partkey, l_suppkey, max(l_quantity) / 50.0 AS s FROM lineitem GROUP BY ALL)")
def review_proposals(t):
    score = t.lineitem.groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other")).agg((F.max("l_quantity") / 50.0).alias("s"))
    return score.select("id", "other", F.when(F.col("s") >= 0.95, "approved").when(F.col("s") >= 0.9, "review").otherwise("rejected").alias("action"))


@query("""WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part)
    SELECT DISTINCT l_suppkey AS source_id, coalesce(new, l_partkey) AS target_id FROM lineitem LEFT JOIN m ON l_partkey = old""")
def id_migration(t):
    """Edges re-pointed to the first of equal parts, then deduplicated."""
    mapped = t.part.select(F.col("p_partkey").alias("old"), F.min("p_partkey").over(W.partitionBy("p_name", "p_brand")).alias("new"))
    edges = t.lineitem.join(mapped, F.col("l_partkey") == F.col("old"), "left")
    return edges.select(F.col("l_suppkey").alias("source_id"), F.coalesce("new", "l_partkey").alias("target_id")).distinct()


@query(f"WITH {NODES} SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT id FROM nodes WHERE status = 'active')")
def active_embeddings(t):
    active = t.nodes().where("status = 'active'").select(F.col("id").alias("vec_id"))
    return t.embeddings.join(active, "vec_id", "left_semi").select("vec_id", "label")


@query("""WITH c AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.label <> b.label)
    SELECT query, vec_id FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) <= 8""")
def semantic_neighbours(t):
    """Nearest vectors that are not linked already; those of one label are."""
    return search.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", k=8, unless="label").select("query", "vec_id")


@query("SELECT conv_id, turn, substr(text, greatest(strpos(lower(text), 'the and') - 30, 1), 67) AS snippet FROM conversations WHERE contains(lower(text), 'the and')")
def phrase_snippets(t):
    at = F.locate("the and", F.lower("text"))
    return t.conversations.where(at > 0).select("conv_id", "turn", F.substring(F.col("text"), F.greatest(at - 30, F.lit(1)), F.lit(67)).alias("snippet"))


@query("SELECT doc_id, alias FROM (SELECT doc_id, lower(text) AS x FROM documents), (SELECT unnest(['apache', 'mit license', 'gnu', 'rights reserved']) AS alias) WHERE contains(x, alias)")
def alias_references(t):
    """Which of a short list of names each text contains; the list travels in the plan."""
    names = ("apache", "mit license", "gnu", "rights reserved")
    hits = F.array_compact(F.array(*[F.when(F.lower("text").contains(n), n) for n in names]))
    return t.documents.select("doc_id", F.explode(hits).alias("alias"))


@query("SELECT doc_id, i AS line, ref FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), LATERAL (SELECT unnest(regexp_extract_all(l, '[Ll]icen[cs]ed?')) AS ref)")
def line_references(t):
    return referenced(t.documents, "doc_id", "text", "[Ll]icen[cs]ed?")


@query("SELECT p_partkey, round(0.4 * p_size / 50 + 0.3 * (p_type = 'SMALL')::INT + 0.2 * (p_name ILIKE '%ring%')::INT + 0.1 * least(p_retailprice / 1000, 1), 6) AS score FROM part WHERE p_size >= 10")
def promotion_score(t):
    score = 0.4 * F.col("p_size") / 50 + 0.3 * (F.col("p_type") == "SMALL").cast("int") + 0.2 * F.col("p_name").ilike("%ring%").cast("int") + 0.1 * F.least(F.col("p_retailprice") / 1000, F.lit(1.0))
    return t.part.where("p_size >= 10").select("p_partkey", F.round(score, 6).alias("score"))


@query("""WITH i(item, pattern) AS (VALUES ('views', '^view$'), ('errors', 'err'), ('buys', 'purch|buy')) SELECT item, count(e.event_id) AS n FROM i LEFT JOIN events e ON regexp_matches(e.event_type, pattern) GROUP BY item""")
def checklist_evidence(t):
    """How many answers meet each item's evidence pattern."""
    items = {"views": "^view$", "errors": "err", "buys": "purch|buy"}
    counted = t.events.agg(*[F.count_if(F.col("event_type").rlike(p)).alias(k) for k, p in items.items()])
    return counted.unpivot([], list(items), "item", "n")


@query("SELECT n_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY n_name")
def related_sets(t):
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 200000")
def optional_parameters(t):
    """A parameterised statement of which one parameter is not given."""
    t.orders.createOrReplaceTempView("_lw_orders")
    sql = "SELECT o_orderkey, o_totalprice FROM _lw_orders WHERE (:status IS NULL OR o_orderstatus = :status) AND (:priority IS NULL OR o_orderpriority = :priority) AND o_totalprice >= :least"
    return t.spark.sql(sql, args={"status": "P", "priority": None, "least": 200000})


@query("SELECT lang AS project, round(100.0 * count(quality) / count(*), 4) AS labelled, sum((d.doc_id * 31 + n_chars) % 1000003)::BIGINT AS checksum FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def coverage_and_checksum(t):
    """Share of labelled rows, and a checksum that needs no order and gathers nothing."""
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    checksum = F.sum((F.col("doc_id") * 31 + F.col("n_chars")) % 1000003)
    return joined.groupBy(F.col("lang").alias("project")).agg(F.round(100.0 * F.count("quality") / F.count("*"), 4).alias("labelled"), checksum.alias("checksum"))


from loomwork import catalogue_checks, catalogue_entries, catalogue_knowledge, catalogue_materials, catalogue_retrieval, catalogue_texts  # noqa: E402, F401  they register their queries

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
