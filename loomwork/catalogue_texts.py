"""Queries over texts with structure (sections, front matter, answers, logs, imports) and the audits of tools and entries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwork.functions import encodings, parsing, text
from loomwork.operators import aliases, checks, entries, graph, knowledge, tables
from loomwork.plans.storage import shared_folder
from loomwork.registry import query
from loomwork.sources import code, logs

FLAT = "replace(text, chr(10), ' ')"


# Sections, heads, answers and logs


@query(f"""WITH s AS (SELECT conv_id, turn, role, {FLAT} AS x, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations),
    g AS (SELECT conv_id, section, max(CASE WHEN role = 'user' THEN substr(x, 1, 40) END) AS title, trim(coalesce(string_agg(CASE WHEN role <> 'user' THEN x END, chr(10) ORDER BY turn), '')) AS content, min(turn) AS t0, max(turn) AS t1 FROM s WHERE section > 0 GROUP BY conv_id, section),
    p AS (SELECT *, t0 // 2 AS first, coalesce(lead(t0) OVER (PARTITION BY conv_id ORDER BY section), t1) // 2 AS last FROM g)
    SELECT conv_id, title, content, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''))::INT AS word_count,
           CASE WHEN regexp_matches(title || ' ' || substr(content, 1, 200), '(?i)the ing|tion') THEN 'tion' ELSE 'other' END AS content_type, 'p' || first || CASE WHEN last > first THEN '-' || last ELSE '' END AS source_page
    FROM p WHERE len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) >= 5""")
def conversation_sections(t):
    """Turns as Markdown lines, each after a mark of its page: a user's turn opens a section, the others are its body."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    page = F.format_string("<!-- page %d -->", F.floor(F.col("turn") / 2))
    line = F.when(F.col("role") == "user", F.concat(F.lit("## "), F.substring(flat, 1, 40))).otherwise(flat)
    rows = t.conversations.select("conv_id", F.inline(F.array(F.struct((F.col("turn") * 2).alias("pos"), page.alias("line")), F.struct((F.col("turn") * 2 + 1).alias("pos"), line.alias("line")))))
    found = logs.sections(rows, "conv_id", "pos", "line", [("tion", "the ing|tion")])
    return found.select("conv_id", "title", "content", "word_count", "content_type", "source_page")


@query("SELECT doc_id, lang, source AS owner, n_chars::VARCHAR AS size, NULL::VARCHAR AS missing FROM documents")
def front_matter_entries(t):
    """The keys of a fenced head before each text."""
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nowner:  "), "source", F.lit("\nnot a key\nsize: "), F.col("n_chars").cast("string"), F.lit("\n---\n"), "text")
    keys = t.documents.select("doc_id", code.front_matter(head).alias("m"))
    return keys.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("lang", "owner", "size", "missing")])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k')::INT END AS k FROM events")
def fenced_answers(t):
    """JSON out of answers that fence it, say it bare, or fail."""
    answer = F.when(F.col("event_type") == "error", F.lit("no answer")).when(F.col("event_type") == "click", F.col("props")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nthanks")))
    return t.events.select("event_id", code.fenced_json(answer, "k int")["k"].alias("k"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type <> 'error' GROUP BY event_type")
def event_log_lines(t):
    """A log of JSON lines written and read again; the lines cut short are skipped."""
    folder = f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    t.events.select(F.when(F.col("event_type") == "error", F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    return logs.event_log(t.spark, folder, "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT p_partkey, p_brand AS brand, p_type || ',' || p_size AS listed FROM part""")
def comment_meta(t):
    """``k=v`` pairs of a comment line, with a list."""
    line = F.concat(F.lit("<!-- brand="), "p_brand", F.lit(" kinds="), "p_type", F.lit("|"), F.col("p_size").cast("string"), F.lit(" -->"))
    got = t.part.select("p_partkey", text.meta_pairs(line).alias("m"))
    return got.select("p_partkey", F.get(F.try_element_at("m", F.lit("brand")), F.lit(0)).alias("brand"), F.array_join(F.try_element_at("m", F.lit("kinds")), ",").alias("listed"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')), 1, 200) AS q FROM documents")
def text_queries(t):
    """Texts as queries of a text index: without marks, at most 200 characters."""
    return t.documents.select("doc_id", text.text_match_query(F.col("text")).alias("q"))


@query("SELECT c_custkey, 'K-' || upper(substr(sha1(c_mktsegment || '|' || c_name), 1, 8)) AS id FROM customer")
def content_ids(t):
    return t.customer.select("c_custkey", text.content_id("K", F.col("c_mktsegment"), F.col("c_name")).alias("id"))


@query("SELECT event_id, round(epoch(TIMESTAMP '2024-02-01' - ts) / 86400, 6) AS age, event_type || ' | ' || props AS embedded FROM events")
def event_ages(t):
    """Days before a time, and the text that is embedded, without its empty parts."""
    age = text.age_days(F.col("ts"), F.lit("2024-02-01").cast("timestamp"))
    return t.events.select("event_id", F.round(age, 6).alias("age"), text.embed_text(F.col("event_type"), F.lit(""), F.col("props")).alias("embedded"))


@query("""SELECT conv_id, turn, length(trim(text)) < 12 OR regexp_matches(lower(trim(text)), '^(ok|yes|done|n/?a|none|checked|good|fine)([ ,.]+(ok|yes|done|checked|good|fine))*\\.?$') AS low, CASE WHEN turn < 5 THEN power(2, turn) END AS wait FROM conversations""")
def low_signal_turns(t):
    """Answers too short to say anything, and the wait before another try."""
    wait = F.when(F.col("turn") < 5, parsing.backoff_seconds(F.col("turn") + 1, "exponential"))
    return t.conversations.select("conv_id", "turn", parsing.low_signal(F.col("text")).alias("low"), wait.alias("wait"))


@query(f"""SELECT conv_id, turn, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT contains(lower(x), 'the')), lambda x: trim(x)) AS questions FROM conversations WHERE role = 'user'""")
def open_question_lines(t):
    """The bullets of a section of open questions; placeholders are left out."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.when(F.lower(x).contains("the"), F.lit("- (none)")).otherwise(F.concat(F.lit("* "), x)))
    body = F.concat(F.lit("# Notes\n## Open\n"), F.array_join(lines, "\n"), F.lit("\n## Closed\n- x"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.coalesce(text.open_questions(text.markdown_section(body, "Open")), F.array().cast("array<string>")).alias("questions"))


# Descriptions of materials

MADE = "concat_ws('/', {0})"


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'LEF' WHEN 'LARGE' THEN 'GLU' WHEN 'PROMO' THEN 'PAC' WHEN 'ECONOMY' THEN 'WAF' ELSE NULL END AS parser, p_type IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY') AS success,
    CASE p_type WHEN 'SMALL' THEN CASE WHEN p_size > 25 THEN 'HD ' || p_brand ELSE p_brand END WHEN 'LARGE' THEN p_brand || '/' || p_size WHEN 'PROMO' THEN p_brand || ';' || p_name WHEN 'ECONOMY' THEN p_size || ' mil' END AS field FROM part""")
def described_materials(t):
    """Descriptions of four kinds of material, dispatched by kind; other kinds are reported as such."""
    size, join = F.col("p_size").cast("string"), lambda *c: F.concat_ws("/", *[F.lit(x) if x.isupper() or not x else F.col(x) for x in c])
    frame = F.when(F.col("p_size") > 25, join("LF", "p_name", "HD", "p_brand", "AG", "V")).otherwise(join("LF", "p_name", "p_brand", "AG", "V"))
    made = (
        F.when(F.col("p_type") == "SMALL", frame).when(F.col("p_type") == "LARGE", F.concat_ws("/", F.lit("GLUE"), "p_name", F.lit("T"), F.lit("V"), "p_brand", size))
        .when(F.col("p_type") == "PROMO", F.concat_ws("/", F.lit("BOX"), "p_brand", F.lit(""), "p_name"))
        .when(F.col("p_type") == "ECONOMY", F.concat_ws("/", "p_name", F.lit("CHIP"), F.concat(size, F.lit(" mil")), F.lit("T"), F.lit("M"), F.lit("V"), F.lit("R"))).otherwise("what")
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("SMALL", "LEF", "LARGE", "GLU", "PROMO", "PAC", "ECONOMY", "WAF", "STANDARD", "XXX", "MEDIUM", "XXX")]), F.col("p_type"))
    got = t.part.select("p_partkey", parsing.described(made, kind).alias("d"))
    names = {"LEF": "option", "GLU": "rest", "PAC": "items", "WAF": "size"}
    field = F.coalesce(*[F.when(F.col("d.parser") == k, F.get_json_object("d.fields", f"$.{v}")) for k, v in names.items()])
    return got.select("p_partkey", "d.parser", "d.success", field.alias("field"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS size, CASE WHEN contains(upper(p_name), 'RED') THEN 'R1' WHEN contains(upper(p_name), 'BOLT') OR contains(upper(p_name), 'RING') THEN 'B2' END AS compound, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS in_mm FROM part""")
def numbers_and_codes(t):
    """Numbers that may be dashes, the first code of an ordered table, numbers with a unit."""
    raw = F.when(F.col("p_size") % 3 == 0, F.element_at(F.array(F.lit("-"), F.lit(""), F.lit("1_0")), (F.col("p_size") / 3).cast("int") % 3 + 1)).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    unit = F.concat(F.lit("about "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " mm").otherwise(" mil"))
    compound = parsing.first_code(F.col("p_name"), [("R1", ["RED"]), ("B2", ["BOLT", "RING"])])
    return t.part.select("p_partkey", parsing.safe_number(raw).alias("size"), compound.alias("compound"), parsing.value_with_unit(unit, "mm").alias("in_mm"))


# Imports and arguments


@query(r"""WITH l AS (SELECT DISTINCT page_id, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="/([^"]*)"', 1)) AS h FROM pages) WHERE regexp_matches(h, '^[a-z]+$')),
    m AS (SELECT DISTINCT h, min(page_id) OVER (PARTITION BY h) AS first FROM l), p AS (SELECT h, first FROM m WHERE length(h) % 2 = 0)
    SELECT page_id, p.h AS module, 'm' || first || '/' || p.h || '.py' AS path FROM l JOIN p USING (h)""")
def resolved_imports(t):
    """Links of pages as imports: a module's dotted name is known for names of even length, the rest resolves to none."""
    links = logs.page_links(t.pages, "page_id", "html").select("page_id", F.substring("href", 2, 1000).alias("h")).where(F.col("h").rlike("^[a-z]+$")).distinct()
    first = links.groupBy("h").agg(F.min("page_id").alias("first")).where(F.length("h") % 2 == 0)
    modules = first.select(F.concat(F.lit("m"), "first", F.lit("/"), "h", F.lit(".py")).alias("path"), F.concat(F.lit("pages."), "h").alias("dotted"), F.col("h").alias("base"))
    imports = links.select(F.concat(F.lit("page"), "page_id", F.lit(".py")).alias("importer"), F.concat(F.lit("pages."), "h", F.lit(".part")).alias("name"))
    found = graph.resolve_imports(imports, modules)
    return found.select(F.regexp_extract("importer", r"\d+", 0).cast("long").alias("page_id"), F.regexp_extract("name", r"^pages\.(\w+)\.", 1).alias("module"), "path")


@query("""WITH n AS (SELECT p_name || '/' || p_brand || '/' || p_partkey || '.py' AS path, p_partkey FROM part) SELECT p_partkey || '.py' AS query, path FROM n UNION ALL SELECT path, path FROM n""")
def resolved_arguments(t):
    """Modules that an argument means: a path, or a base name."""
    modules = t.part.select(F.concat_ws("/", "p_name", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".py"))).alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return knowledge.resolved_exactly(modules.select(name.alias("query")).union(modules.select("path")), modules)


@query("SELECT DISTINCT l_orderkey AS workflow, p_name AS agent FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL'")
def workflow_delegates(t):
    """Which agents the nodes of a workflow delegate to, out of its definition in JSON; an order's lines are its nodes."""
    node = F.struct(F.col("l_linenumber").alias("step"), F.struct(F.col("l_partkey").alias("part")).alias("delegate"))
    written = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").alias("name"), F.collect_list(node).alias("nodes"))).alias("definition"))
    read = written.select(F.from_json("definition", "name long, nodes array<struct<step:int,delegate:struct<part:long>>>").alias("d"))
    nodes = read.select(F.col("d.name").alias("name"), F.col("d.nodes.delegate.part").alias("nodes"))
    return entries.delegates(nodes, t.part.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("agent")))


# Writing entries


@query("""WITH c AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey + 100000000, 1.0 FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN c USING (o_orderkey) UNION ALL SELECT o_orderkey + 200000000, 2.0 FROM orders WHERE o_orderpriority = '5-LOW'""")
def upserted_entries(t):
    """Entries replaced and inserted by key, then those appended whose keys are new."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    doubled = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    fresh = t.orders.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"))
    low = t.orders.where("o_orderpriority = '5-LOW'").select((F.col("o_orderkey") + 200_000_000).alias("o_orderkey"), F.lit(2.0).alias("o_totalprice"))
    known = orders.select("o_orderkey", F.lit(3.0).alias("o_totalprice"))
    return tables.append_new(tables.upsert(orders, doubled.union(fresh), ["o_orderkey"]), low.union(known), ["o_orderkey"])


# Audits, one rule family each


@query("""SELECT 'WARN' AS severity, 'alias' AS "check", page_id::VARCHAR AS key, 'old name: ' || old AS message FROM pages, (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS old FROM benchmark) WHERE contains(lower(html), old)""")
def stale_alias_audit(t):
    """Names of a registry of retired names in any page."""
    old = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("name"))
    found = aliases.alias_matches(t.pages, old, "page_id", "html", "name")
    return tables.issues(found, "WARN", "alias", F.col("key"), F.concat(F.lit("old name: "), "alias"))


@query("""SELECT 'ERROR' AS severity, 'derived table' AS "check", doc_id || ':' || i AS key, 'derived' AS message FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, '(?i)\\b(of|the)\\s+(and|in)\\b')""")
def derived_table_rule(t):
    """Lines that read from a name that must not be read."""
    return checks.pattern_issues(t.documents, "doc_id", "text", {"derived": r"(?i)\b(of|the)\s+(and|in)\b"}, "derived table", "ERROR")


@query("""SELECT 'WARN' AS severity, 'legacy path' AS "check", page_id || ':' || i AS key, rule AS message FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS i FROM pages), (VALUES ('root', 'href="/'), ('host', 'https?://')) r(rule, p) WHERE regexp_matches(l, p)""")
def legacy_path_rule(t):
    return checks.pattern_issues(t.pages, "page_id", "html", {"root": 'href="/', "host": "https?://"}, "legacy path")


@query("""SELECT 'WARN' AS severity, 'metadata' AS "check", c_custkey::VARCHAR AS key, 'no segment' AS message FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'WARN', 'metadata', c_custkey::VARCHAR, 'no owner' FROM customer WHERE c_nationkey = 3""")
def metadata_audit(t):
    """Entries whose required fields are blank."""
    told = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("owner"))
    return checks.required(told, "c_custkey", ["segment", "owner"], "metadata")


@query("""SELECT 'ERROR' AS severity, 'unused supplier' AS "check", s_suppkey::VARCHAR AS key, 'no such line' AS message FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)
    UNION ALL SELECT 'ERROR', 'unused part', p_partkey::VARCHAR, 'no such line' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
    UNION ALL SELECT 'ERROR', 'unused customer', c_custkey::VARCHAR, 'no such line' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def activation_audit(t):
    """Suppliers, parts and customers that nothing of a kind refers to: three anti joins."""
    lines = t.lineitem.where("l_quantity > 49")
    unused = lambda df, key, by, other, name: checks.dangling(df.withColumnRenamed(key, "line"), by.select(F.col(other).alias("id")), "line", name)
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return tables.audit(unused(t.supplier, "s_suppkey", lines, "l_suppkey", "unused supplier"), unused(t.part, "p_partkey", lines, "l_partkey", "unused part"), unused(t.customer, "c_custkey", urgent, "o_custkey", "unused customer"))


@query("""SELECT 'ERROR' AS severity, 'drift' AS "check", 'part ' || p_partkey AS key, p_brand || ' is not ' || want AS message FROM part JOIN (SELECT p_name AS name, min(p_brand) AS want FROM part GROUP BY p_name) ON p_name = name WHERE p_brand <> want""")
def drift_audit(t):
    """Entries that differ from the agreed one of their name."""
    agreed = t.part.groupBy("p_name").agg(F.min("p_brand").alias("want"))
    apart = t.part.join(agreed, "p_name").where("p_brand <> want")
    return tables.issues(apart, "ERROR", "drift", F.concat(F.lit("part "), F.col("p_partkey").cast("string")), F.concat("p_brand", F.lit(" is not "), "want"))


@query("""SELECT source AS rule, CASE WHEN sum((length(text) > 5000)::INT) > 0 THEN 2 WHEN sum((length(text) < 50)::INT) > 0 THEN 1 ELSE 0 END AS exit_code FROM documents GROUP BY source""")
def source_exit_codes(t):
    """The worst severity of each source's issues: long texts are errors, short ones warnings."""
    rule = F.when(F.length("text") > 5000, "ERROR").when(F.length("text") < 50, "WARN").otherwise("INFO")
    level = F.max(F.when(rule == "ERROR", 2).when(rule == "WARN", 1).otherwise(0))
    return t.documents.groupBy(F.col("source").alias("rule")).agg(level.alias("exit_code"))


# Encodings


@query("""SELECT doc_id, CASE WHEN text = '' THEN 'utf-8' WHEN lang = 'de' THEN 'utf-16-le' WHEN lang = 'en' THEN 'utf-16-be' WHEN lang = 'fr' AND regexp_matches(substr(text, 1, 10000), '[\\x{80}-\\x{ff}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM documents""")
def detected_encodings(t):
    """The encodings of files that each language writes in its own."""
    names = {"de": "UTF-16LE", "en": "UTF-16BE", "fr": "ISO-8859-1", "es": "UTF-8"}
    # Characters that Latin-1 lacks are written as question marks, as its writers do.
    known = F.when(F.col("lang") == "fr", F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?")).otherwise(F.col("text"))
    content = F.coalesce(*[F.when(F.col("lang") == k, F.encode(known, v)) for k, v in names.items()])
    return t.documents.select("doc_id", encodings.encoding(content).alias("encoding"))
