"""Queries over materials, package codes, descriptions, stores of nested documents, and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import materials, parsing, text
from loomwork.operators import tables
from loomwork.registry import query

SIDE = "CASE p_type WHEN 'SMALL' THEN 'WIRE' WHEN 'ECONOMY' THEN 'DIE' ELSE 'TEST' END"


@query(f"SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'WIRE' WHEN p_type = 'ECONOMY' THEN 'DIE' END AS kind, CASE WHEN p_type = 'SMALL' THEN p_brand WHEN p_type = 'ECONOMY' THEN p_brand END AS tool, CASE WHEN p_type = 'SMALL' THEN {SIDE} || ' BOND' END AS wire FROM part")
def process_descriptions(t):
    made = F.concat_ws("/", F.concat(F.expr(SIDE), F.lit(" BOND")), "p_brand", F.substring_index("p_name", " ", 1), F.col("p_size").cast("string"))
    got = t.part.select("p_partkey", materials.process_description(made).alias("d"))
    return got.select("p_partkey", "d.kind", F.try_element_at("d.fields", F.lit("tool")).alias("tool"), "d.wire")


@query("SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RED') THEN 'CU' WHEN contains(upper(p_name), 'BLUE') OR contains(upper(p_name), 'HOT') THEN 'AU' ELSE upper(p_name) END AS wire, CASE WHEN contains(upper(p_name), 'RING') THEN 'ring maker' END AS supplier FROM part")
def normal_names(t):
    wire = materials.normal_form(F.col("p_name"), [("CU", ["red"]), ("AU", ["blue", "hot"])])
    return t.part.select("p_partkey", wire.alias("wire"), materials.normal_form(F.col("p_name"), [("ring maker", ["ring"])], F.lit(None).cast("string")).alias("supplier"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'special' WHEN 1 THEN 'family' WHEN 2 THEN 'short' WHEN 3 THEN 'pins' ELSE 'unknown' END AS mode,
    CASE p_size % 5 WHEN 0 THEN 'odd one' WHEN 1 THEN 'quad flat ' || (100 + p_size) WHEN 2 THEN 'small outline' WHEN 3 THEN (100 + p_size) || ' pins' END AS name FROM part""")
def package_segments(t):
    n = (F.col("p_size") + 100).cast("string")
    code = F.element_at(F.array(F.lit("XX0000"), F.concat(F.lit("qfp"), n), F.lit("SOxxxx"), F.concat(n, F.lit("ABC")), F.lit("zz")), F.col("p_size") % 5 + 1)
    got = materials.package_segment(code, {"XX0000": "odd one"}, {"QFP": "quad flat", "SO": "small outline"})
    return t.part.select("p_partkey", got.alias("g")).select("p_partkey", "g.*")


@query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN contains(upper(p_name), 'BOLT') THEN 'bolt' ELSE 'other' END AS type, p_name || ' datasheet' AS phrase, p_size::DOUBLE AS value FROM part")
def material_records(t):
    described = F.concat(F.lit("size "), "p_size", F.lit(" mil of "), "p_name")
    made = materials.material_record(F.col("p_brand"), F.col("p_name"), described, {"Brand#1": "first"}, {"bolt": "bolt"}, [("x", ["x"])])
    got = t.part.select("p_partkey", made.alias("m"))
    return got.select("p_partkey", "m.type", F.get("m.phrases", F.lit(2)).alias("phrase"), F.get("m.values", F.lit(0))["value"].alias("value"))


@query("SELECT p_partkey, 'package: ' || p_type || ' | wire: ' || p_brand AS summary FROM part")
def code_summaries(t):
    made = F.struct(F.col("p_type").alias("package"), F.col("p_brand").alias("wire"), F.lit(None).cast("string").alias("die"))
    return t.part.select("p_partkey", materials.code_summary(made, ["package", "wire", "die"]).alias("summary"))


@query("SELECT p_partkey, p_type = 'SMALL' AS valid, CASE WHEN p_type = 'SMALL' THEN 0 ELSE 2 END AS n FROM part")
def code_validation(t):
    code = F.when(F.col("p_type") == "SMALL", "A00000-a-D1-L1-C001-v").otherwise("A0000-a-D1-L1-C001")
    known = {"package": {"A00000": "x"}, "wire": {"A": "x"}, "die": {"D1": "x"}, "leadframe": {"L1": "x"}, "compound": {"C001": "x"}, "vendor": {"v": "x"}}
    got = t.part.select("p_partkey", parsing.six_segments(code, known).alias("c"), parsing.code_differences(code, F.lit("A00000-a-D1-L1-C001-v")).alias("d"))
    return got.select("p_partkey", F.col("c.success").alias("valid"), F.size("d").alias("n"))


@query("SELECT a.l_orderkey, a.l_linenumber, CASE WHEN p_type = 'SMALL' THEN 'WIR' WHEN p_type = 'ECONOMY' THEN 'WAF' ELSE 'COM' END AS kind FROM lineitem a JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#3'")
def rows_by_kind(t):
    """Wafer, wire and compound rows of an item, by the kind of material."""
    kind = F.when(F.col("p_type") == "SMALL", "WIR").when(F.col("p_type") == "ECONOMY", "WAF").otherwise("COM")
    parts = t.part.where("p_brand = 'Brand#3'").select("p_partkey", kind.alias("kind"))
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "kind")


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 5 AS page, p_partkey % 97 AS x0, p_partkey % 89 AS y0, p_partkey % 97 + 1 + p_size % 7 AS x1, p_partkey % 89 + 2 AS y1 FROM part),
    o AS (SELECT a.id AS a, b.id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS s FROM r a JOIN r b ON a.page = b.page AND a.id < b.id)
    SELECT a, b, round(w * h / s::DOUBLE, 6) AS share FROM o WHERE w > 0.5 AND h > 0.5""")
def rectangle_tolerance(t):
    """Overlaps beyond a tolerance, with the share of the smaller rectangle that they cover."""
    key = F.col("p_partkey")
    x, y = (key % 97).cast("double"), (key % 89).cast("double")
    rects = t.part.select(key.alias("id"), (F.col("p_size") % 5).alias("page"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("p_size") % 7).alias("x1"), (y + 2).alias("y1"))
    return tables.overlap_shares(rects, cell=8.0, tolerance=0.5).select("a", "b", F.round("share", 6).alias("share"))


@query("SELECT p_name, CASE WHEN p_name LIKE 'red%' THEN 'core' WHEN p_name LIKE 'b%' THEN 'base' ELSE 'other' END AS tier FROM (SELECT DISTINCT p_name FROM part)")
def path_tiers(t):
    return t.part.select("p_name").distinct().select("p_name", materials.tier(F.col("p_name"), [("red", "core"), ("b", "base")]).alias("tier"))


@query("SELECT o_custkey AS standard, o_orderstatus AS \"group\", o_orderkey AS test_id, o_totalprice AS \"limit\" FROM orders")
def test_requirements(t):
    """Tests nested in groups nested in standards, taken apart again."""
    groups = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("limit"))).alias("tests"))
    standards = groups.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("name"), "tests")).alias("groups"))
    return materials.test_requirements(standards)


@query("SELECT p_partkey FROM part WHERE (p_type = 'SMALL' OR p_brand = 'SMALL') AND contains(lower(p_brand), 'd#1') AND contains(lower(p_name), 'ring')")
def store_search(t):
    store = t.part.select("p_partkey", F.col("p_type").alias("type"), F.col("p_brand").alias("subtype"), F.col("p_brand").alias("maker"), "p_name")
    return materials.store_search(store, "SMALL", "D#1", "RING").select("p_partkey")


@query("SELECT 'part' AS segment, p_partkey::VARCHAR AS code, p_name AS meaning FROM part WHERE contains(lower(p_name), 'ring') OR contains(p_partkey::VARCHAR, 'ring') UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(n_nationkey::VARCHAR, '1')")
def code_search(t):
    tables_ = {"part": t.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("meaning")), "nation": t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("meaning"))}
    return materials.code_search(tables_, {"part": "Ring", "nation": "1"})


@query("SELECT doc_id, trim(text, chr(10)) = '' AS blank, length(split_part(text, chr(10), 1)) > 80 AS cut FROM documents WHERE text IS NOT NULL")
def short_targets(t):
    first = F.trim(F.substring_index("text", "\n", 1))
    got = t.documents.where("text is not null").select("doc_id", "text", first.alias("first"), text.short_target(F.col("text")).alias("target"), text.without_boilerplate(F.col("text"), ()).alias("clean"))
    return got.select("doc_id", (F.col("clean") == "").alias("blank"), (F.length(F.substring_index("text", "\n", 1)) > 80).alias("cut"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'D-' || p_size WHEN p_partkey % 3 = 1 THEN 'D-' || p_size || ',E-7' ELSE '' END AS ids FROM part")
def superseded_ids(t):
    k, own = F.col("p_partkey") % 3, F.concat(F.lit("D-"), F.col("p_size") + 1000)
    body = F.when(k == 0, F.concat(F.lit("x\nsupersedes: D-"), "p_size", F.lit(", D-"), "p_size", F.lit("\n"))).when(k == 1, F.concat(F.lit("Supersedes D-"), "p_size", F.lit(" E-7, "), own)).otherwise("D-1 and D-2")
    return t.part.select("p_partkey", F.array_join(text.superseded_ids(body, own), ",").alias("ids"))


@query("SELECT p_partkey, '<!-- status=' || lower(p_type) || CASE WHEN p_size > 25 THEN ' target=' || p_size ELSE '' END || ' -->' AS line FROM part")
def meta_lines(t):
    return t.part.select("p_partkey", text.meta_line(status=F.lower("p_type"), target=F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), refs=F.lit("")).alias("line"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN 'Title of ' || p_name END AS heading FROM part")
def headings(t):
    k = F.col("p_size") % 3
    body = F.when(k == 0, F.concat(F.lit("some text\nChapter "), "p_size", F.lit("\nmore"))).when(k == 1, F.concat(F.lit("## Title of "), "p_name", F.lit("\nx"))).otherwise("no heading here")
    return t.part.select("p_partkey", text.heading(body).alias("heading"))


@query("SELECT p_partkey, 'a' || chr(10) || chr(10) || p_name AS clean FROM part")
def stripped_pages(t):
    body = F.concat(F.lit("Page 3 of 9\na\n\n\n\nCONFIDENTIAL\n"), "p_name", F.lit("\nPage 4\n"))
    return t.part.select("p_partkey", text.without_boilerplate(body).alias("clean"))


@query("SELECT doc_id, CASE WHEN contains(text, 'and') THEN 'and' END AS kb, contains(lower(text), 'secret') AS db FROM documents")
def detected_references(t):
    """Which of a list of names a block refers to."""
    return t.documents.select("doc_id", F.when(F.col("text").contains("and"), "and").alias("kb"), F.lower("text").contains("secret").alias("db"))
