"""Queries that answer from kept indexes and from joins of whole tables, with the SQL that scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.catalogue import ORACLES, SPARSE
from loomwork.catalogue_knowledge import PHRASES
from loomwork.operators import aliases, conflicts, graph, ordering, vectors
from loomwork.operators.text_index import TextIndex
from loomwork.operators.versioned import VersionedTable
from loomwork.plans.storage import shared_folder
from loomwork.registry import query
from loomwork.streaming.attempts import RESULT, attempt_stream
from loomwork.streaming.logs import LogReader


def _kept(t, kind: str) -> TextIndex:
    """An index of documents by three batches: stale texts, strays and most documents; the right texts and the rest; strays deleted."""
    index = TextIndex(t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}", kind, "long")
    docs = t.documents.select(F.col("doc_id").alias("key"), "text", "lang", "source")
    stale = docs.where("source <> 'src0'").select("key", F.when(F.col("lang") == "fr", F.reverse("text")).otherwise(F.col("text")).alias("text"))
    strays = docs.where("lang = 'de'").select((-F.col("key") - 1).alias("key"), "text")
    index.apply(stale.union(strays))
    index.apply(docs.where("source = 'src0' or lang = 'fr'").select("key", "text"), strays)
    return index


@query(ORACLES["trigram_search"])
def kept_phrase_search(t):
    """Phrases in any script from the positions of their grams."""
    return _kept(t, "grams").phrases(PHRASES).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(ORACLES["bm25_topk"])
def kept_bm25_topk(t):
    """Words from merged postings, blocks opened by their bounds."""
    index = _kept(t, "words")
    index.merge()
    return index.bm25(("the", "ing", "tion"), 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


# One order over a whole table


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def order_numbers(t):
    return ordering.numbered(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query("SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_urgent FROM orders")
def order_last_urgent(t):
    """The price of the last urgent order, carried over all orders by date."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    rows = t.orders.select("o_orderkey", "o_orderdate", urgent.alias("urgent"))
    return ordering.carried_forward(rows, ["o_orderdate", "o_orderkey"], "urgent", "last_urgent").select("o_orderkey", "last_urgent")


@query("SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id)::BIGINT AS errors FROM events")
def event_running_errors(t):
    rows = t.events.select("event_id", "ts", (F.col("event_type") == "error").cast("int").alias("error"))
    return ordering.running_sum(rows, ["ts", "event_id"], "error", "errors").select("event_id", "errors")


@query("""WITH e AS (SELECT DISTINCT event_id AS v FROM events WHERE event_type = 'purchase'), w AS (SELECT v, lead(v) OVER (ORDER BY v) AS before FROM e)
    SELECT v AS after, before, before - v - 1 AS n FROM w WHERE before - v > 1""")
def event_gaps(t):
    """What lies between the purchases, over all events."""
    return ordering.gaps(t.events.where("event_type = 'purchase'"), "event_id")


@query("""WITH e AS (SELECT DISTINCT event_id AS v FROM events WHERE event_type <> 'purchase'), w AS (SELECT v, v - row_number() OVER (ORDER BY v) AS k FROM e)
    SELECT min(v) AS first, max(v) AS last, count(*) AS n FROM w GROUP BY k""")
def event_runs(t):
    return ordering.runs(t.events.where("event_type <> 'purchase'"), "event_id")


@query("SELECT s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS c_custkey FROM supplier")
def assigned_ids(t):
    """Suppliers that become customers get the next ids, by their order."""
    return ordering.with_new_ids(t.customer, t.supplier.select("s_name", "s_suppkey"), "c_custkey", ["s_suppkey"]).select("s_name", "c_custkey")


# Vectors in cells


@query(ORACLES["cosine_topk"])
def kept_vectors_topk(t):
    """From a table of vectors that was added to, changed and purged; cells are opened by their bounds."""
    index = vectors.VectorIndex(t.spark, f"{shared_folder(t.spark)}/vectors-{uuid.uuid4().hex}")
    rows = t.embeddings.select("vec_id", "label", "embedding")
    index.create(rows, "vec_id", "embedding")
    stale = rows.where("label < 7").select("vec_id", F.when(F.col("label") == 2, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    strays = rows.where("label = 3").select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")
    index.add(stale.union(strays), "vec_id", "embedding")
    index.add(rows.where("label >= 7 or label = 2"), "vec_id", "embedding")
    index.remove(strays.select("vec_id"))
    found = index.exact(t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10)
    return found.select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


#: Every vector, and its sum with a share of the next one's; a share of 0.5 makes a pair to write, one of 0.8 a pair to review.
MIXED = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT vec_id, v FROM e UNION ALL SELECT -1 - a.vec_id, list_transform(list_zip(a.v, b.v), lambda x: x[1] + CASE WHEN a.vec_id % 3 = 0 THEN 0.5 ELSE 0.8 END * x[2]) FROM e a JOIN e b ON b.vec_id = a.vec_id + 1
          UNION ALL SELECT vec_id + 10000000, v FROM e)"""


@query(f"""WITH {MIXED}, r AS (SELECT min(vec_id) AS id, v FROM m GROUP BY v),
    s AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list_cosine_similarity(x.v, y.v) AS similarity FROM r x JOIN r y ON x.id < y.id)
    SELECT a, b, CASE WHEN similarity >= 0.85 THEN 'write' ELSE 'review' END AS action FROM s WHERE similarity >= 0.7""")
def alike_vectors(t):
    """Pairs of all vectors at 0.7 or more, between representatives of equal vectors."""
    own = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    following = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    met = own.join(following, "vec_id").withColumn("share", F.when(F.col("vec_id") % 3 == 0, 0.5).otherwise(0.8))
    mixed = met.select((-1 - F.col("vec_id")).alias("vec_id"), F.zip_with("v", "w", lambda x, y: x + F.col("share") * y).alias("v"))
    everything = own.union(mixed).union(own.select((F.col("vec_id") + 10_000_000).alias("vec_id"), "v"))
    pairs, _ = vectors.similar_vectors(everything, "vec_id", "v", 0.7)
    return pairs.select("a", "b", vectors.action("similarity").alias("action"))


@query("SELECT vec_id AS key, min(vec_id) OVER (PARTITION BY embedding) AS representative FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, embedding FROM embeddings WHERE label = 4)")
def vector_members(t):
    """Which representative stands for each vector."""
    rows = t.embeddings.select("vec_id", "embedding")
    return vectors.classes(rows.union(t.embeddings.where("label = 4").select(F.col("vec_id") + 10_000_000, "embedding")), "vec_id", "embedding")


# Names of a registry table in texts

PAIRS = "SELECT DISTINCT lower(w[i] || ' ' || w[i + 1]) AS alias FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark)) WHERE length(w[i] || w[i + 1]) > 1"


def _registry(t):
    """Pairs of neighbouring words of the benchmark, as a table of names."""
    words = t.benchmark.select(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w")).where("size(w) > 1")
    pair = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).alias("alias"))
    return pair.where("length(alias) > 2")


@query(f"SELECT DISTINCT doc_id, alias FROM documents, ({PAIRS}) WHERE contains(lower(text), alias)")
def registry_aliases(t):
    """Every text against a table of names, by one automaton."""
    return aliases.alias_matches(t.documents, _registry(t), "doc_id", "text", "alias").select(F.col("key").alias("doc_id"), "alias")


@query(f"WITH c AS (SELECT conv_id * 100 + turn AS id, lower(text) AS x FROM conversations) SELECT DISTINCT id, alias FROM c, ({PAIRS}) WHERE contains(x, alias)")
def registry_aliases_joined(t):
    """The same by a join on each name's rarest gram, as for registries that no task should hold."""
    turns = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return aliases.alias_matches(turns, _registry(t), "id", "text", "alias", bound=(0, 0)).select(F.col("key").alias("id"), "alias")


# Versions of a keyed table


def _versioned(t) -> VersionedTable:
    """Orders in four versions: those that are not pending; all urgent ones at twice the price; low ones removed; what lacks, added."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    table = VersionedTable(t.spark, f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}", "o_orderkey long, o_orderpriority string, o_totalprice double", ["o_orderkey"])
    urgent = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    table.apply(t.orders.where("o_orderstatus <> 'P'").select(*orders.columns), batch=("loader", 0))
    table.apply(urgent, batch=("loader", 1))
    table.apply(removed=orders.where("o_orderpriority = '5-LOW'"), batch=("loader", 2))
    table.apply(orders.where("o_orderpriority <> '5-LOW'"), new_only=True, batch=("loader", 3))
    table.apply(orders, batch=("loader", 1))  # a batch that comes again
    return table


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END * o_totalprice AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'")
def versioned_orders(t):
    """The last version."""
    return _versioned(t).read().select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END * o_totalprice AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'")
def versioned_orders_before(t):
    """The second version, after two more were committed."""
    return _versioned(t).read(2).select("o_orderkey", "o_totalprice")


# Attempts as a stream with state


@query(ORACLES["attempt_states"])
def attempt_stream_states(t):
    """The states of ``attempt_states``, kept by a stream of three batches and upserted as they change."""
    folder = f"{shared_folder(t.spark)}/attempts-{uuid.uuid4().hex}"
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    made = t.events.select(F.col("user_id").alias("node"), seq.cast("long").alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("value").alias("seconds"), F.lit(80.0).alias("limit"), F.col("ts").cast("timestamp").alias("at"))
    made.repartition(3 * t.spark.sparkContext.defaultParallelism, "node", "seq").write.parquet(f"{folder}/in")
    files = -(-len(t.spark.read.schema(made.schema).parquet(f"{folder}/in").inputFiles()) // 3)  # a batch
    table = VersionedTable(t.spark, f"{folder}/out", RESULT, ["node", "kind"])
    stream = t.spark.readStream.schema(made.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    keep = lambda rows, number: table.apply(rows, batch=("attempts", number)) and None
    kept = attempt_stream(stream, late="365 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    kept.trigger(availableNow=True).start().awaitTermination()
    return table.read().where("kind = 'state'").select("node", "tries", "state")


# Conflicts of short texts

WORDS = "list_distinct(list_filter(regexp_extract_all(x, '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'and', 'for', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'with')))"


@query(f"""WITH f AS (SELECT doc_id, lower(substr(split_part(text, chr(10), 1), 1, 60)) AS x FROM documents), s AS (SELECT doc_id, x, {WORDS} AS t FROM f),
    j AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS n, contains(a.x, b.x) OR contains(b.x, a.x) AS inside FROM s a JOIN s b ON a.doc_id < b.doc_id)
    SELECT a, b, round_even(greatest(k / (n - k)::DOUBLE, CASE WHEN inside THEN 0.6 ELSE 0 END), 4) AS score FROM j WHERE k > 0 AND greatest(k / (n - k)::DOUBLE, CASE WHEN inside THEN 0.6 ELSE 0 END) >= 0.4""")
def first_line_conflicts(t):
    """Documents whose first lines may contradict."""
    lines = t.documents.select(F.col("doc_id").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("text"))
    found = conflicts.conflicts_within(lines, 0.4)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.bround("score", 4).alias("score"))


# Many paths at once


@query(f"""WITH RECURSIVE {SPARSE}, p AS (SELECT 'S:' || a.s_suppkey AS a, CASE WHEN a.s_suppkey % 5 = 0 THEN 'P:' || a.s_suppkey ELSE 'S:' || b.s_suppkey END AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
    r(src, node, depth) AS (SELECT DISTINCT a, a, 0 FROM p UNION SELECT src, e.v, depth + 1 FROM r JOIN e ON e.u = r.node WHERE depth < 3)
    SELECT a, b, min(depth) AS hops FROM p LEFT JOIN r ON src = a AND node = b GROUP BY a, b""")
def pair_distances(t):
    """Hops, at most three, between each supplier and the next one, or a part."""
    supplier, part = (lambda key: 2 * F.col(key)), (lambda key: 2 * F.col(key) + 1)
    following = t.supplier.select((F.col("s_suppkey") - 1).alias("k"), supplier("s_suppkey").alias("next"))
    met = t.supplier.join(following, F.col("s_suppkey") == F.col("k"))
    pairs = met.select(supplier("s_suppkey").alias("a"), F.when(F.col("s_suppkey") % 5 == 0, part("s_suppkey")).otherwise(F.col("next")).alias("b"))
    kind = lambda node: F.pmod(node, F.lit(2))
    name = lambda c: F.concat(F.when(kind(F.col(c)) == 0, "S:").otherwise("P:"), F.shiftright(c, 1)).alias(c)
    edges = t.lineitem.select(supplier("l_suppkey").alias("u"), part("l_partkey").alias("v"))
    return graph.path_lengths(edges, pairs, 3, symmetric=True, kind=kind).select(name("a"), name("b"), "hops")


# A log that grows


@query("""SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type UNION ALL SELECT 'bad', count(*) FROM events WHERE event_type = 'error'""")
def growing_log(t):
    """Events as JSON lines in two parts, read by a reader that stops between them; cut lines are counted apart."""
    folder = f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    lines = t.events.select("event_type", "ts", F.when(F.col("event_type") == "error", F.substring(line, 1, 30)).otherwise(line).alias("value"))
    reader = LogReader(t.spark, f"{folder}/in", f"{folder}/kept", "event_id long, event_type string, value double", ("event_id",))
    for part in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        lines.where(part).select("value").write.mode("append").text(f"{folder}/in")
        reader.catch_up()
    good = reader.rows.read().groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return good.union(reader.rejects.read().agg(F.lit("bad"), F.coalesce(F.sum("n"), F.lit(0))))
