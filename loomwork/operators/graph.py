"""Bounded traversal of an edge table by a frontier that joins outwards, one hop a round."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomwork.plans.storage import materialize, shuffled


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) rows in both directions, self edges aside."""
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()


def depths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """node, depth of everything within ``most`` hops along (u, v) of the ``starts`` (node).

    Each round joins the frontier and drops nodes seen before; every round is
    written out, so the plan does not grow with the depth.
    """
    seen = materialize(starts.select("node").distinct().withColumn("depth", F.lit(0)), "depth")
    frontier = seen
    for depth in range(1, most + 1):
        reached = frontier.join(edges, frontier["node"] == edges["u"]).select(F.col("v").alias("node")).distinct()
        frontier = materialize(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "depth")
        if not frontier.take(1):
            break
        seen = seen.union(frontier)
    return seen


def path_length(edges: DataFrame, start, end, most: int = 6) -> DataFrame:
    """One row: hops from start to end, null beyond ``most``; 0 if they are the same."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["u"]
    one = spark.range(1).select(F.lit(start).cast(kind).alias("node"))
    found = depths(edges, one, most).where(F.col("node") == F.lit(end))
    return found.agg(F.min("depth").alias("hops"))


#: Nodes of a list, about: a node's neighbours, or what an end has reached, are dealt over lists by the nodes' hashes.
LIST = 2_048
#: Sums of degrees that bound the greatest degree.
SUMS = 1 << 18
#: Bits a node, and at most, of a list's signature.
BITS, MOST_BITS = 16, 1 << 15
#: Pairs of kinds up to which kinds are made use of.
KINDS = 64

_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _part(node: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts)).cast("int")


def _lists(rows: DataFrame, parts: int) -> DataFrame:
    """u, part, nodes: the distinct v of each u, dealt over the parts."""
    dealt = rows.select("u", "v", _part(F.col("v"), parts).alias("part")).repartition("u", "part")
    return dealt.groupBy("u", "part").agg(F.sort_array(F.collect_set("v")).alias("nodes"))


def _places(nodes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(65 - bits.bit_length())
    return [nodes.view(np.uint64) * odd >> shift for odd in _ODD]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end, part, nodes) to (end, part, signature)."""
    for batch in batches:
        signs = []
        for nodes in batch.column(2):
            nodes = nodes.values.to_numpy()
            bits = min(MOST_BITS, 1 << max(6, (BITS * len(nodes) - 1).bit_length()))
            has = np.zeros(bits, bool)
            for place in _places(nodes, bits):
                has[place] = True
            signs.append(np.packbits(has).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signs, pa.binary())], ["end", "part", "signature"])


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, part, signature, nodes) to (a, b, part, nodes) of the nodes that the signature lets pass."""
    for batch in batches:
        at, kept = [], []
        for k, (sign, nodes) in enumerate(zip(batch.column(3), batch.column(4))):
            sign, nodes = np.frombuffer(sign.as_buffer(), np.uint8), nodes.values.to_numpy()
            one, two = (sign[p >> np.uint64(3)] << (p & np.uint64(7)).astype(np.uint8) & 128 > 0 for p in _places(nodes, 8 * len(sign)))
            nodes = nodes[one & two]
            if len(nodes):
                at.append(k), kept.append(nodes)
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int32())) for c in range(3)), lists], ["a", "b", "part", "nodes"])


def _walks(rows: DataFrame, kind, most: int) -> list[list[tuple] | None]:
    """Per number of hops from 0 the pairs of kinds that walks of so many edges join; None for all."""
    steps = [tuple(r) for r in rows.select(kind(F.col("u")), kind(F.col("v"))).distinct().limit(KINDS + 1).collect()] if kind else []
    if not kind or len(steps) > KINDS:
        return [None] * (most + 1)
    walks = [[(k, k) for k in {k for step in steps for k in step}]]
    for _ in range(most):
        walks.append(sorted({(x, w) for x, y in walks[-1] for v, w in steps if v == y}))
    return walks


def _joinable(pairs: DataFrame, kind, walks: list[list[tuple] | None]) -> DataFrame:
    """The pairs whose kinds some of the walks join."""
    if None in walks:
        return pairs
    return pairs.where(reduce(Column.__or__, [(kind(F.col("a")) == x) & (kind(F.col("b")) == y) for x, y in sorted({w for own in walks for w in own})], F.lit(False)))


def path_lengths(edges: DataFrame, pairs: DataFrame, most: int = 6, symmetric: bool = False, kind=None) -> DataFrame:
    """a, b, hops of many pairs (a, b) at once, along (u, v); null beyond ``most``, 0 where both are the same node.

    Frontiers go out from all first ends and, against the edges, from all last
    ends, by turns; a pair is met where its two reach one node, and ends that
    only met pairs have go no further.  Hops up to ``most`` so take half the
    depth from either end.  What the last hop reaches is not kept: it only has
    to meet the other end's frontier, whose signatures let few nodes pass.

    Neighbours and frontiers are lists of bounded length, so that a hop
    shuffles lists and not a row per node.  Edges are read more than once and
    should be a scan or a written table; rows may repeat.  ``symmetric`` edges
    go both ways, whichever is given.  ``kind`` is a function of a node, of few
    values: what kinds the edges join tells which pairs no walk of so many hops
    can join.
    """
    own = [pairs.schema[c].dataType for c in ("a", "b")]
    edges = edges.select("u", "v").where("u is not null and v is not null")
    wanted = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    if not isinstance(edges.schema["u"].dataType, IntegralType):  # nodes are numbered
        kind, named = None, edges.select(F.col("u").alias("node")).union(edges.select("v")).union(wanted.select("a")).union(wanted.select("b"))
        named = materialize(named.distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
        number = lambda df, c: df.join(named.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c).withColumnRenamed(f"{c}_id", c)
        plain = path_lengths(materialize(number(number(edges, "u"), "v"), "edges"), number(number(wanted, "a"), "b"), most, symmetric)
        back = lambda df, c: df.join(named.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node")), c).drop(c).withColumnRenamed(f"{c}_node", c)
        return back(back(plain, "a"), "b").select("a", "b", "hops")
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    against = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges, against = (edges.union(against),) * 2 if symmetric else (edges, against)
    wanted = materialize(wanted.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "pairs")
    walks = _walks(edges, kind, most)
    met = materialize(wanted.where("a = b").select("a", "b", F.lit(0).alias("hops")), "met")
    left = wanted.where("a <> b")
    # No list is longer than LIST, about: of what an end reaches, the parts grow with the greatest degree.
    sums = [df.groupBy(F.pmod(F.xxhash64("u"), F.lit(SUMS)).alias("k")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first() for df in ([edges] if symmetric else [edges, against])]
    depth = max(1, most // 2)
    parts = 1 + min(max(x[0] or 0 for x in sums) ** depth, sums[0][1] or 0) // LIST
    near = {"a": materialize(_lists(edges, parts), "near")}
    near["b"] = near["a"] if symmetric else materialize(_lists(against, parts), "near")
    sides: dict[str, list[DataFrame]] = {}
    for end in ("a", "b"):
        start = left.select(F.col(end).alias("end")).distinct()
        sides[end] = [materialize(start.select("end", _part(F.col("end"), parts).alias("part"), F.array("end").alias("nodes"), F.lit(0).alias("depth")), "side")]
    for hops in range(1, most + 1):
        end, other = ("a", "b") if hops % 2 else ("b", "a")
        asked = _joinable(left, kind, [walks[hops]])
        if hops == most:
            found = _last_hop(asked, sides["a"][-1], sides["b"][-1], near)
            met = met.union(materialize(found.withColumn("hops", F.lit(hops)), "met"))
            break
        going = _joinable(left, kind, walks[hops:]).select(F.col(end).alias("end")).distinct()
        reached = _reached(sides[end], going, near[end], parts)
        sides[end].append(materialize(reached.withColumn("depth", F.lit((hops + 1) // 2)), "side"))
        found = materialize(_met(asked, end, sides[end][-1], other, sides[other][-1]).withColumn("hops", F.lit(hops)), "met")
        met = met.union(found)
        left = materialize(left.join(shuffled(found), ["a", "b"], "left_anti"), "left")
        if left.isEmpty():
            break
    rest = wanted.where("a <> b").join(shuffled(met.select("a", "b")), ["a", "b"], "left_anti").select("a", "b", F.lit(None).cast("int"))
    return met.union(rest).select(*[F.col(c).cast(t).alias(c) for c, t in zip(("a", "b"), own)], "hops")


def _reached(seen: list[DataFrame], going: DataFrame, near: DataFrame, parts: int) -> DataFrame:
    """end, part, nodes that one more hop from the last of ``seen`` reaches for the first time."""
    if len(seen) == 1:  # an end's own neighbours
        own = near.join(shuffled(going.select(F.col("end").alias("u"))), "u", "left_semi")
        return own.select(F.col("u").alias("end"), "part", F.array_remove("nodes", F.col("u")).alias("nodes")).where(F.size("nodes") > 0)
    nodes = seen[-1].join(shuffled(going), "end", "left_semi").select("end", F.explode("nodes").alias("node"))
    step = nodes.join(shuffled(near.select(F.col("u").alias("node"), "nodes")), "node").select(F.col("end").alias("u"), F.explode("nodes").alias("v"))
    reached = _lists(step, parts).withColumnRenamed("u", "end")
    for before in seen:
        old = before.select("end", "part", F.col("nodes").alias("old"))
        reached = reached.join(shuffled(old), ["end", "part"], "left").select("end", "part", F.when(F.col("old").isNull(), F.col("nodes")).otherwise(F.array_except("nodes", "old")).alias("nodes"))
    return reached.where(F.size("nodes") > 0)


def _met(asked: DataFrame, end: str, frontier: DataFrame, other: str, there: DataFrame) -> DataFrame:
    """a, b of the pairs whose two frontiers have a node in common; ``there`` should be the smaller."""
    with_there = asked.join(shuffled(there.select(F.col("end").alias(other), "part", F.col("nodes").alias("there"))), other)
    both = with_there.join(shuffled(frontier.select(F.col("end").alias(end), "part", "nodes")), [end, "part"])
    return both.where(F.arrays_overlap("nodes", "there")).select("a", "b").distinct()


def _last_hop(asked: DataFrame, a: DataFrame, b: DataFrame, near: dict[str, DataFrame]) -> DataFrame:
    """a, b of the pairs of whose frontiers some edge joins a node of the one to a node of the other.

    The side with fewer nodes takes the hop, with signatures of the other.
    """
    size = {c: asked.join(shuffled(side.groupBy(F.col("end").alias(c)).agg(F.sum(F.size("nodes")).alias("n"))), c).agg(F.sum("n")).first()[0] or 0 for c, side in (("a", a), ("b", b))}
    going, there = ("a", "b") if size["a"] <= size["b"] else ("b", "a")
    frontier, other = (a, b) if going == "a" else (b, a)
    signed = other.select("end", "part", "nodes").mapInArrow(_signed, "end long, part int, signature binary").withColumnRenamed("end", there)
    nodes = asked.join(shuffled(frontier.select(F.col("end").alias(going), "nodes")), going).select("a", "b", F.explode("nodes").alias("u"))
    asks = nodes.join(shuffled(signed), there)
    stepped = asks.join(shuffled(near[going]), ["u", "part"]).select("a", "b", "part", "signature", "nodes")
    passed = stepped.mapInArrow(_sifted, "a long, b long, part int, nodes array<long>")
    both = passed.join(shuffled(other.select(F.col("end").alias(there), "part", F.col("nodes").alias("there"))), [there, "part"])
    return both.where(F.arrays_overlap("nodes", "there")).select("a", "b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over both ends."""
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def ready(nodes: DataFrame) -> DataFrame:
    """id of the pending nodes (id, status, depends_on array) all of whose dependencies are completed."""
    needs = nodes.where("status = 'pending'").select("id", F.explode_outer("depends_on").alias("need"))
    done = nodes.select(F.col("id").alias("need"), (F.col("status") == "completed").alias("done"))
    met = F.col("need").isNull() | F.coalesce("done", F.lit(False))
    return needs.join(done, "need", "left").groupBy("id").agg(F.bool_and(met).alias("ok")).where("ok").select("id")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """importer, name, path: exact dotted name, else longest dotted prefix, else a base name that is unique.

    ``imports``: importer, name; ``modules``: path, dotted, base.  Ambiguous
    base names resolve to the importer's folder if it has one, else to none.
    """
    parts = F.split("name", r"\.")
    options = imports.select("importer", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("dotted")))).alias("o"))
    dotted = options.select("importer", "name", F.col("o.n").alias("n"), F.col("o.dotted").alias("dotted")).join(modules.select("dotted", "path"), "dotted")
    best = dotted.groupBy("importer", "name").agg(F.max_by("path", "n").alias("path"))
    rest = imports.join(best, ["importer", "name"], "left_anti").withColumn("base", F.element_at(parts, -1))
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    own = folder(F.col("path")) == folder(F.col("importer"))
    named = rest.join(modules.select("base", "path"), "base").groupBy("importer", "name").agg(F.count("*").alias("n"), F.min("path").alias("one"), F.min(F.when(own, F.col("path"))).alias("near"))
    named = named.select("importer", "name", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("near")).alias("path")).where("path is not null")
    return best.unionByName(named)
