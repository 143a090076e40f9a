"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class.  If two sets have a Jaccard
similarity of at least t, then under any common order of shingles each has
one of the other's among its first ``n - ceil(t n) + 1``: its prefix.  The
order puts frequent shingles last, so a passage that many documents share is
in the prefix only of documents that consist of little else.

1. Two passes count prefix shingles and name the frequent ones; a third writes
   each document's class and prefix.
2. Every shared shingle has a leader, and classes are compared with their
   leaders first.  That makes components of most families of near copies, in a
   number of comparisons that grows with the classes and not with their square.
3. What is still apart goes through the matrix, whatever its shingles: classes
   that share shingles with other components are partitioned into groups of
   similar sizes and a bounded number of shingles.  (shingle, group) rows state
   each group's prefix union; the rows that a query meets are summed per group;
   and a group is opened only if the sum reaches the overlap that the sizes
   require.  Members of an opened group are found through its shingles.

No step builds the pairs of a group, and a hot shingle is summed before it is
shuffled or split over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.bitmap import in_bitmap, plan_bitmap
from loomwork.llm.names import fresh
from loomwork.llm.shingles import distinct, mix, shingle_hashes, word_hashes
from loomwork.operators.components import connected_components
from loomwork.plans.storage import materialize, small_side

#: A shingle in more prefixes than this is frequent, or than the least power of two that leaves at most MOST_FREQUENT.
FREQUENT = 64
MOST_FREQUENT = 1 << 21
#: Classes and shingles of a matrix group, and the size from which a component has groups of its own.
GROUP, GROUP_SHINGLES, LARGE = 512, 1 << 20, 64


def needed(n: int, percent: int) -> int:
    """Length of the prefix of a set of ``n``."""
    return n - -(-percent * n // 100) + 1


def _set(text: str) -> np.ndarray:
    return distinct(shingle_hashes(word_hashes(text)))


def class_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a shingle set."""
    both = np.array([np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles ^ np.uint64(0x9E37))) + np.uint64(len(shingles))])
    return int(np.bitwise_xor.reduce(mix(both + np.arange(2, dtype=np.uint64))).astype(np.int64))


class Members:
    """Membership in a sorted array of hashes; most hashes are told apart by their leading bits."""

    def __init__(self, known: np.ndarray):
        self.known, self.maybe = known, np.zeros(1 << 22, bool)
        self.maybe[known >> np.uint64(42)] = True

    def __call__(self, own: np.ndarray) -> np.ndarray:
        found = self.maybe[own >> np.uint64(42)]
        if found.any():
            asked = own[found]
            found[found] = self.known[np.minimum(np.searchsorted(self.known, asked), len(self.known) - 1)] == asked
        return found


def _tokens(percent: int, frequent):
    """Shingles to count: plain prefixes; with ``frequent``, all shingles of texts with these in a tenth of their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(frequent.value) if frequent else None
        for batch in batches:
            found, size = [], 0
            for text in batch.column(0):
                own = _set(text.as_py() or "")
                prefix = own[: needed(len(own), percent)] if len(own) else own
                if known is None:
                    found.append(prefix)
                elif 10 * known(prefix).sum() > len(prefix):
                    found.append(own)
                else:
                    continue
                size += len(found[-1])
                if size > 1_000_000:
                    yield _column(found)
                    found, size = [], 0
            yield _column(found)

    return run


def _column(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64))], ["token"])


def frequent_shingles(texts: DataFrame, percent: int, least: int = FREQUENT) -> np.ndarray:
    """At most MOST_FREQUENT of the shingles that many prefixes hold; any set of them leaves the join exact."""
    spark = texts.sparkSession

    def over(known) -> np.ndarray:
        counts = texts.mapInArrow(_tokens(percent, known), "token long").groupBy("token").count().where(F.col("count") > least)
        counts = materialize(counts, "frequent")
        scale = F.floor(F.log2(F.col("count").cast("double"))).cast("int")
        classes = sorted(counts.groupBy(scale.alias("scale")).count().collect(), reverse=True)
        taken, floor = 0, 64
        for level, n in classes:
            if taken + n > MOST_FREQUENT // 2:
                break
            taken, floor = taken + n, level
        return np.sort(counts.where(scale >= floor).select("token").toArrow()["token"].to_numpy().astype(np.uint64))

    first = over(None)
    return np.union1d(first, over(spark.sparkContext.broadcast(first)))


def _prefixes(percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(frequent.value)
        for batch in batches:
            sizes, classes, light, heavy = [], [], [], []
            for text in batch.column("text"):
                own = _set(text.as_py() or "")
                often = known(own)
                p = needed(len(own), percent) if len(own) else 0
                first = own[~often][:p]
                sizes.append(len(own)), classes.append(class_id(own) if len(own) else None)
                light.append(first.astype(np.int64)), heavy.append(own[often][: p - len(first)].astype(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(light, longs), pa.array(heavy, longs)],
                ["doc_id", "k1", "k2", "n_shingles", "cid", "light", "heavy"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, cid): token, cid, n, leader, size of the tokens of two classes or more."""
    names = ["token", "cid", "n", "leader", "size"]
    token, cid, n, times = (np.zeros(0, np.int64) for _ in range(4))

    def finished(token, cid, n, times) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(token)])
        most = np.repeat(np.maximum.reduceat(times, starts), size) if len(token) else times
        group = np.repeat(np.arange(len(starts)), size)
        top = np.flatnonzero(times == most)
        _, first = np.unique(group[top], return_index=True)  # the class of most copies leads; the least of equal ones
        leader, many = np.repeat(cid[top[first]], size) if len(token) else cid, np.repeat(size, size) >= 2
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, cid, n, leader, np.repeat(size, size).astype(np.int64))], names)

    for batch in batches:
        token = np.r_[token, batch.column("token").to_numpy()]
        cid, n, times = np.r_[cid, batch.column("cid").to_numpy()], np.r_[n, batch.column("n").to_numpy()], np.r_[times, np.ones(batch.num_rows, np.int64)]
        new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])])
        token, cid, n, times = token[new], cid[new], n[new], np.add.reduceat(times, new) if len(new) else times
        cut = np.searchsorted(token, token[-1]) if len(token) else 0
        yield finished(token[:cut], cid[:cut], n[:cut], times[:cut])
        token, cid, n, times = token[cut:], cid[cut:], n[cut:], times[cut:]
    yield finished(token, cid, n, times)


def shared_needed(n: int, m: int, percent: int) -> int:
    """Shingles that the prefixes of sets of n and m must share for a link; 0 or less: no claim; sizes apart: never.

    Beyond the earlier of the two prefix ends the sets can share what the set
    of that prefix has left, ``ceil(t n) - 1``.
    """
    if 100 * min(n, m) < percent * max(n, m):
        return n + m
    overlap = -(-percent * (n + m) // (100 + percent))
    return overlap - (max(n, m) - needed(max(n, m), percent))


def least_shared(n: Column, least: Column, most: Column, percent: int) -> Column:
    """A bound from below on ``shared_needed`` of a set of n and any of ``least`` to ``most``; null where no size fits."""
    up = lambda x, y: F.ceil(x / y)

    def at(m: Column) -> Column:
        larger = F.greatest(n, m)
        return up(percent * (n + m), F.lit(100 + percent)) - up(percent * larger, F.lit(100)) + 1

    low, high = F.greatest(least, up(percent * n, F.lit(100))), F.least(most, F.floor(100 * n / percent))
    # It rises up to m = n and falls from there, but for steps of one.
    return F.when(low <= high, F.greatest(F.lit(1), F.least(at(low), at(high)) - 1))


def promising(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sizes and prefixes allow a link."""
    ends = materialize(pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct(), "asked")
    prefixes = rows.join(small_side(ends), "cid", "left_semi").groupBy("cid").agg(F.first(F.struct("n_shingles", F.concat("light", "heavy").alias("prefix"))).alias("p"))
    prefixes = materialize(prefixes.select("cid", "p.n_shingles", "p.prefix"), "ends")

    def run(batches):
        for batch in batches:
            found = []
            for u, v, n, m, a, b in zip(*(batch.column(c) for c in ("u", "v", "n", "m", "a", "b"))):
                least = shared_needed(n.as_py(), m.as_py(), percent)
                if least < n.as_py() + m.as_py() and len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True)) >= least:
                    found.append((u.as_py(), v.as_py()))
            yield _pairs(found)

    sized = lambda end, n, p: prefixes.select(F.col("cid").alias(end), F.col("n_shingles").alias(n), F.col("prefix").alias(p))
    joined = sized("u", "n", "a").join(small_side(pairs), "u").join(sized("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b")
    return materialize(joined.mapInArrow(run, "u long, v long"), "promising")


def _pairs(found) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["cid", "tokens"]
    for batch in batches:
        classes, sets, size = [], [], 0
        for text in batch.column(0):
            own = _set(text.as_py() or "")
            if len(own):
                classes.append(class_id(own)), sets.append(own.tobytes())
                size += 8 * len(own)
            if size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names)
                classes, sets, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names)


def shingle_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """cid, tokens (sorted 64-bit shingles) of the classes in ``cids``, from one document of each.

    Texts that a bitmap of fixed size excludes are not hashed again.
    """
    wanted = materialize(classes.join(cids.distinct(), "cid").select("cid", "one.k1"), "wanted")
    bits = materialize(plan_bitmap(wanted, "k1"), "bits")
    sets = docs.where(in_bitmap(F.xxhash64("doc_id", "text"), bits)).select("text").mapInArrow(_sets, "cid long, tokens binary")
    return materialize(sets.join(small_side(wanted.select("cid")), "cid", "left_semi").dropDuplicates(["cid"]), "sets")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("u", "v", "a", "b")))
            yield _pairs([(u.as_py(), v.as_py()) for u, v, a, b in rows if _linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent)])

    first = sets.select(F.col("cid").alias("u"), F.col("tokens").alias("a")).join(small_side(pairs), "u")
    joined = first.join(sets.select(F.col("cid").alias("v"), F.col("tokens").alias("b")), "v").select("u", "v", "a", "b")
    return materialize(joined.mapInArrow(run, "u long, v long"), "links")


def _opened(percent: int):
    def run(key, members: pa.Table, queries: pa.Table) -> pa.Table:
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in members["tokens"]]
        cids, roots, sizes = members["cid"].to_pylist(), members["root"].to_numpy(), np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        union = np.unique(every)
        found = []
        for q, root, tokens in zip(queries["cid"].to_pylist(), queries["root"].to_pylist(), queries["tokens"]):
            own = np.frombuffer(tokens.as_buffer(), np.uint64)
            covered = own[union[np.minimum(np.searchsorted(union, own), len(union) - 1)] == own]
            if 100 * len(covered) < percent * len(own):  # no member can share more than the union does
                continue
            a, b = np.searchsorted(every, covered, "left"), np.searchsorted(every, covered, "right")
            hits = np.concatenate([owner[x:y] for x, y in zip(a, b)]) if len(covered) else owner[:0]
            both = np.bincount(hits, minlength=len(sets))
            ok = (100 * both >= percent * (sizes + len(own) - both)) & (roots != root)
            seen = set()
            for k in np.flatnonzero(ok):  # one link to each component is enough
                if roots[k] not in seen:
                    seen.add(roots[k])
                    found.append((q, cids[k]))
        return pa.Table.from_batches([_pairs(found)])

    return run


def unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """token, cid, n, heavy, root of the shared shingles that classes of two components or more have.

    ``shared``: token, cid, n, heavy of shingles in three prefixes or more (of
    two, one is the leader, and they have been compared).  Pairs that have not
    been compared have all the shingles that they share among these.
    """
    rooted = shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = materialize(rooted, "rooted")
    apart = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
    return materialize(rooted.join(materialize(apart, "apart"), "token", "left_semi"), "unsettled")


def matrix_meetings(rows: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, queries) of the groups to open, by (group, share): rows of cid and root.

    ``rows``: of ``unsettled``.  Large components have groups of their own and
    are not queried by themselves: the smaller side of any two components
    asks, members of small ones ask everywhere.
    """
    sizes = materialize(roots.groupBy("root").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.12)))
    key = F.coalesce(F.min(F.when(F.col("heavy"), F.col("token"))), F.min("token"))  # families of near copies share their least frequent shingle
    first = rows.groupBy("cid", "root", "n").agg(key.alias("key")).join(sizes, "root", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    own = materialize(first.withColumns({"own": F.when(F.col("members") > LARGE, F.col("root")), "band": band}), "own")
    counts = own.groupBy(F.col("key").alias("_key"), F.col("own").alias("_own"), F.col("band").alias("_band")).agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    counts = counts.withColumn("parts", F.greatest(F.ceil(F.col("classes") / GROUP), F.ceil(F.col("shingles") / GROUP_SHINGLES)))
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("own").eqNullSafe(F.col("_own")) & F.col("band").eqNullSafe(F.col("_band"))
    grouped = own.join(materialize(counts, "counts"), same).select("cid", "root", "n", "members", "own", F.xxhash64("key", "own", "band", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("group"))
    grouped = materialize(grouped, "groups")
    limits = grouped.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("own").alias("own"), F.max("members").alias("weight"), F.min("root").alias("one"), F.max("root").alias("other"))
    limits = materialize(limits, "limits")
    placed = materialize(rows.select("token", "cid").join(grouped.select("cid", "root", "n", "members", "group"), "cid"), "placed")
    matrix = materialize(placed.select("token", "group").distinct().join(limits, "group"), "matrix")
    asking = placed.select("token", "cid", "root", "n", "members")
    # A group of classes of one component only has nothing to say to a query of that component.
    open_to = (F.col("one") != F.col("other")) | (F.col("one") != F.col("root"))
    mixed = F.col("own").isNull() & (F.col("members") <= LARGE)
    larger = F.col("own").isNotNull() & (F.struct("members", "root") < F.struct(F.col("weight").alias("members"), F.col("own").alias("root")))
    needed_ = least_shared(F.col("n"), F.col("least"), F.col("most"), percent)
    met = asking.join(matrix, "token").where(open_to & (mixed | larger) & needed_.isNotNull())
    met = met.groupBy("cid", "root", "n", "group", "least", "most").agg(F.count("*").alias("shared")).where(F.col("shared") >= needed_)
    met = materialize(met.select("cid", "root", "n", "group"), "met")
    asked = met.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / (8 * GROUP)), F.ceil(F.sum("n") / (4 * GROUP_SHINGLES))).alias("shares"))
    asked = materialize(asked, "asked")
    queries = met.join(asked, "group").select("group", "cid", "root", F.pmod(F.xxhash64("cid"), F.col("shares")).alias("share"))
    members = grouped.join(asked, "group").select("group", "cid", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    return materialize(members, "members"), materialize(queries, "queries")


def group_links(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between queries and members of the groups that they meet."""
    left = sets.join(small_side(members), "cid").select("group", "share", "cid", "root", "tokens")
    right = sets.join(small_side(queries), "cid").select(*[F.col(c).alias(c) for c in ("group", "share", "cid", "root", "tokens")])  # columns of their own
    return materialize(left.groupBy("group", "share").cogroup(right.groupBy("group", "share")).applyInArrow(_opened(percent), "u long, v long"), "links")


def _keys() -> list:
    """Two hashes that stand for a row: its id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2")]


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links; texts link, so
    rows of one id and different texts may have different components; a null
    id never names a component that has another.  Null and empty texts have no shingles and no links.  Other
    columns are ignored; no rows give no rows.  A class is named by 64 bits of
    hash: among n distinct sets two share a name with probability n^2 / 2^65.
    """
    return _components(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) without near copies of others.

    The row of each component's smallest doc_id stays, one of them where that
    id repeats; rows without shingles and components without any id stay.
    """
    a, b = fresh(docs.columns, "_k1", "_k2")
    keyed = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(7), "doc_id")})
    found = materialize(_components(docs, percent).where("component_id is not null and n_shingles > 0"), "components")
    keepers = found.where("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    gone = found.select("k1", "k2").distinct().join(keepers, ["k1", "k2"], "left_anti").select(F.col("k1").alias(a), F.col("k2").alias(b))
    return keyed.join(gone, [a, b], "left_anti").dropDuplicates([a, b]).select(*docs.columns)


def _components(docs: DataFrame, percent: int) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(slim.select("text"), percent))
    rows = materialize(slim.select("doc_id", *_keys(), "text").mapInArrow(_prefixes(percent, frequent), "doc_id long, k1 long, k2 long, n_shingles long, cid long, light array<long>, heavy array<long>"), "prefixes")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("k1", "k2")).alias("one"))
    classes = materialize(classes, "classes")
    light = rows.select(F.explode("light").alias("token"), "cid", F.col("n_shingles").alias("n")).repartition("token").sortWithinPartitions("token", "cid")
    light = materialize(light.mapInArrow(_groups, "token long, cid long, n long, leader long, size long"), "light")
    heavy = rows.select(F.explode("heavy").alias("token"), "cid", F.col("n_shingles").alias("n")).groupBy("token", "cid", "n").agg(F.count("*").alias("copies"))
    heavy = materialize(heavy, "heavy")
    leaders = materialize(heavy.groupBy("token").agg(F.max_by("cid", F.struct("copies", -F.col("cid"))).alias("leader"), F.count("*").alias("size")).where("size > 1"), "leaders")
    led = materialize(heavy.join(leaders, "token"), "led")
    stars = light.select("cid", "leader").union(led.select("cid", "leader")).where("cid <> leader")
    stars = materialize(stars.select(F.least("cid", "leader").alias("u"), F.greatest("cid", "leader").alias("v")).distinct(), "pairs")
    near = promising(stars, rows, percent)
    ends = near.select(F.col("u").alias("cid")).union(near.select("v"))
    links = verified(near, shingle_sets(slim, classes, ends), percent)
    roots = materialize(connected_components(links), "roots")
    shared = light.where("size > 2").select("token", "cid", "n", F.lit(False).alias("heavy")).union(led.where("size > 2").select("token", "cid", "n", F.lit(True).alias("heavy")))
    members, queries = matrix_meetings(unsettled(shared, roots), roots, percent)
    if queries.take(1):
        sets = shingle_sets(slim, classes, members.select("cid").union(queries.select("cid")))
        links = links.union(group_links(members, queries, sets, percent))
        roots = connected_components(links)
    named = materialize(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("root", "cid").alias("root")), "named")
    names = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    component = named.join(names, "root").select("cid", "component_id")
    return rows.join(component, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "k1", "k2")
