"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

Lines are compared with white space made single.  The texts are split once and
read again at the end:

1. Every line becomes a row of its text and two hashes: of the line as it is and
   of its leaf in the tree, which is its token count and its leading tokens with
   digits masked.  Lines that recur as they are go at ``min_docs`` documents, long
   ones at ``exact_docs``.
2. Lines of leaves that recur are read from these rows and masked.  Within a
   leaf, a token is constant when at least ``min_docs`` distinct documents have
   it at its place, and any other is variable, which makes a line's template.
   Templates with enough constant tokens in ``min_docs`` distinct documents are
   boilerplate.
3. Such lines are dropped from all documents but the first of their line or
   template, so that a group of copies never loses its text altogether.

Passes 2 and 3 skip lines and texts that cannot be concerned by bitmaps of
fixed size, so only candidate lines and the texts that change are shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.bitmap import in_bitmap, plan_bitmap
from loomwork.llm.names import fresh
from loomwork.plans.storage import materialize

MASK = "<*>"
LEADING = 3
_NO_ID = (1 << 63) - 1
#: White space but the line feed, and the characters that make a look at it worthwhile.
BLANKS = r"[\t\x0B\f\r \x{85}\p{Z}]+"
RARE_BLANKS, FOREIGN_BLANKS = ("\t", "\r", "  ", "\x0b", "\f"), r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{206f}\x{3000}]"
#: Twenty letters of scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = r"(?:[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿][^\n]{0,2}?){20}"


def plain_lines(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, pos, line: the lines of ``text`` that are not empty, trimmed, with single spaces for any white space.

    ``keep`` is worked out once a row, before the text is split.
    """
    text = F.coalesce("text", F.lit(""))
    odd = reduce(or_, [text.contains(blank) for blank in RARE_BLANKS]) | ((F.octet_length(text) > F.length(text)) & text.rlike(FOREIGN_BLANKS))
    split = docs.select(*keep, F.split(F.when(odd, F.regexp_replace(text, BLANKS, " ")).otherwise(text), "\n").alias("lines"))
    # Without "outer" Spark adds a filter on the size of the lists, for which it splits every text once more.
    return split.select(*split.columns[:-1], F.posexplode_outer("lines").alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def n_tokens(line: Column) -> Column:
    return F.size(F.split(line, " "))


def masked(line: Column) -> Column:
    """Tokens with a digit become MASK."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", MASK)).otherwise(line)


def leaf(line: Column, n: Column, min_tokens: int) -> Column:
    """Hash of the token count and the masked leading tokens; null for lines of too few tokens."""
    return F.when(n >= min_tokens, F.xxhash64(n, masked(F.substring_index(line, " ", LEADING))))


def _key() -> list[Column]:
    """Two hashes that stand for a document: rows of equal id and text are treated alike."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2")]


def _two(*of: Column | str) -> list[Column]:
    return [F.xxhash64(*of), F.xxhash64(F.lit(7), *of)]


def _lines(docs: DataFrame, min_tokens: int, long_tokens: int) -> DataFrame:
    """doc, k1, k2, pos, long, a, b (hashes of the line), leaf, line (where it has a leaf) of every line that is not empty."""
    own = F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc")
    lines = plain_lines(docs, own, *_key()).withColumn("n", n_tokens(F.col("line")))
    a, b = _two("line")
    long = (F.col("n") >= long_tokens) | ((F.octet_length("line") - F.length("line") >= 40) & F.col("line").rlike(UNSPACED))
    place = leaf(F.col("line"), F.col("n"), min_tokens).alias("leaf")
    return lines.select("doc", "k1", "k2", "pos", long.alias("long"), a.alias("a"), b.alias("b"), place, F.when(F.col("n") >= min_tokens, F.col("line")).alias("line"))


def _exact(lines: DataFrame, min_docs: int, exact_docs: int) -> DataFrame:
    """a, b, keeper of the lines that recur as they are."""
    once = lines.groupBy("a", "b", "long", "k1", "k2").agg(F.min("doc").alias("doc"))
    known = once.groupBy("a", "b", "long").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"))
    return known.where(F.col("n") >= F.when(F.col("long"), exact_docs).otherwise(min_docs)).select("a", "b", "keeper")


def _templates(lines: DataFrame, min_docs: int, min_tokens: int, min_constant: float) -> DataFrame:
    """k1, k2, pos, doc, keeper of the lines of recurring templates."""
    leaves = lines.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.min("k1").alias("least"), F.max("k1").alias("most"))
    leaves = leaves.where((F.col("n") >= min_docs) & (F.col("least") != F.col("most"))).select("leaf")
    bits = materialize(plan_bitmap(leaves, "leaf"), "leaves")
    read = lines.where(in_bitmap(F.col("leaf"), bits)).select("doc", "k1", "k2", "pos", "line", "leaf")
    ma, mb = _two("leaf", "line")
    read = read.withColumn("line", masked(F.col("line"))).withColumns({"ma": ma, "mb": mb})
    # The line of one document stands for those of all.
    read = materialize(read, "candidates")
    words = read.groupBy("ma", "mb").agg(F.min(F.struct("doc", "k1", "k2", "pos")).alias("one"))
    words = words.select("ma", "mb", "one.*").join(read.select("k1", "k2", "pos", "leaf", "line").distinct(), ["k1", "k2", "pos"]).select("ma", "mb", "leaf", "line")
    # At most min_docs documents stand for those of a line: whether a union of such sets has min_docs is the same.
    first = Window.partitionBy("ma", "mb").orderBy("doc", "k1", "k2")
    own = read.select("ma", "mb", "doc", "k1", "k2").distinct()
    own = own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= min_docs)
    own = own.groupBy("ma", "mb").agg(F.min("doc").alias("first"), F.collect_list("k1").alias("docs"))
    each = materialize(words.join(own, ["ma", "mb"]), "masked")
    tokens = each.select("leaf", "ma", "mb", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    apart = tokens.where(F.col("token") != MASK).select("leaf", "pos", "token", F.explode("docs").alias("k")).distinct()
    constant = apart.groupBy("leaf", "pos", "token").count().where(F.col("count") >= min_docs).select("leaf", "pos", "token", F.lit(True).alias("constant"))
    constant = materialize(constant, "constant")  # a join of two plain shuffles can split a hot token
    marked = tokens.drop("docs").join(constant, ["leaf", "pos", "token"], "left")
    word = F.struct("pos", F.when(F.col("constant"), F.col("token")).otherwise(MASK).alias("token"))
    formed = marked.groupBy("ma", "mb").agg(F.sort_array(F.collect_list(word)).alias("words"), F.count_if("constant").alias("kept"), F.count_if(F.col("constant") & (F.col("pos") >= LEADING)).alias("beyond"))
    enough = (F.col("kept") >= F.least(F.lit(min_tokens), F.size("words"))) & (F.col("kept") >= min_constant * F.size("words")) & (F.col("beyond") > 0)
    ta, tb = _two("words")
    formed = formed.where(enough).select("ma", "mb", ta.alias("ta"), tb.alias("tb"))
    formed = materialize(formed.join(each.select("ma", "mb", "first", "docs"), ["ma", "mb"]), "formed")
    support = formed.select("ta", "tb", F.explode("docs").alias("k")).distinct().groupBy("ta", "tb").count().where(F.col("count") >= min_docs)
    keeper = formed.groupBy("ta", "tb").agg(F.min("first").alias("keeper"))
    known = formed.select("ma", "mb", "ta", "tb").join(support.select("ta", "tb").join(keeper, ["ta", "tb"]), ["ta", "tb"]).select("ma", "mb", "keeper")
    return read.select("ma", "mb", "k1", "k2", "pos", "doc").join(materialize(known, "templates"), ["ma", "mb"])


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, min_constant: float = 0.6, exact_docs: int = 2, long_tokens: int = 10) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the lines that recur; n_lines and n_dropped are added.

    A line of any length that is in ``min_docs`` rows as it is goes, and in
    ``exact_docs`` rows if it has ``long_tokens`` tokens or twenty letters of a
    script without spaces.  So do lines of a template, of at least
    ``min_tokens`` tokens, ``min_constant`` of them constant and one of these
    past the leading ones, in ``min_docs`` rows.  Rows of equal id and text
    count once; tokens are parted by any white space; empty lines stay; the
    remaining lines stay as they were.  The row of the smallest doc_id keeps
    its copy (a null id counts as the largest; rows of one id keep theirs
    alike).  Null text stays null with no lines; columns named n_lines and
    n_dropped are replaced; no rows give no rows.
    """
    docs = docs.withColumn("text", F.col("text").cast("string")).drop("n_lines", "n_dropped")
    slim = docs.select("doc_id", "text")
    lines = materialize(_lines(slim, min_tokens, long_tokens), "lines")
    exact = materialize(_exact(lines, min_docs, exact_docs), "exact")
    gone = lines.join(exact, ["a", "b"]).where("doc <> keeper").select("k1", "k2", "pos")
    gone = gone.union(_templates(lines, min_docs, min_tokens, min_constant).where("doc <> keeper").select("k1", "k2", "pos"))
    key, other, lost = fresh(docs.columns, "_key", "_other", "_gone")
    gone = materialize(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias(lost)), "gone")
    own = docs.select("*", F.struct(*_key()).alias(key))
    changes = in_bitmap(F.col(f"{key}.k1"), materialize(plan_bitmap(gone, "k1"), "changed"))
    joined = own.where(changes).join(gone.select(F.struct("k1", "k2").alias(other), lost), F.col(key) == F.col(other), "left").drop(other)
    same = own.where(~changes).withColumn(lost, F.lit(None).cast("array<int>"))
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(F.col(lost), i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)
    counts = {"n_lines": F.coalesce(F.size(split), F.lit(0)), "n_dropped": F.coalesce(F.array_size(lost), F.lit(0))}
    return joined.unionByName(same).select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *[v.cast("long").alias(k) for k, v in counts.items()])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id, 9223372036854775807) AS doc, hash(doc_id, text) AS k FROM documents),
s AS (SELECT r, doc, k, string_split(coalesce(text, ''), chr(10)) AS ls FROM d),
l AS (SELECT * FROM (SELECT r, doc, k, i AS pos, trim(regexp_replace(ls[i], '[\t\x0B\f\r \x{{85}}\p{{Z}}]+', ' ', 'g'), ' ') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)) WHERE line <> ''),
t AS (SELECT *, string_split(line, ' ') AS ws FROM l),
e AS (SELECT line, min(doc) AS keeper FROM t GROUP BY line, ws HAVING count(DISTINCT k) >= CASE WHEN len(ws) >= 10 OR regexp_matches(line, '{UNSPACED}') THEN 2 ELSE 5 END),
m AS (SELECT r, doc, k, pos, list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws FROM t WHERE len(ws) >= 3),
n AS (SELECT ws, list(DISTINCT k) AS ks, min(doc) AS first FROM m GROUP BY ws),
p AS (SELECT ws, ks, len(ws) AS n, list_slice(ws, 1, 3) AS head, unnest(range(1, len(ws) + 1)) AS pos FROM n),
c AS (SELECT n, head, pos, token FROM (SELECT n, head, pos, ws[pos] AS token, unnest(ks) AS k FROM p) WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT k) >= 5),
f AS (SELECT ws, ks, count(c.token) AS kept, count(c.token) FILTER (WHERE p.pos > 3) AS beyond, list(coalesce(c.token, '<*>') ORDER BY p.pos) AS template
      FROM p LEFT JOIN c ON p.n = c.n AND p.head = c.head AND p.pos = c.pos AND p.ws[p.pos] = c.token GROUP BY ws, ks),
g AS (SELECT template FROM (SELECT template, unnest(ks) AS k FROM f WHERE kept >= 3 AND kept >= 0.6 * len(ws) AND beyond > 0) GROUP BY template HAVING count(DISTINCT k) >= 5),
h AS (SELECT f.ws, min(n.first) OVER (PARTITION BY f.template) AS keeper FROM f JOIN g USING (template) JOIN n ON n.ws = f.ws WHERE kept >= 3 AND kept >= 0.6 * len(f.ws) AND beyond > 0),
x AS (SELECT t.r, t.pos FROM t JOIN e USING (line) WHERE t.doc <> e.keeper UNION SELECT m.r, m.pos FROM m JOIN h USING (ws) WHERE m.doc <> h.keeper),
y AS (SELECT r, list(pos) AS gone FROM x GROUP BY r)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda s, i: NOT list_contains(gone, i)), chr(10)) END AS text,
       coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN y USING (r)
"""
