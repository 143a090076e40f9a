"""Materials: process descriptions, normal forms of names, package segments, suppliers, searches, nested standards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.parsing import number_in


def _named(parts: Column, names: Sequence[str]) -> Column:
    return F.struct(*[F.coalesce(F.trim(F.get(parts, k)), F.lit("")).alias(n) for k, n in enumerate(names)])


#: process -> names of the slash-separated parts of its description.
PROCESSES = {"DIE": ("process", "tool", "glue", "thickness"), "WIRE": ("process", "tool", "wire", "diameter"), "MOLD": ("process", "tool", "compound", "weight")}


def process_description(text: Column) -> Column:
    """struct(kind, fields as a map, wire): by the first part; ``wire`` is the first part that names a wire, null if none does."""
    parts = F.split(text, "/")
    head = F.upper(F.trim(F.get(parts, F.lit(0))))
    kind, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for name, names in PROCESSES.items():
        own = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.trim(F.get(parts, k)), F.lit("")) for k in range(len(names))]))
        kind, fields = F.when(head.startswith(name), name).otherwise(kind), F.when(head.startswith(name), own).otherwise(fields)
    wire = F.get(F.filter(parts, lambda p: F.upper(p).contains("WIRE")), F.lit(0))
    return F.struct(kind.alias("kind"), fields.alias("fields"), F.trim(wire).alias("wire"))


def normal_form(text: Column, table: Sequence[tuple[str, Sequence[str]]], otherwise: Column | None = None) -> Column:
    """The name whose list of words has one that the upper-cased text contains; the text itself, or ``otherwise``, if none has."""
    out = F.upper(F.trim(text)) if otherwise is None else otherwise
    for name, words in reversed(table):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.upper(text).contains(word.upper())
        out = F.when(hit, name).otherwise(out)
    return out


def package_segment(code: Column, special: dict[str, str], families: dict[str, str]) -> Column:
    """struct(mode, name) of a six-part code's first segment by the first of four modes that fits.

    In order: an entry of its own; a family by the first three letters with
    pins in the rest; a family by the first two; three digits as a number of pins.
    """
    own = F.upper(F.trim(code))
    entry = lambda table, key: F.coalesce(*[F.when(key == k, v) for k, v in table.items()], F.lit(None).cast("string"))
    pins = F.regexp_extract(own, r"(\d+)$", 1)
    three, two = entry(families, F.substring(own, 1, 3)), entry(families, F.substring(own, 1, 2))
    exact = entry(special, own)
    mode = F.when(exact.isNotNull(), "special").when(three.isNotNull() & (pins != ""), "family").when(two.isNotNull(), "short").when(own.rlike(r"^\d{3}"), "pins").otherwise("unknown")
    name = F.when(mode == "special", exact).when(mode == "family", F.concat_ws(" ", three, pins)).when(mode == "short", two).when(mode == "pins", F.concat(F.regexp_extract(own, r"^(\d{3})", 1), F.lit(" pins")))
    return F.struct(mode.alias("mode"), name.alias("name"))


def material_type(ident: Column, text: Column, prefixes: dict[str, str], words: dict[str, str]) -> Column:
    """By the prefix of the id, else by a word of the description, else other."""
    out = F.lit("other")
    for word, name in reversed(words.items()):
        out = F.when(F.upper(text).contains(word.upper()), name).otherwise(out)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(ident.startswith(prefix), name).otherwise(out)
    return out


def search_phrases(name: Column, kind: Column) -> Column:
    """Phrases to look a material up with, without blanks and repeats."""
    clean = F.trim(F.regexp_replace(name, r"[^\w.-]+", " "))
    phrases = F.array(clean, F.concat_ws(" ", clean, kind), F.concat_ws(" ", clean, F.lit("datasheet")), F.regexp_extract(clean, r"^\S+", 0))
    return F.filter(F.array_distinct(phrases), lambda p: F.trim(p) != "")


def description_values(text: Column, units: Sequence[str] = ("mil", "um", "mm", "g")) -> Column:
    """array of struct(name, value, unit): numbers with a unit, named by the word before them."""
    pattern = rf"([A-Za-z]+)?[ =:]*(\d+(?:\.\d+)?) ?({'|'.join(units)})\b"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    return F.transform(found, lambda x: F.struct(F.nullif(part(x, 1), F.lit("")).alias("name"), part(x, 2).cast("double").alias("value"), part(x, 3).alias("unit")))


def material_record(ident: Column, name: Column, text: Column, prefixes: dict[str, str], words: dict[str, str], suppliers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """struct(id, type, supplier, phrases, values): what is known of a material before any search."""
    kind = material_type(ident, text, prefixes, words)
    return F.struct(ident.alias("id"), kind.alias("type"), normal_form(name, suppliers, F.lit(None).cast("string")).alias("supplier"), search_phrases(name, kind).alias("phrases"), description_values(text).alias("values"))


def code_summary(parsed: Column, names: Sequence[str]) -> Column:
    """One line of the decoded segments."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), parsed[n]) for n in names])


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of the overlap of two rectangles (x0, y0, x1, y1), as a share of the smaller one; 0 if that has none."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, 0.0).otherwise(w * h / smaller)


def tier(path: Column, tiers: Sequence[tuple[str, str]]) -> Column:
    """The name of the first prefix that a path has, else other."""
    out = F.lit("other")
    for prefix, name in reversed(tiers):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def test_requirements(standards: DataFrame, test: str | None = None) -> DataFrame:
    """standard, group, test_id, limit of the tests nested in standards (id, groups array of (name, tests array of (id, limit)))."""
    groups = standards.select(F.col("id").alias("standard"), F.explode("groups").alias("g"))
    tests = groups.select("standard", F.col("g.name").alias("group"), F.explode("g.tests").alias("t")).select("standard", "group", F.col("t.id").alias("test_id"), F.col("t.limit").alias("limit"))
    return tests if test is None else tests.where(F.col("test_id") == test)


def store_search(store: DataFrame, kind: str | None = None, maker: str | None = None, keyword: str | None = None) -> DataFrame:
    """Entries of a store by type or subtype, by a part of the maker's name, by a word anywhere in the entry."""
    found = store
    if kind is not None:
        found = found.where((F.col("type") == kind) | (F.col("subtype") == kind))
    if maker is not None:
        found = found.where(F.lower("maker").contains(maker.lower()))
    if keyword is not None:
        found = found.where(F.lower(F.to_json(F.struct(*[F.col(c) for c in store.columns]))).contains(keyword.lower()))
    return found


def code_search(tables: dict[str, DataFrame], wanted: dict[str, str]) -> DataFrame:
    """segment, code, meaning of the code tables (code, meaning) that contain what is wanted of their segment, case ignored."""
    out = None
    for segment, text in wanted.items():
        hit = tables[segment].where(F.lower("meaning").contains(text.lower()) | F.lower("code").contains(text.lower())).select(F.lit(segment).alias("segment"), "code", "meaning")
        out = hit if out is None else out.unionByName(hit)
    return out
