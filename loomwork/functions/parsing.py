"""Description strings, codes and labels as struct columns; every function is a plain column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed values, the notation of sizes in the input: a number has digits and perhaps a point and more digits.
#: Descriptions write a die as ``/W/*L mil`` or, if it is square, ``/W mil/`` with two digits at least;
#: the raw size is ``W x L`` (or *, X, ×) or one number.
NUMBER = r"(\d+\.?\d*)"
PAIR, SQUARE = rf"(?i)/{NUMBER}/\*{NUMBER}\s*mil", r"(?i)/\*?(\d+\.?\d+)\s*mil/"
RAW_PAIR, RAW_ONE = rf"^{NUMBER}\s*[x×X*]\s*{NUMBER}$", rf"^{NUMBER}$"


def number_in(text: Column) -> Column:
    """The first number of a text, null if none."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def safe_number(text: Column, blanks: Sequence[str] = ("", "-")) -> Column:
    """A number, or null for blanks and anything that is not one (underscores included)."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(*blanks) & ~trimmed.contains("_"), trimmed.try_cast("double"))


def die_geometry(description: Column, raw_size: Column, thickness: Column) -> Column:
    """struct(width, length, diagonal, thickness) by the first of four patterns that matches.

    In order: ``/W/*L mil`` in the description, ``W x L`` as the raw size, a
    single raw number (square), ``/W mil/`` in the description (square, two
    digits at least).  No match leaves the first three null.
    """
    raw = F.trim(raw_size)

    def side(k: int) -> Column:
        found = (
            F.when(description.rlike(PAIR), F.regexp_extract(description, PAIR, k))
            .when(raw.rlike(RAW_PAIR), F.regexp_extract(raw, RAW_PAIR, k))
            .when(raw.rlike(RAW_ONE), F.regexp_extract(raw, RAW_ONE, 1))
            .when(description.rlike(SQUARE), F.regexp_extract(description, SQUARE, 1))
        )
        return found.try_cast("double")

    w, h = side(1), side(2)
    return F.struct(F.round(w, 4).alias("width"), F.round(h, 4).alias("length"), F.round(F.sqrt(w * w + h * h), 4).alias("diagonal"), number_in(thickness).alias("thickness"))


def first_code(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first code of an ordered table one of whose needles the upper-cased text contains; null if none."""
    out = F.lit(None).cast("string")
    for code, needles in reversed(table):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.upper(text).contains(needle)
        out = F.when(hit, code).otherwise(out)
    return out


def _part(parts: Column, k: int) -> Column:
    return F.coalesce(F.trim(F.get(parts, k)), F.lit(""))


def wafer_description(text: Column) -> Column:
    """Seven named parts of a slash-separated wafer text; null unless the text has that shape.

    At least seven parts, a first one that is not empty, and a second that is
    empty, ``CHIP`` or has a digit.
    """
    parts = F.split(text, "/")
    names = ("product", "chip", "size", "thickness", "metal", "vendor", "rest")
    second = _part(parts, 1)
    ok = (F.size(parts) >= 7) & (_part(parts, 0) != "") & ((second == "") | (second == "CHIP") | second.rlike("[0-9]"))
    return F.when(ok, F.struct(*[_part(parts, k).alias(n) for k, n in enumerate(names)]))


def leadframe_description(text: Column, leading: str = "LF") -> Column:
    """struct(kind, package, option, plating, vendor); an ``HD`` option takes the next part with it."""
    parts = F.split(text, "/")
    hd = (_part(parts, 2) == "HD") & (F.size(parts) >= 6)
    ok = (F.size(parts) >= 5) & (_part(parts, 0) == leading)
    shift = lambda k: F.when(hd, _part(parts, k + 1)).otherwise(_part(parts, k))
    option = F.when(hd, F.concat(F.lit("HD "), _part(parts, 3))).otherwise(_part(parts, 2))
    return F.when(ok, F.struct(_part(parts, 0).alias("kind"), _part(parts, 1).alias("package"), option.alias("option"), shift(3).alias("plating"), shift(4).alias("vendor")))


def wire_description(text: Column) -> Column:
    """struct(kind, diameter, metal, vendor, is_clip); the diameter is the number before ``mil``, else the first."""
    parts = F.split(text, "/")
    body = F.array_join(F.slice(parts, 2, 3), "/")
    before = F.regexp_extract(body, r"(?i)(\d+\.?\d*)\s*mil", 1)
    diameter = F.when(before != "", before).otherwise(F.regexp_extract(body, r"(\d+\.?\d*)", 1))
    clip = F.upper(_part(parts, 0)).contains("CLIP")
    return F.when(
        F.size(parts) >= 4,
        F.struct(_part(parts, 0).alias("kind"), F.when(clip, "").otherwise(diameter).alias("diameter"), _part(parts, 2).alias("metal"), _part(parts, 3).alias("vendor"), clip.alias("is_clip")),
    )


def glue_description(text: Column) -> Column:
    """struct(kind, name, type, vendor, rest): what follows the fourth part is joined again."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) >= 4, F.struct(*[_part(parts, k).alias(n) for k, n in enumerate(("kind", "name", "type", "vendor"))], F.array_join(F.slice(parts, 5, 1000), "/").alias("rest")))


def packing_description(text: Column) -> Column:
    """struct(kind, items): parts that are not empty."""
    parts = F.filter(F.split(text, "/"), lambda p: F.trim(p) != "")
    return F.struct(_part(parts, 0).alias("kind"), F.array_join(F.slice(parts, 2, 1000), ";").alias("items"))


def described(text: Column, kind: Column) -> Column:
    """Dispatch by material kind: struct(parser, success, error, raw, fields as a JSON text)."""
    parsers = {"WAF": wafer_description, "LEF": leadframe_description, "WIR": wire_description, "GLU": glue_description, "PAC": packing_description}
    known = F.when(kind.isin(*parsers), kind).when(F.upper(text).startswith("LF/"), "LEF").when(F.upper(text).startswith("WIRE"), "WIR")
    fields = F.lit(None).cast("string")
    for name, parse in parsers.items():
        fields = F.when(known == name, F.to_json(parse(text))).otherwise(fields)
    error = F.when(known.isNull(), "unknown kind").when(fields.isNull(), "unexpected shape")
    return F.struct(known.alias("parser"), error.isNull().alias("success"), error.alias("error"), text.alias("raw"), fields.alias("fields"))


SEGMENTS = ("package", "wire", "die", "leadframe", "compound", "vendor")
CODE = r"^([A-Za-z0-9]{6})-([A-Za-z0-9])-([A-Za-z0-9]{2})-([A-Za-z0-9]{2})-([A-Za-z0-9]{4})-([A-Za-z0-9])$"


def six_segments(code: Column, tables: dict[str, dict[str, str]]) -> Column:
    """A six-part code decoded by one lookup table per segment.

    success says whether the code has the exact shape; six parts are decoded
    anyway.  A segment without an entry becomes ``UNKNOWN: x`` and one error.
    All but the vendor are looked up in upper case.
    """
    parts = F.split(code, "-")

    def segment(k: int, name: str) -> tuple[Column, Column]:
        own = _part(parts, k)
        key = own if name == "vendor" else F.upper(own)
        known = F.lit(None).cast("string")
        for entry, meaning in tables.get(name, {}).items():
            known = F.when(key == entry, meaning).otherwise(known)
        return F.coalesce(known, F.concat(F.lit("UNKNOWN: "), own)), F.when(known.isNull(), F.concat(F.lit(f"{name} "), own))

    decoded = [segment(k, n) for k, n in enumerate(SEGMENTS)]
    enough = F.size(parts) >= 6
    errors = F.when(enough, F.array_compact(F.array(*[e for _, e in decoded]))).otherwise(F.array(F.lit("format")))
    return F.struct(code.rlike(CODE).alias("success"), *[F.when(enough, v).alias(n) for (v, _), n in zip(decoded, SEGMENTS)], errors.alias("errors"))


def code_differences(left: Column, right: Column) -> Column:
    """array of struct(segment, left, right) for the segments in which two codes differ."""
    a, b = F.split(left, "-"), F.split(right, "-")
    rows = [F.when(~_part(a, k).eqNullSafe(_part(b, k)), F.struct(F.lit(n).alias("segment"), _part(a, k).alias("left"), _part(b, k).alias("right"))) for k, n in enumerate(SEGMENTS)]
    return F.array_compact(F.array(*rows))


def value_with_unit(text: Column, unit: str | None = None) -> Column:
    """The first number; null when a unit is asked for and the text does not name it."""
    found = number_in(text)
    return found if unit is None else F.when(F.lower(text).contains(unit.lower()), found)


def confidence_label(raw: Column) -> Column:
    """high, medium or low from a label or a number from 0 to 1 (0.8 and 0.5 are the limits).

    Other text raises an error whatever the session's ANSI mode.
    """
    text, value = F.lower(F.trim(raw)), F.trim(raw).try_cast("double")
    return (
        F.when(text.isin("high", "medium", "low"), text)
        .when(value.between(0, 1), F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low"))
        .when(raw.isNotNull(), F.raise_error(F.concat(F.lit("not a confidence: "), raw)).cast("string"))
    )


def classify(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern (case ignored) that the text matches."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def low_signal(answer: Column, least: int = 12) -> Column:
    """Whether an answer is too short or consists of customary filler."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (F.length(text) < least) | text.rlike(r"^(ok|yes|done|n/?a|none|checked|good|fine)([ ,.]+(ok|yes|done|checked|good|fine))*\.?$")


def backoff_seconds(attempt: Column, mode: str) -> Column:
    """Delay before an attempt: its number, or two to its number less one."""
    return attempt.cast("double") if mode == "linear" else F.pow(F.lit(2.0), attempt - 1)
