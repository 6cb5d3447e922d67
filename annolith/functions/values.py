"""Values and labels as column expressions (PRJ01-15, 18, 30; FUN01-21; AGG30; MET03, 22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The orders of ordinal labels.
ORDERS = {
    "count_band": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10_20", "20_plus"],
    "age": ["infant", "child", "adolescent", "young_adult", "middle_adult", "older_adult"],
    "legibility": ["0_not_legible", "1_low_legibility", "2_moderate_legibility", "3_high_legibility"],
    "intensity": ["1_slight", "2_clear", "3_broad", "4_laughter_like"],
    "prevalence": ["none", "minority", "about_half", "majority", "all"],
}
#: Labels that were renamed, for all fields and for single ones.
RENAMED = {"general_crowd": "other_group", "1_not_legible": "0_not_legible", "2_low_legibility": "1_low_legibility", "3_moderate_legibility": "2_moderate_legibility", "4_high_legibility": "3_high_legibility"}
RENAMED_IN = {
    "depiction_type": {"naturalistic_illustration": "illustration", "stylized_illustration": "illustration"},
    "gaze_target": {"off_frame": "off_frame_or_scene_direction", "scene_direction": "off_frame_or_scene_direction"},
    "dominant_gaze": {"off_frame": "off_frame_or_scene_direction", "scene_direction": "off_frame_or_scene_direction"},
    "mouth_covering": {"own_body_part": "other_body_part", "another_person": "part_of_another_person"},
}


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def chosen(conditions: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """PRJ06: the value of the first condition that holds."""
    (first, value), *rest = conditions
    return reduce(lambda c, x: c.when(*x), rest, F.when(first, value)).otherwise(otherwise)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """PRJ01: null, not '', where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def full_match(text: Column, pattern: str) -> Column:
    """FUN01"""
    return text.rlike(rf"\A(?:{pattern})\z")


def scan_id(name: Column) -> Column:
    """PRJ02: a file name up to its extension and its first underscore."""
    return F.substring_index(F.regexp_replace(name, r"\.[^.]+$", ""), "_", 1)


def decade(year: Column, width: int = 10) -> Column:
    """PRJ03"""
    return (year - F.pmod(year, F.lit(width))).cast("int")


def face_count_bin(n: Column) -> Column:
    """PRJ04: right-closed bins."""
    return chosen([(n <= 0, None), (n <= 1, "1"), (n <= 2, "2"), (n <= 5, "3-5"), (n <= 11, "6-11")], "12+")


def enum_value(values: Column, allowed: list[str], fallback: str, several: str = "multiple_types_present") -> Column:
    """PRJ11: an array of labels as one: itself if single, ``several`` if it holds more than one allowed label."""
    known = F.array_distinct(F.filter(values, lambda x: x.isin(allowed)))
    return F.when((F.size(known) > 1) & F.lit(several in allowed), F.lit(several)).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit(fallback)))


def confidence(value: Column, fallback: float = 0.5) -> Column:
    """PRJ14"""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.try_cast("double"))), F.lit(fallback))


def normalised(value: Column, field: str = "") -> Column:
    """PRJ15: trimmed lower case, empty and not_applicable as null, renamed labels as they are now."""
    plain = F.lower(F.trim(value))
    special = RENAMED_IN.get(field, {})
    now = F.coalesce(*([F.try_element_at(literal_map(special), plain)] if special else []), F.try_element_at(literal_map(RENAMED), plain), plain)
    return F.when(value.isin("", "not_applicable"), None).otherwise(now)


def rank_of(value: Column, order: list[str]) -> Column:
    """The place in an order from 0, or null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def lenient(human: Column, other: Column, order: list[str] | None = None) -> Column:
    """MET03: equal, or neighbours in the order."""
    near = F.lit(False) if order is None else F.coalesce(F.abs(rank_of(human, order) - rank_of(other, order)) <= 1, F.lit(False))
    return human.eqNullSafe(other) | near


def tri_state(value: Column) -> Column:
    """yes 1.0, no 0.0, all else null."""
    return F.when(value == "yes", 1.0).when(value == "no", 0.0)


def gates_down(first: Column, second: Column) -> Column:
    """PRJ18: a higher gate holds only if the lower one does."""
    return first & second


def gates_up(first: Column, second: Column) -> Column:
    """PRJ18: a higher gate lifts the lower one."""
    return first | second


def relation(human: Column, other: Column) -> Column:
    """MET22"""
    return chosen([(human.isNull() | other.isNull(), "missing"), (other < human, "under"), (other == human, "equal")], "over")


def safe_divide(a: Column, b: Column) -> Column:
    """FUN08"""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def json_in(text: Column) -> Column:
    """FUN11: the outermost braces of a text without its <think> parts, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0), F.lit(""))


def error_kind(text: Column) -> Column:
    """FUN17: the first rule that fits."""
    low = F.lower(text)
    return chosen([(text.isNull(), None), (low.contains("429") | low.contains("rate limit"), "rate_limit"), (low.contains("timeout") | low.contains("timed out"), "timeout"), (low.rlike(r"\b5\d\d\b"), "server"), (low.contains("json") | low.contains("schema"), "format")], "other")


def image_type(content: Column) -> Column:
    """FUN18: by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return chosen([(head.startswith("FFD8FF"), "jpg"), (head.startswith("89504E470D0A1A0A"), "png"), (head.startswith("47494638"), "gif"), (head.startswith("52494646") & head.endswith("57454250"), "webp")])


def strict_bool(text: Column) -> Column:
    """FUN19: true or false in any case, all else an error."""
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def id_list(text: Column, pattern: str) -> Column:
    """FUN20: ids between blanks, commas and semicolons, each once, those of the pattern only."""
    return F.array_distinct(F.filter(F.split(text, r"[\s,;]+"), lambda x: x.rlike(rf"\A(?:{pattern})\z")))


def slug(text: Column) -> Column:
    """FUN04"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """FUN05: a dash where the value is missing."""
    return F.when(value.isNull(), F.lit("—")).otherwise(F.format_string("%.1f [%.1f, %.1f]", value, low, high))


def backoff(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """FUN10"""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def half_life(seconds: Column, half: float = 60.0) -> Column:
    return F.pow(F.lit(0.5), seconds / half)


def face_identity(page: Column, *coordinates: Column) -> Column:
    """FUN15, FUN16: a hash over nine-place renderings."""
    return F.sha2(F.concat_ws("|", page, *[F.format_string("%.9f", c.cast("double")) for c in coordinates]), 256)


def stem(name: Column) -> Column:
    """JOI18: the file name without folders and extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(name, r"[^/\\]+$", 0), r"\.[^.]+$", ""))


def page_of_span(pages: Column, center_x: Column) -> Column:
    """JOI16: the page of a comma list that a relative place falls on."""
    parts = F.split(pages, ",")
    return F.get(parts, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), center_x)) * F.size(parts)).cast("int"))


def pair_key(a: Column, b: Column) -> Column:
    """JOI20: the same for either order."""
    return F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def upper_median(values: Column) -> Column:
    """AGG12"""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def nearest_rank(values: Column, q: float) -> Column:
    """AGG10: the element at (n - 1) * q, rounded half to even."""
    s = F.sort_array(values)
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(q), 0).cast("int"))


def truncated_rank(values: Column, q: float) -> Column:
    """AGG11: the element at (n - 1) * q, rounded down."""
    s = F.sort_array(values)
    return F.get(s, F.floor((F.size(s) - 1) * F.lit(q)).cast("int"))
