"""Scalar functions on strings and JSON text: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_id(v: Column) -> Column:
    """Runs of characters other than letters, digits, ``_.-`` become one ``_``; none at the ends."""
    return F.trim(F.regexp_replace(F.trim(v), "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def sanitize_key(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(F.trim(v), F.lit(" "), F.lit("_")), "[^A-Za-z0-9_]+", "_"), F.lit("_")))


def slug(v: Column, default: str = "target_part") -> Column:
    s = F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s != "", s).otherwise(F.lit(default))


def safe_name(v: Column, default: str = "sample") -> Column:
    """Each character that is not a letter, a digit, ``-``, ``_`` or ``.`` becomes ``_``; runs stay."""
    s = F.trim(F.regexp_replace(v, r"[^\p{L}\p{N}._-]", "_"), F.lit("_"))
    return F.when(s != "", s).otherwise(F.lit(default))


def normalize_name(v: Column) -> Column:
    return F.translate(F.lower(v), "- ", "__")


def has_any(v: Column, words: list[str]) -> Column:
    """Whether any word stands anywhere in the text; words inside words count."""
    return v.rlike("|".join(map(re.escape, words)))


def blank_to_null(v: Column) -> Column:
    return F.when(F.trim(v) != "", v)


def scalar_kind(v: Column) -> Column:
    """What a manifest's cell holds: null, boolean, json or string."""
    t = F.lower(F.trim(v))
    js = F.substring(F.trim(v), 1, 1).isin("{", "[") & F.try_parse_json(F.trim(v)).isNotNull()
    return (
        F.when(v.isNull() | t.isin("", "null", "none"), F.lit("null")).when(t.isin("true", "false"), F.lit("boolean")).when(js, F.lit("json")).otherwise(F.lit("string"))
    )


def coerce_bool(v: Column, field: str = "value") -> Column:
    t = F.lower(F.trim(v))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False)).when(v.isNull() | (t == ""), F.lit(None).cast("boolean")).otherwise(
        F.raise_error(F.concat(F.lit(f"{field} is not true or false: "), v)).cast("boolean")
    )


def distinct_list(v: Column, most: int | None = None) -> Column:
    """Trimmed, without blanks, the first of equal ones, the first ``most``."""
    out = F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, most) if most is not None else out


def id_list(v: Column, valid: Column | None = None) -> Column:
    """Upper-case ids in order, the first of equal ones, only valid ones if those are given."""
    out = distinct_list(F.transform(v, lambda x: F.upper(x)))
    return F.array_intersect(out, valid) if valid is not None else out


def parse_id_list(v: Column) -> Column:
    return id_list(F.split(F.coalesce(v, F.lit("")), ","))


def code_point(n: Column) -> Column:
    """The character of a code point, beyond 255 too (``chr`` of Spark goes round at 256); an error if there is none."""
    valid = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    wide = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    return F.when(valid, wide).when(n.isNotNull(), F.raise_error(F.concat(F.lit("no character has code point "), n.cast("string"))))


def candidate_label(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA and so on; first letters go on by code point after ZZ."""
    return F.when(i < 26, code_point(65 + i)).otherwise(F.concat(code_point(65 + F.floor(i / 26) - 1), code_point(65 + i % 26)))


def candidate_label_numbered(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> C27 and so on."""
    return F.when(i < 26, code_point(65 + i)).otherwise(F.concat(F.lit("C"), (i + 1).cast("string")))


def sample_identifier(sample_id: Column, object_id: Column, task: Column) -> Column:
    return F.coalesce(blank_to_null(sample_id), F.concat_ws("_", object_id, task))


def row_key(explicit: Column, *parts: Column) -> Column:
    """An explicit key, else the parts that are not blank, joined by ``|``."""
    return F.coalesce(blank_to_null(explicit), F.concat_ws("|", *[blank_to_null(p) for p in parts]))


def extract_json(v: Column) -> Column:
    """The whole text if it is JSON, else the stretch from the first ``{`` to the last ``}``, else null."""
    inner = F.regexp_extract(v, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(v).isNotNull(), v).when(F.try_parse_json(inner).isNotNull(), inner)


#: A JSON string, whole or cut off by the end of the text.
_STRING = r'"(?:[^"\\]|\\.)*(?:"|$)'


def repair_json(v: Column) -> Column:
    """Model output as JSON: fences off, straight quotes, the first object, no trailing commas, JSON's own constants, open ends closed.

    Marks and constants inside strings stay as they are: the text is taken
    apart into strings and single marks, and brackets are counted among the
    latter only. Null if nothing can be read.
    """
    s = F.regexp_replace(F.trim(v), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    s = F.translate(s, "“”‘’", "\"\"''")
    s = F.regexp_extract(s, r"(?s)\{.*", 0)
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s){_STRING}|[A-Za-z]+|\s+|."), F.lit(0))
    plain = F.transform(pieces, lambda x: F.when(x == "True", "true").when(x == "False", "false").when(x == "None", "null").otherwise(x))
    # the brackets that are open after each piece, and the text up to where the first object ends
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        closer = F.when(x == "{", "}").when(x == "[", "]")
        left = F.slice(a["open"], 1, F.greatest(F.size(a["open"]) - 1, F.lit(0)))
        now = F.when(closer.isNotNull(), F.concat(a["open"], F.array(closer))).when(x.isin("}", "]"), left).otherwise(a["open"])
        return F.when(a["done"], a).otherwise(F.struct(F.concat(a["out"], F.array(x)).alias("out"), now.alias("open"), (x.isin("}", "]") & (F.size(left) == 0)).alias("done")))

    def finish(a: Column) -> Column:
        last = F.element_at(a["out"], -1)
        torn = last.startswith('"') & ((F.length(last) == 1) | ~last.endswith('"'))
        body = F.concat(F.array_join(a["out"], ""), F.when(torn, F.lit('"')).otherwise(F.lit("")))
        return F.concat(F.regexp_replace(body, r"[,:\s]+$", ""), F.array_join(F.reverse(a["open"]), ""))

    whole = F.when(F.size(plain) > 0, F.aggregate(plain, start, step, finish))
    without = F.regexp_replace(whole, rf"(?s)({_STRING})|,\s*(?=[}}\]])", "$1")
    return F.coalesce(F.when(F.try_parse_json(without).isNotNull(), without), extract_json(F.trim(v)))


def safe_object(v: Column) -> Column:
    """The text if it is a JSON object, else {}."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT"), F.lit(False)), v).otherwise(F.lit("{}"))


def scalar(v: Column) -> Column:
    """A manifest cell as a JSON value: blank, null and none are null, true and false booleans, JSON is taken over, all else is text."""
    t, low = F.trim(v), F.lower(F.trim(v))
    return (
        F.when(low.isin("", "null", "none"), F.lit(None)).when(low.isin("true", "false"), low)
        .when((t.startswith("{") | t.startswith("[")) & F.try_parse_json(t).isNotNull(), t).otherwise(F.to_json(F.struct(t.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(t.alias("v")))) - 6))
    )


def escape_html(v: Column) -> Column:
    out = v
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def compact(v: Column, places: int = 5) -> Column:
    """Numbers for export: half to even at ``places``."""
    return F.bround(v, places)


def confidence(v: Column) -> Column:
    """Clamped to [0, 1]; what is no number is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v.try_cast("double"), F.lit(0.0))))


def portable_path(v: Column, root_name: str) -> Column:
    """Forward slashes, and what follows the dataset's folder in paths of other machines."""
    p = F.replace(v, F.lit("\\"), F.lit("/"))
    inside = F.concat(F.lit("/"), p)
    mark = f"/{root_name}/"
    return F.when(F.contains(inside, F.lit(mark)), F.substring_index(inside, mark, -1)).otherwise(p)


def review_note(old: Column, new: Column) -> Column:
    return F.concat_ws(" | ", blank_to_null(old), blank_to_null(new))


def rule_error(issue: Column, decision: Column) -> Column:
    """Class of a rule's mistake from a review's issue and decision; the first that fits."""
    return (
        F.when((issue == "missing_positive") | (decision == "add_missing"), "missing_label")
        .when(issue == "over_label", "over_label").when(issue == "wrong_region", "wrong_region").when(issue == "executor_mismatch", "executor_mismatch")
        .when(issue == "task_mismatch", "task_mismatch").when(issue == "needs_geometry_rule", "needs_geometry_rule")
        .when(issue == "needs_part_annotation", "needs_part_annotation").when(decision == "refine", "needs_refinement")
        .when(decision == "disable", "channel_disabled").otherwise("other")
    )


def ordered_executors(v: Column, order: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(e) for e in order]), lambda x: F.array_contains(v, x))


def next_free_number(prefix: str, existing: Column, start: Column) -> Column:
    """``prefix`` with the least number from ``start`` on that is not among ``existing``."""
    free = F.array_except(F.transform(F.sequence(start, start + F.size(existing)), lambda i: F.concat(F.lit(prefix), i.cast("string"))), existing)
    return F.element_at(free, 1)
