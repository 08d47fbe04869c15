"""Model answers as typed columns: plans, selections, regions and coverage reports.

An answer is JSON text, possibly wrapped or slightly broken; what cannot be
read gives empty lists and confidence 0, and a row's failure stays data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import boxes, text

#: Names under which the target parts of a plan may stand; the first that is there counts.
TARGET_KEYS = ["target_positive_parts", "target_part_names", "target_parts", "target_grounding_queries"]
REGION = "array<struct<role: string, part_name: string, box: array<double>, positive_points: array<array<double>>, confidence: string, reason: string>>"
COVERAGE = ["covered", "partially_covered", "not_covered", "uncertain"]


def answer(raw: Column) -> Column:
    """The JSON text of an answer, repaired if need be, else null."""
    return F.coalesce(text.extract_json(raw), text.repair_json(raw))


def strings(js: Column, keys: list[str], most: int | None = None) -> Column:
    """The list of strings under the first of ``keys`` that has one: trimmed, distinct, at most ``most``."""
    found = F.lit(None).cast("array<string>")
    for k in reversed(keys):
        found = F.coalesce(F.from_json(F.get_json_object(js, f"$.{k}"), "array<string>"), found)
    return text.distinct_list(F.coalesce(found, F.array().cast("array<string>")), most)


def plan(raw: Column, most: int = 12) -> Column:
    """target, queries, reject, reject_queries, feasible and confidence of a semantic plan."""
    js = answer(raw)
    return F.struct(
        strings(js, TARGET_KEYS, most).alias("target_positive_parts"), strings(js, ["target_grounding_queries"], most).alias("target_grounding_queries"),
        strings(js, ["reject_negative_parts", "reject_parts"], most).alias("reject_negative_parts"), strings(js, ["reject_grounding_queries"], most).alias("reject_grounding_queries"),
        F.coalesce(F.get_json_object(js, "$.feasible").try_cast("boolean"), F.lit(True)).alias("feasible"), text.confidence(F.get_json_object(js, "$.confidence")).alias("confidence"),
    )


def selection(raw: Column, valid: Column) -> Column:
    """selected, uncertain and rejected ids that are valid, each id under the first of the three, and confidence."""
    js = answer(raw)
    ids = lambda *keys: text.id_list(strings(js, list(keys)), valid)
    chosen, unsure = ids("selected_candidates", "selected"), ids("uncertain_candidates", "uncertain")
    unsure = F.array_except(unsure, chosen)
    gone = F.array_except(F.array_except(ids("rejected_candidates", "rejected"), chosen), unsure)
    return F.struct(chosen.alias("selected_candidates"), unsure.alias("uncertain_candidates"), gone.alias("rejected_candidates"), text.confidence(F.get_json_object(js, "$.confidence")).alias("confidence"))


def regions(raw: Column, field: str, role: str, width: Column, height: Column, most: int, most_share: float) -> Column:
    """Regions with boxes and points in pixels, at most ``most``.

    A target's box above ``most_share`` of the image goes if the region has
    points; a region with neither box nor points goes.
    """
    given = F.coalesce(F.from_json(F.get_json_object(answer(raw), f"$.{field}"), REGION), F.array().cast(REGION))

    def one(r: Column) -> Column:
        points = F.coalesce(boxes.normalize_points(r["positive_points"], width, height), F.array().cast("array<array<int>>"))
        box = boxes.normalize_box(r["box"], width, height)
        if role == "target":
            box = F.when(boxes.oversized(box, width, height, most_share) & (F.size(points) > 0), F.lit(None)).otherwise(box)
        return F.struct(F.lit(role).alias("role"), F.coalesce(r["part_name"], F.lit("")).alias("part_name"), box.alias("box"), points.alias("positive_points"), text.confidence(r["confidence"]).alias("confidence"), F.coalesce(r["reason"], F.lit("")).alias("reason"))

    kept = F.filter(F.transform(given, one), lambda r: r["box"].isNotNull() | (F.size(r["positive_points"]) > 0))
    return F.slice(kept, 1, most)


def coverage(raw: Column, width: Column, height: Column, most: int = 6) -> Column:
    """coverage_status (uncertain if it is none of the four), trigger and missing regions; no answer triggers nothing."""
    js = answer(raw)
    status = F.lower(F.trim(F.get_json_object(js, "$.coverage_status")))
    status = F.when(status.isin(*COVERAGE), status).otherwise(F.lit("uncertain"))
    missing = regions(raw, "missing_region_proposals", "missing", width, height, most, 1.0)
    asked = F.coalesce(F.get_json_object(js, "$.should_trigger_missing_candidate").try_cast("boolean"), F.lit(False))
    return F.struct(status.alias("coverage_status"), (asked & (F.size(missing) > 0)).alias("should_trigger_missing_candidate"), missing.alias("missing_region_proposals"))


def expected_parts(raw: Column, issue: Column) -> Column:
    """Target parts of a plan, else the issue's words as one part."""
    found = strings(answer(raw), TARGET_KEYS)
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(F.trim(F.translate(issue, "_", " "))), lambda x: x != ""))


def prompt(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{name}`` places filled; lists are joined by commas."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def explode_selection(rows: DataFrame, keys: list[str], column: str = "selection") -> DataFrame:
    """keys, candidate_id, kind, confidence: one row an id of a selection."""
    kinds = {"selected": "selected_candidates", "uncertain": "uncertain_candidates", "rejected": "rejected_candidates"}

    def items(kind: str, field: str) -> Column:
        return F.transform(F.col(f"{column}.{field}"), lambda x: F.struct(x.alias("candidate_id"), F.lit(kind).alias("kind")))

    every = F.flatten(F.array(*[items(k, f) for k, f in kinds.items()]))
    return rows.select(*keys, F.explode(every).alias("i"), F.col(f"{column}.confidence").alias("confidence")).select(*keys, "i.*", "confidence")
