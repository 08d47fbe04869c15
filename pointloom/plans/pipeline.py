"""Stages of the candidate pipeline composed as one lazy plan, with model calls behind an interface."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import candidates, rules, votes

#: Stages in the order in which they run, whatever order they are asked for in.
STAGES = ["views", "plan", "ground", "project", "grow", "part_propose", "render", "part_select", "part_filter", "coverage", "build", "visualize"]
#: Stages that need rendered views.
_NEEDS_VIEWS = set(STAGES[1:])


class Predictor(Protocol):
    """Answers for rows of requests; how is not the pipeline's matter."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class Recorded:
    """Answers looked up in a table of recorded responses; a request without one gets nulls."""

    def __init__(self, responses: DataFrame, keys: list[str]):
        self.responses, self.keys = responses, keys

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.responses, self.keys, "left")


class DryRun:
    """The same fixed answer to everything."""

    def __init__(self, **answer):
        self.answer = answer

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.withColumns({k: F.lit(v) for k, v in self.answer.items()})


def stage_order(wanted: list[str]) -> list[str]:
    unknown = [s for s in wanted if s not in STAGES]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    chosen = set(wanted) | ({"views"} if _NEEDS_VIEWS & set(wanted) else set())
    return [s for s in STAGES if s in chosen]


def task_filter(spec: str | None, known: list[str]) -> list[str] | None:
    """"all" or nothing given: no filter; "": nothing passes; else a list of known values."""
    if spec is None or spec.strip().lower() == "all":
        return None
    values = [v.strip() for v in spec.split(",") if v.strip()]
    bad = [v for v in values if v not in known]
    if bad:
        raise ValueError(f"unknown values: {', '.join(bad)}")
    return values


def split_rows(pilots: DataFrame, tasks: list[str] | None, decisions: str) -> tuple[DataFrame, DataFrame]:
    """Rows that go through the models, and those of the same tasks that are reviewed empty."""
    d = pilots if tasks is None else pilots.filter(F.col("task").isin(*tasks))
    decision = F.coalesce(F.lower(F.trim("decision")), F.lit(""))
    empty = ["", "empty", "none", "not_applicable", "disable"]
    chosen = F.lit(True) if decisions == "all" else ~decision.isin(*empty) if decisions == "non_empty" else decision.isin(*[x.strip() for x in decisions.split(",")])
    return d.filter(chosen), d.filter(~chosen)


def run(points: DataFrame, pilots: DataFrame, selector: Predictor, base_masks: DataFrame, least_votes: int, kind: str = "high_recall") -> dict[str, DataFrame]:
    """candidates, scored and masks of pilots (pilot_id, object_id, executor, task).

    ``selector`` answers (pilot_id, candidate_id) with kind and confidence rows.
    """
    made = candidates.rank_high_recall(candidates.generate(points, "object_id", "point_idx", kind), "object_id")
    d = pilots.join(made, "object_id")
    answers = selector(d.select("pilot_id", "candidate_id")).filter("kind IS NOT NULL")
    counted = votes.candidate_votes(answers, ["pilot_id"])
    ran = answers.select("pilot_id").distinct().withColumn("ran", F.lit(True))
    scored = d.join(counted, ["pilot_id", "candidate_id"], "left").join(ran, "pilot_id", "left").select(
        "pilot_id", "object_id", "candidate_id", "executor", "task", "points", F.col("family").alias("candidate_family"), "point_fraction", F.col("extent").alias("bbox_extent_ratio"),
        F.array("executor").alias("recommended_executors"), F.lit("").alias("source"), F.lit("").alias("provenance"),
        F.coalesce("selected", F.lit(0)).alias("selected_votes"), F.coalesce("uncertain", F.lit(0)).alias("uncertain_votes"), F.coalesce("ran", F.lit(False)).alias("selection_ran"),
    )
    scored = rules.score_candidates(scored, least_votes)
    scored = rules.row_gate(scored.withColumn("shown", F.lit(None).cast("boolean")), ["pilot_id"], least_votes).drop("shown")
    new = scored.filter("decision = 'accept_candidate'").select("pilot_id", "executor", F.explode("points").alias("point_idx")).distinct()
    return {"candidates": made, "scored": scored, "masks": rules.overwrite_channel(base_masks, new, ["pilot_id"], "point_idx")}
