"""Workflow as events: tasks, maker-checker edits, audit, jobs. State is the first valid or the latest event, never an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.folds import in_order

#: What a verdict does to a task, its field and its conflict.
ACTIONS = {"APPROVE": ("VERIFIED", "VERIFIED", "RESOLVED"), "CORRECT": ("CORRECTED", "CORRECTED", "RESOLVED"), "REJECT": ("REJECTED", "REJECTED", "UNRESOLVED"), "DEFER": ("DEFERRED", "UNVERIFIED", "DEFERRED")}
STALE_MINUTES, REQUESTS_PER_MINUTE = 30, 120


def resolved_edits(edits: DataFrame, decisions: DataFrame, *, key: str = "edit_id") -> DataFrame:
    """Edits with their state: the first decision by someone else of the same organization counts, later ones change nothing."""
    own = decisions.join(edits.select(key, "maker", "organization"), key)
    valid = own.where((F.col("checker") != F.col("maker")) & (F.col("checker_organization") == F.col("organization")) & F.col("decision").isin("APPROVE", "REJECT"))
    first = valid.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("at", "decision_id"))).where("__n = 1").select(key, "decision", "checker", "at")
    state = F.when(F.col("decision") == "APPROVE", "VERIFIED").when(F.col("decision") == "REJECT", "REJECTED").otherwise("PENDING_VERIFICATION")
    return edits.join(first, key, "left").withColumn("status", state)


def task_states(tasks: DataFrame, actions: DataFrame, *, key: str = "task_id") -> DataFrame:
    """Tasks with the states that their latest action sets."""
    last = actions.groupBy(key).agg(F.max_by("action", F.struct("at", "action_id")).alias("action"))
    at = lambda i: F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])])[F.col("action")]
    return tasks.join(last, key, "left").select(key, "action", F.coalesce(at(0), F.lit("PENDING")).alias("task_status"), F.coalesce(at(1), F.lit("UNVERIFIED")).alias("field_status"), F.coalesce(at(2), F.lit("UNRESOLVED")).alias("conflict_status"))


def review_tasks(*, pages: DataFrame | None = None, visuals: DataFrame | None = None, tables: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(object_type, object_id, reason) of everything that needs a person."""
    parts = []
    row = lambda d, kind, reason: d.select(F.lit(kind).alias("object_type"), F.col("id").cast("string").alias("object_id"), reason.alias("reason"))
    if pages is not None:
        parts.append(row(pages.where("confidence < 0.6"), "PAGE", F.lit("LOW_OCR_CONFIDENCE")))
    if visuals is not None:
        parts.append(row(visuals.where("confidence < 0.5 OR ocr_confidence < 0.7"), "VISUAL", F.when(F.col("confidence") < 0.5, "LOW_CLASS_CONFIDENCE").otherwise("LOW_OCR_CONFIDENCE")))
    if tables is not None:
        parts.append(row(tables.where("continuation_status = 'REVIEW_REQUIRED'"), "TABLE", F.lit("TABLE_CONTINUATION")))
    if facts is not None:
        parts.append(row(facts.where("confidence_score < 0.6 OR validation_status = 'ERROR'"), "FIELD", F.when(F.col("validation_status") == "ERROR", "VALIDATION_ERROR").otherwise("LOW_CONFIDENCE")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs in work for longer than ``minutes``, as failed."""
    old = (F.col("status") == "PROCESSING") & (F.coalesce("started_at", "created_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.where(old).withColumns({"status": F.lit("FAILED"), "error_message": F.lit("stale job")})


def job_states(events: DataFrame, *, key: str, at: Column, most_retries: int = 3) -> DataFrame:
    """The state of every job from its events: retries counted, failed for good beyond the limit."""
    g = events.groupBy(key).agg(F.max_by("state", at).alias("last"), F.count_if(F.col("state") == "RETRYING").alias("retries"), F.count("*").alias("n_events"))
    return g.withColumn("status", F.when((F.col("last") == "RETRYING") & (F.col("retries") > most_retries), "FAILED").otherwise(F.col("last")))


def rate_limited(requests: DataFrame, *, client: str, at: str, limit: int = REQUESTS_PER_MINUTE, window: float = 60.0) -> DataFrame:
    """Requests with ``allowed`` by a sliding window in which rejected ones do not count.

    Whether one is allowed depends on which earlier ones were, so a client's requests pass in order, and of a client only the
    allowed ones of the last window (``limit`` at most) are held.
    """

    def allowed(kept: list, x) -> bool:
        kept[:] = [k for k in kept if (x - k).total_seconds() < window]
        if len(kept) < limit:
            kept.append(x)
            return True
        return False

    return in_order(requests, client, at, list, allowed, "allowed", "boolean")


def register(**parts: DataFrame) -> DataFrame:
    """One register of evidence of several kinds; columns that a kind lacks are null."""
    out = None
    for kind, rows in parts.items():
        rows = rows.withColumn("modality", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of stored files against a manifest: CORRUPT, MISSING, UNEXPECTED or OK."""
    both = files.select("path", F.col("sha256").alias("have")).join(manifest.select("path", F.col("sha256").alias("want")), "path", "full")
    return both.select("path", F.when(F.col("have").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("have") != F.col("want"), "CORRUPT").otherwise("OK").alias("status"))


def overall(checked: DataFrame) -> DataFrame:
    """The state of a backup: corrupt before missing before unexpected."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return checked.agg(F.when(has("CORRUPT"), "CORRUPT").when(has("MISSING"), "INCOMPLETE").when(has("UNEXPECTED"), "EXTRA_FILES").otherwise("VALID").alias("status"), F.count("*").alias("n_files"))
