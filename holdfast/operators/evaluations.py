"""Stored policy evaluations: whether one may still be used, what the latest ones say, and pages of their findings."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import cursor
from holdfast.operators import policy
from holdfast.sources.adapter import Catalog

#: The version of the rules that evaluations are made by.
RULES_VERSION = 1
#: Why an evaluation can't be used, in the order in which they are told.
MAX_PAGE = 1000


def validity(asked: DataFrame, evaluations: DataFrame, policies: DataFrame, rollups: DataFrame, findings: DataFrame, input_seq: int, now: int, rules: int = RULES_VERSION) -> DataFrame:
    """asked (evaluation_id) -> usable, reason: the first that applies, none if it is usable.

    evaluations (evaluation_id, policy_id, status, files_expected, files_evaluated, input_seq, policy_version,
    valid_until_ms, rules_version); policies (policy_id, version, status, enabled); rollups (evaluation_id,
    policy_id, total, satisfied, violated, uncertain); findings (evaluation_id, file_id, ...), counted first.
    """
    current = policies.select("policy_id", F.col("version").alias("_version"), F.col("status").alias("_status"), "enabled")
    counts = findings.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("_findings"))
    rows = asked.select("evaluation_id").join(evaluations.join(current, "policy_id"), "evaluation_id", "left").join(rollups, ["evaluation_id", "policy_id"], "left").join(counts, "evaluation_id", "left")
    below = lambda *names: F.greatest(*[(F.col(n) < 0).cast("int") for n in names], F.lit(0)) == 1
    unlike = lambda a, b: ~F.col(a).eqNullSafe(b if not isinstance(b, str) else F.col(b))
    parts = ("total", "satisfied", "violated", "uncertain")
    absent = F.lit(False)
    for n in parts:
        absent = absent | F.col(n).isNull() | (F.col(n) < 0)
    classified = F.col("satisfied") + F.col("violated") + F.col("uncertain")
    reason = (
        F.when(F.col("policy_id").isNull(), "unknown_evaluation").when(F.col("status") != "complete", "evaluation_incomplete").when(below("files_expected", "files_evaluated"), "invalid_file_count")
        .when(F.col("files_expected") != F.col("files_evaluated"), "file_count_mismatch").when(unlike("input_seq", F.lit(input_seq)), "policy_input_advanced").when(below("policy_version", "_version"), "invalid_policy_version")
        .when(F.col("policy_version") != F.col("_version"), "policy_version_changed").when((F.col("_status") != "active") | ~F.col("enabled"), "policy_inactive")
        .when(below("valid_until_ms"), "invalid_valid_until").when(F.col("valid_until_ms") <= now, "freshness_expired").when(unlike("rules_version", F.lit(rules)), "rules_version_changed")
        .when(absent, "rollup_missing_or_invalid").when((F.col("total") != F.col("files_expected")) | (classified != F.col("total")), "rollup_count_mismatch")
        .when(F.coalesce("_findings", F.lit(0)) != F.col("violated") + F.col("uncertain"), "finding_count_mismatch")
    )
    return rows.select("evaluation_id", reason.isNull().alias("usable"), reason.alias("reason"))


def latest_complete(evaluations: DataFrame) -> DataFrame:
    """The last complete evaluation of each policy, ties by id."""
    done = evaluations.filter(F.col("status") == "complete")
    return done.groupBy("policy_id").agg(F.max(F.struct("completed_ms", "evaluation_id")).alias("x")).select("policy_id", "x.evaluation_id")


def cached_status(collections: DataFrame, evaluations: DataFrame, policies: DataFrame, rollups: DataFrame, findings: DataFrame, input_seq: int, now: int, rules: int = RULES_VERSION) -> DataFrame:
    """For each active policy that an active collection uses: its latest complete evaluation with the rollup, or why it is stale."""
    used = collections.filter(F.col("status") == "active").select("policy_id")
    own = policies.filter((F.col("status") == "active") & F.col("enabled")).join(used, "policy_id", "left_semi").select("policy_id").join(latest_complete(evaluations), "policy_id", "left")
    told = validity(own.filter("evaluation_id is not null"), evaluations, policies, rollups, findings, input_seq, now, rules)
    rows = own.join(told, "evaluation_id", "left").join(rollups, ["evaluation_id", "policy_id"], "left")
    usable = F.coalesce("usable", F.lit(False))
    return rows.select("policy_id", "evaluation_id", F.when(F.col("evaluation_id").isNull(), "evaluation_missing").otherwise(F.col("reason")).alias("reason"), *[F.when(usable, F.col(n)).alias(n) for n in ("total", "satisfied", "violated", "uncertain")])


def findings_page(status: DataFrame, findings: DataFrame, limit: int, after: tuple[str, str] | None = None, collection: str | None = None, state: str | None = None, policy_id: str | None = None) -> DataFrame:
    """limit + 1 findings of the usable evaluations of a cached status, by policy and file, behind a key."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} findings")
    if state is not None and state not in ("violated", "uncertain"):
        raise ValueError("findings are violated or uncertain")
    usable = status.filter("evaluation_id is not null and reason is null").select("evaluation_id", "policy_id")
    rows = findings.drop("policy_id").join(usable, "evaluation_id")
    for name, value in (("collection_id", collection), ("status", state), ("policy_id", policy_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if after is not None:
        rows = rows.filter(cursor.after(["policy_id", "file_id"], list(after)))
    return rows.orderBy("policy_id", "file_id").limit(limit + 1)


def store(evaluated: DataFrame, evaluation_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollups and findings of an evaluation. evaluation_ids: policy_id, evaluation_id."""
    rows = evaluated.join(evaluation_ids, "policy_id")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rollups = rows.groupBy("evaluation_id", "policy_id").agg(F.count(F.lit(1)).alias("total"), count("satisfied"), count("violated"), count("uncertain"), F.min("valid_until").alias("valid_until_ms"))
    return rollups, rows.filter(F.col("status") != "satisfied").select("evaluation_id", "policy_id", "file_id", "collection_id", "status", "failed", "actions")


def review_file(c: Catalog, file_id: str, now: int) -> DataFrame:
    """The live evaluation of one file: filtered first, so only copies of its content are judged."""
    return policy.evaluate(dataclasses.replace(c, file_refs=c.file_refs.filter(F.col("file_id") == file_id)), now)
