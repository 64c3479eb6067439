"""Run ledgers, evidence gates, status rules and catalog comparisons as table jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.functions.identity import SHA256_FORMAT
from jetframe.operators import contracts

# Status order and stage prerequisites.
STATUS_RANK = {"specified": 0, "implemented": 1, "verified": 2}
STAGE_PREREQUISITES = {
    "E0": (),
    "E0.5": ("E0",),
    "E1": ("E0", "E0.5"),
    "E2": ("E0", "E0.5", "E1", "E2_budget"),
    "E3": ("E0", "E0.5", "E1", "E2"),
}
FORMAL_ORIGIN = "qualified_runpod"


def sweep_grid(studies: DataFrame) -> DataFrame:
    """Planned runs of every study: features x sizes x seeds in that order, with stable ids.

    ``studies`` has ``study_id, stage, model_condition, configuration_sha256`` and the
    three axis arrays.  The id hashes the JSON text of the identity with sorted keys.
    """
    runs = studies.select(
        "*", F.posexplode("feature_configs").alias("i", "feature_config")
    ).select("*", F.posexplode("train_sizes").alias("j", "train_size_per_class"))
    runs = runs.select("*", F.posexplode("model_seeds").alias("k", "model_seed"))
    identity = F.to_json(
        F.struct(
            "configuration_sha256",
            "feature_config",
            "model_condition",
            "model_seed",
            "stage",
            "study_id",
            "train_size_per_class",
        )
    )
    suffix = F.substring(F.sha2(F.concat(identity, F.lit("\n")), 256), 1, 12)
    stage = F.replace(F.lower("stage"), F.lit("."), F.lit(""))
    place = (F.col("i") * F.size("train_sizes") + F.col("j")) * F.size("model_seeds") + F.col("k")
    return runs.select(
        "study_id",
        place.alias("pos"),
        "feature_config",
        "train_size_per_class",
        "model_seed",
        F.concat(
            stage,
            F.lit("-"),
            "model_condition",
            F.lit("-"),
            F.lower("feature_config"),
            F.lit("-n"),
            F.col("train_size_per_class").cast("string"),
            F.lit("-s"),
            F.col("model_seed").cast("string"),
            F.lit("-"),
            suffix,
        ).alias("condition_id"),
    )


# The keys of a sweep's configuration and what its axes may hold.
SWEEP_FIELDS = {
    "schema_version": contracts.Text(allowed=("1.0.0",)),
    "study_id": contracts.SLUG,
    "stage": contracts.Text(allowed=tuple(STAGE_PREREQUISITES)),
    "feature_configs": contracts.Each(contracts.Text(allowed=("A", "B", "C", "D")), unique=True),
    "train_sizes_per_class": contracts.Each(contracts.Integer(1)),
    "model_seeds": contracts.Each(contracts.Integer(0)),
    "model_condition": contracts.Text(allowed=contracts.FAMILIES),
    "mandatory": contracts.Flag(),
    "dependency_hashes": contracts.Free(),
}


def sweep_violations(configs: DataFrame, json: str = "json", key: str = "study") -> DataFrame:
    """Sweep configurations as JSON against their closed keys and axes: missing and unknown keys, axes that
    are no arrays, empty, of a wrong type, out of range or with a repeated view, and no dependencies."""
    v = F.col("v")
    hashes = F.map_values(F.try_variant_get(v, "$.dependency_hashes", "map<string,variant>"))
    bad_hash = F.exists(
        hashes,
        lambda x: ~F.coalesce(F.try_variant_get(x, "$", "string").rlike(SHA256_FORMAT), F.lit(False)),
    )
    whole = {"RUN_CONFIG_DEPENDENCIES": (F.size(hashes) == 0) | bad_hash}
    parsed = configs.select(F.col(key).alias("key"), F.try_parse_json(json).alias("v"))
    return contracts.variant_violations(parsed, SWEEP_FIELDS, whole)


def matrix_status(planned: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every planned run with its status; ``missing`` where there is no record.

    Metrics are carried for successful runs only.
    """
    joined = planned.join(records, list(keys), "left")
    return joined.withColumns(
        {
            "status": F.coalesce(F.col("status"), F.lit("missing")),
            "metric": F.when(F.col("status") == "succeeded", F.col("metric")),
        }
    )


def stage_gate_failures(stages: DataFrame, gates: DataFrame) -> DataFrame:
    """``(study_id, failure)`` for every prerequisite that is absent, not passed or unhashed."""
    want = F.create_map(
        *[
            x
            for stage, names in STAGE_PREREQUISITES.items()
            for x in (F.lit(stage), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
        ]
    )
    needed = stages.select("study_id", F.explode(F.element_at(want, F.col("stage"))).alias("gate"))
    joined = needed.join(gates.withColumn("found", F.lit(True)), ["study_id", "gate"], "left")
    passed = F.coalesce(F.col("eligible"), F.lit(False)) | F.coalesce(
        F.col("status") == "passed", F.lit(False)
    )
    hashed = F.coalesce(F.col("content_sha256").rlike(SHA256_FORMAT), F.lit(False))
    found = F.col("found").isNotNull()
    failures = F.array_compact(
        F.array(
            F.when(~found, F.lit("missing")),
            F.when(found & ~passed, F.coalesce(F.col("status"), F.lit("invalid"))),
            F.when(found & ~hashed, F.lit("invalid_hash")),
        )
    )
    return joined.select("study_id", "gate", F.explode(failures).alias("reason")).select(
        "study_id", F.concat_ws(":", "gate", "reason").alias("failure")
    )


def gate_rollup(
    evidence: DataFrame,
    required: Mapping[str, Sequence[str]],
    maxima: Mapping[str, float] | None = None,
    minima: Mapping[str, float] | None = None,
    key: str = "bundle_id",
    bundles: DataFrame | None = None,
) -> DataFrame:
    """Missing and failed evidence per bundle with the verdict missing > failed > passed.

    ``evidence(key, kind, name, ok, text, value)`` has one row per item.  Only names the
    policy lists are collected, so a bundle's arrays are bounded by the policy.  Decisions
    that are empty or "unresolved" count as missing; thresholds are looked at only when
    every measurement is there.
    """
    item = F.concat_ws(":", "kind", "name")
    wanted = [f"{kind}:{name}" for kind, names in required.items() for name in names]
    decided = (F.coalesce(F.col("text"), F.lit("")) != "") & (F.lower("text") != "unresolved")
    present = item.isin(*wanted) & ((F.col("kind") != "decision") | F.coalesce(decided, F.lit(False)))
    broken = item.isin(*wanted) & F.col("kind").isin("check", "artifact") & ~F.coalesce(
        F.col("ok"), F.lit(False)
    )
    over = F.lit(None).cast("string")
    for name, limit in (maxima or {}).items():
        over = F.when((F.col("name") == name) & (F.col("value") > limit), F.lit(name)).otherwise(over)
    for name, limit in (minima or {}).items():
        over = F.when((F.col("name") == name) & (F.col("value") < limit), F.lit(name)).otherwise(over)
    limited = F.when(F.col("kind") == "measurement", over)
    grouped = evidence.groupBy(key).agg(
        F.collect_set(F.when(present, item)).alias("present"),
        F.collect_set(F.when(broken, item)).alias("broken"),
        F.collect_set(limited).alias("limits"),
    )
    if bundles is not None:
        # A bundle without any evidence is blocked, not absent.
        grouped = bundles.select(key).distinct().join(grouped, key, "left")
        for name in ("present", "broken", "limits"):
            grouped = grouped.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("present")))
    unmeasured = F.exists("missing", lambda m: m.startswith("measurement:"))
    failed = F.array_sort(
        F.when(unmeasured, F.col("broken")).otherwise(F.array_union("broken", "limits"))
    )
    listed = grouped.withColumn("missing", missing).withColumn("failed", failed)
    return listed.select(
        key,
        F.array_join("missing", ",").alias("missing"),
        F.array_join("failed", ",").alias("failed"),
        F.when(F.size("missing") > 0, F.lit("blocked_external_evidence"))
        .when(F.size("failed") > 0, F.lit("failed"))
        .otherwise(F.lit("passed"))
        .alias("status"),
    )


POLICY = "policy_id string, kind string, name string, test string, bound double, text string, label string, part string"
# A part of a policy is looked into only when nothing of it is missing.
HOST, MEASUREMENT = "host", "measurement"


def policy_gates(
    evidence: DataFrame, policies: DataFrame, bundles: DataFrame, key: str = "bundle_id"
) -> DataFrame:
    """Verdicts of many bundles, each under its own version of a policy.

    ``policies`` has a row per rule (:data:`POLICY`): the item ``(kind, name)`` it is about, a ``test``, what to
    list in ``label``, and the ``part`` it belongs to.  ``bundles`` has ``(key, policy_id)``, ``evidence``
    ``(key, kind, name, ok, text, value)`` with one row per item.  Tests:

    * ``present``, ``decided``, ``same``: else the label is missing; ``decided`` wants a text other than
      "unresolved", ``same`` the rule's text;
    * ``true``, ``filled``, ``equal``, ``at_least``, ``at_most``: else the label failed; an absent item counts as
      failed, too, where no other rule calls it missing.

    What failed in a part is not listed while something of the part is missing: without host, its
    fields are not looked at; without all measurements, no limit.  A measurement that cannot be
    projected stops the other limits.  Rules meet evidence in one equi-join on (bundle, kind, name); a
    bundle's lists are bounded by its policy, and a bundle without evidence is blocked.
    """
    asked = bundles.select(key, "policy_id").distinct().join(policies, "policy_id")
    held = evidence.select(
        key, "kind", "name", "ok", F.col("text").alias("held"), "value", F.lit(True).alias("there")
    )
    joined = asked.join(held, [key, "kind", "name"], "left")
    test, there = F.col("test"), F.coalesce("there", F.lit(False))
    text = F.coalesce(F.trim("held"), F.lit(""))
    good = (
        F.when(test == "present", there)
        .when(test == "decided", (text != "") & (F.lower(text) != "unresolved"))
        .when(test == "same", text == F.col("text"))
        .when(test == "true", F.col("ok"))
        .when(test == "filled", text != "")
        .when(test == "equal", F.col("value") == F.col("bound"))
        .when(test == "at_least", F.col("value") >= F.col("bound"))
        .when(test == "at_most", F.col("value") <= F.col("bound"))
    )
    broken = ~F.coalesce(good, F.lit(False))
    missing = broken & test.isin("present", "decided", "same")
    failed = broken & ~test.isin("present", "decided", "same")
    # A rule about an item that its own "present" rule calls missing says nothing more.
    named = F.struct(F.concat_ws(":", "kind", "name").alias("item"), "label", "part")
    lists = joined.groupBy(key, "policy_id").agg(
        F.collect_set(F.when(missing, named)).alias("gone"),
        F.collect_set(F.when(failed, named)).alias("bad"),
    )
    absent_parts = F.transform("gone", lambda m: m["part"])
    absent_items = F.transform("gone", lambda m: m["item"])
    stopped = F.exists("bad", lambda f: f["label"] == "resource_measurements")
    counted = F.filter(
        "bad",
        lambda f: ~F.array_contains(absent_items, f["item"])
        & ~(f["part"].isin(HOST, MEASUREMENT) & F.array_contains(absent_parts, f["part"]))
        & ~((f["part"] == MEASUREMENT) & stopped & (f["label"] != "resource_measurements")),
    )
    # Without any field of the host there is one thing missing, the host.
    no_host = F.exists("gone", lambda m: m["label"] == "host_qualification")
    shown = F.filter(
        "gone", lambda m: ~(no_host & (m["part"] == HOST) & (m["label"] != "host_qualification"))
    )
    done = lists.select(
        key,
        "policy_id",
        F.array_sort(F.array_distinct(F.transform(shown, lambda m: m["label"]))).alias("missing"),
        F.array_sort(F.array_distinct(F.transform(counted, lambda f: f["label"]))).alias("failed"),
    )
    status = (
        F.when(F.size("missing") > 0, F.lit("blocked_external_evidence"))
        .when(F.size("failed") > 0, F.lit("failed"))
        .otherwise(F.lit("passed"))
    )
    return done.select(
        key,
        "policy_id",
        F.array_join("missing", ",").alias("missing"),
        F.array_join("failed", ",").alias("failed"),
        status.alias("status"),
        (status == "passed").alias("formal_gate_eligible"),
    )


def projected_evidence(projection: DataFrame, key: str) -> DataFrame:
    """The result of :func:`resource_projection` as evidence: whether it is valid, and its total cost."""
    item = F.explode(
        F.array(
            F.struct(
                F.lit("valid").alias("name"),
                (F.col("status") == "ok").alias("ok"),
                F.lit(None).cast("double").alias("value"),
            ),
            F.struct(
                F.lit("total_cost").alias("name"),
                F.lit(True).alias("ok"),
                F.col("projected_total_cost_usd").cast("double").alias("value"),
            ),
        )
    )
    return projection.select(key, F.lit("projection").alias("kind"), item.alias("i")).select(
        key, "kind", "i.name", "i.ok", F.lit(None).cast("string").alias("text"), "i.value"
    )


def check_rollup(
    evidence: DataFrame,
    required: Sequence[str],
    key: str = "bundle_id",
    bundles: DataFrame | None = None,
) -> DataFrame:
    """Verdict failed > missing or wrong origin > passed, with the approved fallback.

    ``evidence(key, name, ok, origin, fallback_approved)``.  A bundle of ``bundles`` without any evidence is
    blocked, not absent.
    """
    wanted = F.col("name").isin(*required)
    grouped = evidence.groupBy(key).agg(
        F.collect_set(F.when(wanted, F.col("name"))).alias("seen"),
        F.collect_set(F.when(wanted & ~F.col("ok"), F.col("name"))).alias("bad"),
        F.max("origin").alias("origin"),
        F.bool_or("fallback_approved").alias("fallback"),
    )
    if bundles is not None:
        grouped = bundles.select(key).distinct().join(grouped, key, "left")
        for name in ("seen", "bad"):
            grouped = grouped.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    missing = F.array_except(F.array(*[F.lit(n) for n in required]), F.col("seen"))
    status = (
        F.when(
            F.size("bad") > 0,
            F.when(F.col("fallback"), F.lit("fallback_approved")).otherwise(F.lit("failed")),
        )
        .when(
            (F.size(missing) > 0) | ~F.col("origin").eqNullSafe(F.lit(FORMAL_ORIGIN)),
            F.lit("blocked_external_evidence"),
        )
        .otherwise(F.lit("passed"))
    )
    return grouped.select(
        key,
        F.array_join(F.array_sort(missing), ",").alias("missing"),
        F.array_join(F.array_sort("bad"), ",").alias("failed"),
        status.alias("status"),
        status.isin("passed", "fallback_approved").alias("formal_gate_eligible"),
    )


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def status_violations(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """Items whose status is stronger than their weakest upstream item.

    Edges are combined per child while they are joined to the upstream status, so a child
    with very many inputs is aggregated on the map side.
    """
    up = statuses.select(F.col("id").alias("upstream"), F.col("status").alias("up_status"))
    per_child = (
        edges.join(up, "upstream", "left")
        .groupBy("child")
        .agg(
            F.bool_or(F.col("up_status").isNull()).alias("unknown"),
            F.bool_or(F.coalesce(F.col("up_status") == "deferred", F.lit(False))).alias("deferred"),
            F.min(status_rank(F.col("up_status"))).alias("weakest"),
        )
    )
    own = statuses.select(F.col("id").alias("child"), "status")
    joined = per_child.join(own, "child", "left")
    rule = (
        F.when(F.col("unknown") | F.col("status").isNull(), F.lit("REPORT_STATUS_REFERENCE"))
        .when(F.col("deferred"), F.when(F.col("status") != "deferred", F.lit("REPORT_STATUS_MONOTONICITY")))
        .when(F.col("status") == "deferred", F.lit(None))
        .when(status_rank(F.col("status")) > F.col("weakest"), F.lit("REPORT_STATUS_MONOTONICITY"))
    )
    return (
        joined.withColumn("rule", rule)
        .filter("rule IS NOT NULL")
        .select("rule", F.col("child").cast("string").alias("key"), F.lit("").alias("detail"))
    )


def claim_reasons(
    claims: DataFrame,
    dependencies: DataFrame,
    statuses: DataFrame,
    supervised_fallback: bool,
    e3_deferred: bool,
) -> DataFrame:
    """``(claim_id, reason)``: why a claim is not eligible, one row per reason."""
    states = statuses.select(F.col("id").alias("dependency"), "status")
    unverified = (
        dependencies.join(states, "dependency", "left")
        .filter(~F.col("status").eqNullSafe(F.lit("verified")))
        .select(
            "claim_id", F.concat(F.lit("unverified:"), F.col("dependency").cast("string")).alias("reason")
        )
    )
    narrowed = F.array_compact(
        F.array(
            F.when(
                F.lit(supervised_fallback) & (F.col("category") == "pretrained_transfer"),
                F.lit("supervised_fallback_removes_pretrained_transfer"),
            ),
            F.when(
                F.lit(e3_deferred) & (F.col("category") == "cross_architecture_robustness"),
                F.lit("e3_control_deferred"),
            ),
        )
    )
    return unverified.unionByName(claims.select("claim_id", F.explode(narrowed).alias("reason")))


def claim_ledger(claims: DataFrame, reasons: DataFrame) -> DataFrame:
    """Every claim with the number of reasons against it and its eligibility."""
    counted = reasons.groupBy("claim_id").agg(F.count(F.lit(1)).alias("reasons"))
    n = F.coalesce(F.col("reasons"), F.lit(0).cast("bigint"))
    return claims.join(counted, "claim_id", "left").select(
        "claim_id", "category", n.alias("reasons"), (n == 0).alias("eligible")
    )


def catalog_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source entry as loaded, skipped (no target) or mismatched (other shape)."""
    t = target.select("name", F.col("shape").alias("target_shape"))
    return source.join(t, "name", "left").select(
        "name",
        F.when(F.col("target_shape").isNull(), F.lit("skipped"))
        .when(F.col("target_shape") == F.col("shape"), F.lit("loaded"))
        .otherwise(F.lit("mismatched"))
        .alias("result"),
    )


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids found on one side only, and ids whose status differs."""
    a = left.select("id", F.col("status").alias("l"))
    b = right.select("id", F.col("status").alias("r"))
    rule = (
        F.when(F.col("r").isNull(), F.lit("missing_right"))
        .when(F.col("l").isNull(), F.lit("missing_left"))
        .when(F.col("l") != F.col("r"), F.lit("status_mismatch"))
    )
    return (
        a.join(b, "id", "full_outer")
        .withColumn("rule", rule)
        .filter("rule IS NOT NULL")
        .select("rule", F.col("id").cast("string").alias("key"), F.concat_ws("/", "l", "r").alias("detail"))
    )


RESOURCE_SUMS = (
    "source_bytes",
    "events_processed",
    "cpu_seconds",
    "wall_seconds",
    "failed_files",
    "total_files",
    "compact_bytes",
    "canonical_bytes",
    "view_bytes",
)
COSTS = ("e0_base_cost_usd", "e1_base_cost_usd", "e2_base_cost_usd")


def resource_projection(jobs: DataFrame, key: str, reserve: float) -> DataFrame:
    """Throughput, failure share, storage and reserved cost from per-job rows."""
    if reserve < 0:
        raise ValueError("E0_MEASUREMENT: reserve must not be negative")
    s = jobs.groupBy(key).agg(*[F.sum(c).alias(c) for c in (*RESOURCE_SUMS, *COSTS)])
    valid = (
        (F.col("wall_seconds") > 0)
        & (F.col("events_processed") > 0)
        & (F.col("total_files") > 0)
        & (F.col("failed_files") <= F.col("total_files"))
    )
    factor = F.lit(1.0 + reserve)
    total = sum((F.col(c) * factor for c in COSTS[1:]), F.col(COSTS[0]) * factor)

    def ratio(a: str, b: str, name: str) -> Column:
        return F.when(valid, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))).alias(name)

    return s.select(
        key,
        ratio("source_bytes", "wall_seconds", "source_bytes_per_wall_second"),
        ratio("events_processed", "wall_seconds", "events_per_wall_second"),
        ratio("cpu_seconds", "events_processed", "cpu_seconds_per_event"),
        ratio("failed_files", "total_files", "file_failure_fraction"),
        (F.col("compact_bytes") + F.col("canonical_bytes") + F.col("view_bytes"))
        .cast("bigint")
        .alias("retained_storage_bytes"),
        *[(F.col(c) * factor).alias(c.replace("base", "reserved")) for c in COSTS],
        total.alias("projected_total_cost_usd"),
        F.when(valid, F.lit("ok")).otherwise(F.lit("E0_MEASUREMENT")).alias("status"),
    )
