"""Registered queries: run grids, ledgers, gates, status rules, reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.operators import ledger
from jetframe.plans import tables
from jetframe.plans.catalog import query


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a study with its own seeds."""
    k = F.col("c_custkey")
    seed = (k % 5).cast("int")
    return tables.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("study-"), k.cast("string")).alias("study_id"),
        F.lit("E2").alias("stage"),
        F.lit("deep_sets_pfn").alias("model_condition"),
        F.sha2(F.concat(F.lit("config-"), (k % 3).cast("string")), 256).alias("configuration_sha256"),
        F.array(*[F.lit(c) for c in "ABCD"]).alias("feature_configs"),
        F.array(*[F.lit(n) for n in (1000, 10000, 100000)]).alias("train_sizes"),
        F.array(seed, seed + 1, seed + 2).alias("model_seeds"),
    )


@query(
    "sweep_grid",
    """WITH s AS (SELECT 'study-' || c_custkey AS study_id, sha256('config-' || c_custkey % 3) AS h, c_custkey % 5 AS b
  FROM customer),
r AS (SELECT study_id, h, f, n, b + d AS seed, (i * 3 + j) * 3 + d AS pos FROM s,
  (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3)) AS x(f, i), (VALUES (1000, 0), (10000, 1), (100000, 2)) AS y(n, j),
  range(3) AS z(d))
SELECT study_id, pos::INTEGER AS pos, f AS feature_config, n AS train_size_per_class, seed::INTEGER AS model_seed,
  'e2-deep_sets_pfn-' || lower(f) || '-n' || n || '-s' || seed || '-' || substr(sha256(
    '{"configuration_sha256":"' || h || '","feature_config":"' || f || '","model_condition":"deep_sets_pfn","model_seed":'
    || seed || ',"stage":"E2","study_id":"' || study_id || '","train_size_per_class":' || n || '}' || chr(10)), 1, 12)
  AS condition_id FROM r""",
)
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.sweep_grid(_studies(spark, sf_dir))


_SWEEP = """concat('{"schema_version":"1.0.0","study_id":"study-', c_custkey, '","stage":"',
  CASE WHEN c_custkey % 11 = 0 THEN 'E9' ELSE 'E2' END, '","feature_configs":',
  CASE WHEN c_custkey % 13 = 0 THEN '[]' WHEN c_custkey % 17 = 0 THEN '["A","B","A"]' WHEN c_custkey % 19 = 0
  THEN '["A","E"]' WHEN c_custkey % 23 = 0 THEN '"A"' ELSE '["A","B"]' END, ',"train_sizes_per_class":',
  CASE WHEN c_custkey % 29 = 0 THEN '[1000,0]' WHEN c_custkey % 31 = 0 THEN '[1000.0]' ELSE '[1000,10000]' END,
  ',"model_seeds":', CASE WHEN c_custkey % 37 = 0 THEN '[0,-1]' WHEN c_custkey % 41 = 0 THEN '[true]' ELSE '[0,1]' END,
  ',"model_condition":"deep_sets_pfn"', CASE WHEN c_custkey % 43 = 0 THEN '' ELSE ',"mandatory":true' END,
  CASE WHEN c_custkey % 47 = 0 THEN ',"note":1' ELSE '' END, ',"dependency_hashes":',
  CASE WHEN c_custkey % 53 = 0 THEN '{}' WHEN c_custkey % 59 = 0 THEN '{"a":"short"}'
  ELSE concat('{"a":"', repeat('0', 64), '"}') END, '}')"""
_SWEEP_CHECKS = (
    ("CONTRACT_SCHEMA:stage", "k % 11 = 0"),
    ("CONTRACT_SCHEMA:feature_configs", "k % 13 = 0 OR k % 17 = 0 OR (k % 23 = 0 AND k % 19 <> 0)"),
    ("CONTRACT_SCHEMA:feature_configs[]", "k % 13 <> 0 AND k % 17 <> 0 AND k % 19 = 0"),
    ("CONTRACT_SCHEMA:train_sizes_per_class[]", "k % 29 = 0 OR k % 31 = 0"),
    ("CONTRACT_SCHEMA:model_seeds[]", "k % 37 = 0 OR k % 41 = 0"),
    ("CONTRACT_SCHEMA:mandatory", "k % 43 = 0"),
    ("CONTRACT_UNKNOWN_PROPERTY", "k % 47 = 0"),
    ("RUN_CONFIG_DEPENDENCIES", "k % 53 = 0 OR k % 59 = 0"),
    (
        "CONTRACT_TYPES",
        "(k % 23 = 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0) OR (k % 31 = 0 AND k % 29 <> 0) "
        "OR (k % 41 = 0 AND k % 37 <> 0) OR k % 47 = 0",
    ),
)


@query(
    "sweep_rules",
    "WITH c AS (SELECT c_custkey AS k FROM customer) "
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, k::VARCHAR AS key, '' AS detail FROM c WHERE {bad}" for rule, bad in _SWEEP_CHECKS
    ),
)
def sweep_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep configuration per customer, with faults of keys and axes planted."""
    keys = tables.spread(tables.table(spark, sf_dir, "customer").select("c_custkey"))
    configs = keys.select(F.col("c_custkey").alias("study"), F.expr(_SWEEP).alias("json"))
    return ledger.sweep_violations(configs)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'timed_out' END"


@query(
    "matrix_status",
    f"""WITH p AS (SELECT c_custkey AS study, f AS feature_config, i AS pos FROM customer,
  (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3)) AS x(f, i)),
r AS (SELECT o_custkey AS study, substr('ABCD', (o_orderkey % 4 + 1)::INTEGER, 1) AS feature_config,
  arg_max({_STATUS}, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS metric FROM orders GROUP BY ALL)
SELECT study, feature_config, pos, coalesce(status, 'missing') AS status,
  CASE WHEN status = 'succeeded' THEN metric END AS metric FROM p LEFT JOIN r USING (study, feature_config)""",
)
def matrix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four planned runs per customer; the last order of a kind is the run's record."""
    planned = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("study"),
        F.posexplode(F.array(*[F.lit(c) for c in "ABCD"])).alias("pos", "feature_config"),
    )
    config = F.substring(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    records = (
        tables.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("study"), config.alias("feature_config"))
        .agg(
            F.max_by(F.expr(_STATUS), "o_orderkey").alias("status"),
            F.max_by("o_totalprice", "o_orderkey").alias("metric"),
        )
    )
    made = ledger.matrix_status(planned, records, ["study", "feature_config"])
    return made.select("study", "feature_config", "pos", "status", "metric")


@query(
    "stage_gates",
    """WITH s AS (SELECT c_custkey AS study_id, ['E0', 'E0.5', 'E1', 'E2', 'E3'][(c_custkey % 5 + 1)::INTEGER] AS stage
  FROM customer),
n AS (SELECT study_id, gate FROM s JOIN (VALUES ('E0.5', 'E0'), ('E1', 'E0'), ('E1', 'E0.5'), ('E2', 'E0'), ('E2', 'E0.5'),
  ('E2', 'E1'), ('E2', 'E2_budget'), ('E3', 'E0'), ('E3', 'E0.5'), ('E3', 'E1'), ('E3', 'E2')) AS p(stage, gate)
  USING (stage)),
g AS (SELECT o_custkey AS study_id, ['E0', 'E0.5', 'E1', 'E2', 'E2_budget'][(o_orderkey % 5 + 1)::INTEGER] AS gate,
  arg_max(CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'blocked' END, o_orderkey) AS status,
  arg_max(o_orderkey % 3 = 0, o_orderkey) AS eligible, max(o_orderkey) AS k FROM orders GROUP BY ALL),
j AS (SELECT n.study_id, n.gate, k, status, eligible, coalesce(eligible, FALSE) OR coalesce(status = 'passed', FALSE) AS ok
  FROM n LEFT JOIN g USING (study_id, gate))
SELECT study_id, gate || ':missing' AS failure FROM j WHERE k IS NULL
UNION ALL SELECT study_id, gate || ':' || coalesce(status, 'invalid') FROM j WHERE k IS NOT NULL AND NOT ok
UNION ALL SELECT study_id, gate || ':invalid_hash' FROM j WHERE k % 7 = 0""",
)
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("E0", "E0.5", "E1", "E2", "E3")])
    stages = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("study_id"),
        F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("stage"),
    )
    gates = F.array(*[F.lit(s) for s in ("E0", "E0.5", "E1", "E2", "E2_budget")])
    k = F.col("o_orderkey")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'blocked' END")
    digest = F.when(k % 7 == 0, F.lit("stale")).otherwise(F.sha2(k.cast("string"), 256))
    last = F.max_by(
        F.struct(status.alias("status"), (k % 3 == 0).alias("eligible"), digest.alias("content_sha256")), k
    )
    held = (
        tables.table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("study_id"), F.element_at(gates, (k % 5 + 1).cast("int")).alias("gate")
        )
        .agg(last.alias("g"))
        .select("study_id", "gate", "g.*")
    )
    return ledger.stage_gate_failures(stages, held)


_REQUIRED = {
    "artifact": ("canonical_dataset",),
    "check": ("manifest", "labels", "split"),
    "decision": ("n_max",),
    "measurement": ("charged_no_track_fraction",),
}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a part are the evidence of one bundle; one item per line number."""
    n = F.col("l_linenumber")
    names = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
            for kind, name in (
                ("check", "manifest"),
                ("check", "labels"),
                ("check", "split"),
                ("artifact", "canonical_dataset"),
                ("decision", "n_max"),
                ("measurement", "charged_no_track_fraction"),
                ("note", "comment"),
            )
        ]
    )
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("bundle_id"),
        F.element_at(names, ((n - 1) % 7 + 1).cast("int")).alias("i"),
        "l_linestatus",
        "l_returnflag",
        "l_discount",
    )
    return rows.groupBy("bundle_id", "i.kind", "i.name").agg(
        F.bool_or(F.col("l_linestatus") == "F").alias("ok"),
        F.min(F.when(F.col("l_returnflag") == "N", F.lit("unresolved")).otherwise(F.col("l_returnflag"))).alias(
            "text"
        ),
        F.min("l_discount").alias("value"),
    )


@query(
    "gate_rollup",
    """WITH e AS (SELECT l_partkey AS b, (l_linenumber - 1) % 7 AS i, bool_or(l_linestatus = 'F') AS ok,
  min(CASE l_returnflag WHEN 'N' THEN 'unresolved' ELSE l_returnflag END) AS txt, min(l_discount) AS v
  FROM lineitem GROUP BY ALL),
x AS (SELECT b, list(DISTINCT i) FILTER (i <= 5 AND NOT (i = 4 AND txt = 'unresolved')) AS have,
  list(DISTINCT i) FILTER (i <= 3 AND NOT ok) AS bad, bool_or(i = 5 AND v > 0.02) AS hi FROM e GROUP BY b),
y AS (SELECT b, list_filter([3, 1, 0, 2, 4, 5], lambda q: NOT coalesce(list_contains(have, q), FALSE)) AS m,
  list_filter([3, 1, 0, 2], lambda q: coalesce(list_contains(bad, q), FALSE)) AS f, hi FROM x),
z AS (SELECT b, array_to_string(list_transform(m, lambda q: ['check:manifest', 'check:labels', 'check:split',
    'artifact:canonical_dataset', 'decision:n_max', 'measurement:charged_no_track_fraction'][q + 1]), ',') AS missing,
  array_to_string(list_sort(list_concat(list_transform(f, lambda q: ['check:manifest', 'check:labels', 'check:split',
    'artifact:canonical_dataset'][q + 1]), CASE WHEN hi AND NOT list_contains(m, 5) THEN ['charged_no_track_fraction']
    ELSE [] END)), ',') AS failed FROM y)
SELECT b AS bundle_id, missing, failed, CASE WHEN missing <> '' THEN 'blocked_external_evidence'
  WHEN failed <> '' THEN 'failed' ELSE 'passed' END AS status FROM z
UNION ALL
SELECT DISTINCT p_partkey + 10000000 * (p_partkey % 40 = 0)::INTEGER, 'artifact:canonical_dataset,check:labels,check:manifest,check:split,decision:n_max,measurement:charged_no_track_fraction',
  '', 'blocked_external_evidence' FROM part
WHERE p_partkey % 40 = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
)
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a bundle; some bundles have no evidence at all."""
    evidence = _evidence(spark, sf_dir)
    k = F.col("p_partkey")
    part = tables.table(spark, sf_dir, "part")
    unknown = part.filter(k % 40 == 0).select((k + 10000000).alias("bundle_id"))
    listed = part.select(k.alias("bundle_id")).union(unknown).union(evidence.select("bundle_id"))
    return ledger.gate_rollup(
        evidence, _REQUIRED, maxima={"charged_no_track_fraction": 0.02}, bundles=listed
    )


@query(
    "check_rollup",
    """WITH e AS (SELECT l_partkey AS b, (l_linenumber - 1) % 7 AS i, bool_or(l_linestatus = 'F') AS ok
  FROM lineitem GROUP BY ALL),
x AS (SELECT b, count(*) FILTER (i <= 2) AS n, list_sort(list(i) FILTER (i <= 2)) AS have,
  list_sort(list(['manifest', 'labels', 'split'][i + 1]) FILTER (i <= 2 AND NOT ok)) AS bad FROM e GROUP BY b),
y AS (SELECT b, array_to_string(list_filter(['labels', 'manifest', 'split'], lambda q: NOT coalesce(list_contains(
    list_transform(have, lambda h: ['manifest', 'labels', 'split'][h + 1]), q), FALSE)), ',') AS missing,
  coalesce(array_to_string(bad, ','), '') AS failed FROM x),
z AS (SELECT *, CASE WHEN failed <> '' THEN CASE WHEN b % 2 = 0 THEN 'fallback_approved' ELSE 'failed' END
  WHEN missing <> '' OR b % 4 = 3 THEN 'blocked_external_evidence' ELSE 'passed' END AS status FROM y)
SELECT b AS bundle_id, missing, failed, status, status IN ('passed', 'fallback_approved') AS formal_gate_eligible FROM z""",
)
def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bundle_id")
    rows = _evidence(spark, sf_dir).select(
        b,
        "name",
        "ok",
        F.when(b % 4 == 3, F.lit("workstation")).otherwise(F.lit(ledger.FORMAL_ORIGIN)).alias("origin"),
        (b % 2 == 0).alias("fallback_approved"),
    )
    return ledger.check_rollup(rows, ("manifest", "labels", "split"))


# Two versions of a policy as rows: they differ in pilots, yield and budget.
_VERSIONS = (("v1", 2.0, 900.0, 1000.0), ("v2", 3.0, 1000.0, 600.0))
_HOST_TEXTS = ("container_digest", "host_id", "source_manifest_sha256", "tested_commit")


def _policy_rows() -> list[tuple]:
    rows = []
    for version, pilots, yield_, budget in _VERSIONS:

        def rule(kind, name, test, label, part="", bound=None, text=None, version=version):
            rows.append((version, kind, name, test, bound, text, label, part))

        rule("tier", "evidence_tier", "same", "qualified_host_evidence_tier", text="qualified_host")
        rule("host", "qualification", "present", "host_qualification", ledger.HOST)
        for name in _HOST_TEXTS:
            rule("host", name, "present", f"host_qualification:{name}", ledger.HOST)
            rule("host", name, "filled", f"host_qualification:{name}", ledger.HOST)
        for name in ("tt_qualification_files", "qcd_qualification_files"):
            rule("host", name, "equal", f"host_qualification:{name}", ledger.HOST, 1.0)
        rule("host", "tt_pilot_files", "at_least", "tt_pilot_file_coverage", ledger.HOST, pilots)
        for record in ("18001", "18002"):
            rule("pilot", record, "at_least", f"qcd_pilot_file_coverage:{record}", ledger.HOST, 2.0)
        for name in ("manifest", "dataset"):
            rule("artifact", name, "present", f"artifact:{name}")
            rule("artifact", name, "true", f"artifact:{name}")
        rule("check", "overlap", "present", "check:overlap")
        rule("check", "overlap", "true", "check:overlap")
        rule("decision", "pt_window", "decided", "freeze_decision:pt_window")
        for name in ("charged_no_track_fraction", "selected_qcd_jets", "selected_top_jets"):
            rule("measurement", name, "present", f"measurement:{name}", ledger.MEASUREMENT)
        rule("projection", "valid", "true", "resource_measurements", ledger.MEASUREMENT)
        rule("measurement", "charged_no_track_fraction", "at_most", "charged_no_track_fraction", ledger.MEASUREMENT, 0.05)
        rule("measurement", "selected_qcd_jets", "at_least", "qcd_yield", ledger.MEASUREMENT, yield_)
        rule("measurement", "selected_top_jets", "at_least", "top_yield", ledger.MEASUREMENT, yield_)
        rule("projection", "total_cost", "at_most", "working_budget", ledger.MEASUREMENT, budget)
    return rows


# (label, when it is missing or failed); k is the customer, b the budget of its version.
_HOSTLESS = "k % 23 = 0"
_HOST_GAP = "(k % 23 = 0 OR k % 19 = 0)"
_UNMEASURED = "k % 29 = 0"
_MISSING = (
    ("artifact:manifest", "k % 11 = 0"),
    ("check:overlap", "k % 13 = 0"),
    ("freeze_decision:pt_window", "k % 17 = 0"),
    ("host_qualification", _HOSTLESS),
    ("host_qualification:host_id", f"k % 19 = 0 AND NOT {_HOSTLESS}"),
    ("measurement:selected_top_jets", _UNMEASURED),
    ("qualified_host_evidence_tier", "k % 31 = 0"),
)
_LIMITS = f"NOT {_UNMEASURED} AND NOT k % 37 = 0"
_FAILED = (
    ("artifact:dataset", "k % 41 = 0"),
    ("charged_no_track_fraction", f"{_LIMITS} AND k % 43 = 0"),
    ("check:overlap", "k % 13 <> 0 AND k % 47 = 0"),
    ("host_qualification:qcd_qualification_files", f"NOT {_HOST_GAP} AND k % 53 = 0"),
    ("host_qualification:tested_commit", f"NOT {_HOST_GAP} AND k % 59 = 0"),
    ("qcd_pilot_file_coverage:18002", f"NOT {_HOST_GAP} AND k % 61 = 0"),
    ("qcd_yield", f"{_LIMITS} AND 900 + k % 300 < y"),
    ("resource_measurements", f"NOT {_UNMEASURED} AND k % 37 = 0"),
    ("top_yield", f"{_LIMITS} AND k % 67 = 0"),
    ("tt_pilot_file_coverage", f"NOT {_HOST_GAP} AND 1 + k % 5 < p"),
    ("working_budget", f"{_LIMITS} AND 1.25::DOUBLE * (300 + k % 500) > b"),
)


def _labels_sql(rules) -> str:
    cases = ", ".join(f"CASE WHEN {bad} THEN '{label}' END" for label, bad in rules)
    return f"coalesce(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ','), '')"


@query(
    "policy_gates",
    f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS policy_id,
  CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS p, CASE WHEN c_custkey % 2 = 0 THEN 900 ELSE 1000 END AS y,
  CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 600 END AS b FROM customer),
l AS (SELECT k AS bundle_id, policy_id, {_labels_sql(_MISSING)} AS missing, {_labels_sql(_FAILED)} AS failed FROM c),
s AS (SELECT *, CASE WHEN missing <> '' THEN 'blocked_external_evidence' WHEN failed <> '' THEN 'failed' ELSE 'passed' END
  AS status FROM l)
SELECT *, status = 'passed' AS formal_gate_eligible FROM s
UNION ALL SELECT -1 - n_nationkey, 'v1', 'artifact:dataset,artifact:manifest,check:overlap,freeze_decision:pt_window,'
  || 'host_qualification,measurement:charged_no_track_fraction,measurement:selected_qcd_jets,'
  || 'measurement:selected_top_jets,qualified_host_evidence_tier', '', 'blocked_external_evidence', FALSE FROM nation""",
)
def policy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a bundle under one of two policy versions; nations are bundles without evidence.
    Costs come from the resource projection of the bundle's jobs."""
    k = F.col("bundle_id")
    customers = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("bundle_id"))

    def item(kind, name, ok=None, text=None, value=None, when=None):
        struct = F.struct(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            (F.lit(None).cast("boolean") if ok is None else ok).alias("ok"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
        )
        return struct if when is None else F.when(when, struct)

    host = k % 23 != 0
    items = [
        item("tier", "evidence_tier", text=F.when(k % 31 == 0, F.lit("workstation")).otherwise(F.lit("qualified_host"))),
        item("host", "qualification", when=host),
        *[
            item("host", name, text=F.lit("x"), when=host)
            for name in ("container_digest", "source_manifest_sha256")
        ],
        item("host", "host_id", text=F.lit("h"), when=host & (k % 19 != 0)),
        item("host", "tested_commit", text=F.when(k % 59 == 0, F.lit(" ")).otherwise(F.lit("c")), when=host),
        item("host", "tt_qualification_files", value=F.lit(1), when=host),
        item("host", "qcd_qualification_files", value=F.when(k % 53 == 0, 2).otherwise(1), when=host),
        item("host", "tt_pilot_files", value=1 + k % 5, when=host),
        item("pilot", "18001", value=F.lit(2), when=host),
        item("pilot", "18002", value=F.lit(3), when=host & (k % 61 != 0)),
        item("artifact", "manifest", ok=F.lit(True), when=k % 11 != 0),
        item("artifact", "dataset", ok=k % 41 != 0),
        item("check", "overlap", ok=k % 47 != 0, when=k % 13 != 0),
        item("decision", "pt_window", text=F.when(k % 17 == 0, F.lit("Unresolved")).otherwise(F.lit("500-1000"))),
        item("measurement", "charged_no_track_fraction", value=F.when(k % 43 == 0, F.lit(0.06)).otherwise(F.lit(0.05))),
        item("measurement", "selected_qcd_jets", value=900 + k % 300),
        item("measurement", "selected_top_jets", value=F.when(k % 67 == 0, 10).otherwise(5000), when=k % 29 != 0),
    ]
    evidence = customers.select("bundle_id", F.explode(F.array_compact(F.array(*items))).alias("i")).select(
        "bundle_id", "i.*"
    )
    one = F.lit(1).cast("bigint")
    jobs = customers.select(
        "bundle_id",
        *[one.alias(c) for c in ledger.RESOURCE_SUMS if c not in ("wall_seconds", "failed_files")],
        F.when(k % 37 == 0, 0).otherwise(10).cast("bigint").alias("wall_seconds"),
        F.lit(0).cast("bigint").alias("failed_files"),
        *[
            (F.lit(100.0) if n else (F.lit(100) + k % 500).cast("double")).alias(c)
            for n, c in enumerate(ledger.COSTS)
        ],
    )
    costs = ledger.projected_evidence(ledger.resource_projection(jobs, "bundle_id", 0.25), "bundle_id")
    version = F.when(k % 2 == 0, F.lit("v1")).otherwise(F.lit("v2"))
    without = tables.table(spark, sf_dir, "nation").select(
        (F.lit(-1) - F.col("n_nationkey")).cast("bigint").alias("bundle_id"), F.lit("v1").alias("policy_id")
    )
    bundles = customers.select("bundle_id", version.alias("policy_id")).unionByName(without)
    policies = spark.createDataFrame(_policy_rows(), ledger.POLICY)
    return ledger.policy_gates(evidence.unionByName(costs), policies, bundles)


_STATUSES = """st AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'specified' WHEN '2-HIGH'
  THEN 'implemented' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'deferred' ELSE 'verified' END
  ELSE 'verified' END AS status FROM orders)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'specified' WHEN '2-HIGH' THEN 'implemented' "
        "WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'deferred' ELSE 'verified' END "
        "ELSE 'verified' END"
    )
    return tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status")
    )


@query(
    "status_monotonicity",
    f"""WITH {_STATUSES}, e AS (SELECT l_orderkey AS child, l_partkey * 8 AS upstream FROM lineitem),
a AS (SELECT child, bool_or(s.status IS NULL) AS unknown, bool_or(coalesce(s.status = 'deferred', FALSE)) AS d,
  min(CASE s.status WHEN 'specified' THEN 0 WHEN 'implemented' THEN 1 WHEN 'verified' THEN 2 END) AS weakest
  FROM e LEFT JOIN st s ON s.id = upstream GROUP BY child),
j AS (SELECT a.*, st.status FROM a LEFT JOIN st ON st.id = child),
r AS (SELECT CASE WHEN unknown OR status IS NULL THEN 'REPORT_STATUS_REFERENCE'
  WHEN d THEN CASE WHEN status <> 'deferred' THEN 'REPORT_STATUS_MONOTONICITY' END
  WHEN status = 'deferred' THEN NULL
  WHEN CASE status WHEN 'specified' THEN 0 WHEN 'implemented' THEN 1 ELSE 2 END > weakest
    THEN 'REPORT_STATUS_MONOTONICITY' END AS rule, child FROM j)
SELECT rule, child::VARCHAR AS key, '' AS detail FROM r WHERE rule IS NOT NULL""",
)
def status_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are items, their parts point to upstream items, some of which do not exist."""
    edges = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("child"), (F.col("l_partkey") * 8).alias("upstream")
    )
    return ledger.status_violations(edges, _statuses(spark, sf_dir))


_CATEGORY = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'pretrained_transfer' WHEN 'MACHINERY' THEN "
    "'cross_architecture_robustness' ELSE 'feature_value' END"
)
_CLAIMS = f"""{_STATUSES}, claims AS (SELECT c_custkey AS claim_id, {_CATEGORY} AS category FROM customer),
reasons AS (
  SELECT o_custkey AS claim_id, 'unverified:' || o_orderkey AS reason FROM orders
  JOIN st ON id = o_orderkey WHERE status <> 'verified'
  UNION ALL SELECT claim_id, 'supervised_fallback_removes_pretrained_transfer' FROM claims
  WHERE category = 'pretrained_transfer'
  UNION ALL SELECT claim_id, 'e3_control_deferred' FROM claims WHERE category = 'cross_architecture_robustness')"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    claims = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("claim_id"), F.expr(_CATEGORY).alias("category")
    )
    dependencies = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("dependency")
    )
    return claims, ledger.claim_reasons(claims, dependencies, _statuses(spark, sf_dir), True, True)


@query("claim_reasons", f"WITH {_CLAIMS} SELECT * FROM reasons")
def claim_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)[1]


@query(
    "claim_ledger",
    f"""WITH {_CLAIMS} SELECT claim_id, category, count(reason)::BIGINT AS reasons, count(reason) = 0 AS eligible
FROM claims LEFT JOIN reasons USING (claim_id) GROUP BY claim_id, category""",
)
def claim_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, reasons = _claims(spark, sf_dir)
    return ledger.claim_ledger(claims, reasons)


@query(
    "catalog_diff",
    """SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'skipped' WHEN p_partkey % 11 = 0 THEN 'mismatched'
  ELSE 'loaded' END AS result FROM part WHERE p_partkey % 7 <> 0""",
)
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as two shape catalogs that differ in entries and in shapes."""
    p = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(
        p, p.alias("name"), F.array(F.col("p_size"), (p % 64).cast("int")).alias("shape")
    )
    source = rows.filter(p % 7 != 0).select("name", "shape")
    target = rows.filter(p % 5 != 0).select(
        "name",
        F.when(p % 11 == 0, F.slice("shape", 1, 1)).otherwise(F.col("shape")).alias("shape"),
    )
    return ledger.catalog_diff(source, target)


@query(
    "status_reconcile",
    f"""WITH {_STATUSES}, l AS (SELECT * FROM st WHERE id % 61 <> 0),
r AS (SELECT id, CASE WHEN id % 59 = 0 THEN 'verified' ELSE status END AS status FROM st WHERE id % 67 <> 0),
j AS (SELECT id, l.status AS a, r.status AS b FROM l FULL OUTER JOIN r USING (id))
SELECT 'missing_right' AS rule, id::VARCHAR AS key, a AS detail FROM j WHERE b IS NULL
UNION ALL SELECT 'missing_left', id::VARCHAR, b FROM j WHERE a IS NULL
UNION ALL SELECT 'status_mismatch', id::VARCHAR, a || '/' || b FROM j WHERE a <> b""",
)
def status_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statuses(spark, sf_dir)
    i = F.col("id")
    right = rows.filter(i % 67 != 0).withColumn(
        "status", F.when(i % 59 == 0, F.lit("verified")).otherwise(F.col("status"))
    )
    return ledger.reconcile(rows.filter(i % 61 != 0), right)


@query(
    "resource_projection",
    """WITH j AS (SELECT user_id, 1000 + event_id % 977 AS sb, 1 + event_id % 13 AS ev,
    (event_id % 101)::DOUBLE / 8 AS cpu, (event_id % 89)::DOUBLE / 4 AS wall, (event_type = 'error')::INTEGER AS bad,
    event_id % 17 AS cb, event_id % 19 AS kb, event_id % 23 AS vb, event_id % 5 AS c0, event_id % 6 AS c1, event_id % 7 AS c2
  FROM events),
s AS (SELECT user_id, sum(sb) AS sb, sum(ev) AS ev, sum(cpu) AS cpu, sum(wall) AS wall, sum(bad) AS bad, count(*) AS n,
  sum(cb + kb + vb) AS st, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2 FROM j GROUP BY 1)
SELECT user_id, CASE WHEN wall > 0 THEN round(sb / wall, 6) END AS source_bytes_per_wall_second,
  CASE WHEN wall > 0 THEN round(ev / wall, 6) END AS events_per_wall_second,
  CASE WHEN wall > 0 THEN round(cpu / ev, 6) END AS cpu_seconds_per_event,
  CASE WHEN wall > 0 THEN round(bad::DOUBLE / n, 6) END AS file_failure_fraction,
  st::BIGINT AS retained_storage_bytes, c0 * 1.25::DOUBLE AS e0_reserved_cost_usd,
  c1 * 1.25::DOUBLE AS e1_reserved_cost_usd, c2 * 1.25::DOUBLE AS e2_reserved_cost_usd,
  (c0 + c1 + c2) * 1.25::DOUBLE AS projected_total_cost_usd,
  CASE WHEN wall > 0 THEN 'ok' ELSE 'E0_MEASUREMENT' END AS status FROM s""",
)
def resource_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one job row of its user's bundle."""
    e = F.col("event_id")
    jobs = tables.table(spark, sf_dir, "events").select(
        "user_id",
        (e % 977 + 1000).alias("source_bytes"),
        (e % 13 + 1).alias("events_processed"),
        ((e % 101) / F.lit(8.0)).alias("cpu_seconds"),
        ((e % 89) / F.lit(4.0)).alias("wall_seconds"),
        (F.col("event_type") == "error").cast("int").alias("failed_files"),
        F.lit(1).alias("total_files"),
        (e % 17).alias("compact_bytes"),
        (e % 19).alias("canonical_bytes"),
        (e % 23).alias("view_bytes"),
        (e % 5).alias("e0_base_cost_usd"),
        (e % 6).alias("e1_base_cost_usd"),
        (e % 7).alias("e2_base_cost_usd"),
    )
    made = ledger.resource_projection(jobs, "user_id", 0.25)
    ratios = [c for c in made.columns if c.endswith(("second", "event", "fraction"))]
    return made.withColumns({c: F.round(c, 6) for c in ratios})
