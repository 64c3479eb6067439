"""Registered queries: record contracts, text scans, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.functions import text
from jetframe.operators import contracts, textscan
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query

SHA = "sha2(cast(o_orderkey as string), 256)"
ARTIFACT = f"named_struct('path', concat('out/', o_orderkey), 'sha256', {SHA})"

_RUN = f"""to_json(named_struct(
  'schema_version', CASE WHEN o_orderkey % 71 = 0 THEN '2.0.0' ELSE '1.0.0' END,
  'run_id', CASE WHEN o_orderkey % 73 = 0 THEN 'Bad Id' ELSE concat('run-', o_orderkey) END,
  'study_id', concat('study-', o_custkey), 'stage', 'E2',
  'status', CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'timed_out' END,
  'created_at', '2026-01-01T00:00:00Z', 'started_at', '2026-01-01T00:00:00Z',
  'ended_at', CASE WHEN o_orderkey % 79 = 0 THEN '2026-01-01T00:00:00+01:00' ELSE '2026-01-01T00:10:00Z' END,
  'git', named_struct('repository', 'repo', 'commit', substring({SHA}, 1, 40), 'dirty', false),
  'data', named_struct('dataset_name', 'CMS 2015 RunIIFall15MiniAODv2', 'source_manifest_sha256', {SHA},
    'canonical_dataset', {ARTIFACT}, 'split_manifest', {ARTIFACT}, 'preprocessing', {ARTIFACT}, 'view', {ARTIFACT}),
  'condition', named_struct('feature_config', substring('ABCDE', cast(o_orderkey % 5 + 1 as int), 1),
    'train_size_per_class', o_orderkey % 83, 'subset_id', 'n1000', 'subset_seed', 7, 'model_seed', 1),
  'model', named_struct('family', element_at(array('pretrained_omnilearned', 'random_initialized_omnilearned',
      'deep_sets_pfn'), cast(o_orderkey % 3 + 1 as int)), 'repository', 'r', 'revision', 'v',
    'adapter_policy', 'native_baseline', 'output_head', 'binary_top_qcd',
    'checkpoint', CASE WHEN o_orderkey % 2 = 0 THEN named_struct('source', 's', 'immutable_revision', 'i',
      'filename', 'f', 'sha256', {SHA}, 'license', 'l', 'pretraining_corpus', 'c') END,
    'omnilearned_index', CASE WHEN o_orderkey % 7 <> 0 THEN {ARTIFACT} END,
    'loaded_tensors', array('t'), 'skipped_tensors', array('t'), 'mismatched_tensors', array('t')),
  'hyperparameters', named_struct('optimizer', 'adamw', 'learning_rate', 0.001D, 'batch_size', 8, 'max_epochs', 5,
    'weight_decay', 0.0D, 'early_stopping', named_struct('monitor', 'auc', 'mode', 'max', 'patience', 5,
    'min_delta', 0.0D), 'extra', named_struct('a', 1)),
  'environment', named_struct('python_version', '3', 'dependency_lock_sha256', {SHA}, 'operating_system', 'linux',
    'device', named_struct('type', 'cpu', 'name', 'cpu'), 'deterministic_algorithms', true),
  'timing', named_struct('wall_seconds', CASE WHEN o_orderkey % 89 = 0 THEN -1.0D ELSE 1.5D END),
  'metrics', CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN named_struct('best_epoch', 1,
    'validation_auc', 0.9D, 'test_auc', CASE WHEN o_orderkey % 97 = 0 THEN 1.5D ELSE 0.9D END, 'test_accuracy', 0.8D,
    'epsilon_b_at_epsilon_s_0_30', 0.1D, 'epsilon_b_at_epsilon_s_0_50', 0.2D) END,
  'artifacts', named_struct('run_directory', 'd', 'resolved_config', {ARTIFACT}, 'stdout_log', {ARTIFACT},
    'stderr_log', {ARTIFACT}, 'prediction_metadata', CASE WHEN o_orderkey % 13 <> 0 THEN {ARTIFACT} END),
  'failure', CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 17 <> 0 OR o_orderstatus = 'F' AND o_orderkey % 19 = 0
    THEN named_struct('code', CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE 'RUN_TIMEOUT' END, 'phase', 'train',
    'message', 'm') END,
  'note', CASE WHEN o_orderkey % 101 = 0 THEN 'extra' END))"""


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per order, with violations planted by key."""
    return _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"), F.expr(_RUN).alias("json")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.spread(narrow)


_RUN_CHECKS = (
    ("CONTRACT_SCHEMA:schema_version", "k % 71 = 0"),
    ("CONTRACT_UNSUPPORTED_MAJOR", "k % 71 = 0"),
    ("CONTRACT_SCHEMA:run_id", "k % 73 = 0"),
    ("CONTRACT_SCHEMA:ended_at", "k % 79 = 0"),
    ("CONTRACT_SCHEMA:condition.feature_config", "k % 5 = 4"),
    ("CONTRACT_SCHEMA:condition.train_size_per_class", "k % 83 = 0"),
    ("CONTRACT_SCHEMA:timing.wall_seconds", "k % 89 = 0"),
    ("CONTRACT_SCHEMA:metrics.test_auc", "s = 'F' AND k % 11 <> 0 AND k % 97 = 0"),
    ("CONTRACT_SCHEMA:failure.code", "(s <> 'F' AND k % 17 <> 0 OR s = 'F' AND k % 19 = 0) AND k % 23 = 0"),
    ("CONTRACT_UNKNOWN_PROPERTY", "k % 101 = 0"),
    ("CONTRACT_TYPES", "k % 101 = 0"),
    ("RUN_SUCCESS_WITHOUT_METRICS", "s = 'F' AND k % 11 = 0"),
    ("RUN_SUCCESS_WITH_FAILURE", "s = 'F' AND k % 19 = 0"),
    ("RUN_SUCCESS_WITHOUT_PREDICTION", "s = 'F' AND k % 13 = 0"),
    ("RUN_FAILED_WITHOUT_FAILURE", "s <> 'F' AND k % 17 = 0"),
    ("RUN_WITHOUT_INDEX", "k % 3 <> 2 AND k % 7 = 0"),
    ("RUN_WITHOUT_CHECKPOINT", "k % 3 = 0 AND k % 2 = 1"),
)


def _checks_sql(source: str, checks) -> str:
    return f"WITH r AS ({source}) " + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, k::VARCHAR AS key, '' AS detail FROM r WHERE {bad}" for rule, bad in checks
    )


@query(
    "record_contract",
    _checks_sql("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders", _RUN_CHECKS),
)
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.record_violations(run_records(spark, sf_dir), "run")


# Every 59th order repeats the run id of the order before it.
_RUN_OF = "o_orderkey - CASE WHEN o_orderkey % 59 = 58 THEN 1 ELSE 0 END"
_RUN_ID = "CASE WHEN o_orderkey % 73 = 0 THEN 'Bad Id' ELSE concat('run-', {}) END"


@query(
    "run_collection",
    _checks_sql("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders", _RUN_CHECKS)
    + f""" UNION ALL SELECT 'REPORT_DUPLICATE_RUN', run_id, 'count=' || count(*)
FROM (SELECT {_RUN_ID.format(_RUN_OF)} AS run_id FROM orders) GROUP BY run_id HAVING count(*) > 1""",
)
def run_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _RUN.replace(_RUN_ID.format("o_orderkey"), _RUN_ID.format(_RUN_OF))
    rows = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"), F.expr(text).alias("json")
    )
    return contracts.run_collection(rows)


@query(
    "contract_kinds",
    """WITH k AS (SELECT o_orderkey AS key, CASE o_orderkey % 7 WHEN 0 THEN 'run' WHEN 1 THEN 'split' WHEN 3 THEN 'e0_audit'
  WHEN 4 THEN 'e05_audit' WHEN 6 THEN 'prediction' END AS kind FROM orders)
SELECT key, kind, CASE WHEN kind IS NULL THEN 'CONTRACT_KIND' END AS rule FROM k""",
)
def contract_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the identifying field of one kind, of two kinds, or of none."""
    k = F.col("o_orderkey")

    def when(*residues: int):
        return F.when((k % 7).isin(*residues), k.cast("string"))

    record = F.to_json(
        F.struct(
            F.lit("1.0.0").alias("schema_version"),
            when(0, 2).alias("run_id"),
            when(1).alias("manifest_id"),
            when(2, 6).alias("prediction_id"),
            when(3).alias("e0_audit_id"),
            when(4).alias("e05_audit_id"),
        )
    )
    rows = _orders(spark, sf_dir).select(k.alias("key"), record.alias("json"))
    return contracts.detected_kinds(rows)


_PREDICTION = f"""to_json(named_struct('schema_version', '1.0.0', 'prediction_id', concat('pred-', o_orderkey),
  'run_id', concat('run-', o_orderkey), 'created_at', '2026-01-01T00:00:00Z',
  'partition', CASE WHEN o_orderkey % 31 = 0 THEN 'train' ELSE 'test' END, 'feature_config', 'A',
  'model_condition', 'deep_sets_pfn', 'split_manifest_sha256', {SHA}, 'view_sha256', {SHA},
  'ordered', o_orderkey % 37 <> 0, 'row_count', 100 + o_orderkey % 41, 'class_counts', named_struct('qcd', 60, 'top', 40),
  'row_order_sha256', CASE WHEN o_orderkey % 43 = 0 THEN 'short' ELSE {SHA} END, 'logical_columns', named_struct('a', 1),
  'payload', named_struct('a', 1), 'content_hash', named_struct('algorithm', 'sha256', 'canonicalization',
  'utf8-sorted-keys-compact-json-lf-excluding-content_hash.metadata_sha256', 'metadata_sha256', {SHA})))"""


@query(
    "prediction_contract",
    _checks_sql(
        "SELECT o_orderkey AS k FROM orders",
        (
            ("CONTRACT_SCHEMA:partition", "k % 31 = 0"),
            ("CONTRACT_SCHEMA:ordered", "k % 37 = 0"),
            ("CONTRACT_SCHEMA:row_order_sha256", "k % 43 = 0"),
            ("CONTRACT_ROW_COUNT", "k % 41 <> 0"),
        ),
    ),
)
def prediction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"), F.expr(_PREDICTION).alias("json")
    )
    return contracts.record_violations(rows, "prediction")


# Planted by position of the key: value types, item types, malformed text, keys inside an object.
_FAULTS = """CASE o_orderkey % 13
  WHEN 1 THEN regexp_replace(json, '"prediction_id":"[^"]*"', '"prediction_id":12')
  WHEN 2 THEN regexp_replace(json, '"payload":[{][^}]*[}]', '"payload":"junk"')
  WHEN 3 THEN regexp_replace(json, '"row_count":([0-9]+)', '"row_count":$1.0')
  WHEN 4 THEN regexp_replace(json, '"ordered":(true|false)', '"ordered":"true"')
  WHEN 5 THEN substring(json, 1, length(json) - 1)
  WHEN 6 THEN regexp_replace(json, '"top":40', '"top":40,"other":1')
  WHEN 7 THEN regexp_replace(json, '"row_count":[0-9]+', '"row_count":null')
  WHEN 8 THEN regexp_replace(json, '"qcd":60', '"qcd":60.5')
  ELSE json END"""


@query(
    "contract_types",
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 13 AS f FROM orders)
SELECT 'CONTRACT_JSON' AS rule, k::VARCHAR AS key, '' AS detail FROM r WHERE f = 5
UNION ALL SELECT 'CONTRACT_TYPES', k::VARCHAR, '' FROM r WHERE f IN (1, 2, 4, 6)
UNION ALL SELECT 'CONTRACT_SCHEMA:prediction_id', k::VARCHAR, '' FROM r WHERE f = 1
UNION ALL SELECT 'CONTRACT_UNKNOWN_PROPERTY:class_counts', k::VARCHAR, '' FROM r WHERE f = 6
UNION ALL SELECT 'CONTRACT_SCHEMA:row_count', k::VARCHAR, '' FROM r WHERE f = 7
UNION ALL SELECT 'CONTRACT_SCHEMA:class_counts.qcd', k::VARCHAR, '' FROM r WHERE f = 8
UNION ALL SELECT 'CONTRACT_SCHEMA:partition', k::VARCHAR, '' FROM r WHERE k % 31 = 0 AND f <> 5
UNION ALL SELECT 'CONTRACT_SCHEMA:ordered', k::VARCHAR, '' FROM r WHERE f NOT IN (4, 5) AND k % 37 = 0 OR f = 4
UNION ALL SELECT 'CONTRACT_SCHEMA:row_order_sha256', k::VARCHAR, '' FROM r WHERE k % 43 = 0 AND f <> 5
UNION ALL SELECT 'CONTRACT_ROW_COUNT', k::VARCHAR, '' FROM r
  WHERE f NOT IN (5, 7, 8) AND k % 41 <> 0 OR f = 8""",
)
def contract_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records with one fault per kind of fault; a whole 100.0 is a valid count."""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.expr(_PREDICTION).alias("json"))
    faulty = rows.select(F.col("o_orderkey").alias("key"), F.expr(_FAULTS).alias("json"))
    return contracts.record_violations(faulty, "prediction")


@query(
    "document_hash",
    """SELECT 'CONTRACT_HASH_MISMATCH' AS rule, o_orderkey::VARCHAR AS key, '' AS detail FROM orders
WHERE o_orderkey % 10 = 3
UNION ALL SELECT 'CONTRACT_HASH_FIELD', o_orderkey::VARCHAR, '' FROM orders WHERE o_orderkey % 10 = 4
UNION ALL SELECT 'CONTRACT_JSON', o_orderkey::VARCHAR, '' FROM orders WHERE o_orderkey % 10 = 5""",
)
def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records that hold the digest of their own canonical text; keys and spaces vary."""
    k = F.col("o_orderkey")
    status = F.concat(F.lit('"status":"é '), "o_orderstatus", F.lit('"'))
    owner = F.concat(F.lit('"e05_audit_id":"a-'), k.cast("string"), F.lit('"'))
    numbers = F.concat(F.lit('"n":{"a":['), k.cast("string"), F.lit(',0.5],"b":null}'))
    canonical = F.concat(F.lit("{"), owner, F.lit(","), numbers, F.lit(","), status, F.lit("}\n"))
    digest = F.sha2(F.when(k % 10 == 3, F.lit("other")).otherwise(canonical), 256)
    field = F.when(k % 10 == 4, F.lit("")).otherwise(
        F.concat(F.lit('"content_sha256" : "'), digest, F.lit('", '))
    )
    end = F.when(k % 10 == 5, F.lit("")).otherwise(F.lit("}"))
    json = F.concat(F.lit("{ "), status, F.lit(", "), field, numbers, F.lit(",\n "), owner, end)
    rows = tables.table(spark, sf_dir, "orders").select(k.alias("key"), json.alias("json"))
    return contracts.hash_violations(rows, "e05_audit")


_GATE = f"""to_json(named_struct('schema_version', '1.0.0', 'e05_audit_id', concat('e-', o_orderkey),
  'status', element_at(array('passed', 'failed', 'blocked_external_evidence', 'fallback_approved'),
    cast(o_orderkey % 4 + 1 as int)), 'formal_gate_eligible', o_orderkey % 2 = 0,
  'evidence_origin', CASE WHEN o_orderkey % 5 = 0 THEN 'laptop' ELSE 'qualified_runpod' END,
  'dependency_revision', substring({SHA}, 1, 40),
  'missing_evidence', CASE WHEN o_orderkey % 3 = 0 THEN array('m') ELSE array() END,
  'failed_checks', CASE WHEN o_orderkey % 7 = 0 THEN array('f', 'f') WHEN o_orderkey % 7 = 1 THEN array('f')
    ELSE array() END,
  'model_condition', CASE WHEN o_orderkey % 11 = 0 THEN 'random_initialized_omnilearned'
    ELSE 'pretrained_omnilearned' END, 'policy_sha256', {SHA}, 'content_sha256', {SHA}))"""


@query(
    "gate_contract",
    _checks_sql(
        "SELECT o_orderkey AS k FROM orders",
        (
            ("CONTRACT_SCHEMA:failed_checks", "k % 7 = 0"),
            ("CONTRACT_GATE_STATUS:eligible", "(k % 2 = 0) <> (k % 4 IN (0, 3))"),
            ("CONTRACT_GATE_STATUS:passed", "k % 4 = 0 AND (k % 3 = 0 OR k % 7 <= 1)"),
            ("CONTRACT_GATE_STATUS:origin", "k % 4 = 0 AND k % 5 = 0"),
            ("CONTRACT_GATE_STATUS:condition", "k % 4 = 0 AND k % 11 = 0"),
            ("CONTRACT_GATE_STATUS:blocked", "k % 4 = 2 AND k % 3 <> 0 AND k % 5 <> 0"),
            ("CONTRACT_GATE_STATUS:fallback", "k % 4 = 3 AND (k % 11 <> 0 OR k % 7 > 1)"),
        ),
    ),
)
def gate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.expr(_GATE).alias("json")
    )
    return contracts.record_violations(rows, "e05_audit")


def _file(name, digest, bucket) -> str:
    """A source file of a split record; faults sit in the second file."""
    return f"""named_struct('record_id', 18000 + o_custkey % 25, 'role', 'signal', 'canonical_pfn', {name},
    'pfn_sha256', {digest}, 'adler32', {{adler}}, 'size_bytes', 1000 + o_custkey, 'bucket', {bucket},
    'split', CASE b{{n}} WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END, 'note', {{note}})"""


_FIRST_FILE = _file("p1", "sha2(p1, 256)", "b1").format(adler="'0a1B2c3d'", n=1, note="null")
_SECOND_FILE = _file(
    "p2",
    "CASE WHEN o_orderkey % 17 = 0 THEN repeat('0', 64) ELSE sha2(p2, 256) END",
    "CASE WHEN o_orderkey % 19 = 0 THEN (b2 + 1) % 10 ELSE b2 END",
).format(
    adler="CASE WHEN o_orderkey % 43 = 0 THEN 'zz' ELSE '00000000' END",
    n=2,
    note="CASE WHEN o_orderkey % 67 = 0 THEN 'n' END",
)
_PART = """named_struct('file_count', 1, 'event_count', 5, 'jet_counts_by_class', named_struct('qcd', 3, 'top', 2),
    'record_jet_counts', map({}))"""
_SPLIT = f"""to_json(named_struct('schema_version', '1.0.0', 'manifest_id', concat('split-', o_orderkey),
  'study_id', 'study-1', 'created_at', '2026-01-01T00:00:00Z',
  'dataset', named_struct('name', 'CMS 2015 RunIIFall15MiniAODv2', 'campaign', 'RunIIFall15MiniAODv2',
    'source_manifest', {ARTIFACT}, 'canonical_dataset', {ARTIFACT}, 'source_records',
    slice(array(named_struct('record_id', 18000, 'role', 'signal'), named_struct('record_id', 18001, 'role',
    'qcd_active')), 1, CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 2 END)),
  'split_rule', named_struct('version', 'exact-pfn-sha256-mod10-v1', 'identifier', 'exact_pfn_sha256_mod10', 'input',
    'exact canonical_pfn field from the sorted source manifest', 'encoding', 'UTF-8', 'digest', 'SHA-256',
    'integer_byte_order', 'big', 'modulus', CASE WHEN o_orderkey % 29 = 0 THEN 11 ELSE 10 END, 'buckets',
    named_struct('test', array(0), 'validation', array(1),
    'train', sequence(2, CASE WHEN o_orderkey % 31 = 0 THEN 8 ELSE 9 END))),
  'source_files', array({_FIRST_FILE}, {_SECOND_FILE}),
  'partitions', named_struct(
    'train', {_PART.format("'18000', CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE 3 END, '18001', 2")},
    'validation', {_PART.format("'18000', 5")},
    'test', {_PART.format("CASE WHEN o_orderkey % 37 = 0 THEN 'x' ELSE '18001' END, 5")}),
  'training_subsets', array(named_struct('subset_id', 'n1000', 'train_size_per_class', 1000, 'subset_seed', 7,
    'selection_rule', 'sha256-ranked-signal-and-record-round-robin-qcd-v1',
    'identity_payload', CASE WHEN o_orderkey % 53 <> 0 THEN {ARTIFACT} END,
    'counts_by_class', named_struct('qcd', 1000, 'top', 1000))),
  'preprocessing', named_struct('feature_version', 'v1', 'policy', {ARTIFACT}, 'fitted_partition', 'train',
    'pid_vocabulary', named_struct('unknown', 0, 'charged_hadron', 1, 'neutral_hadron', 2,
    'photon', CASE WHEN o_orderkey % 61 = 0 THEN 4 ELSE 3 END, 'electron', 4, 'muon', 5),
    'impact_parameter_policy', 'training_fitted', 'pt_eta_control_sha256',
    CASE WHEN o_orderkey % 2 = 0 THEN {SHA} END),
  'semantic_checks', named_struct('unique_pfns', true, 'pfn_disjoint', o_orderkey % 59 <> 0, 'event_disjoint', true,
    'subset_identities_unique', true, 'subsets_nested', true, 'class_counts_sufficient', true),
  'hash_metadata', named_struct('algorithm', 'sha256', 'canonicalization',
    'utf8-sorted-keys-compact-json-lf-excluding-hash_metadata.content_sha256', 'content_sha256', {SHA})))"""
_SPLIT_RECORD = """CASE WHEN o_orderkey % 71 = 0
  THEN replace(json, '"role":"signal","canonical_pfn"', '"role":5,"canonical_pfn"') ELSE json END"""


@query(
    "split_record_contract",
    _checks_sql(
        "SELECT o_orderkey AS k FROM orders",
        (
            ("CONTRACT_HASH_MISMATCH", "k % 17 = 0"),
            ("CONTRACT_SPLIT_MISMATCH", "k % 19 = 0"),
            ("CONTRACT_PFN_DUPLICATE", "k % 23 = 0"),
            ("CONTRACT_SCHEMA:split_rule.modulus", "k % 29 = 0"),
            ("CONTRACT_SCHEMA:split_rule.buckets.train", "k % 31 = 0"),
            ("CONTRACT_UNKNOWN_PROPERTY:partitions.test.record_jet_counts", "k % 37 = 0"),
            ("CONTRACT_SCHEMA:partitions.train.record_jet_counts.*", "k % 41 = 0"),
            ("CONTRACT_SCHEMA:source_files[].adler32", "k % 43 = 0"),
            ("CONTRACT_SCHEMA:dataset.source_records", "k % 47 = 0"),
            ("CONTRACT_SCHEMA:training_subsets[].identity_payload", "k % 53 = 0"),
            ("CONTRACT_SCHEMA:semantic_checks.pfn_disjoint", "k % 59 = 0"),
            ("CONTRACT_SCHEMA:preprocessing.pid_vocabulary.photon", "k % 61 = 0"),
            ("CONTRACT_UNKNOWN_PROPERTY:source_files[]", "k % 67 = 0"),
            ("CONTRACT_SCHEMA:source_files[].role", "k % 71 = 0"),
            ("CONTRACT_TYPES", "k % 37 = 0 OR k % 67 = 0 OR k % 71 = 0"),
        ),
    ),
)
def split_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split records with their files, partitions and rules described; one fault per kind of rule."""
    from jetframe.functions import identity

    name = "concat('root://synthetic.invalid//store/', o_orderkey, '/file-{}.root')"
    rows = _orders(spark, sf_dir).selectExpr(
        "*",
        f"{name.format(1)} AS p1",
        f"CASE WHEN o_orderkey % 23 = 0 THEN {name.format(1)} ELSE {name.format(2)} END AS p2",
    )
    bucketed = rows.withColumns(
        {b: identity.bucket10(identity.file_hash(F.col(p))) for b, p in (("b1", "p1"), ("b2", "p2"))}
    )
    made = bucketed.select("o_orderkey", F.expr(_SPLIT).alias("json"))
    records = made.select(F.col("o_orderkey").alias("key"), F.expr(_SPLIT_RECORD).alias("json"))
    return contracts.record_violations(records, "split", described=True)


_AUDIT = f"""to_json(named_struct('schema_version', '1.0.0', 'e0_audit_id', concat('e0-', o_orderkey),
  'evidence_id', 'ev', 'status', element_at(array('passed', 'failed', 'blocked_external_evidence', 'open'),
    cast(o_orderkey % 4 + 1 as int)), 'formal_gate_eligible', o_orderkey % 4 = 0 OR o_orderkey % 13 = 0,
  'missing_evidence', CASE WHEN o_orderkey % 3 = 0 THEN array('m') ELSE array() END,
  'failed_gates', CASE WHEN o_orderkey % 5 = 0 THEN array('g', 'g') WHEN o_orderkey % 7 = 0 THEN array('g')
    ELSE array() END, 'policy_sha256', {SHA},
  'resource_projection', CASE WHEN o_orderkey % 2 = 0 THEN named_struct('source_bytes_per_wall_second', 1.5D,
    'events_per_wall_second', 2, 'cpu_seconds_per_event', 0.1D,
    'file_failure_fraction', CASE WHEN o_orderkey % 11 = 0 THEN 1.5D ELSE 0.5D END, 'retained_storage_bytes', 10,
    'projected_cost_usd_with_reserve', named_struct('E0', 1.0D, 'E1', CASE WHEN o_orderkey % 17 = 0 THEN -1.0D
    ELSE 1.0D END, 'E2', CASE WHEN o_orderkey % 19 <> 0 THEN 1.0D END),
    'projected_total_cost_usd_with_reserve', 3.0D) END,
  'observed', 'DEEP', 'content_sha256', {SHA}))"""
_DEEP = "concat(repeat('{\"a\":', 40), o_orderkey, repeat('}', 40))"


@query(
    "e0_audit_contract",
    _checks_sql(
        "SELECT o_orderkey AS k FROM orders",
        (
            ("CONTRACT_SCHEMA:status", "k % 4 = 3"),
            ("CONTRACT_SCHEMA:failed_gates", "k % 5 = 0"),
            ("CONTRACT_GATE_STATUS:eligible", "k % 4 <> 0 AND k % 13 = 0"),
            ("CONTRACT_GATE_STATUS:passed", "k % 4 = 0 AND (k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0)"),
            ("CONTRACT_GATE_STATUS:blocked", "k % 4 = 2 AND k % 3 <> 0"),
            ("CONTRACT_SCHEMA:resource_projection.file_failure_fraction", "k % 2 = 0 AND k % 11 = 0"),
            ("CONTRACT_SCHEMA:resource_projection.projected_cost_usd_with_reserve.E1", "k % 2 = 0 AND k % 17 = 0"),
            ("CONTRACT_SCHEMA:resource_projection.projected_cost_usd_with_reserve.E2", "k % 2 = 0 AND k % 19 = 0"),
            ("CONTRACT_TYPES", "k % 23 = 0"),
        ),
    ),
)
def e0_audit_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records whose free part nests forty objects; every 23rd has a text in its place."""
    deep = F.when(F.col("o_orderkey") % 23 == 0, F.lit('"flat"')).otherwise(F.expr(_DEEP))
    rows = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"), F.replace(F.expr(_AUDIT), F.lit('"DEEP"'), deep).alias("json")
    )
    return contracts.record_violations(rows, "e0_audit", described=True)


# The columns a prediction payload describes.
_COLUMNS = ("jet_id", "record_id", "run", "lumi", "event", "jet_index", "target", "signal_score")


@query(
    "prediction_parts",
    _checks_sql(
        "SELECT o_orderkey AS k FROM orders",
        (
            ("CONTRACT_SCHEMA:partition", "k % 31 = 0"),
            ("CONTRACT_SCHEMA:ordered", "k % 37 = 0"),
            ("CONTRACT_SCHEMA:row_order_sha256", "k % 43 = 0"),
            ("CONTRACT_ROW_COUNT", "k % 41 <> 0"),
            ("CONTRACT_SCHEMA:payload.format", "k % 7 = 0"),
            ("CONTRACT_SCHEMA:payload.byte_size", "k % 11 = 0"),
            ("CONTRACT_SCHEMA:logical_columns.target", "k % 13 = 0"),
            ("CONTRACT_UNKNOWN_PROPERTY:logical_columns", "k % 17 = 0"),
            ("CONTRACT_TYPES", "k % 17 = 0"),
        ),
    ),
)
def prediction_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records with the insides of payload and columns checked as well."""
    columns = ", ".join(
        f"'{c}', " + ("CASE WHEN o_orderkey % 13 <> 0 THEN named_struct('dtype', 'i') END" if c == "target"
                      else "named_struct('dtype', 'i')")
        for c in _COLUMNS
    )
    parts = {
        "'logical_columns', named_struct('a', 1)": f"'logical_columns', named_struct({columns}, 'weight', "
        "CASE WHEN o_orderkey % 17 = 0 THEN 1 END)",
        "'payload', named_struct('a', 1)": "'payload', named_struct('format', CASE WHEN o_orderkey % 7 = 0 THEN "
        f"'csv' ELSE 'parquet' END, 'path', 'p', 'sha256', {SHA}, 'byte_size', o_orderkey % 11)",
    }
    text = _PREDICTION
    for plain, described in parts.items():
        text = text.replace(plain, described)
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), F.expr(text).alias("json"))
    return contracts.record_violations(rows, "prediction", described=True)


@query(
    "split_contract",
    f"""WITH {sv.MANIFEST}, f AS (SELECT canonical_pfn, record_id % 6 = 0 AND file_no = 1 AS h,
  {sv.bucket10('sha256(canonical_pfn)')} AS b, file_no, record_id FROM manifest)
SELECT 'CONTRACT_HASH_MISMATCH' AS rule, canonical_pfn AS key, '' AS detail FROM f WHERE h
UNION ALL SELECT 'CONTRACT_SPLIT_MISMATCH', canonical_pfn, '' FROM f WHERE file_no = 2 OR file_no = 5 AND b < 2
UNION ALL SELECT 'CONTRACT_PFN_DUPLICATE', canonical_pfn, 'count=2' FROM f WHERE file_no = 0 AND record_id % 4 = 0""",
)
def split_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split table entries with stale hashes, buckets and splits, and repeated files."""
    from jetframe.functions import identity

    listed = tables.manifest(spark, sf_dir)
    digest = identity.file_hash(F.col("canonical_pfn"))
    no = F.regexp_extract("canonical_pfn", r"file-(\d+)", 1)
    r = F.col("record_id")
    bucket = identity.bucket10(digest)
    files = listed.select(
        "canonical_pfn",
        F.when((r % 6 == 0) & (no == "1"), F.lit("0" * 64)).otherwise(digest).alias("pfn_sha256"),
        F.when(no == "2", (bucket + 1) % 10).otherwise(bucket).alias("bucket"),
        F.when(no == "5", F.lit("train")).otherwise(identity.split_of_bucket(bucket)).alias("split"),
        (r % 4 == 0).alias("again") & (no == "0"),
    )
    files = files.toDF("canonical_pfn", "pfn_sha256", "bucket", "split", "again")
    return contracts.source_file_violations(files.unionByName(files.filter("again")).drop("again"))


@query(
    "failure_normalise",
    """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'timed_out' END
  AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS metrics,
  CASE WHEN o_orderstatus = 'F' THEN 'ckpt' END AS model_checkpoint,
  CASE WHEN o_orderstatus <> 'F' THEN 'RUN_NONZERO_EXIT' END AS code,
  CASE WHEN o_orderstatus <> 'F' THEN 'see https://h/x?token=[REDACTED]&v=1 Bearer [REDACTED] end' END AS message
FROM orders""",
)
def failure_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run rows whose log message carries two kinds of credentials."""
    message = F.concat(
        F.lit("see https://h/x?token="),
        F.md5(F.col("o_orderkey").cast("string")),
        F.lit("&v=1 Bearer "),
        F.md5(F.col("o_custkey").cast("string")),
        F.lit(" end"),
    )
    rows = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.lit("succeeded").alias("status"),
        F.col("o_totalprice").alias("metrics"),
        F.lit("ckpt").alias("model_checkpoint"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'timed_out' END").alias("new"),
        message.alias("log"),
    )
    made = contracts.failure_records(
        rows, F.col("new"), F.lit("RUN_NONZERO_EXIT"), F.lit("train"), F.col("log")
    )
    return made.select(
        "run_id", "status", "metrics", "model_checkpoint", "failure.code", "failure.message"
    )


@query(
    "redact_text",
    r"""WITH t AS (SELECT doc_id, text || ' https://h/a?key=' || md5(doc_id::VARCHAR) || ' bearer ' || source || ' '
  || 'hunter' || (doc_id % 3) AS t FROM documents
  UNION ALL SELECT -1 - page_id, html || ' ' || url || '&sig=' || md5(url) FROM pages),
r AS (SELECT doc_id, replace(regexp_replace(regexp_replace(t, '(?i)([?&](?:token|sig|signature|key|credential)=)[^&\s]+',
  '\1[REDACTED]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), 'hunter1', '[REDACTED]') AS t
  FROM t)
SELECT doc_id, sha256(t) AS digest, length(t)::INTEGER AS chars FROM r""",
)
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and pages, with credentials appended, after redaction."""
    documents = tables.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            "text",
            F.lit(" https://h/a?key="),
            F.md5(F.col("doc_id").cast("string")),
            F.lit(" bearer "),
            "source",
            F.lit(" hunter"),
            (F.col("doc_id") % 3).cast("string"),
        ).alias("t"),
    )
    pages = tables.table(spark, sf_dir, "pages").select(
        (F.lit(-1) - F.col("page_id")).alias("doc_id"),
        F.concat("html", F.lit(" "), "url", F.lit("&sig="), F.md5("url")).alias("t"),
    )
    clean = text.redact(F.col("t"), ["hunter1"])
    return documents.unionByName(pages).select("doc_id", clean.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("chars")
    )


@query(
    "script_scan",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr((19968 + doc_id % 20000)::INTEGER) ELSE text END
  AS t FROM documents), s AS (SELECT doc_id, regexp_extract(t, '[㐀-䶿一-鿿豈-﫿]', 0) AS found FROM t)
SELECT doc_id, found FROM s WHERE found <> ''""",
)
def script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every fifth with one CJK character at its end; the whole text is read."""
    char = F.decode(
        F.unhex(F.hex(F.lit(19968) + F.col("doc_id") % 20000)), "UTF-16BE"
    )
    t = F.when(F.col("doc_id") % 5 == 0, F.concat("text", char)).otherwise(F.col("text"))
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", text.first_cjk(t).alias("found"))
    return rows.filter("found <> ''")


@query(
    "dangling_refs",
    """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages),
f AS (SELECT page_id, regexp_replace(string_split_regex(trim(raw), '\\s+')[1], '^[<>]+|[<>]+$', '', 'g') AS f FROM x),
r AS (SELECT page_id, split_part(f, '#', 1) AS target FROM f WHERE NOT regexp_matches(f, '^(http://|https://|mailto:|#)')),
c AS (SELECT '/' || regexp_extract(html, '<title>([^ <]*)', 1) AS target FROM pages)
SELECT page_id, target, count(*)::BIGINT AS n FROM r ANTI JOIN c USING (target) WHERE target <> '' GROUP BY ALL""",
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links of all pages against the paths made of the first title words."""
    pages = tables.table(spark, sf_dir, "pages")
    refs = textscan.references(pages, "page_id", "html", text.HREF)
    catalog = pages.select(
        F.concat(F.lit("/"), F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("target")
    )
    return textscan.dangling(refs, catalog).select("page_id", "target", "n")


@query(
    "markdown_refs",
    """WITH x AS (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' [see](' || role || '/' || turn
  || '.md#top) ![img](x.png) [site](https://a.b) [me](#here)', '(?:^|[^!])\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) AS raw
  FROM conversations),
r AS (SELECT conv_id, turn, split_part(raw, '#', 1) AS target FROM x
  WHERE NOT regexp_matches(raw, '^(http://|https://|mailto:|#)'))
SELECT conv_id, turn, target, count(*)::BIGINT AS n FROM r
WHERE target NOT IN (SELECT role || '/' || turn || '.md' FROM conversations WHERE conv_id % 2 = 0 AND turn < 3) GROUP BY ALL""",
)
def markdown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a link, an image and two links that need no file."""
    rows = tables.table(spark, sf_dir, "conversations")
    target = F.concat("role", F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    linked = rows.select(
        F.concat_ws(":", "conv_id", "turn").alias("k"),
        F.concat(
            "text", F.lit(" [see]("), target, F.lit("#top) ![img](x.png) [site](https://a.b) [me](#here)")
        ).alias("t"),
    )
    refs = textscan.references(linked, "k", "t", text.MARKDOWN_LINK)
    catalog = rows.filter("conv_id % 2 = 0 AND turn < 3").select(target.alias("target"))
    found = textscan.dangling(refs, catalog)
    parts = F.split("k", ":")
    return found.select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), "target", "n"
    )


_REVISION = "0123456789abcdef"


@query(
    "argv_scan",
    _checks_sql(
        "SELECT event_id AS k FROM events",
        (
            ("RUN_COMMAND_NOT_ALLOWED", "k % 11 = 0"),
            ("RUN_ARGUMENT_INVALID", "k % 13 = 0 OR k % 17 = 0"),
            ("RUN_FLAG_FORBIDDEN", "k % 19 = 0"),
            ("RUN_FLAG_NOT_ALLOWED", "k % 23 = 0"),
            ("RUN_REVISION_REQUIRED", "k % 29 = 0"),
            ("RUN_REVISION_MISMATCH", "k % 29 <> 0 AND k % 31 = 0"),
        ),
    ),
)
def argv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a logged command; faults are planted by key."""
    k = F.col("event_id")

    def some(n: int, *values: str):
        arr = F.array(*[F.lit(v) for v in values])
        return F.when(k % n == 0, arr).otherwise(F.array().cast("array<string>"))

    revision = F.when(k % 31 == 0, F.lit("main")).otherwise(F.lit(_REVISION))
    argv = F.concat(
        F.array(F.lit("tool"), F.when(k % 11 == 0, F.lit("shell")).otherwise(F.lit("train"))),
        F.when(k % 29 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.lit("--revision"), revision)
        ),
        F.array(F.lit("--use-add"), F.lit("--num-add"), F.lit("5"), F.lit("--model-seed"), F.lit("--7")),
        some(13, "stray"),
        some(19, "--use-global"),
        some(23, "--debug"),
        some(17, "--checkpoint"),
    )
    rows = tables.table(spark, sf_dir, "events").select(k, argv.alias("argv"))
    return textscan.command_violations(rows, "event_id", "argv", _REVISION)


@query(
    "record_uniqueness",
    """WITH s AS (SELECT p_partkey AS k, p_brand || '-' || (p_partkey % 900) AS citation_key, lower(p_name) AS title,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'doi:' || p_partkey ELSE '10.1234/' || (p_partkey % 700) END AS doi,
  CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_type END AS venue,
  CASE WHEN p_partkey % 41 = 0 THEN 'draft' ELSE 'verified' END AS v FROM part)
SELECT 'CORPUS_REPEATED:citation_key' AS rule, citation_key AS key, 'count=' || count(*) AS detail FROM s
  GROUP BY citation_key HAVING count(*) > 1
UNION ALL SELECT 'CORPUS_REPEATED:title', title, 'count=' || count(*) FROM s GROUP BY title HAVING count(*) > 1
UNION ALL SELECT 'CORPUS_REPEATED:doi', doi, 'count=' || count(*) FROM s WHERE doi <> '' GROUP BY doi HAVING count(*) > 1
UNION ALL SELECT 'CORPUS_BLANK:venue', k::VARCHAR, '' FROM s WHERE trim(venue) = ''
UNION ALL SELECT 'CORPUS_DOI', k::VARCHAR, '' FROM s WHERE doi LIKE 'doi:%'
UNION ALL SELECT 'CORPUS_UNVERIFIED', k::VARCHAR, '' FROM s WHERE v = 'draft'""",
)
def record_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a corpus of sources with repeated keys, blank venues and bad DOIs."""
    return textscan.corpus_violations(
        _corpus(spark, sf_dir),
        "k",
        unique=("citation_key", "title", "doi"),
        required=("citation_key", "title", "venue"),
        folded=("title", "doi"),
    )


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text_of = lambda c: c.cast("string")
    return tables.table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.concat("p_brand", F.lit("-"), text_of(k % 900)).alias("citation_key"),
        F.col("p_name").alias("title"),
        F.when(k % 4 == 0, F.lit(""))
        .when(k % 4 == 1, F.concat(F.lit("doi:"), text_of(k)))
        .otherwise(F.concat(F.lit("10.1234/"), text_of(k % 700)))
        .alias("doi"),
        F.when(k % 37 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("venue"),
        F.when(k % 41 == 0, F.lit("draft")).otherwise(F.lit("verified")).alias("verification_status"),
        "p_type",
    )


@query(
    "group_coverage",
    """WITH t AS (SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS theme FROM part),
w AS (SELECT unnest(['BASE', 'DISCONTINUED', 'PROMO']) AS theme)
SELECT coalesce((SELECT string_agg(theme, ',' ORDER BY theme) FROM w ANTI JOIN t USING (theme)), '') AS absent,
  (SELECT count(*) FROM t ANTI JOIN w USING (theme))::BIGINT AS other""",
)
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "part").select(
        F.upper(F.split("p_type", " ")[0]).alias("theme")
    )
    return textscan.uncovered(rows, "theme", ("BASE", "DISCONTINUED", "PROMO"))
