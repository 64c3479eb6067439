"""Registered queries: ROC metrics, bootstraps, seed and size summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.operators import bootstrap, metrics
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query
from jetframe.schema import REQUIRED_CONTRASTS

REPLICATES = 1000
BOOTSTRAP_SEED = 20260717


def r9(name: str):
    return F.round(F.col(name), 9).alias(name)


@query(
    "roc_auc",
    f"""WITH {sv.SCORES}, {sv.roc('scores', 'run_id, split')}
SELECT run_id, split, (max(n_all) - max(p_all))::BIGINT AS background_count,
  max(p_all)::BIGINT AS signal_count, round({sv.AUC}, 9) AS roc_auc FROM g GROUP BY run_id, split""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.binary_metrics(tables.scores(spark, sf_dir), ["run_id", "split"], efficiencies=())
    return made.select("run_id", "split", "background_count", "signal_count", r9("roc_auc"))


@query(
    "rejection_30_50",
    f"""WITH {sv.SCORES}, far AS (SELECT * FROM scores UNION ALL
  SELECT 'far', jet_id, split, target, score + 0.3::DOUBLE * target FROM scores WHERE run_id = 'A'),
{sv.roc('far', 'run_id')}, e AS (SELECT run_id, {sv.eff_b(0.3)} AS e30, {sv.eff_b(0.5)} AS e50
  FROM g GROUP BY run_id)
SELECT run_id, round(e30, 9) AS background_efficiency_30, round(e50, 9) AS background_efficiency_50,
  CASE WHEN e30 > 0 THEN round(1 / e30, 6) END AS background_rejection_30,
  CASE WHEN e50 > 0 THEN round(1 / e50, 6) END AS background_rejection_50 FROM e""",
)
def rejection_30_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views, and one run so well separated that no background passes (null rejection)."""
    base = tables.scores(spark, sf_dir)
    far = base.filter("run_id = 'A'").withColumns(
        {"run_id": F.lit("far"), "score": F.col("score") + F.lit(0.3) * F.col("target")}
    )
    made = metrics.binary_metrics(base.unionByName(far), ["run_id"])
    return made.select(
        "run_id",
        r9("background_efficiency_30"),
        r9("background_efficiency_50"),
        F.round("background_rejection_30", 6).alias("background_rejection_30"),
        F.round("background_rejection_50", 6).alias("background_rejection_50"),
    )


_BUNDLE = f"""SELECT run_id, (max(n_all) - max(p_all))::BIGINT AS background_count,
  max(p_all)::BIGINT AS signal_count, round({sv.AUC}, 9) AS roc_auc,
  round(sum(CASE WHEN score >= 0.4::DOUBLE THEN p ELSE n - p END) / max(n_all)::DOUBLE, 9) AS accuracy,
  round({sv.eff_b(0.3)}, 9) AS background_efficiency_30,
  round({sv.eff_b(0.5)}, 9) AS background_efficiency_50 FROM g GROUP BY run_id"""


@query("metric_bundle", f"WITH {sv.SCORES}, {sv.roc('scores', 'run_id')} {_BUNDLE}")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.binary_metrics(tables.scores(spark, sf_dir), ["run_id"], threshold=0.4)
    return made.select(
        "run_id",
        "background_count",
        "signal_count",
        *[
            r9(c)
            for c in ("roc_auc", "accuracy", "background_efficiency_30", "background_efficiency_50")
        ],
    )


@query(
    "metric_bundle_ranged",
    f"WITH {sv.SCORES}, {sv.roc('scores', 'run_id')} {_BUNDLE}",
)
def metric_bundle_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bundle through the path for large runs: score ranges, summed one by one."""
    from jetframe.operators.ordered import range_bounds

    rows = tables.scores(spark, sf_dir)
    bounds = range_bounds(rows, "score", bins=200)
    made = metrics.binary_metrics(rows, ["run_id"], threshold=0.4, bounds=bounds)
    return made.select(
        "run_id",
        "background_count",
        "signal_count",
        *[
            r9(c)
            for c in ("roc_auc", "accuracy", "background_efficiency_30", "background_efficiency_50")
        ],
    )


_DOCS = """docs AS (SELECT doc_id, quality AS target, n_chars::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id))"""


@query(
    "label_length_auc",
    f"""WITH {_DOCS}, one AS (SELECT 'quality' AS run_id, target, score FROM docs),
{sv.roc('one', 'run_id')} SELECT run_id, round({sv.AUC}, 9) AS roc_auc FROM g GROUP BY run_id""",
)
def label_length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ranking task: text length against the quality label."""
    rows = tables.table(spark, sf_dir, "labels").join(
        tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    scored = rows.select(
        F.lit("quality").alias("run_id"),
        F.col("quality").alias("target"),
        F.col("n_chars").cast("double").alias("score"),
    )
    made = metrics.binary_metrics(scored, ["run_id"], efficiencies=())
    return made.select("run_id", r9("roc_auc"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of views A and D side by side on the fixed test jets."""
    return (
        tables.scores(spark, sf_dir)
        .filter("split = 'test'")
        .groupBy("jet_id", "target")
        .agg(
            F.max(F.when(F.col("run_id") == "D", F.col("score"))).alias("left"),
            F.max(F.when(F.col("run_id") == "A", F.col("score"))).alias("right"),
        )
    )


_PAIRS = f"""{sv.SCORES}, pairs AS (
  SELECT jet_id, target, max(score) FILTER (run_id = 'D') AS "left",
    max(score) FILTER (run_id = 'A') AS "right" FROM scores WHERE split = 'test' GROUP BY ALL)"""


def _boot_sql(source: str, sides: str, seed: int, replicates: int) -> str:
    """CTE ``b``: one row per replicate (-1 = observed), side, row."""
    return f"""idx AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY {sv.rank_of(f"'{seed}'", 'jet_id')}, jet_id) - 1
    AS k, count(*) OVER (PARTITION BY target) AS n_c FROM {source}),
d AS (SELECT rep, target, ('0x' || substr(md5('{seed}|' || rep || '|' || target || '|' || k), 1, 12))::BIGINT
    % n_c AS k FROM idx, range({replicates}) AS t(rep)),
w AS (SELECT rep, i.* FROM d JOIN idx i USING (target, k)
  UNION ALL SELECT -1, * FROM idx),
b AS (SELECT rep, target, {sides} FROM w)"""


_SIDES = """unnest(['l', 'r']) AS side, unnest(["left", "right"]) AS score"""


@query(
    "paired_bootstrap",
    f"""WITH {_PAIRS}, {_boot_sql('pairs', _SIDES, BOOTSTRAP_SEED, REPLICATES)},
{sv.roc('b', 'rep, side')},
m AS (SELECT rep, side, {sv.AUC} AS auc,
    sum(CASE WHEN score >= CASE side WHEN 'l' THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END THEN p ELSE n - p END)
      / max(n_all)::DOUBLE AS acc, {sv.eff_b(0.3)} AS e30, {sv.eff_b(0.5)} AS e50
  FROM g GROUP BY rep, side),
v AS (SELECT rep, side, unnest(['roc_auc', 'accuracy', 'background_rejection_30',
      'background_rejection_50']) AS metric, unnest([auc, acc, CASE WHEN e30 > 0 THEN 1 / e30 END,
      CASE WHEN e50 > 0 THEN 1 / e50 END]) AS v FROM m),
x AS (SELECT rep, metric, max(v) FILTER (side = 'l') - max(v) FILTER (side = 'r') AS delta
  FROM v GROUP BY rep, metric),
y AS (SELECT metric, max(delta) FILTER (rep = -1) AS o, quantile_cont(delta, 0.025) FILTER (rep >= 0) AS lo,
  quantile_cont(delta, 0.975) FILTER (rep >= 0) AS hi,
  count(*) FILTER (rep >= 0 AND delta IS NULL)::BIGINT AS discarded_count FROM x GROUP BY metric)
SELECT metric, round(o, 7) AS observed_delta, round(lo, 7) AS low, round(hi, 7) AS high,
  {REPLICATES} AS replicate_count, discarded_count, {BOOTSTRAP_SEED} AS bootstrap_seed,
  CASE WHEN o IS NULL THEN 'METRIC_BOOTSTRAP_OBSERVED'
    WHEN discarded_count > {REPLICATES} * 0.01 THEN 'METRIC_BOOTSTRAP_DISCARDS' ELSE 'ok' END AS status
FROM y""",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bootstrap.paired_bootstrap(
        _pairs(spark, sf_dir), "left", "right", REPLICATES, BOOTSTRAP_SEED, (0.45, 0.4)
    )
    return made.select(
        "metric",
        *[F.round(c, 7).alias(c) for c in ("observed_delta", "low", "high")],
        "replicate_count",
        "discarded_count",
        "bootstrap_seed",
        "status",
    )


@query(
    "gap_fraction",
    f"""WITH {_PAIRS}, {_boot_sql('pairs', _SIDES, BOOTSTRAP_SEED, REPLICATES)},
{sv.roc('b', 'rep, side')},
m AS (SELECT rep, side, {sv.AUC} AS auc FROM g GROUP BY rep, side),
x AS (SELECT rep, max(auc) FILTER (side = 'r') AS n, max(auc) FILTER (side = 'l') AS m FROM m GROUP BY rep),
y AS (SELECT max(n) FILTER (rep = -1) AS a, max(m) FILTER (rep = -1) AS b,
  avg((m - 0.5::DOUBLE <= 0.01::DOUBLE)::INTEGER) FILTER (rep >= 0) AS s FROM x),
z AS (SELECT *, b - 0.5::DOUBLE <= 0.01::DOUBLE OR s > 0.05::DOUBLE AS u FROM y)
SELECT round(a, 9) AS auc_n, round(b, 9) AS auc_max, s AS small_denominators, u AS unstable,
  CASE WHEN NOT u THEN round((a - 0.5) / (b - 0.5), 7) END AS auc_gap_fraction,
  round(a - b, 9) AS auc_difference FROM z""",
)
def gap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View A stands for the small training size, view D for the largest."""
    made = bootstrap.gap_fraction(_pairs(spark, sf_dir), "right", "left", REPLICATES, BOOTSTRAP_SEED)
    return made.select(
        r9("auc_n"),
        r9("auc_max"),
        "small_denominators",
        "unstable",
        F.round("auc_gap_fraction", 7).alias("auc_gap_fraction"),
        r9("auc_difference"),
    )


_SHUFFLED = f"""{sv.JETS}, t AS (SELECT jet_id, target, jet_pt::DOUBLE AS score FROM jets WHERE split = 'train'),
shuffled AS (SELECT jet_id, score, CASE WHEN row_number() OVER (ORDER BY {sv.rank_of("'7'", 'jet_id')}, jet_id)
  <= (SELECT sum(target) FROM t) THEN 1 ELSE 0 END AS target FROM t)"""


@query(
    "shuffled_ci",
    f"""WITH {_SHUFFLED}, {_boot_sql('shuffled', 'score', 11, REPLICATES)}, {sv.roc('b', 'rep')},
m AS (SELECT rep, {sv.AUC} AS auc FROM g GROUP BY rep),
q AS (SELECT max(auc) FILTER (rep = -1) AS auc, quantile_cont(auc, 0.025) FILTER (rep >= 0) AS low,
  quantile_cont(auc, 0.975) FILTER (rep >= 0) AS high FROM m)
SELECT round(auc, 9) AS auc, round(low, 9) AS low, round(high, 9) AS high,
  low <= 0.5 AND high >= 0.5 AS contains_half FROM q""",
)
def shuffled_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the shuffled-label AUC on all training jets."""
    train = tables.jets(spark, sf_dir).filter("split = 'train'")
    rows = bootstrap.shuffled_labels(
        train.select("jet_id", "target", F.col("jet_pt").cast("double").alias("score")), 7
    )
    made = bootstrap.auc_interval(rows, "score", REPLICATES, 11)
    return made.select(r9("auc"), r9("low"), r9("high"), "contains_half")


_GRID_SIZES = (1000, 10000, 100000)
_GRID_SEEDS = (1, 2, 3)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of 4 views x 3 sizes x 3 seeds; separation grows with view and size."""
    test = tables.jets(spark, sf_dir).filter("split = 'test'").select("jet_id", "target")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature_config"),
                F.lit(n).alias("train_size"),
                F.lit(s).alias("model_seed"),
                F.lit(tables.SCORE_SHIFT[c] * (i + 1) // 3).alias("shift"),
            )
            for c in tables.SCORE_SHIFT
            for i, n in enumerate(_GRID_SIZES)
            for s in _GRID_SEEDS
        ]
    )
    text = F.concat_ws("|", "feature_config", "train_size", "model_seed", "jet_id")
    draw = F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint")
    return test.select("jet_id", "target", F.explode(cells).alias("c")).select(
        "jet_id", "target", "c.*"
    ).withColumn("score", (F.lit(7) * (draw % 1000) + F.col("shift") * F.col("target")) / F.lit(10000.0))


_GRID = f"""{sv.JETS}, cells AS (SELECT c AS feature_config, n AS train_size, s AS model_seed,
    (sh * i // 3) AS shift
  FROM (VALUES ('A', 500), ('B', 1000), ('C', 1500), ('D', 2000)) AS a(c, sh),
    (VALUES (1000, 1), (10000, 2), (100000, 3)) AS b(n, i), (VALUES (1), (2), (3)) AS d(s)),
grid AS (SELECT jet_id, target, feature_config, train_size, model_seed,
    (7 * (('0x' || substr(md5(feature_config || '|' || train_size || '|' || model_seed || '|' || jet_id), 1, 6))::BIGINT
      % 1000) + shift * target) / 10000.0::DOUBLE AS score
  FROM jets, cells WHERE split = 'test'),
{sv.roc('grid', 'feature_config, train_size, model_seed')},
auc AS (SELECT feature_config, train_size, model_seed, {sv.AUC} AS roc_auc FROM g GROUP BY ALL)"""

_RUN_KEYS = ["feature_config", "train_size", "model_seed"]


def _grid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_metrics(_grid(spark, sf_dir), _RUN_KEYS, efficiencies=()).select(
        *_RUN_KEYS, "roc_auc"
    )


@query(
    "seed_summary",
    f"""WITH {_GRID} SELECT feature_config, train_size, count(*)::BIGINT AS seeds, round(avg(roc_auc), 9) AS mean,
  round(stddev_samp(roc_auc), 9) AS sample_standard_deviation,
  string_agg(model_seed || '=' || round(roc_auc, 6)::DECIMAL(8,6), ',' ORDER BY model_seed) AS per_seed
FROM auc GROUP BY ALL""",
)
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.seed_summary(
        _grid_auc(spark, sf_dir), ["feature_config", "train_size"], "model_seed", "roc_auc"
    )
    listed = F.transform(
        "per_seed",
        lambda x: F.concat_ws(
            "=", x["model_seed"].cast("string"), F.round(x["roc_auc"], 6).cast("decimal(8,6)").cast("string")
        ),
    )
    return made.select(
        "feature_config",
        "train_size",
        "seeds",
        r9("mean"),
        r9("sample_standard_deviation"),
        F.array_join(listed, ",").alias("per_seed"),
    )


@query(
    "data_efficiency",
    f"""WITH {_GRID}, m AS (SELECT feature_config, train_size, avg(roc_auc) AS auc FROM auc GROUP BY ALL),
t AS (SELECT *, first_value(auc) OVER (PARTITION BY feature_config ORDER BY train_size DESC) AS top FROM m)
SELECT feature_config, train_size, round(auc, 9) AS auc,
  CASE WHEN abs(top - 0.5::DOUBLE) >= 0.05::DOUBLE THEN round((auc - 0.5) / (top - 0.5), 7) END AS auc_gap_fraction,
  CASE WHEN abs(top - 0.5::DOUBLE) < 0.05::DOUBLE THEN 'unstable_large_scale_denominator' END AS reason FROM t""",
)
def data_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _grid_auc(spark, sf_dir).groupBy("feature_config", "train_size").agg(
        F.avg("roc_auc").alias("auc")
    )
    made = metrics.efficiency_by_size(mean, ["feature_config"], "train_size", "auc", 0.05)
    return made.select(
        "feature_config",
        "train_size",
        r9("auc"),
        F.round("auc_gap_fraction", 7).alias("auc_gap_fraction"),
        "reason",
    )


@query(
    "contrasts",
    f"""WITH {_GRID} SELECT l.train_size, l.model_seed, contrast, round(l.roc_auc - r.roc_auc, 9) AS delta
FROM (VALUES {', '.join(f"('{c}')" for c in REQUIRED_CONTRASTS)}) AS t(contrast)
JOIN auc l ON l.feature_config = substr(contrast, 1, 1)
JOIN auc r ON r.feature_config = substr(contrast, 3, 1) AND r.train_size = l.train_size
  AND r.model_seed = l.model_seed""",
)
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.contrasts(
        _grid_auc(spark, sf_dir), ["train_size", "model_seed"], "feature_config", "roc_auc"
    )
    return made.select("train_size", "model_seed", "contrast", r9("delta"))


@query(
    "contrast_set_gaps",
    """WITH c AS (SELECT o_custkey, CASE o_orderkey % 6 WHEN 0 THEN 'A-B' WHEN 1 THEN 'B-C' WHEN 2 THEN 'C-D'
    WHEN 3 THEN 'C-A' WHEN 4 THEN 'D-A' ELSE 'B-A' END AS contrast FROM orders),
s AS (SELECT o_custkey, list_sort(list(DISTINCT contrast)) AS have FROM c GROUP BY o_custkey),
r AS (SELECT o_custkey, array_to_string(list_filter(['A-B', 'B-C', 'C-A', 'C-D', 'D-A'],
    lambda x: NOT list_contains(have, x)), ',') AS missing,
  CASE WHEN list_contains(have, 'B-A') THEN 'B-A' ELSE '' END AS extra FROM s)
SELECT * FROM r WHERE missing <> '' OR extra <> ''""",
)
def contrast_set_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a study; each order reports one contrast, one kind is not allowed."""
    names = F.array(*[F.lit(c) for c in ("A-B", "B-C", "C-D", "C-A", "D-A", "B-A")])
    found = tables.table(spark, sf_dir, "orders").select(
        "o_custkey", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("contrast")
    )
    return metrics.contrast_set_gaps(found, ["o_custkey"])


def _with_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables.jets(spark, sf_dir)
    return base.select(
        "o_orderkey", "jet_id", "target", F.col("o_orderkey").alias("pos")
    )


@query(
    "prediction_alignment",
    f"""WITH {sv.JETS}, l AS (SELECT jet_id, o_orderkey AS pos, target FROM jets WHERE o_orderkey % 31 <> 0),
r AS (SELECT jet_id, CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS pos,
  CASE WHEN o_orderkey % 37 = 0 THEN 1 - target ELSE target END AS target FROM jets WHERE o_orderkey % 29 <> 0),
j AS (SELECT jet_id, l.pos AS lp, r.pos AS rp, l.target AS lt, r.target AS rt
  FROM l FULL OUTER JOIN r USING (jet_id))
SELECT 'PREDICTION_IDENTITY_MISMATCH' AS rule, jet_id AS key, '' AS detail FROM j WHERE lp IS DISTINCT FROM rp
UNION ALL SELECT 'PREDICTION_TARGET_MISMATCH', jet_id, '' FROM j WHERE lt <> rt""",
)
def prediction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_pos(spark, sf_dir)
    k = F.col("o_orderkey")
    right = rows.filter(k % 29 != 0).select(
        "jet_id",
        F.when(k % 41 == 0, k + 1).otherwise(k).alias("pos"),
        F.when(k % 37 == 0, 1 - F.col("target")).otherwise(F.col("target")).alias("target"),
    )
    return metrics.alignment_rules(rows.filter(k % 31 != 0), right)


@query(
    "prediction_rules",
    f"""WITH {sv.SCORES}, s AS (SELECT s.*, o_orderkey FROM scores s JOIN jets USING (jet_id)),
p AS (SELECT run_id, CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE jet_id END AS jet_id,
  CASE WHEN o_orderkey % 47 = 0 THEN 3 ELSE target END AS target, o_orderkey % 53 = 0 AS nf FROM s)
SELECT 'PREDICTION_IDENTITY' AS rule, run_id || ':' || jet_id AS key, '' AS detail FROM p WHERE jet_id = ''
UNION ALL SELECT 'PREDICTION_TARGET', run_id || ':' || jet_id, '' FROM p WHERE target = 3
UNION ALL SELECT 'PREDICTION_SCORE', run_id || ':' || jet_id, '' FROM p WHERE nf
UNION ALL SELECT 'PREDICTION_IDENTITY_REPEATED', run_id || ':' || jet_id, 'count=' || count(*) FROM p
GROUP BY run_id, jet_id HAVING count(*) > 1""",
)
def prediction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tables.jets(spark, sf_dir).select("jet_id", "o_orderkey")
    rows = tables.scores(spark, sf_dir).join(key, "jet_id")
    k = F.col("o_orderkey")
    broken = rows.select(
        "run_id",
        F.when(k % 43 == 0, F.lit("")).otherwise(F.col("jet_id")).alias("jet_id"),
        F.when(k % 47 == 0, F.lit(3)).otherwise(F.col("target")).alias("target"),
        F.when(k % 53 == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"),
    )
    return metrics.prediction_rules(broken)
