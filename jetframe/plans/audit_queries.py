"""Registered queries: audits, class control, truth matching, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.functions.particles import not_finite
from jetframe.operators import audit, digest, fit, match
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query
from jetframe.schema import FEATURE_VIEWS
from jetframe.session import stored


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected mixture: true train background counts, one record off and one unknown."""
    train = tables.jets(spark, sf_dir).filter("split = 'train' AND target = 0")
    n = F.count(F.lit(1))
    counted = train.groupBy("record_id").agg(n.alias("expected")).withColumn(
        "expected", F.when(F.col("record_id") == 18003, F.col("expected") + 1).otherwise(F.col("expected"))
    )
    return counted.withColumn(
        "record_id", F.when(F.col("record_id") == 18008, F.lit(19999)).otherwise(F.col("record_id"))
    )


_EXPECTED = """seen AS (SELECT record_id, count(*) AS observed FROM jets
  WHERE split = 'train' AND target = 0 GROUP BY 1),
expected AS (SELECT CASE record_id WHEN 18008 THEN 19999 ELSE record_id END AS record_id,
  CASE record_id WHEN 18003 THEN observed + 1 ELSE observed END AS expected FROM seen)"""


@query(
    "background_mixture",
    f"""WITH {sv.JETS}, {_EXPECTED}
SELECT record_id::BIGINT AS record_id, observed, expected, observed IS NOT DISTINCT FROM expected AS passed
FROM seen FULL OUTER JOIN expected USING (record_id)""",
)
def background_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.mixture(tables.jets(spark, sf_dir), _expected(spark, sf_dir))


_FIELDS = (*FEATURE_VIEWS["D"], "n_vertices", "jet_pt")


@query(
    "data_audit",
    f"""WITH {sv.CANONICAL}, {_EXPECTED},
t AS (SELECT jet_id, target, jet_pt::DOUBLE AS score, n_vertices FROM jets WHERE split = 'train'),
shuffled AS (SELECT 'x' AS run_id, score, CASE WHEN row_number() OVER (ORDER BY {sv.rank_of("'7'", 'jet_id')}, jet_id)
  <= (SELECT sum(target) FROM t) THEN 1 ELSE 0 END AS target FROM t),
{sv.roc('shuffled', 'run_id')},
a AS (SELECT {sv.AUC} AS v FROM g),
m AS (SELECT count(*) FILTER (track_state = 3)::DOUBLE / count(*) FILTER (track_state IN (1, 3)) AS v
  FROM canonical WHERE split = 'train'),
x AS (SELECT count(*) AS v FROM seen FULL OUTER JOIN expected USING (record_id)
  WHERE observed IS DISTINCT FROM expected),
s AS (SELECT min(n_vertices) AS lo, avg(n_vertices) AS mean, max(n_vertices) AS hi,
  count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM t)
SELECT 'missing_track' AS "check", round(v, 9) AS observed, 0.5::DOUBLE AS threshold, v <= 0.5 AS passed FROM m
UNION ALL SELECT 'shuffled_label', round(v, 9), 0.55, v <= 0.55 FROM a
UNION ALL SELECT 'mixture_differences', v, 0, v = 0 FROM x
UNION ALL SELECT 'n_vertices_min', lo, NULL, TRUE FROM s
UNION ALL SELECT 'n_vertices_mean', round(mean, 9), NULL, TRUE FROM s
UNION ALL SELECT 'n_vertices_max', hi, NULL, TRUE FROM s
UNION ALL SELECT 'class_yield', least(n0, n1), 1, n0 > 0 AND n1 > 0 FROM s
UNION ALL SELECT 'forbidden_fields', 2, 0, FALSE FROM s""",
)
def data_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audit.data_audit(
        tables.canonical_rows(spark, sf_dir),
        tables.jets(spark, sf_dir),
        _expected(spark, sf_dir),
        _FIELDS,
        0.5,
        0.55,
        7,
    )
    return made.withColumn("observed", F.round("observed", 9))


@query(
    "missingness_cube",
    f"""WITH {sv.CANONICAL},
n AS (SELECT o_orderkey, count(*) AS c FROM kept GROUP BY 1),
a AS (SELECT target, record_id, split, count(*) AS jets, count(*) FILTER (c > 5) AS truncated
  FROM jets LEFT JOIN n USING (o_orderkey) GROUP BY ALL),
b AS (SELECT target, record_id, split, count(*) AS particles,
  count(*) FILTER (track_state = 3) AS track_missing FROM canonical GROUP BY ALL),
c AS (SELECT a.*, coalesce(particles, 0) AS particles, coalesce(track_missing, 0) AS track_missing
  FROM a LEFT JOIN b USING (target, record_id, split))
SELECT target, record_id, split, sum(jets)::BIGINT AS jets, sum(truncated)::BIGINT AS truncated,
  sum(particles)::BIGINT AS particles, sum(track_missing)::BIGINT AS track_missing
FROM c GROUP BY CUBE (target, record_id, split)""",
)
def missingness_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    jets = tables.jets(spark, sf_dir)
    rows = tables.canonical_rows(spark, sf_dir)
    kept = (
        tables.raw_particles(spark, sf_dir)
        .filter((F.col("pt") >= tables.MIN_PT) & (F.col("energy") >= tables.MIN_ENERGY))
        .groupBy("o_orderkey")
        .agg(F.count(F.lit(1)).alias("n_before"))
    )
    return audit.missingness_cube(rows, jets.join(kept, "o_orderkey", "left"), 5)


@query(
    "smd_ks",
    f"""WITH {sv.JETS}, t AS (SELECT * FROM jets WHERE split = 'train'),
m AS (SELECT abs(avg(n_vertices::DOUBLE) FILTER (target = 1) - avg(n_vertices::DOUBLE) FILTER (target = 0))
  / sqrt((var_samp(n_vertices::DOUBLE) FILTER (target = 0) + var_samp(n_vertices::DOUBLE) FILTER (target = 1)) / 2)
  AS smd FROM t),
v AS (SELECT pv_z, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM t GROUP BY 1),
k AS (SELECT max(abs(f1 - f0)) AS ks FROM (SELECT
  sum(n0) OVER (ORDER BY pv_z)::DOUBLE / sum(n0) OVER () AS f0,
  sum(n1) OVER (ORDER BY pv_z)::DOUBLE / sum(n1) OVER () AS f1 FROM v))
SELECT 'n_vertices' AS field, 'smd' AS statistic, round(smd, 7) AS value, smd > 0.10 AS mismatch FROM m
UNION ALL SELECT 'pv_z', 'ks', round(ks, 7), ks > 0.10 FROM k""",
)
def smd_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = tables.jets(spark, sf_dir).filter("split = 'train'")
    smd = fit.standardized_difference(train, "n_vertices", "target").select(
        "field", F.lit("smd").alias("statistic"), F.col("smd").alias("value")
    )
    ks = fit.ks_distance(train, "pv_z", "target").select(
        "field", F.lit("ks").alias("statistic"), F.col("ks").alias("value")
    )
    return smd.unionByName(ks).select(
        "field", "statistic", F.round("value", 7).alias("value"), (F.col("value") > 0.10).alias("mismatch")
    )


_AXES = {"jet_pt": (400.0, 550.0, 700.0, 850.0, 1000.0, 1100.0), "jet_eta": (-2.5, -1.0, 0.0, 1.0, 2.5)}
_CELLS = """CASE WHEN jet_pt >= 1000 THEN 4 WHEN jet_pt >= 850 THEN 3 WHEN jet_pt >= 700 THEN 2
    WHEN jet_pt >= 550 THEN 1 ELSE 0 END AS jet_pt_cell,
  CASE WHEN jet_eta >= 1 THEN 3 WHEN jet_eta >= 0 THEN 2 WHEN jet_eta >= -1 THEN 1 ELSE 0 END AS jet_eta_cell"""


@query(
    "reweight",
    f"""WITH {sv.JETS}, p AS (SELECT *, {_CELLS} FROM jets),
c AS (SELECT jet_pt_cell, jet_eta_cell, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1
  FROM p WHERE split = 'train' GROUP BY ALL),
w AS (SELECT jet_pt_cell, jet_eta_cell, (n1::DOUBLE / (SELECT sum(n1) FROM c))
  / (n0::DOUBLE / (SELECT sum(n0) FROM c)) AS weight FROM c WHERE n0 > 0)
SELECT jet_id, split, round(CASE target WHEN 1 THEN 1.0::DOUBLE ELSE coalesce(weight, 0) END, 9) AS audit_weight
FROM p LEFT JOIN w USING (jet_pt_cell, jet_eta_cell)""",
)
def reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    jets = tables.jets(spark, sf_dir)
    weights = fit.class_weights(jets, _AXES)
    return fit.apply_weights(jets, weights, _AXES).select(
        "jet_id", "split", F.round("audit_weight", 9).alias("audit_weight")
    )


def _event_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders make one event of up to four jets."""
    k = F.col("o_orderkey")
    return tables.jets(spark, sf_dir).select(
        k,
        F.floor(k / 4).alias("ev"),
        (k % 4).alias("source"),
        F.col("jet_pt").cast("double").alias("pt"),
        F.col("jet_eta").cast("double").alias("eta"),
        F.col("jet_phi").cast("double").alias("phi"),
        (F.lit(18000) + F.floor(k / 4) % 5).alias("sample"),
        (F.floor(k / 4) % 5 < 2).alias("is_signal"),
    )


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("ev"),
        ((p % 400 - 200) / F.lit(100.0)).alias("t_eta"),
        (((s * 37 + p) % 629 - 314) / F.lit(100.0)).alias("t_phi"),
        p,
        s,
    )
    step = F.lit(0.1)
    return rows.select(
        "ev",
        "t_eta",
        "t_phi",
        (F.col("t_eta") + (p % 7 - 3) * step).alias("b_eta"),
        (F.col("t_phi") + (s % 7 - 3) * step).alias("b_phi"),
        (F.col("t_eta") + (p % 5 - 2) * step).alias("q1_eta"),
        (F.col("t_phi") + (s % 5 - 2) * step).alias("q1_phi"),
        (F.col("t_eta") - (p % 5 - 2) * step).alias("q2_eta"),
        (F.col("t_phi") - (s % 5 - 2) * step).alias("q2_phi"),
    )


def _near(wrap) -> str:
    """A top and its three daughters lie within the match radius; ``wrap`` gives the text of an angle."""
    return " AND ".join(
        f"sqrt((eta - {p}_eta) * (eta - {p}_eta) + {wrap(f'phi - {p}_phi')} * {wrap(f'phi - {p}_phi')}) < 0.8::DOUBLE"
        for p in ("t", "b", "q1", "q2")
    )


_DR = _near(sv.wrap)
_MATCH = f"""{sv.JETS}, ej AS (SELECT o_orderkey, o_orderkey // 4 AS ev, o_orderkey % 4 AS source,
    jet_pt::DOUBLE AS pt, jet_eta::DOUBLE AS eta, jet_phi::DOUBLE AS phi,
    (18000 + (o_orderkey // 4) % 5)::BIGINT AS sample, (o_orderkey // 4) % 5 < 2 AS is_signal FROM jets),
r AS (SELECT l_orderkey // 4 AS ev, (l_partkey % 400 - 200) / 100.0::DOUBLE AS t_eta,
    ((l_suppkey * 37 + l_partkey) % 629 - 314) / 100.0::DOUBLE AS t_phi, l_partkey AS p, l_suppkey AS s
  FROM lineitem),
tops AS (SELECT ev, t_eta, t_phi, t_eta + (p % 7 - 3) * 0.1::DOUBLE AS b_eta,
    t_phi + (s % 7 - 3) * 0.1::DOUBLE AS b_phi, t_eta + (p % 5 - 2) * 0.1::DOUBLE AS q1_eta,
    t_phi + (s % 5 - 2) * 0.1::DOUBLE AS q1_phi, t_eta - (p % 5 - 2) * 0.1::DOUBLE AS q2_eta,
    t_phi - (s % 5 - 2) * 0.1::DOUBLE AS q2_phi FROM r),
kin AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY source) - 1 AS jet_index
  FROM ej WHERE pt >= 500 AND pt < 1000 AND abs(eta) < 2),
mm AS (SELECT o_orderkey, count(*) AS matches FROM kin JOIN tops USING (ev) WHERE is_signal AND {_DR} GROUP BY 1)"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    jets = _event_jets(spark, sf_dir).filter(match.kinematic(F.col("pt"), F.col("eta")))
    return match.event_index(jets, ["ev"], "source")


@query(
    "event_jet_index",
    f"WITH {_MATCH} SELECT o_orderkey, ev, jet_index::INTEGER AS jet_index FROM kin",
)
def event_jet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("o_orderkey", "ev", "jet_index")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _selected(spark, sf_dir)
    signal = kept.filter("is_signal")
    found = match.truth_matches(signal, _tops(spark, sf_dir), ["ev"], ["ev", "o_orderkey"])
    zero = F.lit(0).cast("bigint")
    return kept.join(found, ["ev", "o_orderkey"], "left").withColumn(
        "matches", F.coalesce("matches", zero)
    )


@query(
    "deltar_match",
    f"""WITH {_MATCH.replace(_DR, _near(sv.floored_wrap))}
SELECT o_orderkey, jet_index::INTEGER AS jet_index, coalesce(matches, 0)::BIGINT AS matches,
  CASE WHEN NOT is_signal THEN 'background' WHEN matches = 1 THEN 'matched' WHEN matches > 1 THEN 'EXTRACT_AMBIGUOUS_TRUTH' ELSE 'dropped' END AS status
FROM kin LEFT JOIN mm USING (o_orderkey)""",
)
def deltar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = match.match_status(F.col("matches"), F.col("is_signal"))
    return _matched(spark, sf_dir).select(
        "o_orderkey", "jet_index", "matches", status.alias("status")
    )


@query(
    "cutflow",
    f"""WITH {_MATCH}, child AS (SELECT l_orderkey AS o_orderkey,
    count(*) FILTER (l_suppkey % 50 = 0 OR l_partkey % 97 = 0) AS broken FROM lineitem GROUP BY 1),
f AS (SELECT sample, ev, ej.o_orderkey, k.o_orderkey IS NOT NULL AS kin,
  NOT ej.is_signal OR coalesce(matches, 0) = 1 AS truth, coalesce(broken, 0) = 0 AS finite
  FROM ej LEFT JOIN kin k USING (o_orderkey, ev, sample) LEFT JOIN mm USING (o_orderkey)
  LEFT JOIN child USING (o_orderkey))
SELECT sample, count(DISTINCT ev)::BIGINT AS events, count(*)::BIGINT AS jets,
  count(*) FILTER (kin)::BIGINT AS kinematic, count(*) FILTER (kin AND truth)::BIGINT AS truth,
  count(*) FILTER (kin AND truth AND finite)::BIGINT AS finite,
  count(*) FILTER (kin AND truth AND finite)::BIGINT AS retained FROM f GROUP BY sample""",
)
def cutflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages per sample; background jets pass the truth stage unmatched.

    Particles of some lines have a field that is not finite; a jet with one is not retained.
    """
    truth = _matched(spark, sf_dir).select("o_orderkey", "matches")
    lines = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_suppkey") % 50 == 0, F.lit(float("inf"))).otherwise(F.lit(0.5)).alias("eta"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("dz"),
    )
    broken = not_finite(F.col("eta")) | not_finite(F.col("dz"))
    child = lines.groupBy("o_orderkey").agg(F.count_if(broken).alias("broken"))
    jets = (
        _event_jets(spark, sf_dir)
        .join(truth, "o_orderkey", "left")
        .join(child, "o_orderkey", "left")
    )
    kin = F.col("matches").isNotNull()
    passed = kin & (~F.col("is_signal") | (F.col("matches") == 1))
    finite = passed & (F.coalesce("broken", F.lit(0)) == 0)
    flags = {"kinematic": kin, "truth": passed, "finite": finite, "retained": finite}
    return match.cutflow(jets, "sample", ["ev"], flags)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as a decay tree: event e has daughters 2e+1 and 2e+2; the type is the code."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "event_type")
    code = F.expr(
        "CASE event_type WHEN 'purchase' THEN 6 WHEN 'view' THEN 24 WHEN 'error' THEN 5 "
        "WHEN 'signup' THEN 2 ELSE 21 END"
    )
    nodes = events.select(F.col("event_id").alias("node"), code.alias("code"))
    e = F.col("event_id")
    edges = events.filter(e > 0).select(
        F.floor((e - 1) / 2).alias("mother"), e.alias("daughter"), ((e - 1) % 2).alias("ord")
    )
    return edges, nodes


_GRAPH = """nodes AS (SELECT event_id AS node, CASE event_type WHEN 'purchase' THEN 6 WHEN 'view' THEN 24
    WHEN 'error' THEN 5 WHEN 'signup' THEN 2 ELSE 21 END AS code FROM events),
edges AS (SELECT (event_id - 1) // 2 AS mother, event_id AS daughter, (event_id - 1) % 2 AS ord
  FROM events WHERE event_id > 0),
nxt AS (SELECT mother AS node, arg_min(daughter, ord) AS next FROM edges
  JOIN nodes m ON m.node = mother JOIN nodes d ON d.node = daughter WHERE m.code = d.code GROUP BY mother),
walk AS (SELECT node, node AS cur FROM nodes
  UNION ALL SELECT walk.node, next FROM walk JOIN nxt ON nxt.node = walk.cur),
term AS (SELECT walk.node, cur AS terminal FROM walk LEFT JOIN nxt ON nxt.node = cur WHERE next IS NULL)"""


@query("terminal_copy", f"WITH RECURSIVE {_GRAPH} SELECT node, terminal FROM term")
def terminal_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _graph(spark, sf_dir)
    return match.terminal_copies(edges, nodes)


@query(
    "decay_signature",
    f"""WITH RECURSIVE {_GRAPH},
coded AS (SELECT e.*, code FROM edges e JOIN nodes ON node = daughter),
tops AS (SELECT n.node AS top FROM nodes n JOIN term t USING (node) WHERE code = 6 AND terminal = n.node),
f AS (SELECT top, arg_max(daughter, ord) FILTER (code = 5) AS b, arg_max(daughter, ord) FILTER (code = 24) AS w
  FROM tops JOIN coded ON mother = top GROUP BY top),
x AS (SELECT top, tb.terminal AS b, tw.terminal AS w FROM f JOIN term tb ON tb.node = b JOIN term tw ON tw.node = w),
q AS (SELECT mother AS w, arg_min(daughter, ord) AS q1, arg_max(daughter, ord) AS q2 FROM coded
  WHERE abs(code) BETWEEN 1 AND 5 GROUP BY mother HAVING count(*) = 2)
SELECT top, b AS bottom, t1.terminal AS q1, t2.terminal AS q2 FROM x JOIN q USING (w)
JOIN term t1 ON t1.node = q1 JOIN term t2 ON t2.node = q2""",
)
def decay_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = (stored(part) for part in _graph(spark, sf_dir))
    return match.decay_signature(edges, nodes, stored(match.terminal_copies(edges, nodes)))


_LANES = ", ".join(
    f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) AS l{i}" for i in range(8)
)


@query(
    "dataset_digest",
    f"""WITH {sv.JETS},
d AS (SELECT split, sha256('{{"event":' || event || ',"jet_id":"' || jet_id || '","record_id":' || record_id
  || ',"target":' || target || '}}') AS d FROM jets),
s AS (SELECT split, count(*) AS rows, {_LANES} FROM d GROUP BY split)
SELECT split, rows, sha256('row-sha256-lane-sum-v1:' || rows || ':' || {" || ':' || ".join(f'l{i}' for i in range(8))})
  AS digest FROM s""",
)
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.content_digest(
        tables.jets(spark, sf_dir), ["jet_id", "target", "record_id", "event"], ["split"]
    )


@query(
    "row_order_digest",
    f"""WITH {sv.JETS},
d AS (SELECT split, sha256('{{"jet_id":"' || jet_id || '","pos":' || o_orderkey || '}}') AS d FROM jets),
s AS (SELECT split, count(*) AS rows, {_LANES} FROM d GROUP BY split)
SELECT split, rows, sha256('row-sha256-lane-sum-v1:' || rows || ':' || {" || ':' || ".join(f'l{i}' for i in range(8))})
  AS digest FROM s""",
)
def row_order_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position is part of the row, so reordering changes the digest."""
    rows = tables.jets(spark, sf_dir).select("split", "jet_id", F.col("o_orderkey").alias("pos"))
    return digest.content_digest(rows, ["jet_id", "pos"], ["split"])
