"""Registered queries: particle cleaning, features, scaling, views, array operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.functions import arrays, particles as phys
from jetframe.operators import canonical, fit, profile, ranking, views
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query
from jetframe.plans.data_queries import SEED, SIZES, _pool, _subset_sql
from jetframe.schema import CONTINUOUS_FIELDS, FEATURE_VIEWS
from jetframe.session import stored

FIELDS = CONTINUOUS_FIELDS


def r6(column):
    return F.round(column.cast("double"), 6)


@query(
    "particles_topk",
    f"""WITH {sv.PARTICLES}
SELECT o_orderkey, idx::INTEGER AS idx, pt, energy, pdg_id, has_track FROM kept WHERE idx < 3""",
)
def particles_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tables.with_particle_fields(tables.selected_particles(spark, sf_dir, k=3))
    return chosen.select(
        "o_orderkey", (F.col("rn") - 1).cast("int").alias("idx"), "pt", "energy", "pdg_id", "has_track"
    )


@query(
    "particle_features",
    f"""WITH {sv.CANONICAL}
SELECT jet_id, idx::INTEGER AS idx, pid_type::TINYINT AS pid_type,
  track_state::TINYINT AS track_state,
  {', '.join(f'round({f}::DOUBLE, 6) + 0.0::DOUBLE AS {f}' for f in sv.FIELDS)} FROM canonical""",
)
def particle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.canonical_rows(spark, sf_dir).select(
        "jet_id", "idx", "pid_type", "track_state", *[r6(F.col(f)).alias(f) for f in FIELDS]
    )


@query(
    "nested_clean",
    f"""WITH {sv.JETS}, {sv.PARTICLES},
a AS (SELECT o_orderkey, count(*) AS n FROM kept GROUP BY 1),
b AS (SELECT o_orderkey, pt, energy, idx FROM kept WHERE idx < 2)
SELECT jet_id, coalesce(n, 0)::INTEGER AS n_before, pt, energy, idx::INTEGER AS idx
FROM jets LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey)""",
)
def nested_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array form: cut, stable order and truncation inside each row, no shuffle of its own."""
    jets = tables.nested_jets(spark, sf_dir, 1e-9, 1e-9)
    done = canonical.clean_particles(jets, tables.MIN_PT, tables.MIN_ENERGY, k=2)
    return done.select(
        "jet_id", "n_before", F.posexplode_outer("particles").alias("idx", "p")
    ).select("jet_id", "n_before", "p.pt", "p.energy", "idx")


@query(
    "compact_rules",
    f"""WITH {sv.JETS}, {sv.PARTICLES},
bad AS (SELECT DISTINCT o_orderkey FROM particles WHERE l_suppkey % 50 = 0 OR l_partkey % 97 = 0),
r AS (SELECT j.*, CASE WHEN o_orderkey % 101 = 0 THEN 'holdout' ELSE split END AS s2,
        CASE WHEN o_orderkey % 103 = 0 THEN 2 ELSE target END AS t2,
        CASE WHEN o_orderkey % 107 = 0 THEN 0 ELSE lumi END AS l2,
        o_orderkey IN (SELECT o_orderkey FROM bad) AS nonfinite FROM jets j),
k AS (SELECT *, record_id || ':' || canonical_pfn || ':' || run || ':' || l2 || ':' || event || ':'
        || jet_index AS key FROM r)
SELECT 'DATA_NONFINITE' AS rule, key, '' AS detail FROM k WHERE nonfinite
UNION ALL SELECT 'DATA_SPLIT', key, '' FROM k WHERE s2 = 'holdout'
UNION ALL SELECT 'DATA_LABEL', key, '' FROM k WHERE t2 = 2
UNION ALL SELECT 'SPLIT_IDENTITY_VALUE:lumi', key, '' FROM k WHERE l2 < 1""",
)
def compact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted copies of the jets: infinite and NaN fields, bad splits, labels, coordinates."""
    raw = tables.selected_particles(spark, sf_dir, 1e-9, 1e-9)
    bad_eta, bad_dz = F.col("l_suppkey") % 50 == 0, F.col("l_partkey") % 97 == 0
    marked = raw.select("*", bad_eta.alias("bad_eta"), bad_dz.alias("bad_dz"))
    broken = tables.with_particle_fields(marked).withColumns(
        {
            "eta": F.when(F.col("bad_eta"), F.lit(float("inf"))).otherwise(F.col("eta")),
            "dz": F.when(F.col("bad_dz"), F.lit(float("nan"))).otherwise(F.col("dz")),
        }
    )
    children = canonical.nest_children(broken, "o_orderkey")
    jets = canonical.attach_children(tables.jets(spark, sf_dir), children, "o_orderkey")
    k = F.col("o_orderkey")
    return canonical.compact_rules(
        jets.withColumns(
            {
                "split": F.when(k % 101 == 0, F.lit("holdout")).otherwise(F.col("split")),
                "target": F.when(k % 103 == 0, F.lit(2).cast("tinyint")).otherwise(F.col("target")),
                "lumi": F.when(k % 107 == 0, F.lit(0).cast("bigint")).otherwise(F.col("lumi")),
            }
        )
    )


@query(
    "fit_scaling",
    "WITH {}, s AS (SELECT count(*)::BIGINT AS n, {} FROM canonical WHERE split = 'train') {}".format(
        sv.CANONICAL,
        ", ".join(
            f"avg({f}::DOUBLE) AS l_{f}, stddev_pop({f}::DOUBLE) AS s_{f}" for f in sv.FIELDS
        ),
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, round(l_{f}, 6) AS location, round(CASE s_{f} WHEN 0 THEN 1 "
            f"ELSE s_{f} END, 6) AS scale, n FROM s"
            for f in sv.FIELDS
        ),
    ),
)
def fit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fit.fit_scaling(tables.canonical_rows(spark, sf_dir))
    return state.select("field", r6(F.col("location")).alias("location"), r6(F.col("scale")).alias("scale"), "n")


def _scaling(spark: SparkSession, sf_dir: str) -> views.Scaling:
    return fit.lazy_scaling(tables.canonical_rows(spark, sf_dir))


def _slot_sum(position: int) -> Column:
    """Sum over all slots of ``data`` of one feature rounded to four places.

    Rounding goes by way of decimal numbers; a zero, which padding is, needs none and adds nothing.
    """
    values = F.filter(F.transform("data", lambda d: d[position]), lambda v: ~v.eqNullSafe(F.lit(0.0)))
    rounded = F.transform(values, lambda v: F.round(v.cast("double"), 4))
    return F.aggregate(rounded, F.lit(0.0), lambda total, v: total + v)


def _value_sql(field: str) -> str:
    if field == "pid_type":
        return "pid_type::DOUBLE AS pid_type"
    return (
        f"round(((({field} - loc_{field})::FLOAT) / scale_{field})::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS {field}"
    )


def _view_sql(config: str) -> str:
    fields = FEATURE_VIEWS[config]
    return f"""WITH {sv.CANONICAL}, fitted AS (SELECT jet_id, target AS label, idx::INTEGER AS idx,
    {', '.join(fields)}, {', '.join(sv.fitted(f) for f in fields if f != 'pid_type')} FROM canonical)
SELECT jet_id, label, idx, {', '.join(_value_sql(f) for f in fields)} FROM fitted"""


def _register_view(config: str) -> None:
    @query(f"view_{config.lower()}", _view_sql(config))
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables.canonical_rows(spark, sf_dir).withColumnRenamed("target", "label")
        made = views.view_rows(rows, _scaling(spark, sf_dir), config)
        return made.select(
            "jet_id",
            "label",
            "idx",
            *[F.round(F.col(f).cast("double"), 4).alias(f) for f in FEATURE_VIEWS[config]],
        )


for _config in FEATURE_VIEWS:
    _register_view(_config)


@query(
    "padded_view",
    f"""WITH {sv.CANONICAL}, {sv.FIT},
v AS (SELECT jet_id, {', '.join(_value_sql(f) for f in FEATURE_VIEWS['D'])} FROM canonical, fit),
s AS (SELECT jet_id, count(*) AS n, sum(log_pt) AS log_pt, sum(pid_type) AS pid_type
  FROM v GROUP BY jet_id)
SELECT jet_id, target AS label, 150 AS slots, coalesce(n, 0)::INTEGER AS real,
  round(coalesce(log_pt, 0), 6) + 0.0::DOUBLE AS log_pt_sum, coalesce(pid_type, 0) AS pid_sum
FROM jets LEFT JOIN s USING (jet_id)""",
)
def padded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View D with every jet padded to the full width; all slots are summed, padding included."""
    rows = tables.canonical_jets(spark, sf_dir).withColumnRenamed("target", "label")
    view = views.feature_view(rows, _scaling(spark, sf_dir), "D")

    return view.select(
        "jet_id",
        "label",
        F.size("data").alias("slots"),
        arrays.mask_count(F.col("mask")).alias("real"),
        F.round(_slot_sum(2), 6).alias("log_pt_sum"),
        _slot_sum(4).alias("pid_sum"),
    )


_SUBSET_VIEW = f"""{sv.CANONICAL}, {_subset_sql(f"'{SEED}'")},
m AS (SELECT CASE label WHEN 0 THEN pos ELSE pos + {SIZES[1]} END - 1 AS row, jet_id, label
  FROM ordered WHERE pos <= {SIZES[1]})"""


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = ranking.balanced_order(_pool(spark, sf_dir), SIZES[1], SEED)
    members = ranking.subset_members(ordered, [SIZES[1]])
    # Particles are ordered and features derived after the choice, for the chosen jets only.
    jets = tables.jets(spark, sf_dir).withColumnRenamed("target", "label")
    chosen = stored(views.subset_rows(members, jets, SIZES[1]))
    return canonical.derive_features(tables.with_particles(chosen, spark, sf_dir))


@query(
    "subset_view",
    f"""WITH {_SUBSET_VIEW}, {sv.FIT},
c AS (SELECT jet_id, count(*) AS n,
        sum(round((((log_pt - loc_log_pt)::FLOAT) / scale_log_pt)::FLOAT::DOUBLE, 4)) AS s
      FROM canonical, fit GROUP BY jet_id)
SELECT row::BIGINT AS row, m.jet_id, label, coalesce(n, 0)::INTEGER AS real,
  round(coalesce(s, 0), 6) + 0.0::DOUBLE AS log_pt_sum FROM m LEFT JOIN c USING (jet_id)""",
)
def subset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View A of one nested subset: every jet keeps its place in the subset order."""
    view = views.feature_view(
        _subset(spark, sf_dir), _scaling(spark, sf_dir), "A", keep=("row", "jet_id", "label")
    )
    return view.select(
        "row",
        "jet_id",
        "label",
        arrays.mask_count(F.col("mask")).alias("real"),
        F.round(_slot_sum(2), 6).alias("log_pt_sum"),
    )


MANY_SIZES = (10, 1000, 5000)


@query(
    "subset_view_sizes",
    f"""WITH {sv.JETS}, {_subset_sql(f"'{SEED}'")}
SELECT (CASE label WHEN 0 THEN pos ELSE pos + {MANY_SIZES[1]} END - 1)::BIGINT AS row, jet_id, label
FROM ordered WHERE pos <= {MANY_SIZES[1]}""",
)
def subset_view_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subset out of three that are held in one table."""
    ordered = ranking.balanced_order(_pool(spark, sf_dir), MANY_SIZES[-1], SEED)
    members = ranking.subset_members(ordered, MANY_SIZES)
    jets = tables.jets(spark, sf_dir).select("jet_id")
    found = views.subset_rows(members, jets, MANY_SIZES[1])
    return found.select("row", "jet_id", F.col("subset_label").alias("label"))


@query(
    "view_equivalence",
    f"""WITH {_SUBSET_VIEW}
SELECT 'VIEW_EQUIVALENCE' AS rule, row::VARCHAR AS key, 'views=' || 3 AS detail
FROM m WHERE row % 10 = 0""",
)
def view_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View D lacks every tenth row here, which must be found."""
    rows = stored(_subset(spark, sf_dir))  # every view reads it
    scaling = _scaling(spark, sf_dir)
    made = {
        c: views.feature_view(rows, scaling, c, keep=("row", "jet_id", "label"))
        for c in FEATURE_VIEWS
    }
    made["D"] = made["D"].filter("row % 10 <> 0")
    return views.view_differences(made)


@query(
    "subset_identity_gaps",
    f"""WITH {sv.JETS}, {_subset_sql(f"'{SEED}'")},
m AS (SELECT DISTINCT jet_id FROM ordered WHERE pos <= {SIZES[-1]}),
c AS (SELECT jet_id FROM jets WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT jet_id FROM jets WHERE o_orderkey % 50 = 1)
SELECT 'VIEW_IDENTITY_MISSING' AS rule, jet_id AS key, '' AS detail FROM m ANTI JOIN c USING (jet_id)
UNION ALL
SELECT 'VIEW_IDENTITY_DUPLICATE', jet_id, 'count=' || count(*) FROM c
GROUP BY jet_id HAVING count(*) > 1""",
)
def subset_identity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = ranking.balanced_order(_pool(spark, sf_dir), SIZES[-1], SEED)
    members = ranking.subset_members(ordered, SIZES)
    jets = tables.jets(spark, sf_dir)
    held = jets.filter("o_orderkey % 9 <> 0").unionByName(jets.filter("o_orderkey % 50 = 1"))
    return views.subset_violations(members, held.select("jet_id"))


# Feature groups and integer positions of a 64-wide vector table.
LADDER = {
    "A": ("kinematics",),
    "B": ("kinematics", "charge"),
    "C": ("kinematics", "charge", "pid"),
    "D": ("kinematics", "charge", "pid", "impact_parameter"),
}
GROUPS = {
    "kinematics": ("px", "py", "pz", "e"),
    "charge": ("q",),
    "pid": ("is_had", "is_lep"),
    "impact_parameter": ("d0", "dz"),
}
POSITIONS = {"px": 0, "py": 1, "pz": 2, "e": 3, "q": 8, "is_had": 5, "is_lep": 6, "d0": 12, "dz": 15}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-vector as four children of sixteen features; small values count as padding."""
    rows = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v")
    )
    children = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, 16)
    )
    return rows.select(
        "vec_id",
        "label",
        F.transform(
            children,
            lambda row, i: F.when(F.pmod(F.col("vec_id") + i, F.lit(4)) == 3, F.array_repeat(F.lit(0.0), 16))
            .otherwise(row),
        ).alias("data"),
    )


_VECTORS = """vectors AS (
  SELECT vec_id, label, i, j, CASE WHEN (vec_id + i) % 4 = 3 THEN 0.0::DOUBLE
    ELSE embedding[(i * 16 + j + 1)::INTEGER]::DOUBLE END AS v
  FROM embeddings, range(4) AS a(i), range(16) AS b(j))"""


@query(
    "feature_gather",
    f"""WITH {_VECTORS}
SELECT vec_id, i::INTEGER AS child, {', '.join(
    f'max(CASE j WHEN {POSITIONS[n]} THEN v END) AS {n}' for g in LADDER['D'] for n in GROUPS[g])}
FROM vectors GROUP BY vec_id, i""",
)
def feature_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = arrays.resolve_features("D", LADDER, GROUPS)
    positions = arrays.feature_positions(names, POSITIONS, 16)
    rows = _vectors(spark, sf_dir).withColumn("data", arrays.gather(F.col("data"), positions))
    return rows.select("vec_id", F.posexplode("data").alias("child", "d")).select(
        "vec_id", "child", *[F.col("d")[i].alias(n) for i, n in enumerate(names)]
    )


@query(
    "mask_counts",
    f"""WITH {_VECTORS},
c AS (SELECT vec_id, i, bool_or(abs(v) > 0) AS m, bool_or(j = 2 AND v > 0.05) AS k,
  bool_or(abs(v) > 0.35) AS big FROM vectors GROUP BY vec_id, i)
SELECT vec_id, count(*) FILTER (m)::INTEGER AS inferred, count(*) FILTER (big)::INTEGER AS above_eps,
  count(*) FILTER (k)::INTEGER AS by_feature, count(*) FILTER (m <> k)::INTEGER AS disagree
FROM c GROUP BY vec_id""",
)
def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    # The source column of the second mask is zeroed where it is small.
    marked = F.transform(
        "data",
        lambda d: F.transform(
            d, lambda v, j: F.when((j == 2) & (v <= 0.05), F.lit(0.0)).otherwise(v)
        ),
    )
    inferred = arrays.infer_mask(F.col("data"))
    by_feature = arrays.mask_from_feature(marked, 2)
    return rows.select(
        "vec_id",
        arrays.mask_count(inferred).alias("inferred"),
        arrays.mask_count(arrays.infer_mask(F.col("data"), 0.35)).alias("above_eps"),
        arrays.mask_count(by_feature).alias("by_feature"),
        arrays.mask_disagreements(inferred, by_feature).alias("disagree"),
    )


@query(
    "finite_fraction",
    """SELECT label, round((count(*) - count(*) FILTER ((vec_id + j) % 11 = 0))::DOUBLE / count(*), 9)
  AS finite_fraction FROM embeddings, range(64) AS t(j) GROUP BY label""",
)
def finite_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in which one value in eleven is replaced by NaN."""
    holed = F.transform(
        "embedding",
        lambda v, j: F.when((F.col("vec_id") + j) % 11 == 0, F.lit(float("nan"))).otherwise(
            v.cast("double")
        ),
    )
    rows = tables.table(spark, sf_dir, "embeddings").select("label", holed.alias("v"))
    done = profile.finite_fraction(rows, "v", ["label"])
    return done.select("label", F.round("finite_fraction", 9).alias("finite_fraction"))


@query(
    "structure_profile",
    f"""WITH {sv.JETS}, {sv.PARTICLES},
n AS (SELECT o_orderkey, count(*) AS c FROM kept GROUP BY 1),
s AS (SELECT count(*) AS n, min(coalesce(c, 0)) AS lo, max(coalesce(c, 0)) AS hi,
  count(*) FILTER (c IS NULL) AS e FROM jets LEFT JOIN n USING (o_orderkey))
SELECT 'particles' AS field, 'array' AS kind, n::BIGINT AS n_rows, 0::BIGINT AS nulls, lo::INTEGER AS min_size,
  hi::INTEGER AS max_size, e::BIGINT AS empty FROM s
UNION ALL SELECT 'jet_id', 'string', n, 0, NULL, NULL, 0 FROM s
UNION ALL SELECT 'jet_pt', 'float', n, 0, NULL, NULL, 0 FROM s
UNION ALL SELECT 'target', 'tinyint', n, 0, NULL, NULL, 0 FROM s""",
)
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.nested_jets(spark, sf_dir).select("jet_id", "jet_pt", "target", "particles")
    return profile.structure_profile(rows)


@query(
    "vector_input_contract",
    """SELECT 'data' AS field, 2 AS expected_rank, 1 AS found_rank, count(*)::BIGINT AS n_rows,
  64::INTEGER AS min_width, 64::INTEGER AS max_width, 'rank' AS issue FROM embeddings
UNION ALL SELECT 'pid', 0, 0, count(*), NULL, NULL, '' FROM embeddings
UNION ALL SELECT 'jet', 1, NULL, NULL, NULL, NULL, 'missing' FROM (SELECT 1)""",
)
def vector_input_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").select(
        F.col("embedding").alias("data"), F.col("label").alias("pid")
    )
    return profile.input_contract(rows, {"data": 2, "pid": 0, "jet": 1})


@query(
    "label_counts",
    "SELECT label, count(*)::BIGINT AS count FROM embeddings GROUP BY label",
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_counts(tables.table(spark, sf_dir, "embeddings"), "label")


_LABEL_MAP = {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1}


@query(
    "label_remap",
    """SELECT vec_id, CASE WHEN label < 8 THEN label % 2 END::BIGINT AS remapped,
  label >= 8 AS unknown FROM embeddings""",
)
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the ten labels are not in the map and must be reported."""
    return profile.remap_labels(
        tables.table(spark, sf_dir, "embeddings"), "label", _LABEL_MAP
    ).select("vec_id", "remapped", "unknown")


@query(
    "masked_sum_pool",
    f"""WITH {_VECTORS},
m AS (SELECT vec_id, i, bool_or(abs(v) > 0) AS m FROM vectors GROUP BY vec_id, i)
SELECT vec_id, j::INTEGER AS feature, round(sum(CASE WHEN m THEN v ELSE 0 END), 6) AS pooled_sum,
  round(sum(CASE WHEN m THEN v ELSE 0 END) / greatest(count(*) FILTER (m), 1), 6) AS pooled_mean
FROM vectors JOIN m USING (vec_id, i) GROUP BY vec_id, j""",
)
def masked_sum_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean over real children; masked slots hold garbage on purpose."""
    mask = arrays.infer_mask(F.col("data"))
    rows = _vectors(spark, sf_dir).withColumn("mask", mask)
    garbage = rows.withColumn(
        "data",
        F.zip_with(
            "data", "mask", lambda d, m: F.when(m, d).otherwise(F.array_repeat(F.lit(12345.0), 16))
        ),
    )
    pooled = garbage.select(
        "vec_id",
        arrays.masked_sum(F.col("data"), F.col("mask"), 16).alias("s"),
        arrays.masked_mean(F.col("data"), F.col("mask"), 16).alias("m"),
    )
    return pooled.select("vec_id", F.posexplode(F.arrays_zip("s", "m")).alias("feature", "v")).select(
        "vec_id",
        "feature",
        F.round("v.s", 6).alias("pooled_sum"),
        F.round("v.m", 6).alias("pooled_mean"),
    )


@query(
    "masked_batch_rules",
    """WITH r AS (SELECT vec_id,
    vec_id % 17 = 0 AS short, vec_id % 19 = 0 AS nonfinite, vec_id % 23 = 0 AS empty FROM embeddings)
SELECT 'BASELINE_SHAPE' AS rule, vec_id::VARCHAR AS key, '' AS detail FROM r WHERE short
UNION ALL SELECT 'BASELINE_INPUT', vec_id::VARCHAR, '' FROM r WHERE nonfinite
UNION ALL SELECT 'BASELINE_EMPTY_JET', vec_id::VARCHAR, '' FROM r WHERE empty""",
)
def masked_batch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a short mask, a NaN feature or no real child at all."""
    k = F.col("vec_id")
    rows = _vectors(spark, sf_dir).select(
        k,
        F.when(k % 19 == 0, F.transform("data", lambda d: F.array_repeat(F.lit(float("nan")), 16)))
        .otherwise(F.col("data"))
        .alias("data"),
        F.when(k % 23 == 0, F.array_repeat(F.lit(False), 4))
        .otherwise(F.array_repeat(F.lit(True), 4))
        .alias("mask"),
    )
    short = rows.withColumn(
        "mask", F.when(k % 17 == 0, F.slice("mask", 1, 3)).otherwise(F.col("mask"))
    )
    return profile.masked_batch_rules(short, "vec_id", "data", "mask")


@query(
    "tiny_slice",
    f"""WITH {_VECTORS},
f AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8),
c AS (SELECT vec_id, i, bool_or(abs(v) > 0) AS m, bool_or(j = 2 AND v <> 0) AS k FROM vectors
  JOIN f USING (vec_id) GROUP BY vec_id, i)
SELECT vec_id, 4 AS children, 1.0::DOUBLE AS finite_fraction, count(*) FILTER (k)::INTEGER AS real,
  count(*) FILTER (m <> k)::INTEGER AS disagree FROM c GROUP BY vec_id""",
)
def tiny_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight rows with shape, finiteness and mask report."""
    return profile.first_rows(_vectors(spark, sf_dir), "vec_id", "data", 8, mask_feature=2)


@query(
    "pair_distance",
    f"""WITH {sv.JETS}, {sv.PARTICLES},
t AS (SELECT o_orderkey, eta, phi FROM kept WHERE idx = 0)
SELECT jet_id, round(sqrt((jet_eta::DOUBLE - eta) * (jet_eta::DOUBLE - eta)
  + {sv.wrap('jet_phi::DOUBLE - phi')} * {sv.wrap('jet_phi::DOUBLE - phi')}), 6) AS distance
FROM jets JOIN t USING (o_orderkey)""",
)
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angular distance between every jet and its leading particle."""
    rows = tables.nested_jets(spark, sf_dir).filter(F.size("particles") > 0)
    lead = F.col("particles")[0]
    return rows.select(
        "jet_id",
        r6(
            phys.delta_r(
                F.col("jet_eta").cast("double"), F.col("jet_phi").cast("double"), lead["eta"], lead["phi"]
            )
        ).alias("distance"),
    )
