"""Jets, particles and scores derived from the star-schema tables.

The definitions use integer arithmetic, so any SQL engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.functions.identity import class_of_role
from jetframe.operators import canonical, split
from jetframe.schema import MAX_PARTICLES

# Policy parameters of the registered queries.
MIN_PT = 10.0
MIN_ENERGY = 10.0
SUBSET_SEED = 7
SUBSET_SIZES = (10, 50, 100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows over all tasks, for work on each row that costs far more than moving it.

    The tables here have one row group, which one task would read and work on alone.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def role_of_nation(nation):
    return (
        F.when(nation % 5 == 0, F.lit("signal"))
        .when(nation % 5 == 4, F.lit("qcd_candidate"))
        .otherwise(F.lit("qcd_active"))
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        (F.lit(18000) + n).cast("bigint").alias("record_id"), role_of_nation(n).alias("role")
    )


def pfn(record, file_no):
    return F.concat(
        F.lit("root://synthetic.invalid//store/"),
        record.cast("string"),
        F.lit("/file-"),
        file_no.cast("string"),
        F.lit(".root"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record, file and split of every customer's jets.

    A file's hash and split are worked out once per customer, not once per order, and a filter on the split
    falls on customers.
    """
    nation = F.col("c_nationkey")
    named = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.lit(18000) + nation).cast("bigint").alias("record_id"),
        role_of_nation(nation).alias("role"),
        pfn((F.lit(18000) + nation).cast("bigint"), F.col("c_custkey") % 8).alias("canonical_pfn"),
    )
    return split.with_source(named.withColumn("target", class_of_role(F.col("role"))))


def jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One jet per order, with identity, split, class and jet-level fields."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source = sources(spark, sf_dir)
    k = F.col("o_orderkey")
    raw = orders.join(source, F.col("o_custkey") == F.col("c_custkey")).select(
        k,
        "record_id",
        F.lit(1).cast("bigint").alias("run"),
        (F.lit(1) + F.floor(k / 1000)).cast("bigint").alias("lumi"),
        (k + 1).alias("event"),
        F.lit(0).alias("jet_index"),
        "role",
        (F.lit(400) + F.floor("o_totalprice") % 700).cast("float").alias("jet_pt"),
        ((k % 500 - 250) / F.lit(100.0)).cast("float").alias("jet_eta"),
        ((k % 629 - 314) / F.lit(100.0)).cast("float").alias("jet_phi"),
        ((F.col("o_custkey") % 21 - 10) / F.lit(10.0)).cast("float").alias("pv_z"),
        (F.lit(5) + F.col("o_custkey") % 40).cast("int").alias("n_vertices"),
        "canonical_pfn",
        "target",
        "pfn_sha256",
        "bucket",
        "split",
    )
    return split.with_jet_id(raw)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files per record, as a source manifest would list them."""
    return (
        table(spark, sf_dir, "nation")
        .select(
            (F.lit(18000) + F.col("n_nationkey")).cast("bigint").alias("record_id"),
            F.explode(F.sequence(F.lit(0), F.lit(7))).alias("file_no"),
        )
        .select(
            "record_id",
            pfn(F.col("record_id"), F.col("file_no")).alias("canonical_pfn"),
            F.substring(
                F.sha2(F.concat_ws("-", F.col("record_id"), F.col("file_no")), 256), 1, 8
            ).alias("adler32"),
            (F.lit(1000) + F.col("record_id") + F.col("file_no")).cast("bigint").alias("size_bytes"),
        )
    )


# Source order of the lines of one order (the line number alone is not unique).
TIE = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)


def raw_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per order line: its source columns, pt and energy."""
    pt = F.col("l_extendedprice") / F.lit(1000.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        *TIE,
        pt.alias("pt"),
        (pt * (F.lit(1.0) + F.col("l_tax"))).alias("energy"),
    )


def with_particle_fields(rows: DataFrame) -> DataFrame:
    """The remaining particle fields, replacing the source columns."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    keep = [c for c in rows.columns if c not in TIE]
    codes = F.array(*[F.lit(c) for c in (211, 22, 130, 11, 13, 321, 2112, 310, 999)])
    return rows.select(
        *keep,
        ((s % 500 - 250) / F.lit(100.0)).alias("eta"),
        ((p % 629 - 314) / F.lit(100.0)).alias("phi"),
        F.when(F.col("l_returnflag") == "R", F.lit(-1.0))
        .when(F.col("l_returnflag") == "A", F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("charge"),
        F.element_at(codes, (s % 9 + 1).cast("int")).alias("pdg_id"),
        (F.col("l_quantity") / F.lit(1000.0)).alias("dxy"),
        (F.col("l_quantity") / F.lit(10000.0)).alias("dxy_error"),
        (F.col("l_tax") / F.lit(10.0)).alias("dz"),
        (F.col("l_discount") / F.lit(10.0)).alias("dz_error"),
        (F.col("l_linestatus") == "F").alias("has_track"),
    )


def selected_particles(
    spark: SparkSession,
    sf_dir: str,
    min_pt: float = MIN_PT,
    min_energy: float = MIN_ENERGY,
    k: int = MAX_PARTICLES,
) -> DataFrame:
    return canonical.select_children(
        raw_particles(spark, sf_dir), "o_orderkey", TIE, min_pt, min_energy, k
    )


def nested_jets(
    spark: SparkSession, sf_dir: str, min_pt: float = MIN_PT, min_energy: float = MIN_ENERGY
) -> DataFrame:
    """Jets with their selected particles as an ordered array."""
    chosen = with_particle_fields(selected_particles(spark, sf_dir, min_pt, min_energy))
    children = canonical.nest_children(chosen, "o_orderkey")
    return canonical.attach_children(jets(spark, sf_dir), children, "o_orderkey")


def with_particles(
    chosen: DataFrame, spark: SparkSession, sf_dir: str, min_pt: float = MIN_PT, min_energy: float = MIN_ENERGY
) -> DataFrame:
    """A choice of jets with their selected particles; only lines of these jets are ordered and nested."""
    lines = raw_particles(spark, sf_dir).join(chosen.select("o_orderkey"), "o_orderkey", "left_semi")
    kept = canonical.select_children(lines, "o_orderkey", TIE, min_pt, min_energy, MAX_PARTICLES)
    children = canonical.nest_children(with_particle_fields(kept), "o_orderkey")
    return canonical.attach_children(chosen, children, "o_orderkey")


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected particles as rows with their features and jet columns."""
    chosen = with_particle_fields(selected_particles(spark, sf_dir))
    return canonical.feature_rows(chosen, jets(spark, sf_dir), "o_orderkey")


def canonical_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.derive_features(nested_jets(spark, sf_dir))


# Separation of the classes per view, in units of 1/10000.
SCORE_SHIFT = {"A": 500, "B": 1000, "C": 1500, "D": 2000}


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per jet and view: ``run_id`` is the view name."""
    config = F.explode(F.array(*[F.lit(c) for c in SCORE_SHIFT])).alias("run_id")
    shift = F.lit(0)
    for name, value in SCORE_SHIFT.items():
        shift = F.when(F.col("run_id") == name, F.lit(value)).otherwise(shift)
    draw = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.col("run_id"), F.col("jet_id"))), 1, 6), 16, 10
    ).cast("bigint")
    return (
        jets(spark, sf_dir)
        .select("jet_id", "split", "target", config)
        .withColumn("score", (F.lit(7) * (draw % 1000) + shift * F.col("target")) / F.lit(10000.0))
    )
