"""Cleaning, ordering, truncation and feature derivation of nested children."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetframe.functions import identity, particles as phys
from jetframe.rules import as_text, broken_rules, union_all, repeated_keys
from jetframe.schema import MAX_PARTICLES, PARALLEL_ARRAYS, SPLITS, TRACK_FIELDS

NUMERIC_FIELDS = ("pt", "eta", "phi", "energy", "charge", "pdg_id", *TRACK_FIELDS)
CHILD_FIELDS = (*NUMERIC_FIELDS, "has_track")


def check_cuts(min_pt: float, min_energy: float) -> None:
    if not (min_pt > 0 and min_energy > 0):
        raise ValueError("particle thresholds must be positive")


def top_children(
    children: DataFrame, key: str, order: Sequence[Column], k: int, salts: int = 1
) -> DataFrame:
    """First ``k`` children of every parent; adds ``rn``.

    The filter on ``row_number`` makes Spark cut each parent to ``k`` rows on the map
    side already (``WindowGroupLimit``), so a parent with very many children sends at
    most ``k`` rows per map task.  ``salts > 1`` adds a round that cuts parts of a parent
    in parallel, for parents so large that even those rows are too many for one task.
    """
    if salts > 1:
        part = F.pmod(F.xxhash64(*children.columns), F.lit(salts))
        w = Window.partitionBy(key, "_salt").orderBy(*order)
        children = (
            children.withColumn("_salt", part)
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= k)
            .drop("rn", "_salt")
        )
    w = Window.partitionBy(key).orderBy(*order)
    return children.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def select_children(
    children: DataFrame,
    key: str,
    tie: Sequence[str],
    min_pt: float,
    min_energy: float,
    k: int = MAX_PARTICLES,
    salts: int = 1,
) -> DataFrame:
    """Cuts, then the first ``k`` by descending pt; ``tie`` is the source order.

    Needs ``pt``, ``energy`` and raw columns only, so derived fields are best added
    afterwards: they are then neither sorted nor shuffled.
    """
    check_cuts(min_pt, min_energy)
    kept = children.filter((F.col("pt") >= min_pt) & (F.col("energy") >= min_energy))
    return top_children(kept, key, [F.col("pt").desc(), *[F.col(c).asc() for c in tie]], k, salts)


def nest_children(ranked: DataFrame, key: str) -> DataFrame:
    """Nest selected children, at most ``k`` per parent, into an ordered array.

    The array is built on the partitioning of the top-k window: one shuffle in all.
    """
    item = F.struct((F.col("rn") - 1).cast("int").alias("idx"), *CHILD_FIELDS)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("particles"))


def attach_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents keep an empty array when nothing survived the cuts."""
    item = children.schema["particles"].dataType
    return parents.join(children, key, "left").withColumn(
        "particles", F.coalesce(F.col("particles"), F.array().cast(item))
    )


def zip_parallel(jets: DataFrame) -> DataFrame:
    """Eleven parallel arrays to one array of structs."""
    sources = [source for source, _, _ in PARALLEL_ARRAYS]
    zipped = F.arrays_zip(*sources)
    return jets.withColumn(
        "particles",
        F.transform(
            zipped,
            lambda p, i: F.struct(
                i.alias("idx"),
                *[p[source].cast(kind).alias(name) for source, name, kind in PARALLEL_ARRAYS],
            ),
        ),
    ).drop(*sources)


def unequal_lengths(jets: DataFrame) -> Column:
    sources = [source for source, _, _ in PARALLEL_ARRAYS]
    bad = F.lit(False)
    for name in sources[1:]:
        bad = bad | ~F.size(name).eqNullSafe(F.size(sources[0]))
    return bad


def clean(min_pt: float, min_energy: float, k: int = MAX_PARTICLES) -> Column:
    """Cut, stable descending-pt order and truncation of an already nested array."""
    check_cuts(min_pt, min_energy)
    kept = F.filter("particles", lambda p: (p["pt"] >= min_pt) & (p["energy"] >= min_energy))
    keyed = F.transform(
        kept, lambda p: F.struct((-p["pt"]).alias("o"), p["idx"].alias("i"), p.alias("p"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["p"])


def clean_particles(
    jets: DataFrame, min_pt: float, min_energy: float, k: int = MAX_PARTICLES
) -> DataFrame:
    """Adds ``n_before``, the count after the cuts and before truncation."""
    n_before = F.size(
        F.filter("particles", lambda p: (p["pt"] >= min_pt) & (p["energy"] >= min_energy))
    )
    return jets.withColumn("n_before", n_before).withColumn("particles", clean(min_pt, min_energy, k))


def features(field: Callable[[str], Column]) -> list[Column]:
    """Relative and logarithmic features in double, stored as float.

    ``field`` gives a child's raw column, so the same rules serve flat rows and structs.
    """
    jet_eta, jet_phi = F.col("jet_eta").cast("double"), F.col("jet_phi").cast("double")
    has_track = field("has_track")
    return [
        (field("eta") - jet_eta).cast("float").alias("delta_eta"),
        phys.wrap_angle(field("phi") - jet_phi).cast("float").alias("delta_phi"),
        F.ln(field("pt")).cast("float").alias("log_pt"),
        F.ln(field("energy")).cast("float").alias("log_energy"),
        field("charge").cast("float").alias("charge"),
        *[
            F.when(has_track, field(name)).otherwise(F.lit(0.0)).cast("float").alias(f"{name}_raw")
            for name in TRACK_FIELDS
        ],
        phys.pid_category(field("pdg_id")).alias("pid_type"),
        phys.track_state(field("charge"), has_track).alias("track_state"),
    ]


def derive_features(jets: DataFrame) -> DataFrame:
    """Row-shaped form: one array of feature structs per jet."""
    return jets.withColumn(
        "particles", F.transform("particles", lambda p: F.struct(*features(lambda n: p[n])))
    )


def feature_rows(children: DataFrame, jets: DataFrame, key: str) -> DataFrame:
    """Long form: one row per selected child, all features compiled, no nested arrays.

    ``children`` are partitioned by ``key`` from their top-k window; only jets move.
    """
    return jets.join(children, key).select(
        *jets.columns, (F.col("rn") - 1).cast("int").alias("idx"), *features(F.col)
    )


def exploded(canonical: DataFrame) -> DataFrame:
    """Long form of stored canonical rows."""
    keep = [c for c in canonical.columns if c != "particles"]
    return canonical.select(*keep, F.posexplode("particles").alias("idx", "p")).select(
        *keep, "idx", "p.*"
    )


def canonicalize(
    jets: DataFrame, min_pt: float, min_energy: float, k: int = MAX_PARTICLES
) -> DataFrame:
    """Nested compact jets to canonical rows; one pass, no shuffle."""
    named = jets.withColumn("pfn_sha256", identity.file_hash(F.col("canonical_pfn"))).withColumn(
        "jet_id",
        identity.stable_id(
            F.col("record_id"),
            F.col("pfn_sha256"),
            F.col("run"),
            F.col("lumi"),
            F.col("event"),
            F.col("jet_index"),
        ),
    )
    return derive_features(clean_particles(named, min_pt, min_energy, k)).withColumnRenamed(
        "target", "label"
    )


def compact_rules(jets: DataFrame) -> DataFrame:
    """Row rules of compact jets; finiteness covers particles a cut would drop too."""
    bad_particle = F.exists(
        "particles",
        lambda p: _any(*[phys.not_finite(p[f].cast("double")) for f in NUMERIC_FIELDS]),
    )
    key = F.concat_ws(
        ":",
        *[
            as_text(F.col(c))
            for c in ("record_id", "canonical_pfn", "run", "lumi", "event", "jet_index")
        ],
    )
    return broken_rules(
        jets,
        key,
        {
            "DATA_NONFINITE": bad_particle,
            "DATA_SPLIT": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
            "DATA_LABEL": ~F.coalesce(F.col("target").isin(0, 1), F.lit(False)),
            **identity.coordinate_rules(),
        },
    )


def _any(*columns: Column) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out | column
    return out


def dataset_rules(jets: DataFrame) -> DataFrame:
    """All checks a conversion makes, as one violations table."""
    identity_columns = ["record_id", "canonical_pfn", "run", "lumi", "event", "jet_index"]
    return union_all(
        [
            compact_rules(jets),
            repeated_keys(jets, identity_columns, "DATA_DUPLICATE_IDENTITY"),
        ]
    )
