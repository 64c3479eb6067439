"""Explicit schemas and the closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Field order, vocabularies and limits that results depend on.
MAX_PARTICLES = 150
SPLITS = ("train", "validation", "test")
CONTINUOUS_FIELDS = (
    "delta_eta",
    "delta_phi",
    "log_pt",
    "log_energy",
    "charge",
    "dxy_raw",
    "dxy_error_raw",
    "dz_raw",
    "dz_error_raw",
)
TRACK_FIELDS = ("dxy", "dxy_error", "dz", "dz_error")
ROLES = ("signal", "qcd_candidate", "qcd_active", "qcd_excluded_after_e0")
FEATURE_VIEWS = {
    "A": ("delta_eta", "delta_phi", "log_pt", "log_energy"),
    "B": ("delta_eta", "delta_phi", "log_pt", "log_energy", "charge"),
    "C": ("delta_eta", "delta_phi", "log_pt", "log_energy", "pid_type", "charge"),
    "D": (
        "delta_eta",
        "delta_phi",
        "log_pt",
        "log_energy",
        "pid_type",
        "charge",
        "dxy_raw",
        "dxy_error_raw",
        "dz_raw",
        "dz_error_raw",
    ),
}
FORBIDDEN_MODEL_FIELDS = (
    "record_id",
    "canonical_pfn",
    "pfn_sha256",
    "run",
    "lumi",
    "event",
    "jet_index",
    "jet_pt",
    "jet_eta",
    "jet_phi",
    "pv_z",
    "n_vertices",
    "generator_bin",
    "process",
    "truth",
    "truth_label",
    "audit_weight",
)
REQUIRED_CONTRASTS = ("A-B", "B-C", "C-D", "C-A", "D-A")

PARTICLE = T.StructType(
    [T.StructField("idx", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("pt", "eta", "phi", "energy", "charge")]
    + [T.StructField("pdg_id", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in TRACK_FIELDS]
    + [T.StructField("has_track", T.BooleanType())]
)

IDENTITY_FIELDS = [
    T.StructField("record_id", T.LongType()),
    T.StructField("canonical_pfn", T.StringType()),
    T.StructField("run", T.LongType()),
    T.StructField("lumi", T.LongType()),
    T.StructField("event", T.LongType()),
    T.StructField("jet_index", T.IntegerType()),
]

JET_FIELDS = IDENTITY_FIELDS + [
    T.StructField("split", T.StringType()),
    T.StructField("target", T.ByteType()),
    T.StructField("jet_pt", T.FloatType()),
    T.StructField("jet_eta", T.FloatType()),
    T.StructField("jet_phi", T.FloatType()),
    T.StructField("pv_z", T.FloatType()),
    T.StructField("n_vertices", T.IntegerType()),
]

JETS = T.StructType(JET_FIELDS + [T.StructField("particles", T.ArrayType(PARTICLE))])

# The same jets with eleven parallel arrays, as extractors emit them.
PARALLEL_ARRAYS = (
    ("particle_pt", "pt", T.DoubleType()),
    ("particle_eta", "eta", T.DoubleType()),
    ("particle_phi", "phi", T.DoubleType()),
    ("particle_energy", "energy", T.DoubleType()),
    ("particle_charge", "charge", T.DoubleType()),
    ("particle_pdg_id", "pdg_id", T.IntegerType()),
    ("particle_dxy", "dxy", T.DoubleType()),
    ("particle_dxy_error", "dxy_error", T.DoubleType()),
    ("particle_dz", "dz", T.DoubleType()),
    ("particle_dz_error", "dz_error", T.DoubleType()),
    ("particle_has_track_details", "has_track", T.BooleanType()),
)
PARALLEL_JETS = T.StructType(
    JET_FIELDS + [T.StructField(name, T.ArrayType(kind)) for name, _, kind in PARALLEL_ARRAYS]
)

INVENTORY = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "canonical_dataset",
            T.StructType(
                [
                    T.StructField("path", T.StringType()),
                    T.StructField("sha256", T.StringType()),
                    T.StructField("byte_size", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "jets",
            T.ArrayType(T.StructType(IDENTITY_FIELDS + [T.StructField("target", T.IntegerType())])),
        ),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("jet_id", T.StringType()),
        T.StructField("target", T.ByteType()),
        T.StructField("score", T.DoubleType()),
    ]
)
