"""Contracts of JSON records, checked for whole tables of records.

A contract lists, per kind, the allowed keys of every object and the typed fields.  A record is
parsed once, to a VARIANT.  The contract becomes one expression per described value, which reads that value in
place by its path and gives the names of the rules it breaks; items of arrays are gone through where they lie.  Parts
that a contract leaves free are not opened, so they may nest to any depth.  Nothing is shuffled, and no value
of a record is copied into a row of its own.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.functions import identity
from jetframe.functions.text import redact
from jetframe.rules import broken_rules, repeated_keys

SUPPORTED_MAJOR = "1"

# Record kinds and the field that identifies each.
KINDS = {
    "run": "run_id",
    "split": "manifest_id",
    "prediction": "prediction_id",
    "e0_audit": "e0_audit_id",
    "e05_audit": "e05_audit_id",
}
# Vocabularies.
FAMILIES = ("pretrained_omnilearned", "random_initialized_omnilearned", "deep_sets_pfn")
DATASET_NAME = "CMS 2015 RunIIFall15MiniAODv2"
FAILURE_CODE = "^[A-Z][A-Z0-9_]{2,63}$"
COMMIT = "^[0-9a-f]{40}$"
FAILED = ("failed", "timed_out", "interrupted")


@dataclass(frozen=True)
class Text:
    """Text field: optionally a pattern, an exact value or a vocabulary."""

    pattern: str | None = None
    allowed: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class Number:
    low: float | None = None
    above: float | None = None
    high: float | None = None
    whole: bool = False
    required: bool = True


@dataclass(frozen=True)
class Integer:
    """Whole number written as one: neither 1.0 nor true nor "1"."""

    low: float | None = None
    high: float | None = None
    required: bool = True


@dataclass(frozen=True)
class Flag:
    required: bool = True
    must_be: bool | None = None


@dataclass(frozen=True)
class Names:
    """Array of texts."""

    required: bool = True
    unique: bool = True


@dataclass(frozen=True)
class Constants:
    """Array that holds exactly these whole numbers, in this order."""

    values: tuple[int, ...]
    required: bool = True


@dataclass(frozen=True)
class Items:
    """Array of at least ``least`` objects with a closed key set."""

    fields: dict
    least: int = 0
    required: bool = True


@dataclass(frozen=True)
class Each:
    """Array of at least ``least`` values that all keep to one scalar rule; ``unique``: none twice."""

    value: Text | Integer | Number
    least: int = 1
    unique: bool = False
    required: bool = True


@dataclass(frozen=True)
class Keyed:
    """Object whose keys are positive whole numbers and whose values are all alike."""

    value: Number
    required: bool = True


@dataclass(frozen=True)
class Free:
    """Object or array whose inside is not described here."""

    kind: str = "OBJECT"
    required: bool = True


@dataclass(frozen=True)
class Object:
    """Nested object with a closed key set."""

    fields: dict = field(default_factory=dict)
    required: bool = True


SHA = Text(identity.SHA256_FORMAT)
SLUG = Text(identity.SLUG_FORMAT)
STAMP = Text(identity.UTC_FORMAT)
ANY = Text(".")
ARTIFACT = {"path": ANY, "sha256": SHA, "byte_size": Number(0, whole=True, required=False)}
UNIT = Number(0, high=1)

# Fields of every record kind.
CONTRACTS: dict[str, dict] = {
    "run": {
        "schema_version": Text(allowed=("1.0.0",)),
        "run_id": SLUG,
        "study_id": SLUG,
        "stage": Text(allowed=("E0.5", "E1", "E2", "E3")),
        "status": Text(allowed=("succeeded", *FAILED)),
        "created_at": STAMP,
        "started_at": STAMP,
        "ended_at": STAMP,
        "git": Object({"repository": ANY, "commit": Text(COMMIT), "dirty": Flag()}),
        "data": Object(
            {
                "dataset_name": Text(allowed=(DATASET_NAME,)),
                "source_manifest_sha256": SHA,
                "canonical_dataset": Object(ARTIFACT),
                "split_manifest": Object(ARTIFACT),
                "preprocessing": Object(ARTIFACT),
                "view": Object(ARTIFACT),
                "qcd_mixture_sha256": Text(identity.SHA256_FORMAT, required=False),
            }
        ),
        "condition": Object(
            {
                "feature_config": Text(allowed=("A", "B", "C", "D")),
                "train_size_per_class": Number(1, whole=True),
                "subset_id": ANY,
                "subset_seed": Number(0, high=4294967295, whole=True),
                "model_seed": Number(0, high=4294967295, whole=True),
            }
        ),
        "model": Object(
            {
                "family": Text(allowed=FAMILIES),
                "repository": ANY,
                "revision": ANY,
                "adapter_policy": Text(
                    allowed=("configuration_specific", "approved_neutralization", "native_baseline")
                ),
                "output_head": Text(allowed=("binary_top_qcd",)),
                "checkpoint": Object(
                    {
                        "source": ANY,
                        "immutable_revision": ANY,
                        "filename": ANY,
                        "sha256": SHA,
                        "license": ANY,
                        "pretraining_corpus": ANY,
                    },
                    required=False,
                ),
                "omnilearned_index": Object(ARTIFACT, required=False),
                "loaded_tensors": Names(unique=False),
                "skipped_tensors": Names(unique=False),
                "mismatched_tensors": Names(unique=False),
            }
        ),
        "hyperparameters": Object(
            {
                "optimizer": ANY,
                "learning_rate": Number(above=0),
                "batch_size": Number(1, whole=True),
                "max_epochs": Number(1, whole=True),
                "weight_decay": Number(0),
                "early_stopping": Object(
                    {
                        "monitor": ANY,
                        "mode": Text(allowed=("min", "max")),
                        "patience": Number(0, whole=True),
                        "min_delta": Number(0),
                    }
                ),
                "extra": Free(),
            }
        ),
        "environment": Object(
            {
                "python_version": ANY,
                "dependency_lock_sha256": SHA,
                "operating_system": ANY,
                "device": Object(
                    {
                        "type": Text(allowed=("cpu", "cuda", "mps", "other")),
                        "name": ANY,
                        "driver": Text(".", required=False),
                    }
                ),
                "deterministic_algorithms": Flag(),
                "known_nondeterminism": Names(required=False),
            }
        ),
        "timing": Object(
            {"wall_seconds": Number(0), "peak_gpu_memory_mib": Number(0, required=False)}
        ),
        "metrics": Object(
            {
                "best_epoch": Number(0, whole=True),
                "validation_auc": UNIT,
                "test_auc": UNIT,
                "test_accuracy": UNIT,
                "epsilon_b_at_epsilon_s_0_30": UNIT,
                "epsilon_b_at_epsilon_s_0_50": UNIT,
                "background_rejection_at_epsilon_s_0_30": Number(above=0, required=False),
                "background_rejection_at_epsilon_s_0_50": Number(above=0, required=False),
                "validation_threshold": Number(required=False),
                "zero_background_pass_count_0_30": Number(0, whole=True, required=False),
                "zero_background_pass_count_0_50": Number(0, whole=True, required=False),
                "test_background_count": Number(1, whole=True, required=False),
            },
            required=False,
        ),
        "artifacts": Object(
            {
                "run_directory": ANY,
                "resolved_config": Object(ARTIFACT),
                "stdout_log": Object(ARTIFACT),
                "stderr_log": Object(ARTIFACT),
                "model_checkpoint": Object(ARTIFACT, required=False),
                "prediction_metadata": Object(ARTIFACT, required=False),
            }
        ),
        "failure": Object(
            {
                "code": Text(FAILURE_CODE),
                "phase": ANY,
                "message": ANY,
                "traceback_path": Text(".", required=False),
            },
            required=False,
        ),
    },
    "prediction": {
        "schema_version": Text(allowed=("1.0.0",)),
        "prediction_id": SLUG,
        "run_id": SLUG,
        "created_at": STAMP,
        "partition": Text(allowed=("test",)),
        "feature_config": Text(allowed=("A", "B", "C", "D")),
        "model_condition": Text(allowed=FAMILIES),
        "split_manifest_sha256": SHA,
        "view_sha256": SHA,
        "ordered": Flag(must_be=True),
        "row_count": Number(2, whole=True),
        "class_counts": Object({"qcd": Number(1, whole=True), "top": Number(1, whole=True)}),
        "row_order_sha256": SHA,
        "logical_columns": Free(),
        "payload": Free(),
        "content_hash": Object(
            {
                "algorithm": Text(allowed=("sha256",)),
                "canonicalization": Text(
                    allowed=(
                        "utf8-sorted-keys-compact-json-lf-excluding-content_hash.metadata_sha256",
                    )
                ),
                "metadata_sha256": SHA,
            }
        ),
    },
    "split": {
        "schema_version": Text(allowed=("1.0.0",)),
        "manifest_id": SLUG,
        "study_id": SLUG,
        "created_at": STAMP,
        "dataset": Free(),
        "split_rule": Free(),
        "source_files": Free("ARRAY"),
        "partitions": Free(),
        "training_subsets": Free("ARRAY"),
        "preprocessing": Free(),
        "semantic_checks": Object(
            {
                name: Flag(must_be=True)
                for name in (
                    "unique_pfns",
                    "pfn_disjoint",
                    "event_disjoint",
                    "subset_identities_unique",
                    "subsets_nested",
                    "class_counts_sufficient",
                )
            }
        ),
        "hash_metadata": Object(
            {
                "algorithm": Text(allowed=("sha256",)),
                "canonicalization": Text(
                    allowed=(
                        "utf8-sorted-keys-compact-json-lf-excluding-hash_metadata.content_sha256",
                    )
                ),
                "content_sha256": SHA,
            }
        ),
    },
    "e0_audit": {
        "schema_version": Text(allowed=("1.0.0",)),
        "e0_audit_id": ANY,
        "evidence_id": ANY,
        "status": Text(allowed=("passed", "failed", "blocked_external_evidence")),
        "formal_gate_eligible": Flag(),
        "missing_evidence": Names(),
        "failed_gates": Names(),
        "policy_sha256": SHA,
        "resource_projection": Free(required=False),
        "observed": Free(),
        "content_sha256": SHA,
    },
    "e05_audit": {
        "schema_version": Text(allowed=("1.0.0",)),
        "e05_audit_id": ANY,
        "status": Text(
            allowed=("passed", "failed", "blocked_external_evidence", "fallback_approved")
        ),
        "formal_gate_eligible": Flag(),
        "evidence_origin": ANY,
        "dependency_revision": Text(COMMIT),
        "missing_evidence": Names(),
        "failed_checks": Names(),
        "model_condition": Text(allowed=FAMILIES[:2]),
        "policy_sha256": SHA,
        "content_sha256": SHA,
    },
}


ROLE = Text(allowed=("signal", "qcd_candidate", "qcd_active", "qcd_excluded_after_e0"))
CLASS_COUNTS = Object({"qcd": Number(0, whole=True), "top": Number(0, whole=True)})
PARTITION = Object(
    {
        "file_count": Number(0, whole=True),
        "event_count": Number(0, whole=True),
        "jet_counts_by_class": CLASS_COUNTS,
        "record_jet_counts": Keyed(Number(0, whole=True)),
    }
)
PID_NAMES = ("unknown", "charged_hadron", "neutral_hadron", "photon", "electron", "muon")


def _is(value: str) -> Text:
    return Text(allowed=(value,))


# The insides of parts whose type alone :data:`CONTRACTS` states.
DESCRIBED: dict[str, dict] = {
    "prediction": {
        "logical_columns": Object(
            {
                **{
                    name: Free()
                    for name in (
                        "jet_id", "record_id", "run", "lumi", "event", "jet_index", "target", "signal_score",
                    )
                },
                "hard_prediction": Free(required=False),
            }
        ),
        "payload": Object(
            {
                "format": Text(allowed=("npz", "parquet", "hdf5")),
                "path": ANY,
                "sha256": SHA,
                "byte_size": Number(1, whole=True),
                "compression": Text(".", required=False),
            }
        ),
    },
    "split": {
        "dataset": Object(
            {
                "name": _is(DATASET_NAME),
                "campaign": _is("RunIIFall15MiniAODv2"),
                "source_manifest": Object(ARTIFACT),
                "canonical_dataset": Object(ARTIFACT),
                "source_records": Items({"record_id": Number(1, whole=True), "role": ROLE}, 2),
            }
        ),
        "split_rule": Object(
            {
                "version": _is("exact-pfn-sha256-mod10-v1"),
                "identifier": _is("exact_pfn_sha256_mod10"),
                "input": _is("exact canonical_pfn field from the sorted source manifest"),
                "encoding": _is("UTF-8"),
                "digest": _is("SHA-256"),
                "integer_byte_order": _is("big"),
                "modulus": Number(10, high=10),
                "buckets": Object(
                    {
                        "test": Constants((0,)),
                        "validation": Constants((1,)),
                        "train": Constants((2, 3, 4, 5, 6, 7, 8, 9)),
                    }
                ),
            }
        ),
        "source_files": Items(
            {
                "record_id": Number(1, whole=True),
                "role": ROLE,
                "canonical_pfn": ANY,
                "pfn_sha256": SHA,
                "adler32": Text("^[0-9a-fA-F]{8}$"),
                "size_bytes": Number(1, whole=True),
                "bucket": Number(0, high=9, whole=True),
                "split": Text(allowed=("train", "validation", "test")),
            },
            1,
        ),
        "partitions": Object({"train": PARTITION, "validation": PARTITION, "test": PARTITION}),
        "training_subsets": Items(
            {
                "subset_id": SLUG,
                "train_size_per_class": Number(1, whole=True),
                "subset_seed": Number(0, high=4294967295, whole=True),
                "selection_rule": _is("sha256-ranked-signal-and-record-round-robin-qcd-v1"),
                "identity_payload": Object(ARTIFACT),
                "counts_by_class": CLASS_COUNTS,
            },
            1,
        ),
        "preprocessing": Object(
            {
                "feature_version": ANY,
                "policy": Object(ARTIFACT),
                "fitted_partition": _is("train"),
                "pid_vocabulary": Object({name: Number(n, high=n) for n, name in enumerate(PID_NAMES)}),
                "impact_parameter_policy": Text(allowed=("checkpoint_native", "training_fitted")),
                "pt_eta_control_sha256": Text(identity.SHA256_FORMAT, required=False),
                "pileup_reweighting_sha256": Text(identity.SHA256_FORMAT, required=False),
            }
        ),
    },
    "e0_audit": {
        "resource_projection": Object(
            {
                "source_bytes_per_wall_second": Number(0),
                "events_per_wall_second": Number(0),
                "cpu_seconds_per_event": Number(0),
                "file_failure_fraction": UNIT,
                "retained_storage_bytes": Number(0, whole=True),
                "projected_cost_usd_with_reserve": Object({e: Number(0) for e in ("E0", "E1", "E2")}),
                "projected_total_cost_usd_with_reserve": Number(0),
            },
            required=False,
        ),
    },
}


def kind_of(keys: Column) -> Column:
    """The one kind whose identifying field is among ``keys``; null if none or several are."""
    found = F.array_intersect(keys, F.array(*[F.lit(f) for f in KINDS.values()]))
    kind = F.lit(None).cast("string")
    for name, key in KINDS.items():
        kind = F.when(found[0] == key, F.lit(name)).otherwise(kind)
    return F.when(F.size(found) == 1, kind)


def detected_kinds(records: DataFrame, json: str = "json", key: str = "key") -> DataFrame:
    """``(key, kind, rule)``; the rule names records that fit no kind or more than one.

    A prediction record also names its run, so it fits two kinds and must be validated
    with its kind given.
    """
    kind = kind_of(F.json_object_keys(json))
    return records.select(F.col(key), kind.alias("kind")).withColumn(
        "rule", F.when(F.col("kind").isNull(), F.lit("CONTRACT_KIND"))
    )


KEY_NUMBER = "^[1-9][0-9]*$"
# Between the rules that one value breaks; no field of a contract has it in its name.
AND = "\n"
# How VARIANT names the types of numbers. 1.0 is held as DECIMAL(1,0); whole numbers are decimals
# only where they pass 64 bits.
NUMBER_SHAPE = r"^(?:BIGINT|DOUBLE|DECIMAL.*)$"
INTEGER_SHAPE = r"^(?:BIGINT|DECIMAL\((?:19|[23]\d),0\))$"


def all_true(conditions: list[Column]) -> Column:
    good = F.lit(True)
    for condition in conditions:
        good = good & condition
    return F.coalesce(good, F.lit(False))


def bounds(number: Column, spec: Number | Integer) -> list[Column]:
    return [
        *([number >= float(spec.low)] if spec.low is not None else []),
        *([number > float(spec.above)] if getattr(spec, "above", None) is not None else []),
        *([number <= float(spec.high)] if spec.high is not None else []),
        *([number == F.floor(number)] if getattr(spec, "whole", False) else []),
    ]


def is_typed(spec, get) -> Column:
    """Whether a value has its contract's type."""
    shape = F.schema_of_variant(get("variant"))
    if isinstance(spec, Text):
        return shape == "STRING"
    if isinstance(spec, Number):
        return shape.rlike(NUMBER_SHAPE)
    if isinstance(spec, Integer):
        return shape.rlike(INTEGER_SHAPE)
    if isinstance(spec, Flag):
        return shape == "BOOLEAN"
    if isinstance(spec, Names):
        return shape.isin("ARRAY<STRING>", "ARRAY<VOID>")
    if isinstance(spec, Constants | Items | Each) or getattr(spec, "kind", "") == "ARRAY":
        return get("array<variant>").isNotNull()
    return get("map<string,variant>").isNotNull()


def is_good(spec, get) -> Column:
    """Whether a value of its contract's type is a good one."""
    good: list[Column] = []
    if isinstance(spec, Text):
        good += [get("string").rlike(spec.pattern)] if spec.pattern else []
        good += [get("string").isin(*spec.allowed)] if spec.allowed else []
    elif isinstance(spec, Number | Integer):
        good += bounds(get("double"), spec)
    elif isinstance(spec, Flag):
        good += [get("boolean") == spec.must_be] if spec.must_be is not None else []
    elif isinstance(spec, Constants):
        constants = F.array(*[F.lit(n) for n in spec.values]).cast("array<bigint>")
        good.append(get("array<bigint>") == constants)
    elif isinstance(spec, Items | Each):
        good += [F.size(get("array<variant>")) >= spec.least] if spec.least else []
    if getattr(spec, "unique", False):
        names = get("array<string>")
        good.append(F.size(F.array_distinct(names)) == F.size(names))
    return all_true(good)


def broken_by_value(
    spec, record: Column, at: str = "$", path: str = "", parent: Column | None = None
) -> list[Column]:
    """Rules broken by the value at a path of a VARIANT, and by what lies in it: texts or arrays of texts with the
    rules' names by lines, null or empty where none is.

    ``at`` is the place within ``record``, ``path`` that in the contract: ``[]`` stands for every item of an array,
    ``*`` for every key of a keyed object.  ``parent`` is the object that must have the value, if it must.
    """

    @cache
    def get(kind: str) -> Column:
        return F.try_variant_get(record, at, kind)

    own, types = f"CONTRACT_SCHEMA:{path}", "CONTRACT_TYPES"
    wrong = types if isinstance(spec, Free) or not path else f"{types}{AND}{own}"
    unknown = f"CONTRACT_UNKNOWN_PROPERTY{':' if path else ''}{path}{AND}{types}"
    null = get("variant").isNull() | F.is_variant_null(get("variant"))
    absent = None if parent is None else F.when(parent.isNotNull(), F.lit(own))

    def unless(cases: Column) -> Column:
        """The cases of a value of its type; else it is absent or of another type."""
        return cases.when(null, absent).otherwise(F.lit(wrong))

    if isinstance(spec, Object):
        whole = get("map<string,variant>")
        names = F.array(*[F.lit(name) for name in spec.fields]).cast("array<string>")
        others = F.array_size(F.array_except(F.map_keys(whole), names))
        found = [unless(F.when(others == 0, None).when(others > 0, F.lit(unknown)))]
        for name, inner in spec.fields.items():
            inside = f"{path}.{name}" if path else name
            part = broken_by_value(inner, record, f"{at}['{name}']", inside, whole if inner.required else None)
            found += unless_good(inner, F.try_variant_get(record, f"{at}['{name}']", "variant"), part)
        return found
    found = [unless(F.when(is_typed(spec, get), F.when(~is_good(spec, get), F.lit(own))))]
    if isinstance(spec, Items | Each):
        item = Object(spec.fields) if isinstance(spec, Items) else spec.value
        found.append(
            F.transform(
                get("array<variant>"), lambda x: lines(unless_good(item, x, broken_by_value(item, x, path=f"{path}[]")))
            )
        )
    elif isinstance(spec, Keyed):
        found.append(
            F.transform(
                F.map_entries(get("map<string,variant>")),
                lambda e: F.when(
                    e["key"].rlike(KEY_NUMBER),
                    F.concat_ws(AND, *broken_by_value(spec.value, e["value"], path=f"{path}.*")),
                ).otherwise(F.lit(unknown)),
            )
        )
    return found


def lines(names: list[Column]) -> Column:
    return F.concat_ws(AND, *names)


def holds_integers(spec) -> bool:
    inner = spec.fields.values() if isinstance(spec, Object | Items) else [getattr(spec, "value", None)]
    return isinstance(spec, Integer) or any(holds_integers(x) for x in inner if x is not None)


def unless_good(spec, value: Column, found: list[Column]) -> list[Column]:
    """What is found in a part of a record; a part whose text shows that it is good is not gone through."""
    if not isinstance(spec, Object | Items) or not is_told(spec) or holds_integers(spec):
        return found
    # VARIANT writes keys in order, and 1.0 as 1.
    return [F.when(matched(spec, F.to_json(value), order=sorted) == "", lines(found))]


# The shape of a free part: brackets within each other to a fixed depth, no quoted names.
_INSIDE = "[^<>`]*+"
for _ in range(4):
    _INSIDE = f"(?:[^<>`]++|<{_INSIDE}>)*+"


def shape_pattern(spec) -> str:
    """Matches the types that VARIANT names for values of the contract's types, all fields known; null fits anywhere.

    What it does not match may still be right (quoted names, deep free parts, unlike items).
    """
    if isinstance(spec, Text):
        shape = "STRING"
    elif isinstance(spec, Number):
        shape = r"(?:BIGINT|DOUBLE|DECIMAL\([0-9,]+\))"
    elif isinstance(spec, Integer):
        shape = "BIGINT"
    elif isinstance(spec, Flag):
        shape = "BOOLEAN"
    elif isinstance(spec, Names):
        shape = "ARRAY<(?:STRING|VOID)>"
    elif isinstance(spec, Constants):
        shape = "ARRAY<(?:BIGINT|VOID)>"
    elif isinstance(spec, Each):
        plain = isinstance(spec.value, Text) or not spec.unique
        shape = f"ARRAY<{shape_pattern(spec.value)}>" if plain else "(?!)"
    elif isinstance(spec, Items):
        shape = f"ARRAY<{shape_pattern(Object(spec.fields))}>"
    elif isinstance(spec, Keyed):
        shape = f"OBJECT<(?:`[1-9][0-9]*`: {shape_pattern(spec.value)}(?:, (?!>)|(?=>)))*+>"
    elif isinstance(spec, Free):
        shape = f"{spec.kind}<{_INSIDE}>"
    else:
        # Names stand in order; each is followed by the next or by the end.
        fields = "".join(f"(?:{n}: {shape_pattern(spec.fields[n])}(?:, (?!>)|(?=>)))?+" for n in sorted(spec.fields))
        shape = f"OBJECT<{fields}>"
    return f"(?:{shape}|VOID)"


def plain_type(spec) -> str:
    """The SQL type in which values of the contract's type are read at once; of free parts only the text."""
    if isinstance(spec, Number | Integer):
        return "double"
    if isinstance(spec, Flag):
        return "boolean"
    if isinstance(spec, Names):
        return "array<string>"
    if isinstance(spec, Constants):
        return "array<bigint>"
    if isinstance(spec, Each):
        return f"array<{plain_type(spec.value)}>"
    if isinstance(spec, Items):
        return f"array<{plain_type(Object(spec.fields))}>"
    if isinstance(spec, Keyed):
        return f"map<string,{plain_type(spec.value)}>"
    if isinstance(spec, Object):
        return f"struct<{','.join(f'`{n}`:{plain_type(inner)}' for n, inner in spec.fields.items())}>"
    return "string"


def broken_by_plain(spec, value: Column, path: str = "", parent: Column | None = None) -> list[Column]:
    """What :func:`broken_by_value` gives, for a value known to fit :func:`shape_pattern`, read as :func:`plain_type`."""
    own = F.lit(f"CONTRACT_SCHEMA:{path}")
    absent = [] if parent is None else [F.when(parent.isNotNull() & value.isNull(), own)]
    if isinstance(spec, Object):
        found = absent
        for name, inner in spec.fields.items():
            inside = f"{path}.{name}" if path else name
            found += broken_by_plain(inner, value[name], inside, value if inner.required else None)
        return found
    found = [*absent, F.when(value.isNotNull() & ~is_good(spec, lambda _: value), own)]
    if isinstance(spec, Items | Each):
        item = Object(spec.fields) if isinstance(spec, Items) else spec.value
        found.append(F.transform(value, lambda x: F.concat_ws(AND, *broken_by_plain(item, x, f"{path}[]"))))
    elif isinstance(spec, Keyed):
        found.append(
            F.transform(
                F.map_values(value), lambda x: F.concat_ws(AND, *broken_by_plain(spec.value, x, f"{path}.*"))
            )
        )
    return found


# Characters listed one by one are looked up in a table, ranges are compared.
_LISTED = {
    "0-9": string.digits, "a-f": "abcdef", "A-F": "ABCDEF", "a-z": string.ascii_lowercase, "A-Z": string.ascii_uppercase,
}
# One character of a JSON text that stands for itself, and one that "." matches too.
_QUOTED = '"' + r"\\" + "".join(rf"\x{n:02x}" for n in range(32))
_CHAR = rf"[^{_QUOTED}�]"
_DOT = rf"[^{_QUOTED}�\x85  ]"
# Patterns of fields that match the same between the quotes of a JSON text: classes and counts of plain characters.
_CLASS = r"\[(?:a-z|A-Z|0-9|a-f|A-F|[A-Za-z0-9._])+-?\]"
_PLAIN_PATTERN = re.compile(rf"\^((?:{_CLASS}|[A-Za-z0-9_]|\{{\d+(?:,\d+)?\}})+)\$")
# Matches nothing: a value that no pattern tells to be good.
NEVER = "(?!)"
# Longer texts go to the parser, and so do objects of more keys of their own than these.
MATCHED_BYTES = 1 << 20
MATCHED_KEYS = 16


def good_text(spec: Text) -> str:
    if spec.allowed:
        plain = [re.escape(a) for a in spec.allowed if re.fullmatch(r"[\x20-\x7e]+", a) and not set(a) & set('"\\')]
        if not plain or spec.pattern is not None:
            return NEVER
        return f'"(?:{"|".join(plain)})"' if len(plain) > 1 else f'"{plain[0]}"'
    if spec.pattern is None:
        return f'"{_CHAR}*+"'
    if spec.pattern == ".":
        return f'"{_DOT}{_CHAR}*+"'
    if spec.pattern == identity.UTC_FORMAT:
        return f'"{_CHAR}*+(?<=Z)"'
    plain = _PLAIN_PATTERN.fullmatch(spec.pattern)
    if not plain:
        return NEVER
    return '"' + re.sub("|".join(_LISTED), lambda m: _LISTED[m[0]], plain[1]) + '"'


def good_number(spec: Number | Integer) -> str:
    """Plain decimal digits only; what else a contract allows (1.0 for 1, exponents) is left to the parser."""
    low, above, high = spec.low, getattr(spec, "above", None), spec.high
    part = "" if isinstance(spec, Integer) or spec.whole else r"(?:\.[0-9]{1,15}+)?+"
    whole, positive = "(?:0|[1-9][0-9]{0,14}+)", "[1-9][0-9]{0,14}+"
    if above is not None:
        if (low, above, high) != (None, 0, None):
            return NEVER
        return rf"(?:{positive}{part}|0\.0{{0,9}}+[1-9][0-9]{{0,9}}+)" if part else positive
    if high is None:
        return {None: f"-?+{whole}{part}", 0: whole + part, 1: positive + part}.get(low, NEVER)
    if low == high and low in range(100):
        return str(int(low))
    if (low, high) == (0, 1):
        return f"(?:0{part}|1)"
    if low not in (0, 1) or high < 9:
        return NEVER
    digits = f"{{0,{len(str(int(high) + 1)) - 2}}}+"
    return f"(?:0|[1-9][0-9]{digits})" if low == 0 else f"[1-9][0-9]{digits}"


def array_text(item: str, least: int = 0, unique: bool = False) -> str:
    """Of values that must differ, none or one."""
    more = f"(?:,{item}){{{max(least - 1, 0)},}}+" if not unique else "" if least < 2 else NEVER
    return rf"\[{item}{more}\]" if least else rf"\[(?:{item}{more})?+\]"


def json_text(
    spec, rules: bool = True, order: Callable = list, groups: Iterator[int] | None = None, keep: str | None = None
) -> str:
    """Pattern of JSON texts, compact and without escapes, of values that break no rule of the contract; without
    ``rules``, of those that have its types and no unknown keys, so that :func:`broken_by_plain` can tell the rest.

    What matches is JSON and names no key twice; keys stand as ``order`` gives them.  What does not match may be
    good all the same.  The value of the key ``keep`` is the group ``kept``.
    """
    groups = groups or count()
    if isinstance(spec, Text):
        return good_text(spec) if rules else f'"{_CHAR}*+"'
    if isinstance(spec, Number | Integer):
        return good_number(spec) if rules else good_number(type(spec)())
    if isinstance(spec, Flag):
        return "(?:true|false)" if spec.must_be is None or not rules else str(spec.must_be).lower()
    if isinstance(spec, Names):
        return array_text(f'"{_CHAR}*+"', unique=spec.unique and rules)
    if isinstance(spec, Constants):
        return rf"\[{','.join(map(str, spec.values))}\]" if rules else array_text(good_number(Integer()))
    if isinstance(spec, Each):
        if spec.unique and not isinstance(spec.value, Text):
            return NEVER
        item = json_text(spec.value, rules, order, groups)
        return array_text(item, spec.least, spec.unique) if rules else array_text(item)
    if isinstance(spec, Items):
        return array_text(json_text(Object(spec.fields), rules, order, groups), spec.least if rules else 0)
    if isinstance(spec, Free):
        return NEVER
    # Where no pair need be there, each is followed by the next or by the end.
    end = r"(?:,(?!\})|(?=\}))"
    if isinstance(spec, Keyed):
        key = f"k{next(groups)}"
        name = rf'"(?<{key}>[1-9][0-9]*+)"(?![^{{}}]*,"\k<{key}>")'
        return rf"\{{(?:{name}:{json_text(spec.value, rules)}{end}){{0,{MATCHED_KEYS}}}+\}}"
    names = order(spec.fields)
    needed = [rules and spec.fields[name].required for name in names]
    first = needed.index(True) if any(needed) else None
    pairs = ""
    for at, name in enumerate(names):
        value = json_text(spec.fields[name], rules, order, groups)
        value = f"(?<kept>{value})" if name == keep else value
        pair = f'"{re.escape(name)}":{value if needed[at] else f"(?:{value}|null)"}'
        # A group within an atomic one would stay set where what follows fails.
        may = "?" if name == keep else "?+"
        if first is None:
            pairs += f"(?:{pair}{end}){may}"
        elif at <= first:
            pairs += pair if at == first else f"(?:{pair},){may}"
        else:
            pairs += f",{pair}" if needed[at] else f"(?:,{pair}){may}"
    return rf"\{{{pairs}\}}" if keep else rf"(?>\{{{pairs}\}})"


def is_told(spec) -> bool:
    """Whether :func:`json_text` can match at all."""
    if isinstance(spec, Object | Items):
        return all(is_told(inner) for inner in spec.fields.values() if inner.required)
    if isinstance(spec, Each | Keyed):
        return is_told(spec.value) and NEVER not in json_text(spec)
    return NEVER not in json_text(spec)


def matched(spec, json: Column, rules: bool = True, order: Callable = list, keep: str | None = None) -> Column:
    """The text that :func:`json_text` matches, or that of its key ``keep``; empty where it does not match."""
    pattern = json_text(spec, rules, order, keep=keep)
    pattern = pattern if keep else f"(?<kept>{pattern})"
    group = 1 + pattern[: pattern.index("(?<kept>")].count("(?<k")
    # It matches at the start of every text, if without the group: a search would try each place of the text.
    text = F.regexp_extract(json, rf"\A(?:{pattern}\z)?", group)
    return F.when(F.octet_length(json) <= MATCHED_BYTES, text).otherwise("")


def with_matched(records: DataFrame, name: str, spec, unless: Column, rules: bool = True, keep: str | None = None) -> DataFrame:
    """``name``: what is :func:`matched` in ``json`` with keys as the contract lists them, or sorted; ``unless``: not tried."""
    json, found = F.col("json"), F.col(name)
    listed = records.withColumn(name, F.when(~unless, matched(spec, json, rules, list, keep)).otherwise(""))
    return listed.withColumn(
        name, F.when(unless | (found != ""), found).otherwise(matched(spec, json, rules, sorted, keep))
    )


# The digest field of a record, which its own digest leaves out.
SELF_HASH = {
    "prediction": "content_hash.metadata_sha256",
    "split": "hash_metadata.content_sha256",
    "e0_audit": "content_sha256",
    "e05_audit": "content_sha256",
}


def document_hash(record: Column, field_path: str) -> Column:
    """SHA-256 of a VARIANT record as compact JSON with sorted keys and a line feed.

    The digest field itself is left out.  Its name must occur once in the record, as in all contracts.
    """
    name = field_path.rsplit(".", 1)[-1]
    pair = f'"{name}":"[^"]*"'
    text = F.regexp_replace(F.to_json(record), f",{pair}|{pair},?", "")
    return F.sha2(F.concat(text, F.lit("\n")), 256)


def hash_violations(records: DataFrame, kind: str, json: str = "json", key: str = "key") -> DataFrame:
    """Records whose embedded digest is missing or is not that of the record."""
    path = SELF_HASH[kind]
    v = F.try_parse_json(json)
    parsed = records.select(F.col(key), v.alias("v"))
    held = F.try_variant_get(F.col("v"), f"$.{path}", "string")
    return broken_rules(
        parsed,
        F.col(key),
        {
            "CONTRACT_JSON": F.col("v").isNull(),
            "CONTRACT_HASH_FIELD": F.col("v").isNotNull() & held.isNull(),
            "CONTRACT_HASH_MISMATCH": held.isNotNull() & (held != document_hash(F.col("v"), path)),
        },
    )


class Record:
    """Typed values of a VARIANT record by dotted path; null where absent, null, or of no such type."""

    def __init__(self, record: Column):
        self.record = record

    def get(self, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.record, f"$.{path}", kind)

    def object(self, path: str) -> Column:
        return self.get(path, "map<string,variant>")

    def size(self, path: str) -> Column:
        return F.size(self.get(path, "array<variant>"))


def run_rules(v: Record) -> dict[str, Column]:
    """What a run's status and model family demand."""
    done = v.get("status") == "succeeded"
    family = v.get("model.family")
    return {
        "RUN_SUCCESS_WITHOUT_METRICS": done & v.object("metrics").isNull(),
        "RUN_SUCCESS_WITH_FAILURE": done & v.object("failure").isNotNull(),
        "RUN_SUCCESS_WITHOUT_PREDICTION": done & v.object("artifacts.prediction_metadata").isNull(),
        "RUN_FAILED_WITHOUT_FAILURE": v.get("status").isin(*FAILED) & v.object("failure").isNull(),
        "RUN_WITHOUT_INDEX": family.isin(*FAMILIES[:2]) & v.object("model.omnilearned_index").isNull(),
        "RUN_WITHOUT_CHECKPOINT": (family == FAMILIES[0]) & v.object("model.checkpoint").isNull(),
    }


def prediction_rules(v: Record) -> dict[str, Column]:
    qcd, top = v.get("class_counts.qcd", "double"), v.get("class_counts.top", "double")
    return {"CONTRACT_ROW_COUNT": qcd + top != v.get("row_count", "double")}


SOURCE_FILES = "array<struct<canonical_pfn:string,pfn_sha256:string,bucket:bigint,split:string>>"


def split_rules(files: Column, hashes: Column) -> dict[str, Column]:
    """Files of a split record: no name twice, and hash, bucket and split those of the ``hashes`` of their names."""
    names = files["canonical_pfn"]

    def misplaced(file: Column, bucket: Column) -> Column:
        return (file["bucket"] != bucket) | (file["split"] != identity.split_of_bucket(bucket))

    def any_of(others: Column, bad: Callable) -> Column:
        return F.exists(F.zip_with(files, others, bad), lambda x: x)

    return {
        "CONTRACT_PFN_DUPLICATE": F.size(F.array_distinct(names)) != F.size(names),
        "CONTRACT_HASH_MISMATCH": any_of(hashes, lambda file, digest: file["pfn_sha256"] != digest),
        "CONTRACT_SPLIT_MISMATCH": any_of(F.transform(hashes, identity.bucket10), misplaced),
    }


def gate_rules(v: Record, failed: str, passing: tuple[str, ...]) -> dict[str, Column]:
    """Eligibility follows status, and a verdict matches its lists."""
    status, missing = v.get("status"), v.size("missing_evidence")
    blockers = (missing > 0) | (v.size(failed) > 0)
    eligible = v.get("formal_gate_eligible", "boolean")
    rules = {
        "CONTRACT_GATE_STATUS:eligible": eligible != status.isin(*passing),
        "CONTRACT_GATE_STATUS:passed": (status == "passed") & blockers,
    }
    blocked = (status == "blocked_external_evidence") & (missing == 0)
    if failed == "failed_gates":
        rules["CONTRACT_GATE_STATUS:blocked"] = blocked
        return rules
    condition = v.get("model_condition")
    formal = v.get("evidence_origin") == "qualified_runpod"
    rules["CONTRACT_GATE_STATUS:origin"] = (status == "passed") & ~formal
    rules["CONTRACT_GATE_STATUS:condition"] = (status == "passed") & (condition != FAMILIES[0])
    rules["CONTRACT_GATE_STATUS:blocked"] = blocked & formal
    rules["CONTRACT_GATE_STATUS:fallback"] = (status == "fallback_approved") & (
        (condition != FAMILIES[1]) | (v.size("failed_checks") == 0)
    )
    return rules


def semantic_rules(kind: str, v: Record, described: bool) -> dict[str, Column]:
    if kind == "run":
        return run_rules(v)
    if kind == "prediction":
        return prediction_rules(v)
    if kind == "split":
        return split_rules(F.col("files"), F.col("hashes")) if described else {}
    if kind == "e0_audit":
        return gate_rules(v, "failed_gates", ("passed",))
    return gate_rules(v, "failed_checks", ("passed", "fallback_approved"))


def record_violations(
    records: DataFrame, kind: str, json: str = "json", key: str = "key", described: bool = False
) -> DataFrame:
    """All broken rules of a table of records of one kind, each once per record.

    ``described`` also checks the insides of the parts in :data:`DESCRIBED`; else their type alone.
    """
    fields = CONTRACTS[kind] | (DESCRIBED.get(kind, {}) if described else {})
    v = F.col("v")
    version = F.try_variant_get(v, "$.schema_version", "string")
    if is_told(Object(fields)):
        shaped = F.when(F.col("shaped"), F.get_json_object("json", "$.schema_version"))
        version = F.when(~F.col("good"), F.when(v.isNull(), shaped).otherwise(version))
    major = F.regexp_extract(version, r"^(\d+)\.\d+\.\d+$", 1)
    whole = {
        "CONTRACT_UNSUPPORTED_MAJOR": (major != "") & (major != SUPPORTED_MAJOR),
        **semantic_rules(kind, Record(v), described),
    }
    spec, text = Object(fields), F.col("json")
    parsed = records.select(F.col(key).alias("key"), F.col(json).alias("json"))
    if not is_told(spec):
        return variant_violations(parsed.withColumn("v", F.try_parse_json(text)), fields, whole)
    # Of a record whose text is matched, only the files are read for the rules on the whole; each name is hashed once.
    keep = "source_files" if kind == "split" and described else None
    told = with_matched(parsed, "good_text", spec, F.lit(False), keep=keep)
    told = with_matched(told, "shaped_text", spec, F.col("good_text") != "", rules=False, keep=keep)
    read = F.concat("good_text", "shaped_text")
    parsed = told.select(
        "key", "json", (F.col("good_text") != "").alias("good"), (F.col("shaped_text") != "").alias("shaped"),
        F.when((read == "") | F.lit(kind != "split"), F.try_parse_json(text)).alias("v"), read.alias("read"),
    )
    if keep:
        # A bucket of 1.5 is matched as a number; it is cut to 1, as VARIANT does.
        listed = F.from_json("read", SOURCE_FILES.replace("bigint", "decimal(38,15)")).cast(SOURCE_FILES)
        files = F.when(F.col("read") != "", listed).otherwise(Record(v).get(keep, SOURCE_FILES))
        parsed = parsed.withColumn("files", files).withColumn(
            "hashes", F.transform(F.col("files")["canonical_pfn"], identity.file_hash)
        )
    return variant_violations(parsed, fields, whole)


def variant_violations(
    records: DataFrame, fields: dict, whole: dict[str, Column] | None = None
) -> DataFrame:
    """Broken rules of VARIANT records ``(key, v)`` under a contract, each once per record.

    Where their text stands beside them as ``json``, records of the contract's shape are read at once with all
    types given, the others value by value.  Records known to be ``good`` are not read, and those known to be
    ``shaped`` need no VARIANT.
    ``whole`` has predicates, true for a bad record, on the record as a whole.  A null record is no JSON.
    """
    spec, v = Object(fields), F.col("v")
    kept, names, no_json = records, lines(broken_by_value(spec, v)), v.isNull()
    if "json" in records.columns:
        fits = F.schema_of_variant(v).rlike(f"^{shape_pattern(spec)}$") & ~F.is_variant_null(v)
        if "good" in records.columns:
            fits = ~F.col("good") & (F.col("shaped") | fits)
        kept = records.withColumn("fits", fits).withColumn(
            "plain", F.when(F.col("fits"), F.from_json("json", plain_type(spec)))
        )
        names = F.when(F.col("fits"), lines(broken_by_plain(spec, F.col("plain")))).otherwise(names)
    if "good" in records.columns:
        names, no_json = F.when(~F.col("good"), names), no_json & ~F.col("good") & ~F.col("shaped")
    broken = [F.when(no_json, F.lit("CONTRACT_JSON")), *[F.when(bad, F.lit(name)) for name, bad in (whole or {}).items()]]
    found = kept.select("key", F.concat_ws(AND, *broken, names).alias("names"))
    # explode would filter on the size of the array first, which works the rules out a second time.
    each = found.select("key", F.explode_outer(F.array_distinct(F.split("names", AND))).alias("rule"))
    return each.filter("rule <> ''").select(
        "rule", F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("key"), F.lit("").alias("detail")
    )


def run_collection(records: DataFrame, json: str = "json", key: str = "key") -> DataFrame:
    """A collection of final run records: the contract of each, and no run id twice.

    Repeated ids are counted on the map side first; an id that most records share is one small row
    per task.
    """
    ids = records.select(F.get_json_object(json, "$.run_id").alias("run_id"))
    repeated = repeated_keys(ids.filter("run_id IS NOT NULL"), ["run_id"], "REPORT_DUPLICATE_RUN")
    return record_violations(records, "run", json, key).unionByName(repeated)


def source_file_violations(files: DataFrame) -> DataFrame:
    """Split tables: hash, bucket and split are recomputed from the file name."""
    digest = identity.file_hash(F.col("canonical_pfn"))
    bucket = identity.bucket10(digest)
    return broken_rules(
        files,
        F.col("canonical_pfn"),
        {
            "CONTRACT_HASH_MISMATCH": F.col("pfn_sha256") != digest,
            "CONTRACT_SPLIT_MISMATCH": (F.col("bucket") != bucket)
            | (F.col("split") != identity.split_of_bucket(bucket)),
        },
    ).unionByName(repeated_keys(files, ["canonical_pfn"], "CONTRACT_PFN_DUPLICATE"))


def failure_records(
    records: DataFrame, status: Column, code: Column, phase: Column, message: Column, secrets=()
) -> DataFrame:
    """Failed variant of run rows: no metrics, no result artifacts, a redacted message.

    Rows whose new status is not a failure are left as they are.
    """
    failed = F.coalesce(status.isin(*FAILED), F.lit(False))
    kinds = {f.name: f.dataType for f in records.schema.fields}
    cleared = {
        c: F.when(~failed, F.col(c)).cast(kinds[c])
        for c in ("metrics", "model_checkpoint", "prediction_metadata")
        if c in kinds
    }
    return records.withColumns(
        {
            **cleared,
            "status": F.when(failed, status).otherwise(F.col("status")),
            "failure": F.when(
                failed,
                F.struct(code.alias("code"), phase.alias("phase"), redact(message, secrets).alias("message")),
            ),
        }
    )
