"""Faults that showed on larger tables: exact rules, bounded steps."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jetframe import plans
from jetframe.functions import particles
from jetframe.operators import bootstrap, contracts, digest, resample
from jetframe.plans import feature_queries, sql_views, tables
from jetframe.sources import files, manifest
from jetframe.sources import tables as table_source


def test_match_sql_wraps_angles_as_the_query_does(spark):
    """Distances of exactly a radius are told apart by the last bit of an angle (F2)."""
    jets, tops = range(-314, 315, 3), range(-344, 345, 2)
    rows = spark.range(629).select((F.col("id") - 314).alias("a")).crossJoin(
        spark.range(689).select((F.col("id") - 344).alias("b"))
    ).filter((F.col("a") + 314) % 3 == 0).filter((F.col("b") + 344) % 2 == 0)
    phi = (F.col("a") / F.lit(100.0)).cast("float").cast("double") - F.col("b") / F.lit(100.0)
    made = {(r.a, r.b): r.w for r in rows.select("a", "b", particles.wrap_angle(phi).alias("w")).collect()}
    told = duckdb.sql(
        f"""SELECT a, b, {sql_views.floored_wrap("(a / 100.0::DOUBLE)::FLOAT::DOUBLE - b / 100.0::DOUBLE")} AS w
        FROM range(-314, 315, 3) AS j(a), range(-344, 345, 2) AS t(b)"""
    ).fetchall()
    assert len(told) == len(made) == len(jets) * len(tops)
    assert all(made[a, b] == w for a, b, w in told)
    assert sql_views.floored_wrap("phi - t_phi") in plans.oracles()["deltar_match"]


@pytest.mark.parametrize("rep, target, n", [(0, 0, 7), (3, 1, 999), (17, 0, 1001), (999, 1, 10_000), (5, 0, 123_457)])
def test_draws_are_md5_of_their_text(rep, target, n):
    """All draws of a class at once, whatever digits their positions have (F1, F3, F4)."""
    told = [int(hashlib.md5(f"20260717|{rep}|{target}|{k}".encode()).hexdigest()[:12], 16) % n for k in range(n)]
    assert np.concatenate(list(resample.drawn(20260717, rep, target, n))).tolist() == told
    counts = resample.counts_of(20260717, rep, target, n, 0)
    assert counts.tolist() == np.bincount(told, minlength=n).tolist()
    assert resample.unpacked(*resample.packed(counts), n).tolist() == counts.tolist()


def test_bootstrap_over_many_ranges_and_windows(spark, monkeypatch):
    """Neither the ranges in which draws meet rows nor the windows in which they are counted change a result (F3)."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame(
        [(f"j{i}", i % 3 // 2, float(rng.integers(0, 40) + 5 * (i % 3 // 2)), float(rng.random())) for i in range(700)],
        "jet_id string, target int, a double, b double",
    )
    index = bootstrap.rank_index(rows, 5, {"l": "a", "r": "b"}, {"l": 20.0, "r": 0.5})
    whole = sorted(bootstrap.rank_blocks(index, 6, 5).collect())
    assert sum(g.n for r in whole for g in r.groups) == 7 * 2 * 700
    monkeypatch.setattr(resample, "RANGE", 64)
    monkeypatch.setattr(resample, "WINDOW", 128)
    seed_counts, meet = resample.count_draws(5), resample.meet_ranges(2, bootstrap.RANK_BLOCK)

    def narrow(run):
        def inner(batches):
            resample.RANGE, resample.WINDOW = 64, 128
            return run(batches)

        return inner

    monkeypatch.setattr(resample, "count_draws", lambda seed: narrow(seed_counts))
    monkeypatch.setattr(resample, "meet_ranges", lambda sides, block: narrow(meet))
    assert sorted(bootstrap.rank_blocks(index, 6, 5).collect()) == whole


def test_draws_meet_rows_in_ranges_not_by_a_join_of_draws(spark):
    """What is shuffled per replicate is counts of ranges: two bits a position, never a row per draw (F4)."""
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("jet_id"), (F.col("id") % 2).cast("int").alias("target"), F.rand(1).alias("a")
    )
    index = bootstrap.rank_index(rows, 5, {"one": "a"})
    made = bootstrap.draws(index.table, 10, 5).agg(F.count("*"), F.sum(F.length("counts") + F.length("more"))).first()
    assert made[0] == 11 * 2 and made[1] < 0.5 * 11 * 3000


def test_contracts_read_values_in_place(spark):
    """Broken rules come from the record's own row: no shuffle, no row per value; names never pass for paths (F5)."""
    fields = {
        "a": contracts.Object({"b": contracts.Integer(1), "c": contracts.Free(required=False)}),
        "n": contracts.Keyed(contracts.Number(0), required=False),
        "l": contracts.Items({"t": contracts.Text("^x$")}, 1, required=False),
        "u": contracts.Each(contracts.Text(allowed=("p", "q")), unique=True, required=False),
    }
    rows = {
        "good": ('{"a":{"b":1,"c":{"d":{"e":{}}}},"n":{"7":0.5},"l":[{"t":"x"},null],"u":["p","q"]}', []),
        "dots": ('{"a":{"b":1},"a.b":1}', ["CONTRACT_TYPES", "CONTRACT_UNKNOWN_PROPERTY"]),
        "star": ('{"a":{"b":1},"n":{"*":1}}', ["CONTRACT_TYPES", "CONTRACT_UNKNOWN_PROPERTY:n"]),
        "free": ('{"a":{"b":1,"c":{"x":{}}},"y":{"x":{}}}', ["CONTRACT_TYPES", "CONTRACT_UNKNOWN_PROPERTY"]),
        "list": ('{"a":{"b":1.0},"l":[{"t":"x"},{"t":"y"},{}]}',
                 ["CONTRACT_SCHEMA:a.b", "CONTRACT_SCHEMA:l[].t", "CONTRACT_TYPES"]),
        "fits": ('{"a":{"b":0},"n":{"1":-1},"l":[],"u":["p","r","p"]}',
                 ["CONTRACT_SCHEMA:a.b", "CONTRACT_SCHEMA:l", "CONTRACT_SCHEMA:n.*", "CONTRACT_SCHEMA:u",
                  "CONTRACT_SCHEMA:u[]"]),
        "none": ("{}", ["CONTRACT_SCHEMA:a"]),
        "null": ("null", []),
        "root": ("[]", ["CONTRACT_TYPES"]),
        "text": ("{", ["CONTRACT_JSON"]),
    }
    table = spark.createDataFrame([(k, j) for k, (j, _) in rows.items()], "key string, json string")
    parsed = table.select("key", F.try_parse_json("json").alias("v"), "json")
    for records in (parsed, parsed.drop("json")):
        made = contracts.variant_violations(records, fields)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        found = {key: [] for key in rows}
        for r in made.collect():
            found[r.key].append(r.rule)
        assert {key: sorted(names) for key, names in found.items()} == {k: want for k, (_, want) in rows.items()}


def split_record(files: int = 2, records: int = 2) -> dict:
    """A split record that keeps its contract."""
    artifact = {"path": "out/1", "sha256": "a" * 64}
    listed = []
    for n in range(files):
        name = f"root://a]b/{n}.root"
        digest = hashlib.sha256(name.encode()).hexdigest()
        bucket = int(digest, 16) % 10
        listed.append({
            "record_id": 18000, "role": "signal", "canonical_pfn": name, "pfn_sha256": digest, "adler32": "0a1B2c3d",
            "size_bytes": 7, "bucket": bucket, "split": {0: "test", 1: "validation"}.get(bucket, "train"),
        })
    counts = {"qcd": 3, "top": 2}
    part = {"file_count": 1, "event_count": 5, "jet_counts_by_class": counts,
            "record_jet_counts": {str(18000 + n): n for n in range(records)}}
    fixed = {name: inner.allowed[0] for name, inner in contracts.DESCRIBED["split"]["split_rule"].fields.items()
             if isinstance(inner, contracts.Text)}
    hashed = {name: inner.allowed[0] for name, inner in contracts.CONTRACTS["split"]["hash_metadata"].fields.items()
              if inner.allowed}
    return {
        "schema_version": "1.0.0", "manifest_id": "split-1", "study_id": "study-1", "created_at": "2026-01-01T00:00:00Z",
        "dataset": {"name": contracts.DATASET_NAME, "campaign": "RunIIFall15MiniAODv2", "source_manifest": artifact,
                    "canonical_dataset": artifact | {"byte_size": 1},
                    "source_records": [{"record_id": 18000, "role": "signal"}, {"record_id": 1, "role": "qcd_active"}]},
        "split_rule": fixed | {"modulus": 10, "buckets": {"test": [0], "validation": [1], "train": list(range(2, 10))}},
        "source_files": listed,
        "partitions": {"train": part, "validation": part, "test": part},
        "training_subsets": [{"subset_id": "n1000", "train_size_per_class": 1000, "subset_seed": 7,
                              "selection_rule": "sha256-ranked-signal-and-record-round-robin-qcd-v1",
                              "identity_payload": artifact, "counts_by_class": counts}],
        "preprocessing": {"feature_version": "v1", "policy": artifact, "fitted_partition": "train",
                          "pid_vocabulary": {name: n for n, name in enumerate(contracts.PID_NAMES)},
                          "impact_parameter_policy": "training_fitted", "pt_eta_control_sha256": None},
        "semantic_checks": dict.fromkeys(contracts.CONTRACTS["split"]["semantic_checks"].fields, True),
        "hash_metadata": hashed | {"content_sha256": "b" * 64},
    }


def ordered(value, spec):
    """``value`` with the keys of its objects as the contract lists them."""
    if isinstance(spec, contracts.Items):
        return [ordered(item, contracts.Object(spec.fields)) for item in value]
    if not isinstance(spec, contracts.Object):
        return value
    return {name: ordered(value[name], inner) for name, inner in spec.fields.items() if name in value}


def test_texts_that_keep_the_contract_are_not_parsed(spark):
    """A good record is told by its text, a bad one never is; all layouts of a record break the same rules (F1)."""
    spec = contracts.Object(contracts.CONTRACTS["split"] | contracts.DESCRIBED["split"])
    faults = {
        "good": None,
        "number": ('"role": "signal"', '"role": 5'), "text": ('"size_bytes": 7', '"size_bytes": "7"'),
        "more": ('"adler32":', '"note": 1, "adler32":'), "less": ('"study_id": "study-1", ', ""),
        "null": ('"study_id": "study-1"', '"study_id": null'), "twice": ('"study_id":', '"study_id": "s-1", "study_id":'),
        "keys": ('"18001": 1', '"18000": 1'), "key": ('"18001": 1', '"x": 1'), "low": ('"18001": 1', '"18001": -1'),
        "one": ('"size_bytes": 7', '"size_bytes": 7.0'), "half": ('"size_bytes": 7', '"size_bytes": 7.5'),
        "zero": ('"size_bytes": 7', '"size_bytes": 0'), "zeros": ('"size_bytes": 7', '"size_bytes": 07'),
        "large": ('"subset_seed": 7', '"subset_seed": 4294967296'), "seed": ('"subset_seed": 7', '"subset_seed": 4294967295'),
        "hex": ('"' + "b" * 64 + '"', '"' + "b" * 64 + "b" + '"'), "hash": ('"pfn_sha256": "', '"pfn_sha256": "0'),
        "line": ('"v1"', '"\u2028"'), "quote": ('"v1"', '"v\\"1"'), "empty": ('"v1"', '""'), "stamp": ("00Z", "00+01:00"),
        "name": ("root://a]b/1.root", "root://a]b/0.root"), "bucket": ('"bucket": ', '"bucket": 1'),
        "place": ('"bucket": 1,', '"bucket": 1.5,'),
        "modulus": ('"modulus": 10', '"modulus": 11'), "train": ("2, 3, 4", "2, 3, 5"), "false": ("true", "false"),
        "files": ('"source_files": [', '"source_files": [null, '), "object": ('"source_files": [', '"source_files": {}, "z": ['),
        "end": ('"hash_metadata": {', '"hash_metadata": {,'), "version": ('"1.0.0"', '"2.0.0"'),
    }
    base, rows = split_record(), []
    listed = ordered(base, spec)
    assert listed == base
    for name, fault in faults.items():
        for layout, value in (("listed", listed), ("sorted", json.loads(json.dumps(base, sort_keys=True)))):
            text = json.dumps(value, ensure_ascii=False)
            assert fault is None or fault[0] in text or (name, layout) == ("less", "sorted"), name
            text = text.replace(*fault) if fault else text
            compact = text.replace('": ', '":').replace(', "', ',"').replace(", ", ",")
            rows += [(name, f"{layout} wide", text), (name, layout, compact)]
    for name, value in (("good long", split_record(3000)), ("good keys", split_record(2, 40))):
        rows.append((name, "listed", json.dumps(ordered(value, spec), separators=(",", ":"))))
    table = spark.createDataFrame([(f"{n}/{layout}", text) for n, layout, text in rows], "key string, json string")
    found = {f"{n}/{layout}": [] for n, layout, _ in rows}
    for r in contracts.record_violations(table, "split", described=True).collect():
        found[r.key].append(r.rule)
    for name in faults:
        ways = {layout: sorted(found[f"{name}/{layout}"]) for n, layout, _ in rows if n == name}
        wide = {layout: ways[f"{layout} wide"] for layout in ("listed", "sorted")}
        assert {layout: ways[layout] for layout in wide} == wide, name
        assert (not ways["listed"]) == (name in ("good", "one", "seed", "quote", "files")), (name, ways)
    assert not found["good long/listed"] and not found["good keys/listed"]
    told = contracts.with_matched(table, "text", spec, F.lit(False), keep="source_files")
    good = {r.key for r in told.filter("text <> ''").collect()}
    # A repeated name breaks no rule that the text shows; it is found among the files.
    assert good == {f"{n}/{layout}" for n in ("good", "name") for layout in ("listed", "sorted")} | {"good long/listed"}


def test_ranges_grow_with_the_manifests(spark, tmp_path):
    """The number of ranges, each a task and a file, is bounded; small manifests keep small ranges (F12)."""
    for i in range(2):
        (tmp_path / f"{i}.txt").write_bytes(b"18000\troot://f/1\t0a1b2c3d\t7\n" * 5000)
    listed = files.list_files(spark, str(tmp_path))
    total = 2 * 5000 * len(b"18000\troot://f/1\t0a1b2c3d\t7\n")
    assert manifest.size_of_ranges(listed, 16 << 10) == 16 << 10
    assert manifest.size_of_ranges(listed, 16, 8) == -(-total // 8)
    assert manifest.size_of_ranges(listed.filter("length < 0"), 16) == 16
    with manifest.range_size(spark, manifest.size_of_ranges(listed, 16, 8)):
        made = manifest.numbered_lines(manifest.read_ranges(spark, str(tmp_path)))
        assert made.select("path", "range").distinct().count() <= 10
        assert made.groupBy("path").agg(F.max("line_no").alias("n")).filter("n = 5000").count() == 2


def test_order_digest_is_compiled(spark):
    """Powers of positions come from tables of digits; the JVM leaves methods of over 8,000 bytes uncompiled (F16)."""
    positions = [0, 1, 255, 256, 65_535, 10**9, 2**40 - 1, None, -1, -257]
    rows = spark.createDataFrame([(p, f"j{i}") for i, p in enumerate(positions)], "pos bigint, jet_id string")
    for base in digest.BASES:
        for r in rows.select("pos", digest._power(base, F.col("pos")).alias("w")).collect():
            assert r.w == (1 if r.pos is None or r.pos < 0 else pow(base, r.pos, digest.MODULUS))
    plan = digest.order_digest(rows, "jet_id", "pos")._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert not sizes or max(sizes) < 8000


def test_metadata_and_digest_in_one_pass(spark):
    """Counts and the digest of a run come from one aggregation, without a join (F16)."""
    rows = spark.createDataFrame(
        [("a", "j0", 0, 0), ("a", "j1", 1, 1), ("b", "j0", None, 0)], "run_id string, jet_id string, target int, pos bigint"
    )
    made = table_source.prediction_metadata(rows)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {r.run_id: r.digest for r in digest.content_digest(rows, ["jet_id", "pos"], ["run_id"]).collect()}
    found = {r.run_id: tuple(r)[1:] for r in made.collect()}
    assert found == {"a": (2, 1, 1, want["a"]), "b": (1, 0, 0, want["b"])}


def test_splits_are_worked_out_per_customer(spark):
    """A split follows from a file, so its hash and the filter on it stand below the join with orders (F15, F17, F20)."""
    plan = tables.jets(spark, "/root/testdata/sf0.001").filter("split = 'train'")._jdf.queryExecution()
    hashed = [line for line in plan.optimizedPlan().toString().splitlines() if "sha2(" in line]
    assert hashed and not any("o_custkey" in line or "o_orderkey" in line for line in hashed)


def test_slot_sums_round_real_values_only(spark):
    """Padding is visited, not rounded: the sums are those of all rounded slots (F13, F22)."""
    data = [[[0.0, 1.00005], [0.0, -2.3], [0.0, 0.0], [0.0, -0.0]], [], [[0.0, None], [0.0, 1.0]], [[0.0, float("nan")]]]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data array<array<float>>")
    every = F.aggregate("data", F.lit(0.0), lambda a, d: a + F.round(d[1].cast("double"), 4))
    made = rows.select("i", feature_queries._slot_sum(1).alias("s"), every.alias("e")).collect()
    assert all(str(r.s) == str(r.e) for r in made)
    few = rows.select(feature_queries._slot_sum(1).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in few and few.index("filter(") < few.index("round(")


def test_only_lines_of_chosen_jets_are_ordered(spark):
    """The choice of a subset is made before its particles are ordered and nested (F21, F22)."""
    made = feature_queries._subset(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [row_number()") < plan.index("Join LeftSemi")


def test_order_of_manifest_values_needs_no_window(spark):
    """Neighbours of a manifest that is a value meet in its row, whatever bad lines stand between (F19)."""
    line = "{}\troot://f/{}\t0a1b2c3d\t7"
    texts = {
        "good": [line.format(1, "a"), line.format(1, "b"), line.format(2, "a")],
        "turned": [line.format(2, "a"), "x", line.format(1, "z"), line.format(1, "y"), line.format(1, "y")],
        "bad": ["", line.format("x", "a"), "a\t\tb\t1"],
        "one": [line.format(1, "a")],
        "empty": [],
    }
    rows = [(name, bytearray(("\n".join(lines) + "\n" if lines else "").encode())) for name, lines in texts.items()]
    values = spark.createDataFrame(rows, "path string, content binary")
    made = manifest.value_disorder(values)
    assert sorted(map(tuple, made.collect())) == [("turned", 3), ("turned", 4)]
    assert "Window" not in manifest.manifest_violations(values)._jdf.queryExecution().optimizedPlan().toString()
    parsed = manifest.parse_lines(manifest.manifest_lines(values))
    by_window = sorted(map(tuple, manifest.line_violations(parsed).collect()))
    repeats = manifest.value_repeats(values)
    assert sorted(map(tuple, repeats.collect())) == [("good", "root://f/a", 2), ("turned", "root://f/y", 2)]
    assert by_window == sorted(map(tuple, manifest.line_violations(parsed, made, repeats).collect()))
