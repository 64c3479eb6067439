"""Readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from jetframe.operators import canonical, digest
from jetframe.rules import RuleViolation
from jetframe.session import stored
from jetframe.sources import files, manifest, tables
from test_units import jet_rows, scored

GOOD = b"1\troot://a\t0123abcd\t5\n2\troot://b\tffffffff\t7\n"


def codes(spark, tmp_path, content):
    path = tmp_path / "m.tsv"
    path.write_bytes(content)
    found = manifest.manifest_violations(manifest.read_manifest_bytes(spark, str(path)))
    return {row.rule for row in found.collect()}


@pytest.mark.parametrize(
    "content, code",
    [
        (b"\xef\xbb\xbf" + GOOD, "MANIFEST_BOM"),
        (GOOD.replace(b"\n", b"\r\n"), "MANIFEST_LINE_ENDING"),
        (GOOD[:-1], "MANIFEST_LINE_ENDING"),
        (GOOD.replace(b"root://a", b"\xff\xfe"), "MANIFEST_UTF8"),
        (GOOD + b"1\troot://0\t0123abcd\t5\n", "MANIFEST_ORDER"),
        (GOOD + b"3\troot://a\t0123abcd\t5\n", "MANIFEST_DUPLICATE_PFN"),
        (GOOD + b"3\t\t0123abcd\t5\n", "MANIFEST_EMPTY_FIELD"),
        (GOOD + b"3\troot://c\tzz\t5\n", "MANIFEST_CHECKSUM"),
        (GOOD + b"3\troot://c\t0123abcd\t0\n", "MANIFEST_SIZE"),
        (GOOD + b"3\troot://c\t0123abcd\n", "MANIFEST_FIELD_COUNT"),
        (GOOD + b"x\troot://c\t0123abcd\t1\n", "MANIFEST_FIELD_VALUE"),
        (b"0\troot://c\t0123abcd\t1\n", "MANIFEST_RECORD_ID"),
    ],
)
def test_manifest_codes(spark, tmp_path, content, code):
    assert code in codes(spark, tmp_path, content)


def test_clean_manifest(spark, tmp_path):
    assert codes(spark, tmp_path, GOOD) == set()
    rows = manifest.read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("line_no").collect()
    assert [(r.record_id, r.canonical_pfn, r.size_bytes) for r in rows] == [(1, "root://a", 5), (2, "root://b", 7)]
    digest = manifest.manifest_hash(manifest.read_manifest_bytes(spark, str(tmp_path / "m.tsv"))).first().sha256
    assert digest == hashlib.sha256(GOOD).hexdigest()


def test_jets_round_trip(spark, tmp_path):
    jets = jet_rows(spark)
    jets.write.parquet(f"{tmp_path}/a")
    read = tables.read_jets(spark, [f"{tmp_path}/a"], parallel=True)
    assert read.count() == 4 and len(read.first().particles) == 3
    jets.drop("particle_dz").write.parquet(f"{tmp_path}/b")
    with pytest.raises(RuleViolation, match="particle_dz"):
        tables.read_jets(spark, [f"{tmp_path}/b"], parallel=True)


def test_canonical_sink(spark, tmp_path):
    rows = canonical.canonicalize(canonical.zip_parallel(jet_rows(spark)), 0.1, 0.1)
    stored = tables.write_canonical(rows, f"{tmp_path}/c", "v1", "0" * 64)
    assert stored.count() == 4
    assert tables.verify_canonical(spark, f"{tmp_path}/c").first().valid
    train = stored.filter("split = 'train'")
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_inventory_round_trip(spark, tmp_path):
    jet = {"record_id": 1, "canonical_pfn": "f", "run": 1, "lumi": 1, "event": 1, "jet_index": 0, "target": 1}
    doc = {
        "schema_version": "1.0.0",
        "canonical_dataset": {"path": "p", "sha256": "0" * 64, "byte_size": 1},
        "jets": [jet, {**jet, "event": "x"}, {**jet, "target": 4}],
    }
    (tmp_path / "i.json").write_text(json.dumps(doc))
    rows = tables.read_inventory(spark, str(tmp_path / "i.json"))
    assert rows.count() == 3
    found = {(r.rule, r.key.split(":")[-1]) for r in tables.inventory_violations(rows).collect()}
    assert found == {("SPLIT_IDENTITY_VALUE:event", "1"), ("CONTRACT_VALUE:target", "2")}


def test_predictions_round_trip(spark, tmp_path):
    rows = scored(spark, [0, 1, 1], [0.25, 0.5, 0.75])
    tables.write_predictions(rows, f"{tmp_path}/p")
    back = tables.read_predictions(spark, f"{tmp_path}/p")
    about = spark.read.json(f"{tmp_path}/p/about")
    assert tables.metadata_violations(back, about).count() == 0
    changed = back.withColumn("pos", 2 - F.col("pos"))
    assert {r.rule for r in tables.metadata_violations(changed, about).collect()} == {
        "PREDICTION_METADATA:row_order_digest"
    }


def test_report_sink(spark, tmp_path):
    tables.write_report({"matrix": spark.range(3)}, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/matrix").count() == 3


def test_file_inventory_by_row_and_by_block(spark, tmp_path):
    root = tmp_path / "x"
    (root / "sub").mkdir(parents=True)
    (root / "a.h5").write_bytes(b"abc" * 1000)
    (root / "sub" / "b.txt").write_bytes(b"q")
    by_row = files.file_inventory(spark, str(root))
    by_block = files.file_inventory(spark, str(root), row_limit=10)
    expected = {
        ("a.h5", hashlib.sha256(b"abc" * 1000).hexdigest(), 3000),
        ("sub/b.txt", hashlib.sha256(b"q").hexdigest(), 1),
    }
    assert {tuple(r) for r in by_row.collect()} == expected == {tuple(r) for r in by_block.collect()}
    found = files.discover(files.list_files(spark, str(root)))
    assert [r.path.endswith("a.h5") for r in found.collect()] == [True]


def test_long_files_are_hashed_in_turns(spark, tmp_path):
    """Lengths around ends of ranges and blocks, names that no URI has as they are; no file fits a value."""
    contents = {f"n{n}": bytes(k * k % 251 for k in range(n)) for n in (64, 191, 192, 193, 384, 385, 1000)}
    contents |= {"a %41#?\u00e9 b.h5": b"q" * 500, "short": b"s"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = files.file_inventory(spark, str(tmp_path), row_limit=10, span=192).collect()
    assert {r.path: r.sha256 for r in rows} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    assert {r.path: r.byte_size for r in rows} == {n: len(c) for n, c in contents.items()}
    with pytest.raises(ValueError, match="multiple of 64"):
        files.file_inventory(spark, str(tmp_path), span=100)


def test_a_turn_reads_its_range_only(spark, tmp_path):
    """A task per unfinished file; the bytes after its range need not be there until their turn comes."""
    paths = [tmp_path / f"f{n}" for n in range(9)]
    for path in paths:
        path.write_bytes(b"x" * 128)
    start = [(path.as_uri(), 300, 0, None, None) for path in paths]
    first = files.next_turn(spark.createDataFrame(start, files.TURN), 9, 128).withColumn("task", F.spark_partition_id())
    rows = first.collect()
    assert {(r.at, len(r.state), r.sha256) for r in rows} == {(128, 32, None)} and len({r.task for r in rows}) == 9
    begun = spark.createDataFrame([r[:5] for r in rows], files.TURN)
    with pytest.raises(Exception, match="ends at byte 128, not at 300"):
        files.next_turn(begun, 9, 128).collect()
    for path in paths:
        path.write_bytes(b"?" * 128 + b"y" * 172)
    second = files.next_turn(begun, 9, 128).collect()
    third = files.next_turn(spark.createDataFrame(second, files.TURN), 9, 128).collect()
    assert {r.sha256 for r in third} == {hashlib.sha256(b"x" * 128 + b"y" * 172).hexdigest()}


def test_whole_files_where_states_or_file_systems_are_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"z" * 1000)
    want = hashlib.sha256(b"z" * 1000).hexdigest()
    monkeypatch.setattr(files, "_opens", lambda path: False)
    assert files.file_inventory(spark, str(tmp_path), row_limit=10, span=64).first().sha256 == want
    monkeypatch.setattr(files.sha256, "library", lambda: None)
    uri = (tmp_path / "f").as_uri()
    assert files._hash_on(uri, 1000, 0, None, 64) == files._hash_on(uri, 1000, 64, b"", 64) == (1000, None, want)


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, size):
    """Every file gives the same rules by byte ranges of any size as by its whole content."""
    long = b"".join(b"%d\troot://f%05d\t0123abcd\t%d\n" % (n // 50 + 1, n, n + 1) for n in range(300))
    contents = {
        "good": GOOD, "mark": b"\xef\xbb\xbf" + GOOD, "crlf": GOOD.replace(b"\n", b"\r\n"), "open": GOOD[:-1],
        "markopen": b"\xef\xbb\xbf" + GOOD[:-1], "empty": b"", "alone": b"\xef\xbb\xbf", "feeds": b"\n\n\n",
        "bytes": GOOD.replace(b"root://a", b"\xff\xfe"), "order": GOOD + b"1\troot://0\t0123abcd\t5\n",
        "long": long, "swap": long[20_00:] + long[:20_00], "blank": GOOD + b"\n" + GOOD,
    }
    for name, content in contents.items():
        (tmp_path / f"{name}.tsv").write_bytes(content)
    last = F.element_at(F.split("path", "/"), -1)
    with manifest.range_size(spark, size):
        ranges = stored(manifest.read_ranges(spark, str(tmp_path)))
    listed = files.list_files(spark, str(tmp_path))
    by_range = manifest.range_violations(ranges.withColumn("path", last), listed.withColumn("path", last))
    whole = manifest.read_manifest_bytes(spark, str(tmp_path)).withColumn("path", last)
    # A file without a line has no numbered line either; the whole-file path gives it one empty line.
    bare = ("empty.tsv:1", "alone.tsv:1")
    found = sorted(tuple(r) for r in by_range.collect() if r.key not in bare)
    want = sorted(tuple(r) for r in manifest.manifest_violations(whole).collect() if r.key not in bare)
    assert found == want
    numbered = manifest.numbered_lines(ranges.withColumn("path", last)).filter("path = 'long.tsv'").collect()
    assert {r.line_no: r.line for r in numbered} == dict(enumerate(long.decode().splitlines(), 1))
    if size < 100:
        assert len({r.range for r in numbered}) > 50


def test_ordered_files_and_their_violations(spark, tmp_path):
    rows = spark.range(1000).selectExpr("999 - id AS pos", "concat('v', id) AS v").repartition(7)
    tables.write_ordered(rows, f"{tmp_path}/o", "pos", 4)
    assert tables.order_violations(spark, f"{tmp_path}/o", "pos").count() == 0
    back = tables.read_in_files(spark, f"{tmp_path}/o").orderBy("file", "line").collect()
    assert [r.pos for r in back] == list(range(1000))
    # A file written in another order, and one that is gone.
    one = sorted(p for p in (tmp_path / "o" / "data").iterdir() if p.suffix == ".parquet")
    turned = spark.read.parquet(str(one[1])).orderBy(F.desc("pos")).coalesce(1)
    turned.write.parquet(f"{tmp_path}/t")
    new = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    one[1].write_bytes(new.read_bytes())
    (one[1].parent / f".{one[1].name}.crc").unlink()
    found = tables.order_violations(spark, f"{tmp_path}/o", "pos").collect()
    assert {r.rule for r in found} == {"ORDER_POSITION"} and len(found) > 200
    lines = (tmp_path / "o" / "offsets").glob("part-*.json")
    text = next(lines)
    kept = [x for x in text.read_text().splitlines() if one[2].name not in x]
    text.write_text("\n".join(kept) + "\n")
    (text.parent / f".{text.name}.crc").unlink()
    assert "ORDER_OFFSET" in {r.rule for r in tables.order_violations(spark, f"{tmp_path}/o", "pos").collect()}


def test_order_digest_merges_and_sees_every_change(spark):
    rows = [(k, f"id{k * 7 % 50}") for k in range(50)]

    def of(values, parts=1):
        table = spark.createDataFrame(values, "pos bigint, id string").repartition(parts)
        return digest.order_digest(table, "id", "pos").first().order_digest

    same = of(rows)
    assert same == of(rows[::-1], 6) == of(rows[25:] + rows[:25], 3)
    names = [v for _, v in rows]
    swapped = names[:]
    swapped[10], swapped[11] = swapped[11], swapped[10]
    repeated = names[:]
    repeated[20] = repeated[21]
    shifted = names[1:] + names[:1]
    others = [of(list(enumerate(v))) for v in (swapped, repeated, shifted, names[:-1])]
    assert len({same, *others}) == 5
    value = [(int(hashlib.sha256(v.encode()).hexdigest()[:12], 16) % (digest.MODULUS - 1)) + 1 for v in names]
    want = [sum(x * pow(b, k, digest.MODULUS) for k, x in enumerate(value)) % digest.MODULUS for b in digest.BASES]
    assert same == ":".join([digest.ORDER_RULE, "50", *map(str, want)])


def test_inventory_types_as_they_are_written(spark, tmp_path):
    jet = {"record_id": 1, "canonical_pfn": "f", "run": 1, "lumi": 1, "event": 1, "jet_index": 0, "target": 1}
    doc = {
        "schema_version": "1.0.0",
        "canonical_dataset": {"path": "p", "sha256": "0" * 64, "byte_size": True},
        "jets": [
            jet, {**jet, "run": True}, {**jet, "run": "1"}, {**jet, "run": 1.0}, {**jet, "run": None},
            {**jet, "more": 1}, {k: v for k, v in jet.items() if k != "run"}, {**jet, "target": 2}, 5, None,
            {**jet, "event": 10**20}, {**jet, "run": 0},
        ],
        "note": {"deep": [1]},
    }
    (tmp_path / "i.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "j.json").write_text("{")
    read = tables.read_inventory_documents(spark, str(tmp_path)).withColumn(
        "source", F.substring_index("source", "/", -1)
    )
    found = {}
    for r in tables.inventory_contract(read).collect():
        found.setdefault(r.key, set()).add(r.rule)
    run, types = "CONTRACT_SCHEMA:run", "CONTRACT_TYPES"
    assert found.pop("j.json", {"CONTRACT_JSON"}) == {"CONTRACT_JSON"}
    assert found == {
        "i.json": {"CONTRACT_SCHEMA:canonical_dataset.byte_size", types, "CONTRACT_UNKNOWN_PROPERTY"},
        "i.json:1": {run, types}, "i.json:2": {run, types}, "i.json:3": {run, types}, "i.json:4": {run},
        "i.json:5": {"CONTRACT_UNKNOWN_PROPERTY", types}, "i.json:6": {run},
        "i.json:7": {"CONTRACT_SCHEMA:target"}, "i.json:8": {types}, "i.json:11": {run},
    } | {k: v for k, v in found.items() if k == "i.json:9"}
    assert found.get("i.json:9", {types}) <= {types, "CONTRACT_JSON"}
