"""Golden vectors, brute-force checks and properties of single operators."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jetframe.functions import arrays, identity, particles
from jetframe.operators import (
    audit,
    bootstrap,
    canonical,
    contracts,
    digest,
    fit,
    ledger,
    match,
    metrics,
    ordered,
    ranking,
    scoring,
    views,
)
from jetframe.rules import RuleViolation, enforce


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, prefix, bucket, split",
    [
        ("root://example.invalid//store/test/file-7.root", "86a2d2ef", 0, "test"),
        ("root://example.invalid//store/test/file-0.root", "037bba1c", 1, "validation"),
        ("root://例子.invalid//cms/μ-jet.root", "71ac8c09", 7, "train"),
    ],
)
def test_split_golden(spark, name, prefix, bucket, split):
    digest_hex = identity.file_hash(F.lit(name))
    row = spark.range(1).select(
        digest_hex.alias("h"), identity.bucket10(digest_hex).alias("b"), identity.assign_split(F.lit(name)).alias("s")
    ).first()
    assert (row.h[:8], row.b, row.s) == (prefix, bucket, split)


def test_bucket_is_big_integer_modulo(spark):
    rows = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for row in rows.select("h", identity.bucket10(F.col("h")).alias("b")).collect():
        assert row.b == int(row.h, 16) % 10


def test_particle_rules(spark):
    assert one(spark, particles.wrap_angle(F.lit(math.pi))) == -math.pi
    codes = {11: 4, -13: 5, 22: 3, 130: 2, 310: 2, 2112: 2, -211: 1, 321: 1, 2212: 1, 999: 0}
    for code, category in codes.items():
        assert one(spark, particles.pid_category(F.lit(code))) == category
    states = [(1.0, True, 1), (0.0, False, 2), (-1.0, False, 3), (0.0, True, 1)]
    for charge, has, state in states:
        assert one(spark, particles.track_state(F.lit(charge), F.lit(has))) == state
    for bad in (float("nan"), float("inf"), -float("inf"), None):
        assert one(spark, particles.not_finite(F.lit(bad).cast("double")))


def jet_rows(spark):
    """Four jets with three particles; two of them tie in pt."""
    rows = []
    for i, (record, target) in enumerate(((18355, 0), (19980, 1), (18355, 0), (19980, 1)), 1):
        rows.append(
            (
                record, f"root://example.invalid//store/test/file-{(8, 2, 0, 7)[i - 1]}.root", i, i + 10, i + 100, 0,
                ("train", "train", "validation", "test")[i - 1], target, 550.0 + i, 0.1 * i,
                3.13 if i == 1 else 0.2, 0.01 * i, 20 + i,
                [10.0, 20.0, 20.0], [0.2, 0.3, -0.1], [3.12, -3.12, 0.4], [12.0, 24.0, 25.0],
                [1.0, 0.0, -1.0], [211, 22, -13], [0.01, 9.0, 8.0], [0.001, 9.0, 8.0], [0.02, 9.0, 8.0],
                [0.002, 9.0, 8.0], [True, False, False],
            )
        )
    from jetframe.schema import PARALLEL_JETS

    return spark.createDataFrame(rows, PARALLEL_JETS)


def test_canonicalize_fixture(spark):
    done = canonical.canonicalize(canonical.zip_parallel(jet_rows(spark)), 0.1, 0.1)
    row = done.orderBy("run").first()
    assert [p.pid_type for p in row.particles] == [3, 5, 1]
    assert [p.track_state for p in row.particles] == [2, 3, 1]
    assert [round(p.dxy_raw, 6) for p in row.particles] == [0.0, 0.0, 0.01]
    assert row.n_before == 3 and row.label == 0
    assert abs(row.particles[0].delta_phi) < math.pi
    assert row.jet_id.startswith("cms:18355:") and row.jet_id.endswith(":1:11:101:0")


def test_truncation_and_zero_particles(spark):
    jets = canonical.zip_parallel(jet_rows(spark))
    two = canonical.clean_particles(jets, 0.1, 0.1, k=2).first()
    assert [p.pt for p in two.particles] == [20.0, 20.0] and [p.idx for p in two.particles] == [1, 2]
    none = canonical.clean_particles(jets, 1000.0, 0.1).first()
    assert none.particles == [] and none.n_before == 0


def test_compact_rules(spark):
    jets = jet_rows(spark)
    enforce(canonical.dataset_rules(canonical.zip_parallel(jets)))
    bad = canonical.zip_parallel(
        jets.withColumn("particle_dz", F.array(F.lit(0.0), F.lit(float("nan")), F.lit(0.0)))
    )
    with pytest.raises(RuleViolation, match="DATA_NONFINITE"):
        enforce(canonical.dataset_rules(bad))
    nested = canonical.zip_parallel(jets)
    with pytest.raises(RuleViolation, match="DATA_DUPLICATE_IDENTITY"):
        enforce(canonical.dataset_rules(nested.unionByName(nested)))
    ragged = jets.withColumn("particle_eta", F.slice("particle_eta", 1, 2))
    assert ragged.filter(canonical.unequal_lengths(ragged)).count() == 4


def test_scaling_uses_train_rows_only(spark):
    rows = canonical.exploded(canonical.canonicalize(canonical.zip_parallel(jet_rows(spark)), 0.1, 0.1))
    state = fit.load_scaling(fit.fit_scaling(rows))
    moved = rows.withColumn(
        "log_pt", F.when(F.col("split") != "train", F.lit(99.0)).otherwise(F.col("log_pt")).cast("float")
    )
    assert fit.load_scaling(fit.fit_scaling(moved)) == state
    constant = rows.withColumn("charge", F.lit(1.0))
    assert fit.load_scaling(fit.fit_scaling(constant))["charge"] == (1.0, 1.0)
    with pytest.raises(ValueError):
        fit.load_scaling(fit.fit_scaling(rows.filter("split = 'test'")))


def hot_children(spark):
    """One parent owns most rows."""
    return spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(F.lit(7)).alias("key"),
        (F.col("id") * 7919 % 101).cast("double").alias("pt"),
        F.lit(1.0).alias("energy"),
        F.col("id").alias("tie"),
    )


def test_salted_top_children_equal(spark):
    order = [F.col("pt").desc(), F.col("tie").asc()]
    plain = canonical.top_children(hot_children(spark), "key", order, 20)
    salted = canonical.top_children(hot_children(spark), "key", order, 20, salts=8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))


def test_hash_ordinal_matches_one_window(spark):
    rows = hot_children(spark).select("key", F.col("tie").cast("string").alias("id"))
    placed = ranking.hash_ordinal(rows, "id", 7, ["key"], digits=2)
    w = Window.partitionBy("key").orderBy(identity.seeded_rank(7, F.col("id")), "id")
    expected = rows.withColumn("ordinal", F.row_number().over(w))
    assert sorted(map(tuple, placed.select("key", "id", "ordinal").collect())) == sorted(
        map(tuple, expected.collect())
    )
    first = ranking.hash_ordinal(rows, "id", 7, ["key"], limit=5, digits=2)
    assert sorted(map(tuple, first.select("key", "id", "ordinal").collect())) == sorted(
        map(tuple, expected.filter("ordinal <= 5").collect())
    )


def round_robin(rows, seed, size):
    """The selection as a plain loop."""
    import hashlib

    def rank(jet):
        return hashlib.sha256(f"{seed}\0{jet}".encode()).hexdigest(), jet

    queues = {r: sorted((j for q, j in rows if q == r), key=rank) for r in sorted({r for r, _ in rows})}
    out = []
    while len(out) < size and any(queues.values()):
        for queue in queues.values():
            if queue:
                out.append(queue.pop(0))
    return out[:size]


def test_nested_subsets_match_the_loop(spark):
    background = [(10 * (1 + i % 3) + (0 if i < 20 else 1), f"b{i}") for i in range(40)]
    signal = [(19980, f"s{i}") for i in range(30)]
    rows = spark.createDataFrame(
        [(r, j, 0) for r, j in background] + [(r, j, 1) for r, j in signal], "record_id bigint, jet_id string, label int"
    )
    members = ranking.subset_members(ranking.balanced_order(rows, 16, 7), (1, 2, 4, 16))
    found = {}
    for row in members.orderBy("size", "label", "pos").collect():
        found.setdefault((row["size"], row.label), []).append(row.jet_id)
    assert found[(16, 0)] == round_robin(background, 7, 16)
    assert found[(16, 1)] == round_robin(signal, 7, 16)
    for size in (1, 2, 4):
        assert found[(size, 0)] == found[(16, 0)][:size]
    assert ranking.nested_violations(members).count() == 0
    assert ranking.yield_violations(members, (1, 2, 4, 16)).count() == 0
    short = ranking.subset_members(ranking.balanced_order(rows, 100, 7), (1, 100))
    assert [r.key for r in ranking.yield_violations(short, (1, 100)).collect()] == ["n100"]
    for bad in ((), (0, 1), (2, 1), (1, 1)):
        with pytest.raises(ValueError):
            ranking.check_sizes(bad)


def scored(spark, targets, scores, run="r"):
    data = [(run, f"j{i:05d}", i, int(t), float(s)) for i, (t, s) in enumerate(zip(targets, scores))]
    return spark.createDataFrame(data, "run_id string, jet_id string, pos bigint, target int, score double")


def test_metric_fixtures(spark):
    row = metrics.binary_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), ["run_id"], threshold=0.5).first()
    assert row.roc_auc == 0.75 and row.accuracy == 0.75
    assert row.background_efficiency_50 == 0.0 and row.background_rejection_50 is None
    tie = metrics.binary_metrics(scored(spark, [0, 1, 0, 1], [0.5, 0.5, 0.1, 0.9]), ["run_id"]).first()
    assert tie.roc_auc == 0.875
    single = metrics.binary_metrics(scored(spark, [1, 1], [0.5, 0.6]), ["run_id"]).first()
    assert single.roc_auc is None


def brute_auc(t, s):
    pos, neg = s[t == 1], s[t == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_background(t, s, eps):
    values = np.unique(s)[::-1]
    tpr = np.array([0.0] + [np.mean(s[t == 1] >= v) for v in values])
    fpr = np.array([0.0] + [np.mean(s[t == 0] >= v) for v in values])
    at = int(np.argmax(tpr >= eps))
    if tpr[at] == eps:
        return fpr[at]
    return np.interp(eps, tpr[at - 1 : at + 1], fpr[at - 1 : at + 1])


@pytest.mark.parametrize("levels", [5, 400])
def test_metrics_against_brute_force_both_paths(spark, levels):
    rng = np.random.default_rng(levels)
    t = rng.integers(0, 2, 600)
    s = rng.integers(0, levels, 600) / levels + 0.2 * t
    frame = scored(spark, t, s)
    bounds = ordered.range_bounds(frame, "score", bins=20)
    for cuts in ([], bounds):
        row = metrics.binary_metrics(frame, ["run_id"], bounds=cuts).first()
        assert row.roc_auc == pytest.approx(brute_auc(t, s), abs=1e-12)
        assert row.background_efficiency_30 == pytest.approx(brute_background(t, s, 0.3), abs=1e-12)
        assert row.background_efficiency_50 == pytest.approx(brute_background(t, s, 0.5), abs=1e-12)


def test_bootstrap_properties(spark):
    t = [0] * 4 + [1] * 4
    s = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
    rows = scored(spark, t, s).select("jet_id", "target", F.col("score").alias("a"), F.col("score").alias("b"))
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(rows, "a", "b", 10, 1)
    made = {r.metric: r for r in bootstrap.paired_bootstrap(rows, "a", "b", 1000, 1, efficiencies=()).collect()}
    auc = made["roc_auc"]
    assert (auc.observed_delta, auc.low, auc.high, auc.discarded_count, auc.status) == (0.0, 0.0, 0.0, 0, "ok")


def test_bootstrap_reports_excess_discards(spark):
    rows = scored(spark, [0, 0, 1, 1], [0.1, 0.9, 0.8, 0.7]).select(
        "jet_id", "target", F.col("score").alias("a"), F.col("score").alias("b")
    )
    made = bootstrap.paired_bootstrap(rows, "a", "b", 1000, 1, efficiencies=(0.5,))
    status = {r.metric: (r.discarded_count, r.status) for r in made.collect()}
    count, text = status["background_rejection_50"]
    assert count > 10 and text == "METRIC_BOOTSTRAP_DISCARDS"


def test_bootstrap_preconditions(spark):
    rows = scored(spark, [0, 1, 1], [0.1, 0.2, 0.3]).select(
        "jet_id", "target", F.col("score").alias("a"), F.when(F.col("score") > 0.1, 0.5).alias("b")
    )
    made = bootstrap.paired_bootstrap(rows, "a", "b", 1000, 1, efficiencies=()).collect()
    assert {r.status for r in made} == {"METRIC_BOOTSTRAP_ALIGNMENT"}
    one = rows.filter("target = 1")
    made = bootstrap.paired_bootstrap(one, "a", "b", 1000, 1, efficiencies=()).collect()
    assert {r.status for r in made} == {"METRIC_BOOTSTRAP_CLASSES"}
    for call in (bootstrap.gap_fraction, bootstrap.paired_bootstrap):
        with pytest.raises(ValueError):
            call(rows, "a", "b", 999, 1)
    with pytest.raises(ValueError):
        bootstrap.auc_interval(rows, "a", 999, 1)


def test_subset_rows_of_several_sizes(spark):
    rows = [(f"j{n:03d}", n % 2, n // 2 + 1) for n in range(100)]
    frame = spark.createDataFrame(rows, "jet_id string, label int, pos long")
    members = ranking.subset_members(frame, [10, 25, 50])
    for size in (10, 25, 50):
        got = views.subset_rows(members, frame.select("jet_id"), size).collect()
        assert sorted(r.row for r in got) == list(range(2 * size))
        assert all((r.row >= size) == (r.subset_label == 1) for r in got)


def test_bootstrap_same_for_any_partitioning(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 2, 60)
    rows = scored(spark, t, rng.random(60)).withColumn("b", F.col("score") * 0.5 + 0.3 * F.col("target")).select(
        "jet_id", "target", F.col("score").alias("a"), "b"
    )
    found = []
    for n in ("8", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made = bootstrap.paired_bootstrap(rows.repartition(int(n)), "a", "b", 1000, 5)
        found.append(sorted((r.metric, r.observed_delta, r.low, r.high) for r in made.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


def test_shuffle_keeps_class_counts(spark):
    rows = scored(spark, [0] * 30 + [1] * 12, range(42))
    made = bootstrap.shuffled_labels(rows, 7)
    assert made.agg(F.sum("target")).first()[0] == 12
    assert made.filter("target = 1").select("jet_id").collect() != rows.filter("target = 1").select("jet_id").collect()


def test_prediction_rules_and_alignment(spark):
    left = scored(spark, [0, 1, 1], [0.1, 0.2, 0.3])
    enforce(metrics.prediction_rules(left))
    enforce(metrics.alignment_rules(left, left))
    swapped = left.withColumn("pos", 2 - F.col("pos"))
    assert metrics.alignment_rules(left, swapped).count() == 2
    with pytest.raises(RuleViolation, match="PREDICTION_SCORE"):
        enforce(metrics.prediction_rules(left.withColumn("score", F.lit(float("nan")))))


def test_seed_summary_fixture(spark):
    rows = spark.createDataFrame([("A", 3, 0.7), ("A", 1, 0.5), ("A", 2, 0.6)], "c string, seed int, v double")
    row = metrics.seed_summary(rows, ["c"], "seed", "v").first()
    assert row["mean"] == pytest.approx(0.6) and row.sample_standard_deviation == pytest.approx(0.1)
    assert [p.seed for p in row.per_seed] == [1, 2, 3] and row.valid


def test_missing_track_and_pooling(spark):
    states = spark.createDataFrame([(1,), (3,), (2,)], "s int")
    assert states.agg(audit.missing_track_fraction(F.col("s"))).first()[0] == 0.5
    assert states.filter("s = 2").agg(audit.missing_track_fraction(F.col("s"))).first()[0] == 0.0
    pooled = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0], [9e9, 9e9]], [True, True, False]), ([[4.0, 4.0], [7.0, 7.0], [1.0, 1.0]], [True, False, False])],
        "d array<array<double>>, m array<boolean>",
    ).select(arrays.masked_sum(F.col("d"), F.col("m"), 2).alias("s"))
    assert [r.s for r in pooled.collect()] == [[4.0, 6.0], [4.0, 4.0]]


def test_mask_from_feature(spark):
    rows = spark.createDataFrame([([[0.0, 0.0, 1.0, 0.0], [3.0, 2.0, 0.0, 4.0], [0.0] * 4],)], "d array<array<double>>")
    row = rows.select(arrays.mask_from_feature(F.col("d"), 2).alias("a"), arrays.infer_mask(F.col("d")).alias("b")).first()
    assert row.a == [True, False, False] and row.b == [True, True, False]


def test_mask_from_feature_fails_on_missing_values(spark):
    for value in ("NULL", "double('nan')", "double('inf')"):
        bad = spark.sql(f"SELECT array(array(1.0D, {value})) AS d")
        with pytest.raises(Exception, match="missing or not finite"):
            bad.select(arrays.mask_from_feature(F.col("d"), 1)).collect()
    with pytest.raises(Exception, match="missing or not finite"):
        bad.select(arrays.mask_from_feature(F.col("d"), 2)).collect()
    with pytest.raises(ValueError):
        arrays.mask_from_feature(F.col("d"), -1)


def test_background_needs_no_match(spark):
    rows = spark.createDataFrame([(0, False), (2, False), (0, True), (1, True), (2, True)], "m int, s boolean")
    got = [r[0] for r in rows.select(match.match_status(F.col("m"), F.col("s"))).collect()]
    assert got == ["background", "background", "dropped", "matched", "EXTRACT_AMBIGUOUS_TRUTH"]


def test_named_split_excludes_unnamed_files(spark):
    names = spark.createDataFrame([("train/a-VAL.h5",), ("x/test_1",), ("x/train/b",), ("c",)], "name string")
    got = {r.name: r.split for r in ranking.named_or_ratio_split(names, "name", 1, (0.8, 0.1, 0.1)).collect()}
    assert got == {"train/a-VAL.h5": "validation", "x/test_1": "test"}
    rest = names.filter("name IN ('x/train/b', 'c')")
    assert ranking.named_or_ratio_split(rest, "name", 1, (0.8, 0.1, 0.1)).count() == 2


def test_feature_names():
    ladder, groups = {"A": ("k", "q")}, {"k": ("x", "y"), "q": ("c",)}
    names = arrays.resolve_features("A", ladder, groups)
    assert names == ["x", "y", "c"]
    assert arrays.feature_positions(names, {"x": 0, "y": 2, "c": 1}, 3) == [0, 2, 1]
    for call in (
        lambda: arrays.resolve_features("B", ladder, groups),
        lambda: arrays.resolve_features("A", ladder, {"k": ()}),
        lambda: arrays.resolve_features("A", ladder, {"k": ("x",), "q": ("x",)}),
        lambda: arrays.feature_positions(names, {"x": 0}),
        lambda: arrays.feature_positions(names, {"x": 0, "y": 0, "c": 1}),
        lambda: arrays.feature_positions(names, {"x": 0, "y": 5, "c": 1}, 3),
    ):
        with pytest.raises(ValueError):
            call()


def test_truth_match_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    jets = [(i % 5, i, float(rng.uniform(-2, 2)), float(rng.uniform(-math.pi, math.pi))) for i in range(120)]
    tops = []
    for _ in range(80):
        e, p = rng.uniform(-2, 2), rng.uniform(-math.pi, math.pi)
        near = [float(x) for _ in range(3) for x in (e + rng.normal(0, 0.3), p + rng.normal(0, 0.3))]
        tops.append((int(rng.integers(0, 5)), float(e), float(p), *near))

    def dr(e1, p1, e2, p2):
        d = (p1 - p2 + math.pi) % (2 * math.pi) - math.pi
        return math.hypot(e1 - e2, d)

    expected = {}
    for ev, j, e, p in jets:
        n = sum(t[0] == ev and all(dr(e, p, *t[i : i + 2]) < 0.8 for i in (1, 3, 5, 7)) for t in tops)
        if n:
            expected[j] = n
    found = match.truth_matches(
        spark.createDataFrame(jets, "ev int, j int, eta double, phi double"),
        spark.createDataFrame(
            tops,
            "ev int, t_eta double, t_phi double, b_eta double, b_phi double, q1_eta double, q1_phi double, q2_eta double, q2_phi double",
        ),
        ["ev"],
        ["ev", "j"],
    )
    assert {r.j: r.matches for r in found.collect()} == expected and expected


def test_copy_chain_and_cycle(spark):
    nodes = spark.createDataFrame([(i, 6) for i in range(20)], "node int, code int")
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(19)], "mother int, daughter int, ord int")
    assert {r.terminal for r in match.terminal_copies(edges, nodes).collect()} == {19}
    loop = edges.unionByName(spark.createDataFrame([(19, 0, 0)], "mother int, daughter int, ord int"))
    with pytest.raises(ValueError, match="cycle"):
        match.terminal_copies(loop, nodes, max_rounds=6)


def test_resource_fixture(spark):
    row = (1000, 10, 5.0, 20.0, 1, 10, 1, 2, 3, 20.0, 40.0, 80.0)
    names = [*ledger.RESOURCE_SUMS, *ledger.COSTS]
    made = ledger.resource_projection(spark.createDataFrame([("b", *row)], ["k", *names]), "k", 0.25).first()
    assert made.source_bytes_per_wall_second == 50.0 and made.cpu_seconds_per_event == 0.5
    assert made.file_failure_fraction == 0.1
    assert (made.e0_reserved_cost_usd, made.e1_reserved_cost_usd, made.e2_reserved_cost_usd) == (25, 50, 100)


def test_digest_depends_on_rows_not_on_layout(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    a = digest.content_digest(rows, ["id", "v"]).first().digest
    assert digest.content_digest(rows.repartition(5), ["v", "id"]).first().digest == a
    assert digest.content_digest(rows.unionByName(rows.limit(1)), ["id", "v"]).first().digest != a
    assert digest.content_digest(rows.withColumn("v", F.col("v") + 1), ["id", "v"]).first().digest != a


def test_deep_sets_scores(spark):
    assert scoring.parameter_count(4) == 12865 and scoring.parameter_count(10) == 13249
    rng = np.random.default_rng(0)
    sets = [rng.normal(size=(n, 4)) for n in (3, 1, 5)]
    data = [
        (f"j{i}", [*x.tolist(), *[[9.0] * 4] * (6 - len(x))], [True] * len(x) + [False] * (6 - len(x)))
        for i, x in enumerate(sets)
    ]
    view = spark.createDataFrame(data, "jet_id string, data array<array<double>>, mask array<boolean>")
    phi, head = scoring.seeded_weights(4, 1)
    found = {r.jet_id: r.logit for r in scoring.score_views(view, phi, head, 4).collect()}

    def plain(x):
        for w, b in phi:
            x = np.maximum(x @ w + b, 0)
        y = x.sum(axis=0)
        (w1, b1), (w2, b2) = head
        return (np.maximum(y @ w1 + b1, 0) @ w2 + b2)[0]

    for i, x in enumerate(sets):
        assert found[f"j{i}"] == pytest.approx(plain(x), abs=1e-9)


def test_contract_opens_records_to_any_depth(spark):
    """Free parts nest without a limit; described parts are checked at every item and key."""
    deep = '{"a":' * 200 + "1" + "}" * 200
    base = {
        "schema_version": "1.0.0", "e0_audit_id": "i", "evidence_id": "e", "status": "failed",
        "formal_gate_eligible": False, "missing_evidence": [], "failed_gates": ["g"], "policy_sha256": "0" * 64,
        "resource_projection": None, "observed": "DEEP", "content_sha256": "0" * 64,
    }
    good = json.dumps(base).replace('"DEEP"', deep)
    rows = [
        ("good", good),
        ("text", good.replace(deep, '"x"')),
        ("list", good.replace('["g"]', '["g", 1]')),
        ("twice", good.replace('["g"]', '["g", "g"]')),
        ("more", good.replace('{"schema', '{"other": {"b": [1]}, "schema')),
        ("less", good.replace('"evidence_id": "e", ', "")),
        ("null", good.replace('"evidence_id": "e"', '"evidence_id": null')),
        ("bad", good[:-1]),
        ("none", None),
        ("plan", good.replace('"resource_projection": null', '"resource_projection": {"events_per_wall_second": "1"}')),
    ]
    table = spark.createDataFrame(rows, "key string, json string")
    got = Counter((r.key, r.rule) for r in contracts.record_violations(table, "e0_audit").collect())
    assert got == Counter(
        {
            ("text", "CONTRACT_TYPES"): 1,
            ("list", "CONTRACT_TYPES"): 1,
            ("list", "CONTRACT_SCHEMA:failed_gates"): 1,
            ("twice", "CONTRACT_SCHEMA:failed_gates"): 1,
            ("more", "CONTRACT_UNKNOWN_PROPERTY"): 1,
            ("more", "CONTRACT_TYPES"): 1,
            ("less", "CONTRACT_SCHEMA:evidence_id"): 1,
            ("null", "CONTRACT_SCHEMA:evidence_id"): 1,
            ("bad", "CONTRACT_JSON"): 1,
            ("none", "CONTRACT_JSON"): 1,
        }
    )
    inside = [
        r.rule
        for r in contracts.record_violations(table, "e0_audit", described=True).collect()
        if r.key == "plan"
    ]
    assert "CONTRACT_SCHEMA:resource_projection.events_per_wall_second" in inside
    assert "CONTRACT_SCHEMA:resource_projection.cpu_seconds_per_event" in inside
    assert "CONTRACT_TYPES" in inside and len(inside) == 8


def test_digest_tree_finds_one_changed_member(spark):
    rows = [("big", f"m{n:05d}", f"{n * 7919 % 10007:064x}") for n in range(6000)]
    rows += [("small", "only", "0" * 64)]
    table = spark.createDataFrame(rows, "key string, name string, sha string")
    root = {r.artifact: r for r in digest.artifact_digest(table, "key", "name", "sha").collect()}
    assert root["big"].members == 6000 and root["small"].members == 1
    again = digest.artifact_digest(table.repartition(13).orderBy("sha"), "key", "name", "sha")
    assert {r.artifact: r for r in again.collect()} == root
    changed = table.withColumn("sha", F.when(F.col("name") == "m04711", "f" * 64).otherwise(F.col("sha")))
    other = {r.artifact: r.digest for r in digest.artifact_digest(changed, "key", "name", "sha").collect()}
    assert other["big"] != root["big"].digest and other["small"] == root["small"].digest
    trees = [digest.digest_tree(t, "key", "name", ["sha"], keep=True) for t in (table, changed)]
    assert len(trees[0]) == digest.TREE_DIGITS + 1
    at = digest.differing_ranges(*trees, "key").collect()
    assert [(r.key, r.range) for r in at] == [("big", hashlib.sha256(b"m04711").hexdigest()[:4])]
    moved = changed.filter("name <> 'm00001'").unionByName(
        spark.createDataFrame([("big", "new", "1" * 64)], table.schema)
    )
    found = digest.changed_members(table, moved, "key", "name", ["sha"]).collect()
    assert {tuple(r) for r in found} == {
        ("big", "m04711", "changed"), ("big", "m00001", "missing"), ("big", "new", "extra"),
    }


def test_round_robin_places_in_closed_form(spark):
    """Lanes of many sizes, limits in the thousands, several groups: equal to taking turns one by one."""
    rng = np.random.default_rng(4)
    rows = []
    for split in ("train", "test"):
        for record in range(1, 13):
            for n in range(int(rng.integers(0, 700))):
                rows.append((split, record, f"{split}-{record}-{n}", 0))
        rows += [(split, 99, f"{split}-s{n}", 1) for n in range(300)]
    table = spark.createDataFrame(rows, "split string, record_id bigint, jet_id string, label int")
    for limit in (7, 1500, 10_000):
        got = {
            (r.split, r.label, r.pos): r.jet_id
            for r in ranking.balanced_order(table, limit, 11, by=["split"]).collect()
        }
        want = {}
        for split in ("train", "test"):
            rank = lambda i: (hashlib.sha256(f"11\0{i}".encode()).hexdigest(), i)
            lanes = {}
            for s, record, jet, label in rows:
                if s == split:
                    lanes.setdefault(-1 if label else record, []).append(jet)
            queues = {k: sorted(v, key=rank) for k, v in lanes.items()}
            signal = queues.pop(-1)
            order = [
                queues[k][turn]
                for turn in range(max(map(len, queues.values())))
                for k in sorted(queues)
                if turn < len(queues[k])
            ]
            want |= {(split, 0, n): j for n, j in enumerate(order[:limit], 1)}
            want |= {(split, 1, n): j for n, j in enumerate(signal[:limit], 1)}
        assert got == want, limit
