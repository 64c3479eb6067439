"""Registered queries: identities, splits, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.operators import ranking, split
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query

SEED = tables.SUBSET_SEED
SIZES = tables.SUBSET_SIZES


@query(
    "split_partition_report",
    f"""WITH {sv.JETS}, {sv.MANIFEST},
e AS (SELECT split, record_id, run, lumi, event, count(*) FILTER (target = 0) AS n0,
        count(*) FILTER (target = 1) AS n1 FROM jets GROUP BY ALL),
s AS (SELECT split, count(*) AS event_count, sum(n0) AS n0, sum(n1) AS n1 FROM e GROUP BY split),
f AS (SELECT {sv.split_of('sha256(canonical_pfn)')} AS split, count(*) AS file_count
      FROM manifest GROUP BY 1)
SELECT x.split, coalesce(file_count, 0)::BIGINT AS file_count,
  coalesce(event_count, 0)::BIGINT AS event_count, coalesce(n0, 0)::BIGINT AS background_jets,
  coalesce(n1, 0)::BIGINT AS signal_jets
FROM (VALUES ('train'), ('validation'), ('test')) AS x(split)
LEFT JOIN f USING (split) LEFT JOIN s USING (split)""",
)
def split_partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.partition_report(tables.jets(spark, sf_dir), tables.manifest(spark, sf_dir))


@query(
    "record_jet_counts",
    f"WITH {sv.JETS} SELECT split, record_id, count(*)::BIGINT AS jets FROM jets GROUP BY ALL",
)
def record_jet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.record_counts(tables.jets(spark, sf_dir))


@query(
    "stable_ids",
    f"WITH {sv.JETS} SELECT o_orderkey, jet_id, bucket::INTEGER AS bucket, split FROM jets",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jets(spark, sf_dir).select("o_orderkey", "jet_id", "bucket", "split")


def _merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jets whose event number was cut to 32-bit-like blocks, so identities collide."""
    raw = tables.jets(spark, sf_dir).drop("pfn_sha256", "bucket", "split", "jet_id")
    return split.with_identity(
        raw.withColumn("event", F.col("event") % 997 + 1).withColumn("lumi", F.lit(1).cast("bigint"))
    )


_MERGED = f"""{sv.JETS}, merged AS (
  SELECT record_id, canonical_pfn, split, 1::BIGINT AS run, 1::BIGINT AS lumi,
    (event % 997 + 1)::BIGINT AS event, jet_index,
    'cms:' || record_id || ':' || pfn_sha256 || ':1:1:' || (event % 997 + 1) || ':' || jet_index
      AS jet_id FROM jets)"""


@query(
    "id_duplicates",
    f"""WITH {_MERGED} SELECT 'SPLIT_IDENTITY_DUPLICATE' AS rule, jet_id AS key,
  'count=' || count(*) AS detail FROM merged GROUP BY jet_id HAVING count(*) > 1""",
)
def id_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.repeated_ids(_merged_ids(spark, sf_dir))


@query(
    "event_disjointness",
    f"""WITH {_MERGED} SELECT 'SPLIT_EVENT_OVERLAP' AS rule,
  record_id || ':' || run || ':' || lumi || ':' || event AS key,
  min(split) || ',' || max(split) AS detail
FROM merged GROUP BY record_id, run, lumi, event HAVING min(split) <> max(split)""",
)
def event_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.event_overlaps(_merged_ids(spark, sf_dir))


_PROVENANCE = f"""{sv.JETS}, {sv.MANIFEST},
known AS (SELECT record_id, canonical_pfn FROM manifest WHERE file_no <> record_id % 8
  UNION ALL SELECT record_id, canonical_pfn || '.bak' FROM manifest WHERE file_no = 0),
seen AS (SELECT record_id, canonical_pfn, count(*) AS n FROM jets GROUP BY ALL)"""


@query(
    "provenance_gaps",
    f"""WITH {_PROVENANCE}
SELECT 'DATA_PROVENANCE_UNKNOWN_SOURCE' AS rule, record_id || ':' || canonical_pfn AS key,
  'jets=' || n AS detail FROM seen ANTI JOIN known USING (record_id, canonical_pfn)
UNION ALL
SELECT 'DATA_PROVENANCE_NO_JETS', record_id || ':' || canonical_pfn, ''
FROM known ANTI JOIN seen USING (record_id, canonical_pfn)""",
)
def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest lacks one file per record and lists one file nobody read."""
    listed = tables.manifest(spark, sf_dir)
    file_no = F.regexp_extract("canonical_pfn", r"file-(\d+)", 1).cast("bigint")
    known = listed.filter(file_no != F.col("record_id") % 8).unionByName(
        listed.filter(file_no == 0).withColumn(
            "canonical_pfn", F.concat("canonical_pfn", F.lit(".bak"))
        )
    )
    return split.source_pair_gaps(tables.jets(spark, sf_dir), known)


@query(
    "source_role_rules",
    f"""WITH {sv.JETS}, {sv.MANIFEST}, {sv.ROLES},
m AS (SELECT canonical_pfn,
        CASE WHEN file_no = 3 THEN record_id + 1 ELSE record_id END AS manifest_record FROM manifest),
seen AS (SELECT DISTINCT canonical_pfn, record_id,
        CASE WHEN record_id % 7 = 0 THEN 1 ELSE target END AS target FROM jets),
j AS (SELECT * FROM seen LEFT JOIN m USING (canonical_pfn) LEFT JOIN roles USING (record_id))
SELECT 'SPLIT_SOURCE_IDENTITY' AS rule, record_id || ':' || canonical_pfn AS key, '' AS detail
FROM j WHERE manifest_record IS NULL OR manifest_record <> record_id
UNION ALL
SELECT 'SPLIT_TARGET_MISMATCH', record_id || ':' || canonical_pfn, ''
FROM j WHERE target <> CASE role WHEN 'signal' THEN 1 ELSE 0 END""",
)
def source_role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jets against a manifest with wrong records and jets with wrong classes."""
    listed = tables.manifest(spark, sf_dir).withColumn(
        "record_id",
        F.when(F.col("canonical_pfn").contains("file-3."), F.col("record_id") + 1).otherwise(
            F.col("record_id")
        ),
    )
    jets = tables.jets(spark, sf_dir).withColumn(
        "target",
        F.when(F.col("record_id") % 7 == 0, F.lit(1).cast("tinyint")).otherwise(F.col("target")),
    )
    return split.source_rules(jets, listed, tables.roles(spark, sf_dir))


@query(
    "record_role_gaps",
    f"""WITH {sv.JETS}, {sv.ROLES},
r AS (SELECT * FROM roles WHERE record_id % 6 <> 0
  UNION ALL SELECT record_id + 500, role FROM roles WHERE role = 'signal'),
m AS (SELECT DISTINCT record_id FROM jets)
SELECT record_id, CASE WHEN b THEN 'left' ELSE 'right' END AS missing_in FROM (
  SELECT record_id, FALSE AS b FROM m ANTI JOIN r USING (record_id)
  UNION ALL SELECT record_id, TRUE FROM r ANTI JOIN m USING (record_id))""",
)
def record_role_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables.roles(spark, sf_dir)
    declared = base.filter("record_id % 6 <> 0").unionByName(
        base.filter("role = 'signal'").withColumn("record_id", F.col("record_id") + 500)
    )
    return split.set_difference(tables.jets(spark, sf_dir), declared, ["record_id"])


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pool joins roles itself, so the table's own role column is left out.
    return split.training_pool(
        tables.jets(spark, sf_dir).drop("role"), tables.roles(spark, sf_dir)
    ).select("record_id", "jet_id", F.col("target").alias("label"))


def _subset_sql(seed: str, by: str = "", where: str = "split = 'train' AND (target = 1 OR role = 'qcd_active')") -> str:
    keys = f"{by}, " if by else ""
    return f"""turns AS (
  SELECT {keys}record_id, jet_id, target AS label, row_number() OVER (
    PARTITION BY {keys}target, CASE target WHEN 1 THEN -1 ELSE record_id END
    ORDER BY {sv.rank_of(seed, 'jet_id')}, jet_id) AS turn
  FROM jets WHERE {where}),
ordered AS (
  SELECT {keys}label, jet_id, row_number() OVER (
    PARTITION BY {keys}label ORDER BY turn, CASE label WHEN 1 THEN -1 ELSE record_id END) AS pos
  FROM turns)"""


@query(
    "nested_subsets",
    f"""WITH {sv.JETS}, {_subset_sql(f"'{SEED}'")}
SELECT 'n' || size AS subset_id, size, label, pos::BIGINT AS pos, jet_id
FROM ordered JOIN (VALUES {', '.join(f'({n})' for n in SIZES)}) AS t(size) ON pos <= size""",
)
def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = ranking.balanced_order(_pool(spark, sf_dir), SIZES[-1], SEED)
    return ranking.subset_members(ordered, SIZES)


@query(
    "subset_nestedness",
    f"""WITH {sv.JETS}, {_subset_sql(f"'{SEED}'")},
m AS (SELECT size, label, pos, jet_id FROM ordered
  JOIN (VALUES {', '.join(f'({n})' for n in (*SIZES, 1000000))}) AS t(size) ON pos <= size),
c AS (SELECT size, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
  FROM m GROUP BY size)
SELECT 'SPLIT_INSUFFICIENT_CLASS_YIELD' AS rule, 'n' || size AS key,
  'class0=' || n0 || ' class1=' || n1 AS detail FROM c WHERE n0 < size OR n1 < size
UNION ALL
SELECT 'SPLIT_NOT_NESTED', label || ':' || pos, min(jet_id) || ',' || max(jet_id)
FROM m GROUP BY label, pos HAVING min(jet_id) <> max(jet_id)""",
)
def subset_nestedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last size asks for more rows than there are, which must be reported."""
    sizes = (*SIZES, 1000000)
    ordered = ranking.balanced_order(_pool(spark, sf_dir), sizes[-1], SEED)
    members = ranking.subset_members(ordered, sizes)
    return ranking.yield_violations(members, sizes).unionByName(ranking.nested_violations(members))


_SPLIT_SEED = "CASE split WHEN 'train' THEN '20260720' WHEN 'validation' THEN '20260721' ELSE '20260722' END"


@query(
    "split_subsets",
    f"""WITH {sv.JETS}, {_subset_sql(f'({_SPLIT_SEED})', 'split', "role <> 'qcd_candidate'")}
SELECT split, 'n' || size AS subset_id, size, label, pos::BIGINT AS pos, jet_id
FROM ordered JOIN (VALUES (5), (20)) AS t(size) ON pos <= size""",
)
def split_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets drawn inside every split, each split with its own seed."""
    jets = tables.jets(spark, sf_dir).filter("role <> 'qcd_candidate'")
    rows = jets.select("split", "record_id", "jet_id", F.col("target").alias("label"))
    seed = F.expr(_SPLIT_SEED)
    ordered = ranking.balanced_order(rows, 20, seed, by=["split"])
    return ranking.subset_members(ordered, (5, 20), by=["split"])


@query(
    "file_assigned_once",
    """SELECT 'SPLIT_PFN_OVERLAP' AS rule, canonical_pfn AS key, 'count=' || count(*) AS detail
FROM (SELECT 'file-' || (doc_id - (doc_id % 17 = 4)::INTEGER) AS canonical_pfn FROM documents)
GROUP BY canonical_pfn HAVING count(*) > 1""",
)
def file_assigned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assigned files, some of them under the name of the one before."""
    k = F.col("doc_id")
    name = F.concat(F.lit("file-"), (k - (k % 17 == 4).cast("int")).cast("string"))
    files = tables.table(spark, sf_dir, "documents").select(name.alias("canonical_pfn"))
    return split.repeated_files(files)


@query(
    "file_split_named",
    """WITH files AS (SELECT 'latest/' || CASE doc_id % 11 WHEN 3 THEN 'Train' WHEN 5 THEN 'val' WHEN 7 THEN 'test'
    ELSE 'part' END || '-' || doc_id || '.h5' AS name, doc_id % 11 AS kind FROM documents)
SELECT name, CASE kind WHEN 3 THEN 'train' WHEN 5 THEN 'validation' ELSE 'test' END AS split FROM files
WHERE kind IN (3, 5, 7)""",
)
def file_split_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where names tell the split, the named files are taken and nothing is drawn."""
    kind = F.col("doc_id") % 11
    word = F.when(kind == 3, "Train").when(kind == 5, "val").when(kind == 7, "test").otherwise("part")
    name = F.concat(F.lit("latest/"), word, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".h5"))
    files = tables.table(spark, sf_dir, "documents").select(name.alias("name"))
    return ranking.named_or_ratio_split(files, "name", 7, (0.8, 0.1, 0.1))


@query(
    "file_split_ratio",
    f"""WITH files AS (SELECT source || '/doc-' || doc_id || '.h5' AS name FROM documents),
r AS (SELECT name, row_number() OVER (ORDER BY {sv.rank_of("'7'", 'name')}, name) AS place,
        count(*) OVER () AS n FROM files),
s AS (SELECT name, place, n, round_even(n * 0.8::DOUBLE, 0) AS n_train,
        least(round_even(n * 0.1::DOUBLE, 0), n - round_even(n * 0.8::DOUBLE, 0)) AS n_val FROM r)
SELECT name, CASE WHEN place <= n_train THEN 'train' WHEN place <= n_train + n_val THEN 'validation'
  ELSE 'test' END AS split FROM s""",
)
def file_split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".h5")).alias("name")
    )
    return ranking.named_or_ratio_split(files, "name", 7, (0.8, 0.1, 0.1))
