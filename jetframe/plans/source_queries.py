"""Registered queries: manifests, inventories, file sets, predictions, scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jetframe.operators import canonical, digest, fit, scoring, views
from jetframe.plans import sql_views as sv
from jetframe.plans import tables
from jetframe.plans.catalog import query
from jetframe.schema import JET_FIELDS, PARALLEL_ARRAYS, PARALLEL_JETS
from jetframe.session import shared_folder, stored
from jetframe.sources import files as files_source
from jetframe.sources import manifest as manifest_source
from jetframe.sources import tables as table_source


def _manifest_line() -> Column:
    k = F.col("o_orderkey")
    line = F.concat_ws(
        "\t",
        F.when(k % 211 == 0, F.lit("0")).when(k % 223 == 0, F.lit("x1")).otherwise(
            (F.lit(18000) + k % 5).cast("string")
        ),
        F.when(k % 227 == 0, F.lit("")).otherwise(
            F.concat(F.lit("root://f/"), F.lpad(F.when(k % 7 == 0, F.floor(k / 20)).otherwise(k).cast("string"), 9, "0"))
        ),
        F.when(k % 229 == 0, F.lit("zz")).otherwise(F.substring(F.md5(k.cast("string")), 1, 8)),
        F.when(k % 233 == 0, F.lit("0")).otherwise((k + 1).cast("string")),
    )
    line = F.when(k % 239 == 0, F.concat(line, F.lit("\textra"))).otherwise(line)
    return line


def _manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per ten orders with a line per order; faults are planted by key.

    Lines stand in order key order, so their records are mostly out of order; names repeat
    where the key is a multiple of seven.
    """
    line = _manifest_line()
    k = F.col("o_orderkey")
    grouped = (
        tables.table(spark, sf_dir, "orders")
        .groupBy(F.floor(k / 10).alias("m"))
        .agg(F.array_sort(F.collect_list(F.struct(k, line.alias("line")))).alias("lines"))
    )
    body = F.concat(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), F.lit("\n"))
    m = F.col("m")
    content = (
        F.when(m % 41 == 0, F.concat(F.unhex(F.lit("EFBBBF")), body.cast("binary")))
        .when(m % 43 == 0, F.concat(body.cast("binary"), F.lit(b"\r\n")))
        .otherwise(body.cast("binary"))
    )
    return grouped.select(m.cast("string").alias("path"), content.alias("content"))


_LINES = """l AS (SELECT o_orderkey // 10 AS m, o_orderkey AS k,
  row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS line_no FROM orders),
f AS (SELECT *, m || ':' || line_no AS key, k % 239 = 0 AS wide, k % 227 = 0 AS blank, k % 211 = 0 AS zero,
  k % 223 = 0 AND k % 211 <> 0 AS bad, CASE WHEN k % 211 = 0 THEN 0 ELSE 18000 + k % 5 END AS record_id,
  'root://f/' || lpad((CASE WHEN k % 7 = 0 THEN k // 20 ELSE k END)::VARCHAR, 9, '0') AS pfn, m % 41 = 0 AS bom, m % 43 = 0 AND m % 41 <> 0 AS crlf FROM l),
-- A byte order mark glues to the first number, which then is not a number.
g AS (SELECT *, NOT wide AND NOT blank AS filled, bad OR (bom AND line_no = 1) AS nonum FROM f),
o AS (SELECT * FROM g WHERE filled AND NOT nonum),
w AS (SELECT *, lag(record_id) OVER v AS r0, lag(pfn) OVER v AS p0 FROM o WINDOW v AS (PARTITION BY m ORDER BY line_no)),
tail AS (SELECT m, max(line_no) + 1 AS line_no FROM f WHERE crlf GROUP BY m)"""


@query(
    "manifest_violations",
    f"""WITH {_LINES}
SELECT DISTINCT 'MANIFEST_BOM' AS rule, m::VARCHAR AS key, '' AS detail FROM f WHERE bom
UNION ALL SELECT DISTINCT 'MANIFEST_LINE_ENDING', m::VARCHAR, '' FROM f WHERE crlf
UNION ALL SELECT 'MANIFEST_FIELD_COUNT', key, '' FROM g WHERE wide
UNION ALL SELECT 'MANIFEST_FIELD_COUNT', m || ':' || line_no, '' FROM tail
UNION ALL SELECT 'MANIFEST_EMPTY_FIELD', key, '' FROM g WHERE NOT wide AND blank
UNION ALL SELECT 'MANIFEST_FIELD_VALUE', key, '' FROM g WHERE filled AND nonum
UNION ALL SELECT 'MANIFEST_RECORD_ID', key, '' FROM o WHERE zero
UNION ALL SELECT 'MANIFEST_CHECKSUM', key, '' FROM o WHERE k % 229 = 0
UNION ALL SELECT 'MANIFEST_SIZE', key, '' FROM o WHERE k % 233 = 0
UNION ALL SELECT 'MANIFEST_DUPLICATE_PFN', m || ':' || pfn, 'count=' || count(*) FROM o GROUP BY m, pfn HAVING count(*) > 1
UNION ALL SELECT 'MANIFEST_ORDER', key, '' FROM w WHERE r0 > record_id OR r0 = record_id AND p0 > pfn""",
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_source.manifest_violations(_manifest_files(spark, sf_dir))


_RANGE_LINES = """l AS (SELECT o_orderkey % 4 AS m, o_orderkey AS k,
  row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS line_no FROM orders),
f AS (SELECT *, m || ':' || line_no AS key, k % 239 = 0 AS wide, k % 227 = 0 AS blank, k % 211 = 0 AS zero,
  k % 223 = 0 AND k % 211 <> 0 AS bad, CASE WHEN k % 211 = 0 THEN 0 ELSE 18000 + k % 5 END AS record_id,
  'root://f/' || lpad((CASE WHEN k % 7 = 0 THEN k // 20 ELSE k END)::VARCHAR, 9, '0') AS pfn, m = 1 AS bom,
  m = 2 AND k % 241 = 0 AS cr FROM l),
-- A carriage return at the end of the last field is taken for space around a number, as in the reader.
g AS (SELECT *, NOT wide AND NOT blank AS filled, bad OR (bom AND line_no = 1) AS nonum FROM f),
o AS (SELECT * FROM g WHERE filled AND NOT nonum),
w AS (SELECT *, lag(record_id) OVER v AS r0, lag(pfn) OVER v AS p0 FROM o WINDOW v AS (PARTITION BY m ORDER BY line_no))"""


@query(
    "manifest_ranges",
    f"""WITH {_RANGE_LINES}
SELECT DISTINCT 'MANIFEST_BOM' AS rule, m::VARCHAR AS key, '' AS detail FROM f WHERE bom
UNION ALL SELECT DISTINCT 'MANIFEST_LINE_ENDING', m::VARCHAR, '' FROM f WHERE cr
UNION ALL SELECT 'MANIFEST_FIELD_COUNT', key, '' FROM g WHERE wide
UNION ALL SELECT 'MANIFEST_EMPTY_FIELD', key, '' FROM g WHERE NOT wide AND blank
UNION ALL SELECT 'MANIFEST_FIELD_VALUE', key, '' FROM g WHERE filled AND nonum
UNION ALL SELECT 'MANIFEST_RECORD_ID', key, '' FROM o WHERE zero
UNION ALL SELECT 'MANIFEST_CHECKSUM', key, '' FROM o WHERE k % 229 = 0
UNION ALL SELECT 'MANIFEST_SIZE', key, '' FROM o WHERE k % 233 = 0
UNION ALL SELECT 'MANIFEST_DUPLICATE_PFN', m || ':' || pfn, 'count=' || count(*) FROM o GROUP BY m, pfn HAVING count(*) > 1
UNION ALL SELECT 'MANIFEST_ORDER', key, '' FROM w WHERE r0 > record_id OR r0 = record_id AND p0 > pfn""",
)
def manifest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as four manifests on disk, written below the shared folder and read by ranges of 16 KiB, or of
    more where that would make too many."""
    folder = f"{shared_folder(spark).rstrip('/')}/manifests-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    line = F.when((k % 4 == 2) & (k % 241 == 0), F.concat(_manifest_line(), F.lit("\r"))).otherwise(
        _manifest_line()
    )
    orders = tables.table(spark, sf_dir, "orders").select(k, (k % 4).alias("m"), line.alias("line"))
    first = Window.partitionBy("m").orderBy("o_orderkey")
    marked = F.when((F.col("m") == 1) & (F.row_number().over(first) == 1), F.lit("\ufeff")).otherwise("")
    orders.select("m", F.concat(marked, "line").alias("value")).write.partitionBy("m").text(folder)
    files = files_source.list_files(spark, folder).filter(F.col("path").endswith(".txt"))
    with manifest_source.range_size(spark, manifest_source.size_of_ranges(files, 16 << 10)):
        ranges = stored(manifest_source.read_ranges(spark, folder))
    number = F.regexp_extract("path", r"/m=(\d+)/", 1)
    found = manifest_source.range_violations(
        ranges.withColumn("path", number), files.withColumn("path", number)
    )
    return found.select("rule", "key", "detail")


def _inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inventory document per lumi section of a thousand orders, with planted faults."""
    k = F.col("o_orderkey")
    jets = tables.jets(spark, sf_dir)
    jet = F.struct(
        "record_id",
        F.when(k % 307 == 0, F.lit("")).otherwise(F.col("canonical_pfn")).alias("canonical_pfn"),
        "run",
        "lumi",
        F.when(k % 311 == 0, F.lit(0).cast("bigint")).otherwise(F.col("event")).alias("event"),
        "jet_index",
        F.when(k % 313 == 0, F.lit(2)).otherwise(F.col("target").cast("int")).alias("target"),
    )
    # A document holds at most a thousand jets, the width of a lumi section.
    return jets.groupBy(F.col("lumi").cast("string").alias("source")).agg(
        F.array_sort(F.collect_list(F.struct(k, jet.alias("jet")))).alias("held")
    ).select(
        "source",
        F.when(F.col("source").cast("bigint") % 4 == 0, F.lit("2.0.0")).otherwise(F.lit("1.0.0")).alias(
            "schema_version"
        ),
        F.struct(
            F.lit("canonical").alias("path"),
            F.sha2("source", 256).alias("sha256"),
            F.lit(1).cast("bigint").alias("byte_size"),
        ).alias("canonical_dataset"),
        F.transform("held", lambda s: s["jet"]).alias("jets"),
    ).unionByName(
        # Regions stand for documents without jets.
        tables.table(spark, sf_dir, "region").select(
            F.concat(F.lit("empty-"), "r_name").alias("source"),
            F.lit("1.0.0").alias("schema_version"),
            F.struct(
                F.lit("canonical").alias("path"),
                F.sha2("r_name", 256).alias("sha256"),
                F.lit(1).cast("bigint").alias("byte_size"),
            ).alias("canonical_dataset"),
            F.array().cast(f"array<{jets.select(jet.alias('j')).schema['j'].dataType.simpleString()}>").alias("jets"),
        )
    )


_INVENTORY = f"""{sv.JETS}, i AS (SELECT *, lumi || ':' || (row_number() OVER (PARTITION BY lumi ORDER BY o_orderkey) - 1)
  AS key FROM jets)"""


@query(
    "inventory_explode",
    f"""WITH {_INVENTORY} SELECT lumi::VARCHAR AS source, split_part(key, ':', 2)::INTEGER AS pos, record_id,
  CASE WHEN o_orderkey % 311 = 0 THEN 0 ELSE event END AS event,
  CASE WHEN o_orderkey % 313 = 0 THEN 2 ELSE target END::INTEGER AS target FROM i
UNION ALL SELECT 'empty-' || r_name, NULL, NULL, NULL, NULL FROM region""",
)
def inventory_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_source.inventory_rows(_inventories(spark, sf_dir)).select(
        "source", "pos", "record_id", "event", "target"
    )


@query(
    "inventory_violations",
    f"""WITH {_INVENTORY} SELECT 'CONTRACT_UNSUPPORTED_MAJOR' AS rule, key, '' AS detail FROM i WHERE lumi % 4 = 0
UNION ALL SELECT 'CONTRACT_VALUE:canonical_pfn', key, '' FROM i WHERE o_orderkey % 307 = 0
UNION ALL SELECT 'CONTRACT_VALUE:target', key, '' FROM i WHERE o_orderkey % 313 = 0
UNION ALL SELECT 'SPLIT_IDENTITY_VALUE:event', key, '' FROM i WHERE o_orderkey % 311 = 0
UNION ALL SELECT 'CONTRACT_EMPTY:jets', 'empty-' || r_name || ':-', '' FROM region""",
)
def inventory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_source.inventory_violations(table_source.inventory_rows(_inventories(spark, sf_dir)))


_KEY_FAULTS = r"""CASE
  WHEN o_orderkey % 101 = 0 THEN replace(jet, '{', '{"extra":1,')
  WHEN o_orderkey % 103 = 0 THEN regexp_replace(jet, '"record_id":[0-9]+', '"record_id":true')
  WHEN o_orderkey % 107 = 0 THEN regexp_replace(jet, '"event":([0-9]+)', '"event":"$1"')
  WHEN o_orderkey % 109 = 0 THEN regexp_replace(jet, '"lumi":([0-9]+)', '"lumi":$1.0')
  WHEN o_orderkey % 113 = 0 THEN regexp_replace(jet, '"run":[0-9]+,', '')
  WHEN o_orderkey % 127 = 0 THEN regexp_replace(jet, '"target":[0-9]+', '"target":2')
  WHEN o_orderkey % 131 = 0 THEN regexp_replace(jet, '"jet_index":[0-9]+', '"jet_index":null')
  ELSE jet END"""


@query(
    "inventory_keys",
    f"""WITH {_INVENTORY}, f AS (SELECT key, o_orderkey AS k, [101, 103, 107, 109, 113, 127, 131] AS ms FROM i),
w AS (SELECT key, list_filter(ms, lambda m: k % m = 0)[1] AS m FROM f)
SELECT 'CONTRACT_UNKNOWN_PROPERTY' AS rule, key, '' AS detail FROM w WHERE m = 101
UNION ALL SELECT 'CONTRACT_TYPES', key, '' FROM w WHERE m IN (101, 103, 107, 109)
UNION ALL SELECT 'CONTRACT_SCHEMA:' || CASE m WHEN 103 THEN 'record_id' WHEN 107 THEN 'event' WHEN 109 THEN 'lumi'
  WHEN 113 THEN 'run' WHEN 127 THEN 'target' ELSE 'jet_index' END, key, '' FROM w WHERE m > 101
UNION ALL SELECT DISTINCT 'CONTRACT_SCHEMA:schema_version', lumi::VARCHAR, '' FROM jets WHERE lumi % 4 = 0
UNION ALL SELECT DISTINCT 'CONTRACT_SCHEMA:canonical_dataset.byte_size', lumi::VARCHAR, '' FROM jets WHERE lumi % 5 = 0
UNION ALL SELECT DISTINCT 'CONTRACT_TYPES', lumi::VARCHAR, '' FROM jets WHERE lumi % 5 = 0 OR lumi % 7 = 0
UNION ALL SELECT DISTINCT 'CONTRACT_UNKNOWN_PROPERTY', lumi::VARCHAR, '' FROM jets WHERE lumi % 7 = 0
UNION ALL SELECT 'CONTRACT_EMPTY:jets', 'empty-' || r_name, '' FROM region""",
)
def inventory_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory documents written below the shared folder and read as VARIANT: keys and types as they stand."""
    k = F.col("o_orderkey")
    jet = F.to_json(F.struct("record_id", "canonical_pfn", "run", "lumi", "event", "jet_index", "target"))
    jets = tables.jets(spark, sf_dir).select(k, "lumi", jet.alias("jet"))
    faulty = jets.select(k, "lumi", F.expr(_KEY_FAULTS).alias("jet"))
    held = faulty.groupBy(F.col("lumi").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct(k, "jet"))).alias("held")
    )
    n = F.col("n")
    documents = held.select(
        n.cast("string").alias("name"),
        F.when(n % 4 == 0, F.lit("2.0.0")).otherwise(F.lit("1.0.0")).alias("version"),
        F.when(n % 5 == 0, F.lit("1.5")).otherwise(F.lit("1")).alias("size"),
        F.when(n % 7 == 0, F.lit('"more":{"a":1},')).otherwise(F.lit("")).alias("more"),
        F.array_join(F.transform("held", lambda h: h["jet"]), ",").alias("jets"),
    ).unionByName(
        tables.table(spark, sf_dir, "region").select(
            F.concat(F.lit("empty-"), "r_name").alias("name"),
            F.lit("1.0.0").alias("version"),
            F.lit("1").alias("size"),
            F.lit("").alias("more"),
            F.lit("").alias("jets"),
        )
    )
    text = F.format_string(
        '{%s"schema_version":"%s","canonical_dataset":{"path":"%s","sha256":"%s","byte_size":%s},"jets":[%s]}',
        "more", "version", "name", F.sha2("name", 256), "size", "jets",
    )
    path = _folder(spark, "inventories")
    documents.select(text.alias("value")).write.text(path)
    read = table_source.read_inventory_documents(spark, path, lines=True)
    named = read.withColumn("source", F.try_variant_get("v", "$.canonical_dataset.path", "string"))
    return table_source.inventory_contract(named)


@query("file_inventory")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table files themselves: relative path, SHA-256 and size."""
    return files_source.file_inventory(spark, sf_dir)


@query(
    "file_discovery",
    """SELECT source || '/doc-' || doc_id || ext AS path, n_chars AS length
FROM (SELECT *, (['.h5', '.HDF5', '.hdf', '.txt', '.h5.part'])[(doc_id % 5 + 1)::INTEGER] AS ext FROM documents)
WHERE doc_id % 5 < 3 AND source <> 'src3'""",
)
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds below their source; one source is excluded."""
    kinds = F.array(*[F.lit(x) for x in (".h5", ".HDF5", ".hdf", ".txt", ".h5.part")])
    name = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"))
    files = tables.table(spark, sf_dir, "documents").select(
        F.concat(name, F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("path"),
        F.col("n_chars").alias("length"),
    )
    return files_source.discover(files, excluded=("src3",))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payload files: the source is the artifact, the text is the content."""
    return tables.table(spark, sf_dir, "documents").select(
        F.col("source").alias("artifact"),
        F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("byte_size"),
        "doc_id",
    )


@query(
    "file_verify",
    """SELECT source || '/doc-' || doc_id AS path, CASE WHEN doc_id % 29 = 0 THEN 'missing' WHEN doc_id % 31 = 0 THEN 'extra'
  ELSE 'changed' END AS state FROM documents
WHERE (doc_id % 29 = 0 OR doc_id % 31 = 0 OR doc_id % 37 = 0) AND NOT (doc_id % 29 = 0 AND doc_id % 31 = 0)""",
)
def file_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded inventory against the documents with some gone, some new, some changed."""
    rows = _payload(spark, sf_dir)
    d = F.col("doc_id")
    recorded = rows.filter(d % 31 != 0)
    observed = rows.filter(d % 29 != 0).withColumn(
        "byte_size", F.when(d % 37 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size"))
    )
    return files_source.inventory_differences(recorded, observed)


def _tree_sql(members: str) -> str:
    """CTEs ``t4`` (smallest ranges) to ``t0`` (roots) over ``members(artifact, name, line)``."""
    levels = [
        f"""t4 AS (SELECT artifact, substr(sha256(name), 1, 4) AS range, count(*) AS members,
  sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM {members} GROUP BY ALL)"""
    ]
    for n in range(3, -1, -1):
        levels.append(
            f"""t{n} AS (SELECT artifact, substr(range, 1, {n}) AS up, sum(members) AS members,
  sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range)) AS digest FROM t{n + 1} GROUP BY ALL)""".replace(
                " AS up", " AS range"
            ).replace("GROUP BY ALL", f"GROUP BY artifact, substr(range, 1, {n})")
        )
    return ",\n".join(levels)


@query(
    "artifact_digest",
    f"""WITH n AS (SELECT source || '/model' AS artifact, source || '/model' || CASE WHEN doc_id % 10 = 0 THEN '.index'
  ELSE '.data-' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || '-of-00100' END AS name, sha256(text) AS sha FROM documents),
m AS (SELECT artifact, name, name || chr(9) || sha AS line FROM n), {_tree_sql('m')}
SELECT artifact, members::BIGINT AS members, digest FROM t0""",
)
def artifact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of one model per source, grouped by the shard name rule."""
    d = F.col("doc_id")
    name = F.concat(
        "artifact",
        F.lit("/model"),
        F.when(d % 10 == 0, F.lit(".index")).otherwise(
            F.concat(F.lit(".data-"), F.lpad((d % 100000).cast("string"), 5, "0"), F.lit("-of-00100"))
        ),
    )
    shards = _payload(spark, sf_dir).select(
        name.alias("name"), digest.artifact_key(name).alias("key"), F.col("sha256").alias("sha")
    )
    return digest.artifact_digest(shards, "key", "name", "sha")


def _then_and_now(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recorded and present files: in two sources some are gone, new or changed."""
    rows = _payload(spark, sf_dir)
    d, touched = F.col("doc_id"), F.col("artifact").isin("src1", "src4")
    recorded = rows.filter(~touched | (d % 31 != 0))
    observed = rows.filter(~touched | (d % 29 != 0)).withColumn(
        "sha256", F.when(touched & (d % 37 == 0), F.sha2("path", 256)).otherwise(F.col("sha256"))
    )
    return recorded, observed


@query(
    "artifact_changes",
    """SELECT source AS artifact, source || '/doc-' || doc_id AS path, CASE WHEN doc_id % 29 = 0 THEN 'missing'
  WHEN doc_id % 31 = 0 THEN 'extra' ELSE 'changed' END AS state FROM documents
WHERE source IN ('src1', 'src4') AND (doc_id % 29 = 0 OR doc_id % 31 = 0 OR doc_id % 37 = 0)
  AND NOT (doc_id % 29 = 0 AND doc_id % 31 = 0)""",
)
def artifact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in the file sets, found by descending their digest trees."""
    recorded, observed = _then_and_now(spark, sf_dir)
    return digest.changed_members(recorded, observed, "artifact", "path", files_source.RECORD)


@query(
    "artifact_verify",
    """WITH s AS (SELECT source, bool_or(source IN ('src1', 'src4') AND (doc_id % 29 = 0 OR doc_id % 31 = 0
    OR doc_id % 37 = 0) AND NOT (doc_id % 29 = 0 AND doc_id % 31 = 0)) AS changed FROM documents GROUP BY source)
SELECT 'ARTIFACT_INCOMPLETE' AS rule, source AS key, '' AS detail FROM s WHERE source IN ('src2', 'src6')
UNION ALL SELECT 'ARTIFACT_RESUME_MISMATCH', source, '' FROM s WHERE source IN ('src3', 'src5')
UNION ALL SELECT 'ARTIFACT_HASH_MISMATCH', source, '' FROM s WHERE changed AND source NOT IN ('src2', 'src6')
UNION ALL SELECT 'ARTIFACT_EMPTY', r_name, '' FROM region
UNION ALL SELECT 'ARTIFACT_RESUME_MISMATCH', r_name, '' FROM region""",
)
def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers against files and requests: some not finished, some asked for with other inputs, some changed;
    regions have markers without files or requests."""
    recorded, observed = _then_and_now(spark, sf_dir)
    name = F.col("artifact")
    request = recorded.select("artifact").distinct().select(
        name,
        F.create_map(F.lit("manifest"), F.md5(name), F.lit("view"), F.sha2(name, 256)).alias("input_hashes"),
        F.sha2(F.concat(name, F.lit("config")), 256).alias("config_sha256"),
    )
    markers = files_source.completion_markers(recorded, request).filter(~name.isin("src2", "src6"))
    gone = tables.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("artifact"),
        F.lit(1).cast("bigint").alias("members"),
        F.sha2("r_name", 256).alias("artifact_sha256"),
        F.create_map(F.lit("manifest"), F.md5("r_name")).alias("input_hashes"),
        F.lit("c").alias("config_sha256"),
    )
    asked = request.withColumns(
        {
            "input_hashes": F.when(
                name == "src3", F.create_map(F.lit("view"), F.sha2(name, 256))
            ).otherwise(
                # The order in which inputs are named does not matter.
                F.map_from_entries(F.reverse(F.map_entries("input_hashes")))
            ),
            "config_sha256": F.when(name == "src5", F.lit("other")).otherwise(F.col("config_sha256")),
        }
    )
    return files_source.artifact_violations(markers.unionByName(gone), observed, asked)


_REQUIRED = ("source", "immutable_revision", "filename", "sha256", "license")


@query(
    "provenance_check",
    """WITH m AS (SELECT doc_id AS k FROM documents)
SELECT 'CHECKPOINT_METADATA_MISSING' AS rule, k::VARCHAR AS key, '' AS detail FROM m WHERE k % 17 = 0
UNION ALL SELECT 'CHECKPOINT_MUTABLE_ID', k::VARCHAR, '' FROM m WHERE k % 19 = 0
UNION ALL SELECT 'CHECKPOINT_MISSING', k::VARCHAR, '' FROM m WHERE k % 23 = 0
UNION ALL SELECT 'CHECKPOINT_FILENAME', k::VARCHAR, '' FROM m WHERE k % 23 <> 0 AND k % 29 = 0
UNION ALL SELECT 'CHECKPOINT_HASH', k::VARCHAR, '' FROM m WHERE k % 23 <> 0 AND k % 31 = 0""",
)
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payload(spark, sf_dir)
    d = F.col("doc_id")
    metadata = rows.select(
        d.alias("artifact"),
        F.lit("origin").alias("source"),
        F.when(d % 19 == 0, F.lit("main")).otherwise(F.substring("sha256", 1, 12)).alias("immutable_revision"),
        F.when(d % 29 == 0, F.lit("other")).otherwise(F.col("path")).alias("filename"),
        F.when(d % 31 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(d % 17 == 0, F.lit(" ")).otherwise(F.lit("MIT")).alias("license"),
    )
    observed = rows.filter(d % 23 != 0).select(
        d.alias("artifact"), F.col("path").alias("filename"), "sha256"
    )
    return files_source.provenance_violations(metadata, observed, _REQUIRED)


@query(
    "index_check",
    """WITH m AS (SELECT doc_id AS k FROM documents)
SELECT 'INDEX_REVISION_MISMATCH' AS rule, k::VARCHAR AS key, '' AS detail FROM m WHERE k % 13 = 0
UNION ALL SELECT 'INDEX_STALE_VIEW', k::VARCHAR, '' FROM m WHERE k % 17 = 0
UNION ALL SELECT 'INDEX_ROW_COUNT', k::VARCHAR, '' FROM m WHERE k % 19 = 0
UNION ALL SELECT 'INDEX_PAYLOAD_HASH', k::VARCHAR, '' FROM m WHERE k % 23 = 0
UNION ALL SELECT 'INDEX_SMOKE_REQUIRED', k::VARCHAR, '' FROM m WHERE k % 29 = 0""",
)
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payload(spark, sf_dir)
    d = F.col("doc_id")
    records = rows.select(
        d.alias("artifact"),
        F.when(d % 13 == 0, F.lit("old")).otherwise(F.lit("r1")).alias("dependency_revision"),
        F.when(d % 17 == 0, F.lit("stale")).otherwise(F.md5("path")).alias("source_view_sha256"),
        (F.col("byte_size") + F.when(d % 19 == 0, F.lit(1)).otherwise(F.lit(0))).alias("row_count"),
        F.when(d % 23 == 0, F.lit("stale")).otherwise(F.col("sha256")).alias("payload_sha256"),
        (d % 29 != 0).alias("official_smoke_loaded"),
    )
    observed = rows.select(
        d.alias("artifact"),
        F.col("sha256").alias("payload_digest"),
        F.md5("path").alias("view_sha256"),
        F.col("byte_size").alias("view_rows"),
    )
    return files_source.index_violations(records, observed, "r1")


@query(
    "prediction_metadata",
    f"""WITH {sv.SCORES}, p AS (SELECT run_id, jet_id, split, s.target, o_orderkey AS pos FROM scores s
  JOIN jets j USING (jet_id, split)),
d AS (SELECT run_id, target, sha256('{{"jet_id":"' || jet_id || '","pos":' || pos || '}}') AS d FROM p),
s AS (SELECT run_id, count(*) AS n, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1,
  {', '.join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) AS l{i}" for i in range(8))} FROM d GROUP BY run_id)
SELECT run_id, n::BIGINT AS row_count, n0::BIGINT AS background_count, n1::BIGINT AS signal_count,
  sha256('row-sha256-lane-sum-v1:' || n || ':' || {" || ':' || ".join(f'l{i}' for i in range(8))}) AS row_order_digest FROM s""",
)
def prediction_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = tables.jets(spark, sf_dir).select("jet_id", F.col("o_orderkey").alias("pos"))
    rows = tables.scores(spark, sf_dir).join(place, "jet_id")
    return table_source.prediction_metadata(rows)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_HELD = f"""{sv.JETS}, {sv.PARTICLES}, held AS (SELECT o_orderkey, count(*) AS n FROM kept WHERE idx < 150 GROUP BY o_orderkey)"""


@query(
    "canonical_sink",
    f"""WITH {_HELD} SELECT split, count(*)::BIGINT AS jets, coalesce(sum(n), 0)::BIGINT AS particles,
  TRUE AS valid, FALSE AS changed_valid FROM jets LEFT JOIN held USING (o_orderkey) GROUP BY split""",
)
def canonical_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical jets written below the shared folder, read back and verified by the observed digest;
    one jet counted twice must not verify."""
    path = _folder(spark, "canonical")
    rows = tables.canonical_jets(spark, sf_dir)
    held = table_source.write_canonical(rows, path, "v1", "0" * 64)
    extra = held.unionByName(held.orderBy("jet_id").limit(1))
    about = table_source.verify_canonical(spark, path)
    other = digest.content_digest(extra, extra.columns).select("digest")
    return held.groupBy("split").agg(
        F.count("*").alias("jets"), F.sum(F.size("particles").cast("bigint")).alias("particles")
    ).select(
        "split",
        "jets",
        "particles",
        about.select("valid").scalar().alias("valid"),
        (about.select("content_sha256").scalar() == other.scalar()).alias("changed_valid"),
    )


@query(
    "jagged_scan",
    f"""WITH {_HELD} SELECT o_orderkey % 2 AS part, count(*)::BIGINT AS jets,
  count(*) FILTER (n > 0 AND o_orderkey % 97 = 0)::BIGINT AS unequal,
  coalesce(sum(n) FILTER (NOT (n > 0 AND o_orderkey % 97 = 0)), 0)::BIGINT AS particles
FROM jets LEFT JOIN held USING (o_orderkey) GROUP BY o_orderkey % 2""",
)
def jagged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as eleven parallel arrays in two folders, scanned with the closed schema; arrays of
    unequal length are found before the arrays are zipped."""
    k = F.col("o_orderkey")
    jets = tables.nested_jets(spark, sf_dir)
    arrays_ = {
        source: F.col(f"particles.{name}").cast(T.ArrayType(kind))
        for source, name, kind in PARALLEL_ARRAYS
    }
    short = F.slice("particle_dz", 1, F.greatest(F.size("particle_dz") - 1, F.lit(0)))
    parallel = jets.select(k, *[f.name for f in JET_FIELDS], *[c.alias(s) for s, c in arrays_.items()])
    planted = parallel.withColumn("particle_dz", F.when(k % 97 == 0, short).otherwise(F.col("particle_dz")))
    path = _folder(spark, "jagged")
    closed = planted.withColumn("part", k % 2).drop("o_orderkey")
    closed.write.partitionBy("part").parquet(path)
    found = None
    for part in (0, 1):
        folder = f"{path}/part={part}"
        raw = spark.read.schema(PARALLEL_JETS).parquet(folder)
        jets_of = table_source.read_jets(spark, [folder], parallel=True)
        unequal = raw.filter(canonical.unequal_lengths(raw))
        good = jets_of.join(unequal.select("event"), "event", "left_anti")
        row = good.agg(F.sum(F.size("particles").cast("bigint")).alias("particles")).select(
            F.lit(part).cast("bigint").alias("part"),
            raw.agg(F.count("*")).scalar().alias("jets"),
            unequal.agg(F.count("*")).scalar().alias("unequal"),
            F.coalesce("particles", F.lit(0)).alias("particles"),
        )
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "ordered_sink",
    """SELECT 0::BIGINT AS kept_violations, 5::BIGINT AS files, count(*)::BIGINT AS rows,
  (count(*) - 1)::BIGINT AS last, TRUE AS moved_found FROM orders""",
)
def ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key over five files; read back file by file they stand in order, and two exchanged
    positions are found."""
    from jetframe.operators import ranking

    path = _folder(spark, "ordered")
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    dense = ranking.dense_positions(orders, "o_orderkey", "pos")
    table_source.write_ordered(dense, f"{path}/good", "pos", 5)
    good = table_source.order_violations(spark, f"{path}/good", "pos")
    table_source.write_ordered(dense, f"{path}/moved", "pos", 5)
    offsets = spark.read.schema("file string, first bigint, last bigint, rows bigint").json(f"{path}/good/offsets")
    swapped = F.when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos"))
    files = table_source.read_in_files(spark, f"{path}/moved").withColumn("pos", swapped)
    ends = files.groupBy("file").agg(F.min("pos").alias("first"))
    moved = files.join(ends, "file").filter(F.col("pos") != F.col("first") + F.col("line"))
    return offsets.agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("last").alias("last")
    ).select(
        good.agg(F.count("*")).scalar().alias("kept_violations"),
        "files",
        "rows",
        "last",
        (moved.agg(F.count("*")).scalar() == 2).alias("moved_found"),
    )


@query(
    "prediction_order",
    f"""WITH {sv.JETS}, n AS (SELECT count(*) AS n FROM jets)
SELECT 'PREDICTION_ROW_ORDER' AS rule, run AS key, '' AS detail FROM (VALUES ('exchanged'), ('missing'), ('repeated')) AS t(run)
UNION ALL SELECT 'PREDICTION_ROW_COUNT', 'missing', ''
UNION ALL SELECT 'PREDICTION_METADATA:' || field, run, '' FROM (VALUES ('missing', 'row_count'), ('missing', 'row_order_digest'),
  ('exchanged', 'row_order_digest'), ('repeated', 'row_order_digest')) AS t(run, field)
UNION ALL SELECT 'PREDICTION_METADATA:' || CASE target WHEN 0 THEN 'background_count' ELSE 'signal_count' END, 'missing', ''
  FROM (SELECT target FROM jets ORDER BY o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'PREDICTION_METADATA:' || field, 'repeated', '' FROM (VALUES ('background_count'), ('signal_count')) AS t(field)
WHERE (SELECT count(DISTINCT target) FROM (SELECT target FROM jets ORDER BY o_orderkey LIMIT 2)) = 2""",
)
def prediction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all jets in the expected order, with two exchanged, the last missing, or one repeated in
    place of another; against the expected ids and against the metadata of the whole run."""
    from jetframe.operators import ranking

    jets = tables.jets(spark, sf_dir).select("o_orderkey", "jet_id", "target")
    expected = stored(ranking.dense_positions(jets, "o_orderkey", "pos").withColumn("pos", F.col("pos").cast("bigint")))
    pos, score = F.col("pos"), F.lit(0.5).alias("score")
    ends = expected.agg(F.max("pos")).scalar()

    def run(name: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(name).alias("run_id"), "pos", "jet_id", "target", score)

    first = expected.filter(pos < 2).select((1 - pos).alias("pos"), "jet_id", "target")
    again = expected.filter(pos == 0).select(F.lit(1).cast("bigint").alias("pos"), "jet_id", "target")
    rest = expected.filter(pos >= 2)
    runs = (
        run("same", expected)
        .unionByName(run("exchanged", rest.unionByName(first, allowMissingColumns=True)))
        .unionByName(run("missing", expected.filter(pos < ends)))
        .unionByName(
            run("repeated", expected.filter(pos != 1).unionByName(again, allowMissingColumns=True))
        )
    )
    whole = table_source.prediction_metadata(run("same", expected)).drop("run_id")
    names = spark.createDataFrame([(n,) for n in ("same", "exchanged", "missing", "repeated")], "run_id string")
    held = whole.agg(F.first(F.struct(*whole.columns))).scalar()
    about = names.select("run_id", *[held[c].alias(c) for c in whole.columns])
    return table_source.expected_order_violations(runs, expected).unionByName(
        table_source.metadata_violations(runs, about)
    )


@query("deepsets_score")
def deepsets_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of all jets that hold a particle, on view D with seeded weights."""
    scaling = fit.lazy_scaling(tables.canonical_rows(spark, sf_dir))
    rows = tables.canonical_jets(spark, sf_dir).withColumnRenamed("target", "label")
    view = views.feature_view(rows.filter(F.size("particles") > 0), scaling, "D")
    phi, head = scoring.seeded_weights(10, 7)
    return scoring.score_views(view, phi, head, 10)
