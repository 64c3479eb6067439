"""Merkle manifest of a table: leaves by row, a tree per language, a tree over the languages.

H is the lower-case hex SHA-256 of its inputs put together; digests go in as hex text. A row's leaf is H of
its fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value. In a tree, leaves ascend by
doc_id; every two consecutive nodes become their H, an odd last one the H of itself alone, until one is
left.

Checkpoint and recompute: of all levels only the leaves and every ``LEVELS``-th one are written. A stored
row is an aligned subtree: the at most 2 ** LEVELS nodes below one node of the next stored level. Building folds
each of these rows by itself. Proofs go from the top down: each subtree is joined with the path of its own
root, makes its missing inner nodes again from the nodes it holds, hands every node its siblings put
before that path, and forgets the inner nodes. No task holds more than one subtree, whatever the size of
a language, and trees of any height take height / LEVELS rounds.

Places in the trees come from a range partitioning by (language, doc_id): rows count up inside their
partition, the partitions' counts are added up. A language with a third of all rows is ranked by as many
tasks as its share.

Null languages are a tree of their own, before all others. A null doc_id comes first in its tree and is
never tampered with; rows with equal ids stand in the order of their leaves, so equal rows have leaves of
their own. Null fields are ``-``, empty texts ``0:``. An empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetframe.session import stored

LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 7
STEP = "array<struct<left:boolean,digest:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def tree_key(lang: Column) -> Column:
    """Never null; sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, the place from 0 inside ``tree`` by the columns ``order``, and ``n``, the tree's size."""
    number = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    dealt = stored(
        rows.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("number", number)
        .withColumn("part", F.shiftright("number", 33))
        .withColumn("row_", F.col("number").bitwiseAND(low))
    )
    counts = dealt.groupBy("tree", "part").agg(
        F.min("row_").alias("first"), F.count("*").alias("rows")
    )
    earlier = Window.partitionBy("tree").orderBy("part")
    whole = Window.partitionBy("tree")
    offsets = counts.select(
        "tree",
        "part",
        (F.sum("rows").over(earlier) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    placed = dealt.join(offsets, ["tree", "part"])
    return placed.withColumn("i", F.col("row_") + F.col("shift")).drop(
        "number", "part", "row_", "shift"
    )


def height(n: Column, levels: int) -> Column:
    """How many levels a subtree of a stored level with ``n`` nodes folds: ``levels``, fewer at the top."""
    needed = F.lit(levels)
    for step in range(levels - 1, -1, -1):
        needed = F.when(n <= (1 << step), step).otherwise(needed)
    return needed


def folded(nodes: Column) -> Column:
    """The level above ``nodes``."""
    last = F.floor((F.size(nodes) - 1) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.sha2(
            F.concat(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.lit(""))), 256
        ),
    )


def subtree_levels(nodes: Column, steps: Column) -> Column:
    """All levels of a subtree from its stored nodes up, ``steps`` of them above these."""
    return F.aggregate(
        F.sequence(F.lit(0), steps),
        F.array(nodes),
        lambda done, step: F.when(step == 0, done).otherwise(
            F.concat(done, F.array(folded(F.element_at(done, -1))))
        ),
    )


def siblings(levels: Column, place: Column) -> Column:
    """Steps from the node at ``place`` of the lowest level to the subtree's root."""
    steps = F.size(levels) - 1

    def step(at: Column) -> Column:
        own = F.call_function("shiftright", place, at)
        other = F.coalesce(F.get(F.get(levels, at), own.bitwiseXOR(F.lit(1))), F.lit(""))
        return F.struct((own % 2 == 1).alias("left"), other.alias("digest"))

    inner = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), step)
    return F.when(steps > 0, inner).otherwise(F.array().cast(STEP))


def climb(leaf: Column, path: Column) -> Column:
    """The root a leaf and its siblings lead to."""
    return F.aggregate(
        path,
        leaf,
        lambda node, step: F.sha2(
            F.when(step["left"], F.concat(step["digest"], node)).otherwise(
                F.concat(node, step["digest"])
            ),
            256,
        ),
    )


def build(leaves: DataFrame, payload: list[str], levels: int = LEVELS) -> list[DataFrame]:
    """Stored levels (tree, block, n, nodes, top): ``leaves`` has (tree, i, n, digest) and the payload.

    The last level holds only single subtrees, whose ``top`` is the tree's root. A tree that is finished
    earlier has its only subtree on an earlier level.
    """
    width = 1 << levels
    found = []
    kept = F.struct(*payload) if payload else F.lit(None).cast("string")
    nodes = leaves.select("tree", "i", "n", "digest", kept.alias("payload"))
    while True:
        gathered = nodes.groupBy(
            "tree", "n", F.floor(F.col("i") / width).cast("bigint").alias("block")
        ).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "payload"))).alias("nodes"))
        subtree = subtree_levels(F.col("nodes.digest"), height(F.col("n"), levels))
        found.append(
            stored(
                gathered.withColumn("top", F.element_at(F.element_at(subtree, -1), 1)).withColumn(
                    "last", F.col("n") <= width
                )
            )
        )
        more = found[-1].filter("NOT last")
        if more.isEmpty():
            return found
        nodes = more.select(
            "tree",
            F.col("block").alias("i"),
            F.ceil(F.col("n") / width).cast("bigint").alias("n"),
            F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("payload"),
        )


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, root) of all trees."""
    parts = [level.filter("last").select("tree", F.col("top").alias("root")) for level in found]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def proofs(found: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, i, digest, payload, path, *rest) of all leaves.

    ``above`` has (tree, path, *rest): what follows on the tree's own root, and columns to hand down.
    """
    width = 1 << levels
    rest = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for level in reversed(found):
        steps = height(F.col("n"), levels)
        tops = level.filter("last").join(above, "tree")
        if paths is None:
            owned = tops
        else:
            inner = level.filter("NOT last").join(
                paths.withColumnRenamed("i", "block").drop("digest", "payload"), ["tree", "block"]
            )
            owned = tops.unionByName(inner)
        again = owned.withColumn("made", subtree_levels(F.col("nodes.digest"), steps))
        each = again.select(
            "tree", "block", "made", "path", *rest, F.posexplode("nodes").alias("place", "node")
        )
        paths = each.select(
            "tree",
            (F.col("block") * width + F.col("place")).alias("i"),
            "node.digest",
            "node.payload",
            F.concat(siblings(F.col("made"), F.col("place")), F.col("path")).alias("path"),
            *rest,
        )
    return paths


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row."""
    own = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(crc % TAMPER_MODULUS == 0, F.lit(False))
    narrow = docs.select(*[docs[f"`{c}`"].alias(c) for c in FIELDS])
    leaves = stored(
        narrow.select(
            tree_key(F.col("lang")).alias("tree"),
            "doc_id",
            leaf_digest(*own).alias("digest"),
            F.when(hit, leaf_digest(*changed)).alias("tampered"),
        )
    )
    found = build(with_places(leaves, ["doc_id", "digest"]), ["doc_id", "tampered"], levels)
    subroots = roots(found).select(
        F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest")
    )
    top = build(with_places(subroots, ["lang"]), ["lang"], levels)
    nothing = roots(top).select("tree", F.array().cast(STEP).alias("path"), "root")
    above = proofs(top, nothing, levels).select(
        F.col("payload.lang").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    every = proofs(found, stored(above), levels)
    whole = F.array_join(F.transform("path", lambda step: step["digest"]), "")
    return every.select(
        "payload.doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(whole, 256).alias("proof_sha256"),
        climb(F.coalesce("payload.tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels are folded by a recursion over all trees at once; the languages' tree follows in a second one.
SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k) & 1)))),
           lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, tree,
         sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN
           sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail)
         END AS tampered
  FROM leaves
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY i) AS next FROM nodes WHERE n > 1)
  WHERE i % 2 = 0
), subroots AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i,
         count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS next FROM upper WHERE n > 1)
  WHERE i % 2 = 0
), siblings AS (
  SELECT p.tree, p.i, l.level, (p.i >> l.level) % 2 = 1 AS is_right,
         coalesce(o.h, '') AS h
  FROM placed p JOIN subroots s USING (tree), unnest(range(s.height)) AS l(level)
  LEFT JOIN nodes o ON o.tree = p.tree AND o.level = l.level AND o.i = xor(p.i >> l.level, 1)
  UNION ALL
  SELECT p.tree, p.i, s.height + l.level, (s.i >> l.level) % 2 = 1, coalesce(o.h, '')
  FROM placed p JOIN subroots s USING (tree),
       unnest(range((SELECT max(level) FROM upper))) AS l(level)
  LEFT JOIN upper o ON o.level = l.level AND o.i = xor(s.i >> l.level, 1)
), paths AS (
  SELECT tree, i, list(h ORDER BY level) AS hs, list(is_right ORDER BY level) AS sides
  FROM siblings GROUP BY tree, i
), climbing AS (
  SELECT tree, i, 1 AS step, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL
  SELECT c.tree, c.i, step + 1,
         sha256(CASE WHEN sides[step] THEN hs[step] || h ELSE h || hs[step] END)
  FROM climbing c JOIN paths p ON p.tree = c.tree AND p.i = c.i WHERE step <= len(hs)
), folded AS (
  SELECT tree, i, arg_max(h, step) AS folded_root FROM climbing GROUP BY tree, i
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root,
       sha256(coalesce(array_to_string(a.hs, ''), '')) AS proof_sha256, f.folded_root,
       f.folded_root = r.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded f ON f.tree = p.tree AND f.i = p.i
     LEFT JOIN paths a ON a.tree = p.tree AND a.i = p.i
     CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
"""
