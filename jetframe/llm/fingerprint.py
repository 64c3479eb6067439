"""Document fingerprints from closed syncmers; DataFrame functions only.

A k-mer (``K`` code points) is an anchor if the smallest of its ``WINDOW`` inner s-mers (``S`` code
points, ordered by hash) is the first or the last of them. Whether a k-mer is an anchor depends on its
own characters alone, so an edit changes no anchor outside the k-mers it touches, and the anchors of a
text made from two known ones are theirs plus those across the seam.

The fingerprint is the list of anchors in text order, five hex digits each. Likeness is twice the number
of shared different anchors over the sum of both numbers (1 for equal fingerprints). A text without any
anchor (shorter than ``K``, or by chance and short) has all its runs of ``S`` characters instead.

Per text: characters, hashes of s-mers by doubling (1, 2, 4), window minima by doubling (2, 4, 8, 16), one
selection. The work is linear in the length. Memory of a task is about 300 bytes per character of the
longest text.

Null texts are empty. Rows are ordered by (doc_id, text), null ids first; the next document of the last
row is the first. A single row is its own next. Repeated rows are rows of their own. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, WINDOW = 4, 16
K = S + WINDOW - 1
BITS, DIGITS = 20, 5
BINS_PER_PARTITION = 8


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def with_anchor_marks(df: DataFrame, text: str, marks: str) -> DataFrame:
    """Adds ``marks``: for every k-mer start its anchor number, or null if it is no anchor.

    Every step is a column of its own, so that no step is evaluated twice.
    """
    df = df.withColumn("_h", F.transform(F.split(text, ""), lambda c: F.xxhash64(c)))
    for step, by in (("_p2", 1), ("_v", 2)):
        last = "_h" if by == 1 else "_p2"
        df = df.withColumn(step, F.zip_with(last, _shifted(last, by), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_v", F.slice("_v", 1, F.greatest(F.length(text) - (S - 1), F.lit(0))))
    last = "_v"
    for by in (1, 2, 4, 8):
        step = f"_m{by * 2}"
        df = df.withColumn(step, F.zip_with(last, _shifted(last, by), lambda a, b: F.least(a, b)))
        last = step
    df = df.withColumn(
        last, F.slice(last, 1, F.greatest(F.size("_v") - (WINDOW - 1), F.lit(0)))
    )
    values = F.col("_v")

    def mark(least: Column, i: Column) -> Column:
        first, end = F.get(values, i), F.get(values, i + (WINDOW - 1))
        inner = (F.get(values, i + by) for by in range(S, WINDOW - 1, S))
        number = F.xxhash64(first, *inner, end)
        return F.when(
            (least == first) | (least == end), number.bitwiseAND((1 << BITS) - 1).cast("int")
        )

    df = df.withColumn(marks, F.transform(last, mark))
    return df.drop("_h", "_p2", "_v", "_m2", "_m4", "_m8", "_m16")


def present(marks: Column) -> Column:
    return F.filter(marks, lambda m: m.isNotNull())


def or_short(anchors: Column, text: str) -> Column:
    """The anchors, or all runs of ``S`` characters where there is none (only short texts have none)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (S - 1), F.lit(1)))
    runs = F.transform(
        starts,
        lambda i: F.xxhash64(F.col(text).substr(i, F.lit(S))).bitwiseAND((1 << BITS) - 1).cast("int"),
    )
    return F.when(F.size(anchors) > 0, anchors).otherwise(runs)


def as_text(anchors: Column) -> Column:
    return F.array_join(
        F.transform(anchors, lambda a: F.substring(F.hex(a + (1 << BITS)), 2, DIGITS)), ""
    )


def likeness(a: str, b: str) -> Column:
    """Of two arrays of anchors without repeats."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, position, anchor): the anchors of every text with their places, from 0."""
    own = docs.select(
        docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )
    marked = with_anchor_marks(own, "text", "marks")
    return marked.select("doc_id", F.posexplode("marks").alias("position", "anchor")).filter(
        "anchor IS NOT NULL"
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bin, extra): rows binned by ranges of doc_id, each bin closed by its next row.

    The bounds are doc_ids of the table (quantiles), so each bin's first document is a bound; it is put
    into the bin before as an ``extra`` row as well. The bounds are the only thing collected: a number
    per bin, ``BINS_PER_PARTITION`` bins per shuffle partition.
    """
    spark = docs.sparkSession
    bins = BINS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / bins for n in range(bins)]
    found = docs.agg(
        F.min("doc_id").alias("least"),
        F.percentile_approx("doc_id", shares, 100 * bins).alias("bounds"),
        F.max(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = sorted({*(found["bounds"] or []), found["least"]} - {None})
    listed = F.array(*(F.lit(b).cast("bigint") for b in bounds)).cast("array<bigint>")
    below = F.size(F.filter(listed, lambda b: b <= F.col("doc_id")))
    own = F.greatest(F.when(F.col("doc_id").isNull(), 1).otherwise(below) - 1, F.lit(0))
    last = max(0, len(bounds) - 1)
    opens = F.array_contains(listed, F.col("doc_id")) & (own > 0)
    first = F.col("doc_id").isNull() if found["nulls"] else own == 0
    first = first & (F.col("doc_id").eqNullSafe(F.lit(None if found["nulls"] else found["least"])))
    places = F.filter(
        F.array(
            F.struct(own.alias("bin"), F.lit(False).alias("extra")),
            F.when(opens, F.struct((own - 1).alias("bin"), F.lit(True).alias("extra"))),
            F.when(first, F.struct(F.lit(last).alias("bin"), F.lit(True).alias("extra"))),
        ),
        lambda p: p.isNotNull(),
    )
    return docs.select("doc_id", "text", F.explode(places).alias("at")).select(
        "doc_id", "text", "at.bin", "at.extra"
    )


def fingerprint_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every text and its edited text (end replaced by the next document's start), fingerprinted.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    Texts are shuffled once; the next text and its anchors come from windows over one sort.
    """
    own = docs.select(
        docs[id_column].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
    )
    # Null ids lie in the first bin, so nulls first is the order of the bins too.
    order = Window.partitionBy("bin").orderBy("extra", F.asc_nulls_first("doc_id"), "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    cut = (F.col("n_chars") - F.col("quarter")).cast("int")
    staged = (
        with_next(own)
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text"))
        .withColumn("quarter", quarter)
        .withColumn("head", cut)
        .withColumn("tail", F.expr("substring(next_text, 1, quarter)"))
        .drop("next_text")
    )
    marked = with_anchor_marks(staged, "text", "_marks").withColumn("_found", present(F.col("_marks")))
    kept = F.slice("_marks", 1, F.greatest(F.col("head") - (K - 1), F.lit(0)))
    marked = (
        marked.withColumn("head_anchors", F.size(present(kept)))
        .drop("_marks")
        .withColumn("anchors", or_short(F.col("_found"), "text"))
        .withColumn("different", F.array_distinct("anchors"))
        .withColumn("next_different", F.lead("different").over(order))
        .filter("NOT extra")
    )
    seam = F.expr(f"substring(text, greatest(head - {K - 2}, 1), least(head, {K - 1}))")
    edited = (
        marked.withColumn("edited", F.concat(F.expr("substring(text, 1, head)"), "tail"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .withColumn("joint", F.concat(seam, "tail"))
    )
    edited = with_anchor_marks(edited, "joint", "_marks")
    both = F.concat(F.expr("slice(_found, 1, head_anchors)"), present(F.col("_marks")))
    edited = (
        edited.withColumn("_both", both)
        .withColumn("edited_anchors", or_short(F.col("_both"), "edited"))
        .withColumn("edited_different", F.array_distinct("edited_anchors"))
    )
    return edited.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness("different", "edited_different").alias("near_edited"),
        likeness("different", "next_different").alias("near_next"),
    )
