"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the mix by its weight, up to a number of whole epochs of its size;
what a source cannot take is shared again by weight. A source's target is met by its complete
epochs first. The remainder is a sample without replacement: each document draws the key
``-ln(u) / quality`` from a hash of its identifier, documents are sorted by key within the source, and
prefix sums of their sizes decide which ones fill the remainder. So a document's chance grows
with its quality, and reruns agree.

A source may hold a third of all rows, so no window runs over a source. Keys are cut into
``BUCKETS`` ranges; sizes are summed by (source, bucket) before anything is ordered, prefix sums over
these sums give each bucket's start, and rows are only ordered within their bucket.

The driver sees one row for each source (name and size).

Cases: a null or empty text has size 0 and takes 0; the null source comes last; a document without a
label has quality 1; repeated labels of a document are averaged; rows with equal identifiers
draw equal keys and are ordered by size, rows without one draw by their size; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.textcols import as_strings, row_chunks, tokens, without

#: Weights of the sources in order of name, repeating; size of the mix; most epochs of a source.
WEIGHTS = (3.0, 1.0, 2.0)
MIX_SHARE, MOST_EPOCHS = 1.5, 2
#: Ranges of keys within a source.
BUCKETS = 4096
#: Quality weights of labelled documents and of the rest.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0
_UNIT = float(1 << 52)
_OWN = ("_source", "_epochs", "_labelled", "_quality", "_key", "_bucket", "_sum", "_s", "_b", "_start")


def with_sizes(df: DataFrame, text_col: str = "text", size_as: str = "size", keep_text: bool = False) -> DataFrame:
    """Adds the number of words ``[^\\x20\\x09-\\x0D]+`` of the text, and drops the text unless asked for."""
    df = without(df, size_as)
    fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(size_as, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(raw, offsets)[2] for _, raw, offsets in row_chunks(as_strings(batch.column(batch.schema.get_field_index(text_col))))]
            sizes = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), sizes], [*names, size_as])

    return df.mapInArrow(run, schema)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, mix_share: float = MIX_SHARE, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Target of each source: its share by weight, no more than ``most`` times its size, the excess reshared."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_ = mix_share * sum(sizes.values()), list(names)
    out: dict[str | None, float] = {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if weight[n] * level > most * sizes[n]]
        if not full:
            return out | {n: weight[n] * level for n in open_}
        for n in full:
            out[n] = float(most * sizes[n])
            left -= out[n]
        open_ = [n for n in open_ if n not in out]
    return out


def unit(id_col: Column, seed: str = "mix") -> Column:
    """A number between 0 and 1 from the MD5 of the identifier's text: 52 bits, never 0 or 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(_UNIT)


def quality_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) from labels: between BAD and GOOD, the mean over repeated labels."""
    found = F.when(F.col("quality") > 0, GOOD).when(F.col("quality") <= 0, BAD)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.avg(found), F.lit(UNKNOWN)).alias("_quality"))


def mix(docs: DataFrame, labels: DataFrame | None = None, buckets: int = BUCKETS, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """Adds source_size, target and taken to rows that have a size.

    ``docs`` is read twice; write it first if it is costly.
    """
    spark = docs.sparkSession
    docs = without(docs, "source_size", "target", "taken", *_OWN)
    sizes = {r[0]: r[1] for r in docs.groupBy(source_col).agg(F.sum(size_col)).collect()}
    goals = targets(sizes)
    plan = spark.createDataFrame(
        [(n, sizes[n], goals[n], int(goals[n] // sizes[n]) if sizes[n] else 0) for n in sizes],
        T.StructType([T.StructField("_source", docs.schema[source_col].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_epochs", T.LongType())]),
    )
    rows = docs.join(plan, F.col(source_col).eqNullSafe(F.col("_source")), "left")
    if labels is not None:
        rows = rows.join(quality_of(labels).withColumnRenamed("doc_id", "_labelled"), F.col(id_col) == F.col("_labelled"), "left").drop("_labelled")
    else:
        rows = rows.withColumn("_quality", F.lit(None).cast("double"))
    # Rows without an identifier draw by their size, so that they do not all meet in one bucket.
    drawn = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.col(size_col).cast("string")))
    key = -F.log(unit(drawn)) / F.coalesce("_quality", F.lit(UNKNOWN))
    # 1 - exp(-key) is between 0 and 1 and grows with the key.
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets).cast("int"))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum(size_col).alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_start") + F.coalesce(F.sum(size_col).over(within), F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    # A document is taken if at least half of it lies before the remainder's end.
    chosen = F.when(2 * ahead + F.col(size_col) <= 2 * rest, 1).otherwise(0)
    taken = F.col(size_col) * F.least(F.col("_epochs") + chosen, F.lit(MOST_EPOCHS))
    return rows.withColumn("taken", taken.cast("bigint")).select(*docs.columns, "source_size", "target", "taken")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    from weftgraph import scratch

    sized = scratch.written(with_sizes(docs.select("doc_id", "source", "text")), "sizes")
    return mix(sized, labels).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM src),
ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS mix_size,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY 2 * source_size / w DESC, source DESC NULLS FIRST) AS w_from FROM numbered),
levels AS (
  SELECT (SELECT (mix_size - full_before) / w_from FROM ordered WHERE w * ((mix_size - full_before) / w_from) <= 2 * source_size
    ORDER BY 2 * source_size / w, source NULLS LAST LIMIT 1) AS level),
plan AS (
  SELECT source, source_size, CAST(CASE WHEN w * level > 2 * source_size OR level IS NULL THEN 2 * source_size ELSE w * level END AS DOUBLE) AS target
  FROM ordered, levels),
quality AS (SELECT doc_id, coalesce(avg(CASE WHEN quality > 0 THEN 2.0 WHEN quality <= 0 THEN 0.5 END), 1.0) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
    CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
    -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '~' || d.size)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / coalesce(q.q, 1.0) AS k
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN quality q ON q.doc_id = d.doc_id),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed)
SELECT doc_id, size, source_size, target,
  CAST(size * least(epochs + CASE WHEN 2 * ahead + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM summed
"""
