"""Mixing sources to target weights: hash order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm.common import WORD
from tessera.session import written

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: size is the number of words of the text, 0 for null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = 3) -> list[tuple]:
    """(source, size, target) by water filling.

    Sources in code point order, null last, take the weights in turn and share the total of all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above. Sources reach their limits in the order of limit / weight, so one
    pass over that order finds which do.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    total, weight = sum(n for _, n, _ in rows), sum(w for *_, w in rows)
    out = {}
    for s, n, w in sorted(rows, key=lambda r: most * r[1] / r[2]):
        if total * w <= most * n * weight:
            break
        out[s] = float(most * n)
        total, weight = total - most * n, weight - w
    return [(s, n, out[s] if s in out else total * w / weight) for s, n, w in rows]


def mix(sizes: DataFrame, weights=WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each row the mix takes: ``doc_id, size, source_size, target, taken``.

    ``sizes`` has ``doc_id, source, size``. Rows of a source are put in the order of
    md5(seed|doc_id), ties by doc_id and size. Whole passes over the source come first (epochs),
    then the rows in that order until the budget (the target's whole part) is used up: the row at
    the cut gives only its first words. Reruns agree, as the order depends on ids alone.

    A source is dealt out in buckets of the key's first hex digits, whose number follows from the
    largest source, so a source with a third of all rows is spread like any other: bucket sums
    (partial aggregates) are accumulated over the small bucket table, rows only within a bucket.
    Only one row per source comes to the driver. Null sources are one source; null ids are rows
    like others; an empty table gives no rows; equal rows tie and share their takings in any order.
    """
    spark = sizes.sparkSession
    keyed = written(sizes.select(
        "doc_id", "source", "size",
        F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))
                          .cast("binary")), 1, 16).alias("key")), "mix_sizes")
    per = keyed.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    plan = targets([(r["source"], r["n"]) for r in per], weights, most)
    digits = 0
    while max([0, *(r["rows"] for r in per)]) / 16**digits > BUCKET_ROWS:
        digits += 1
    rows = []
    for s, n, target in plan:
        epochs = int(target // n) if n else 0
        rows.append((s, n, target, epochs, int(target) - epochs * n))
    table = spark.createDataFrame(rows, "source string, source_size long, target double, "
                                        "epochs long, budget long")
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = (keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
            .withColumn("offset", F.sum("n").over(
                W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
            .select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                    F.coalesce("offset", F.lit(0)).alias("offset")))
    inside = F.coalesce(F.sum("size").over(
        W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (keyed.withColumn("inside", inside)
              .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .drop("s", "b")
              .join(table.withColumnRenamed("source", "s"),
                    F.col("source").eqNullSafe(F.col("s"))))
    part = F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("offset") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


OP8_SQL = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5('mix|' || doc_id::varchar), 1, 16) as k from documents),
s as (select source, sum(size)::bigint as n from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3
                when 0 then 5 when 1 then 2 else 1 end as weight from s),
o as (select *, row_number() over (order by 3 * n / weight::double, source nulls last) as i from w),
r as (select *, (select sum(n) from s) - coalesce(sum(3 * n) over (
                    order by i rows between unbounded preceding and 1 preceding), 0) as left_total,
             sum(weight) over (order by i rows between current row and unbounded following)
                 as left_weight from o),
c as (select *, left_total * weight > 3 * n * left_weight as capped from r),
f as (select min(i) as first_free from c where not capped),
b as (select x.source, x.n, case when x.capped then (3 * x.n)::double
             else (y.left_total::bigint * x.weight)::double / y.left_weight::double end as target
      from c x left join c y on y.i = (select first_free from f)),
e as (select *, case when n > 0 then floor(target / n)::bigint else 0 end as epochs from b),
p as (select d.*, coalesce(sum(size) over (partition by source order by k, doc_id, size
             rows between unbounded preceding and 1 preceding), 0) as before from d)
select p.doc_id, p.size, e.n as source_size, e.target,
       (e.epochs * p.size + least(p.size, greatest(0,
           floor(e.target)::bigint - e.epochs * e.n - p.before)))::bigint as taken
from p join e on p.source is not distinct from e.source
"""


def op8_mixing(spark, folder: str) -> DataFrame:
    """The mix of all documents, by the first sizes, weights and limit of the contract."""
    from tessera.llm.common import documents
    return mix(sized(documents(spark, folder))).drop("source")
