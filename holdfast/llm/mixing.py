"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: every source gets weight * level, clamped at `max_epochs` times its size; the level is the
one at which the targets sum to the share of all words. Sorting sources by size / weight makes the
clamped ones a prefix, so the redistribution loop has a closed form over running sums.

Sample: a source's target is whole repetitions of all of its documents and one fractional
repetition. The latter takes documents in the order of a seeded hash until the words are used up; the
document at the limit is taken if more than half of it fits, so a source misses its target by half a
document at most.
A radix descent finds the end of it: word sums by 12 hash bits, then by 12 more inside the one bucket
per source where the limit falls, and only the documents of that last bucket are ranked.

Defined cases: null text counts 0 words; null source is a source of its own and comes last; an empty
table gives no rows; sources without words get target 0; repeated rows are documents of their own and
share a place in the order, so rows with one doc_id and source are taken equally often, and an id in two
sources is decided in each; other columns of the input are ignored, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch, table, word_count

WEIGHTS = (3, 1, 2)
#: Share of all words as a fraction, so that the arithmetic up to the last division stays in integers.
SHARE = (3, 2)
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hash bits that each radix level looks at, as hexadecimal digits.
DIGITS = 3


def sources(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source: _src, source_size, target, whole, need. `sized` has _src and size.

    The windows run over one row per source, never over documents.
    """
    num, den = share
    rank = F.row_number().over(W.orderBy(F.col("_src").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    grown = sized.groupBy("_src").agg(F.sum("size").alias("source_size")).withColumn("_rank", rank).withColumn("_w", weight)
    every = W.partitionBy(F.lit(0))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("_w"), "_rank").rowsBetween(W.unboundedPreceding, -1)
    sums = grown.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.sum("_w").over(every).alias("_all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before_w"),
    )
    # clamped iff its share of what the earlier ones left exceeds its cap; both sides times den * weights left
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = num * wide("_all") - den * max_epochs * wide("_before")
    clamped = left * wide("_w") > den * max_epochs * wide("source_size") * (wide("_all_w") - wide("_before_w"))
    sums = sums.withColumn("_clamped", clamped)
    held = sums.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("source_size"))).over(every), F.lit(0)).alias("_held"),
        F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("_w"))).over(every), F.lit(0)).alias("_held_w"),
    )
    level = (F.col("_w") * (num * F.col("_all") - den * max_epochs * F.col("_held"))).cast("double") / (den * (F.col("_all_w") - F.col("_held_w"))).cast("double")
    target = F.when(F.col("_clamped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(level)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        held.withColumn("target", target)
        .withColumn("whole", whole)
        .select("_src", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    )


def _digit(level: int) -> F.Column:
    return F.substring("_key", 1 + DIGITS * level, DIGITS)


def _border(rows: DataFrame, level: int) -> DataFrame:
    """Of rows with _src, need, size, _key: per source the hash digits where `need` runs out, and what is left there."""
    sums = rows.groupBy("_src", "need", _digit(level).alias("_bin")).agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy("_src").orderBy("_bin"))
    runs = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("need"))
    first = runs.groupBy("_src").agg(F.min_by(F.struct("_bin", (F.col("need") - (F.col("_upto") - F.col("_sum"))).alias("_rest")), "_bin").alias("_b"))
    return first.select("_src", F.col("_b._bin").alias("_bin"), F.col("_b._rest").alias("_rest"))


class Plan:
    """What decides the repetitions of a row: small tables with one row for each source, or fewer."""

    def __init__(self, docs: DataFrame, scratch: Scratch, seed: str = SEED, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS):
        self.seed = seed
        self.sized = scratch.save(docs.select("doc_id", F.col("source").alias("_src"), word_count(F.col("text")).alias("size"), self.key("doc_id").alias("_key")), "sized")
        self.sources = scratch.save(sources(self.sized, weights, share, max_epochs), "sources")
        inside = self._with(self.sized, self.sources)
        self.borders = []
        for level in range(2):
            edge = scratch.save(_border(inside, level), f"border{level}")
            self.borders.append(edge.select("_src", F.col("_bin").alias(f"_bin{level}"), F.col("_rest").alias(f"_rest{level}")))
            inside = self._with(inside, self.borders[-1]).filter(_digit(level) == F.col(f"_bin{level}")).withColumn("need", F.col(f"_rest{level}"))
        upto = F.sum("size").over(W.partitionBy("_src").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, 0))
        last = inside.withColumn("_upto", upto).filter(F.col("_upto") - F.col("size") / 2 <= F.col("need")).groupBy("_src").agg(F.max("_key").alias("_last"))
        self.last = scratch.save(last, "last")

    def key(self, doc_id) -> F.Column:
        return F.md5(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))

    @staticmethod
    def _with(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        """rows with what `small` has for their source; a null source is one like others."""
        return rows.join(small.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")), how).drop("_s")

    def decided(self, rows: DataFrame) -> DataFrame:
        """rows with _src and _key -> and source_size, target, _reps. Rows with one doc_id and source are decided alike."""
        rows = self._with(rows, self.sources)
        for edge in self.borders:
            rows = self._with(rows, edge, "left")
        rows = self._with(rows, self.last, "left")
        d0, d1 = _digit(0), _digit(1)
        inner = (d0 == F.col("_bin0")) & ((d1 < F.col("_bin1")) | F.col("_bin1").isNull() | ((d1 == F.col("_bin1")) & (F.col("_key") <= F.col("_last"))))
        # without a first border no prefix passes `need`: the fractional repetition takes the whole source, if it takes anything
        more = F.when(F.col("need") <= 0, False).when(F.col("_bin0").isNull(), True).otherwise((d0 < F.col("_bin0")) | F.coalesce(inner, F.lit(False)))
        return rows.withColumn("_reps", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, size, source_size, target, taken, reps.

    taken = reps * size; reps are the whole repetitions plus one if the fractional one takes the document.
    """
    plan = Plan(docs, scratch, **options)
    return plan.decided(plan.sized).select("doc_id", "size", "source_size", "target", (F.col("_reps") * F.col("size")).alias("taken"), F.col("_reps").alias("reps"))


def repeated(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: every row of docs as often as the plan takes it; all columns stay, whatever their names."""
    plan = Plan(docs, scratch, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_src"), plan.key("doc_id").alias("_key"))
    taken = plan.decided(rows).filter("_reps > 0").select("_row", F.explode(F.expr("sequence(1L, _reps)")))
    return taken.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, Scratch(spark, "mix")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS z, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((r - 1) % 3 + 1)::INT]::HUGEINT AS w FROM s),
p AS (SELECT *, sum(z) OVER () AS a, sum(w) OVER () AS aw, coalesce(sum(z) OVER b, 0) AS bz, coalesce(sum(w) OVER b, 0) AS bw
      FROM w WINDOW b AS (ORDER BY z::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (3 * a - 4 * bz) * w > 4 * z * (aw - bw) AS clamped FROM p),
h AS (SELECT *, coalesce(sum(z) FILTER (clamped) OVER (), 0) AS hz, coalesce(sum(w) FILTER (clamped) OVER (), 0) AS hw FROM c),
t AS (SELECT source, z::BIGINT AS source_size, CASE WHEN clamped THEN (2 * z)::DOUBLE ELSE (w * (3 * a - 4 * hz))::DOUBLE / (2 * (aw - hw))::DOUBLE END AS target FROM h),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
f AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN need > 0 AND upto - size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""
