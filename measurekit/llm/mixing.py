"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Sizes are counted once into a narrow table. Sums per source and hash bucket give the sources; a source's target is its share of
the total by weight, clamped at `max_epochs` times its size, the excess shared again among the others by weight until nobody is
above. A target is met by whole repetitions of every document and one more repetition of the documents that come first in a
seeded random order, up to the document where the rest of the target ends; so a source misses its target by half a document at
most. The order is only sorted inside the one hash bucket per source in which the rest ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A key that tells a null source from any text."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def order_key(doc_id: Column, size: Column, seed: int) -> Column:
    """Place of a document in the seeded order. Rows with equal id and size share a place, and so their fate."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(hashed, F.lit(":"), F.lpad(size.cast("string"), 12, "0"))


def water_fill(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Adds weight and target to sources(key, source, source_size), one row per source.

    In order of cap by weight the clamped sources come first: a source is clamped if the level reached when all before it are
    clamped lies above its cap. The windows run over the registry of sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("at", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("at") + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    clamped = ranked.withColumn("clamped", F.col("cap") < level * F.col("weight"))
    held = [F.coalesce(F.sum(F.when(F.col("clamped"), F.col(c))).over(everything), F.lit(0.0)) for c in ("cap", "weight")]
    last = (F.sum("source_size").over(everything) - held[0]) / (F.sum("weight").over(everything) - held[1])
    return clamped.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(last * F.col("weight"))).drop("at", "cap", "clamped")


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, *,
             text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): sizes(doc_id, key, size, place) has a row per document, sources(key, source, source_size, weight,
    target, whole, cut) one per source: every document is taken `whole` times, and once more if place <= cut.

    Nulls: a text without words has size 0, a null source is a source of its own, a null doc_id is hashed as one more id.
    An empty table gives two empty tables. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("key"), F.col(source).alias("source"),
                                     words(F.col(text)).alias("size"))
                         .withColumn("place", order_key(F.col("doc_id"), F.col("size"), seed)), "sizes")
    buckets = sizes.groupBy("key", F.substring("place", 1, 3).alias("bucket")).agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    sources = buckets.groupBy("key").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    filled = water_fill(sources, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = scratch.keep(filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    # the bucket of each source in which the rest ends, and what lies before it
    upto = F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket"))
    ends = (buckets.withColumn("end", upto).join(filled.select("key", "rest"), "key")
            .filter((F.col("end") - F.col("bucket_size") < F.col("rest")) & (F.col("end") >= F.col("rest")))
            .groupBy("key", "rest").agg(F.min_by("bucket", "bucket").alias("bucket"), F.min(F.col("end") - F.col("bucket_size")).alias("base")))
    near = sizes.withColumn("bucket", F.substring("place", 1, 3)).join(ends, ["key", "bucket"])
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("ahead", F.col("base") + ahead)
    taken = F.when(F.col("size") > 0, 2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).otherwise(F.col("ahead") < F.col("rest"))
    cuts = near.filter(taken).groupBy("key").agg(F.max("place").alias("in_bucket"))
    # no document of the bucket taken: the cut lies before the bucket
    cuts = ends.select("key", "bucket").join(cuts, "key", "left").select("key", F.coalesce("in_bucket", "bucket").alias("cut"))
    # the rest may be more than all, by rounding only: then nothing is cut
    sources = filled.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", F.when(F.col("rest") > 0, F.lit("~")).otherwise(F.lit(""))))
    plan = scratch.keep(sources.drop("rest"), "plan")
    scratch.drop("sources")
    return sizes, plan


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns as they came. Options as for plan_mix."""
    _, sources = plan_mix(docs, **options)
    text, source, doc_id = options.get("text", "text"), options.get("source", "source"), options.get("doc_id", "doc_id")
    key, size, place, whole, cut, again = fresh(docs, "mix_key", "mix_size", "mix_place", "mix_whole", "mix_cut", "mix_again")
    seed = options.get("seed", SEED)
    rows = docs.withColumn(key, source_key(F.col(source))).withColumn(size, words(F.col(text))).withColumn(place, order_key(F.col(doc_id), F.col(size), seed))
    rows = rows.join(sources.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("cut").alias(cut)), key)
    times = (F.col(whole) + (F.col(place) <= F.col(cut)).cast("long")).cast("int")
    return rows.withColumn(again, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    sizes, sources = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    times = F.col("whole") + (F.col("place") <= F.col("cut")).cast("long")
    return (sizes.select("doc_id", "key", "size", "place").join(sources.select("key", "source_size", "target", "whole", "cut"), "key")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")))


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
placed AS (
  SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) || ':' || lpad(size::VARCHAR, 12, '0') AS place FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM ranked),
clamped AS (
  SELECT *, cap < (total - cap_before) / (weights - weight_before) * weight AS clamped FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN clamped THEN cap
         ELSE (total - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / (weights - coalesce(sum(weight) FILTER (clamped) OVER (), 0)) * weight END AS target
  FROM clamped),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ahead AS (
  SELECT p.*, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM placed p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source),
cut AS (
  SELECT *, max(CASE WHEN CASE WHEN size > 0 THEN 2 * ahead + size <= 2 * rest ELSE ahead < rest END THEN place END)
    OVER (PARTITION BY source) AS cut FROM ahead)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN place <= cut THEN 1 ELSE 0 END))::BIGINT AS taken FROM cut
"""
