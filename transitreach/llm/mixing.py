"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture.  Its mean repetition rate is the
share of the wanted total divided by the source's own size.  Every document
draws its number of copies by inverting the Poisson distribution of that mean
at a point hashed from its doc_id and the seed, is exploded by the count, and
every copy gets a hashed place in a global shuffle.  Draws depend on nothing but
doc_id and seed: a re-run, another partitioning or a retried task gives the same
mixture.

Sizes count the code points of the texts and one separator each, over all rows.
The inverse is exact: the cumulative probabilities of a source are listed until
what is left is below the resolution of the hashed point (52 bits), so no count
is capped.

Edge cases: a NULL or empty text has size 1.  A NULL source is a source of its
own.  A NULL doc_id draws with the text ``null``.  Rows that repeat a doc_id
draw the same count, and their copies the same places (ties stand next to each
other).  A source without a weight, or of weight 0, has rate 0 and gives no
copies.  An empty table gives an empty result.  Extra columns, whatever their
names, stay as they are in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialise, packed, text_of

SEED = 17
TEMPERATURE = 0.5              # weights are sizes to this power when none are given
MOST_BROADCAST_SOURCES = 10_000    # rate rows (a source name and some hundred doubles each)


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source, size``; sums per task come first, so a hot source costs one row a task."""
    return docs.groupBy("source").agg(
        F.sum(F.length(text_of()).cast("bigint") + F.lit(1)).alias("size"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None,
                 temperature: float = TEMPERATURE, total: float = 1.0) -> DataFrame:
    """``source, rate``: the mean number of copies of a document of the source.

    ``total`` is the wanted size of the mixture as a multiple of the input's.
    """
    sizes = source_sizes(docs)
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) \
            if weights else F.lit(None).cast("map<string,double>")
        weighted = sizes.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)))
    weighted = materialise(docs.sparkSession, weighted, "mix_weights")
    sums = weighted.agg(F.sum("size").cast("double").alias("s"), F.sum("weight").alias("w"))
    share = F.try_divide(F.col("weight"), sums.select("w").scalar())
    return weighted.select("source", F.coalesce(share * F.lit(float(total)) * sums.select("s").scalar()
                                                / F.col("size"), F.lit(0.0)).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """``source, rate, cdf``: P(X <= 0), P(X <= 1), ... up to where the rest is
    below 2^-52 (ten deviations and 40 past the mean).  Terms are summed as
    logarithms, so large rates do not underflow."""
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 40).cast("int")
    start = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"),
                     F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc, k):
        log = acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"),
                        F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return rates.select("source", "rate", F.when(F.col("rate") > 0, F.aggregate(
        F.sequence(F.lit(1), last), start, step)["cdf"]).alias("cdf"))


def _hashed(digits: int, *parts: Column) -> Column:
    """The first hex digits of an MD5 over the parts, as a whole number."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def repetitions(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """``_row, _id, _source, _count``: every row of ``docs`` with its number of copies."""
    rows = packed(docs).withColumns({"_id": F.col("_row.doc_id"), "_source": F.col("_row.source")})
    table = materialise(docs.sparkSession, cumulative(rates), "mix_rates")
    table = broadcast_if(table.select(F.col("source").alias("_s"), "cdf"), table.count(),
                         MOST_BROADCAST_SOURCES)
    point = (_hashed(13, F.lit(seed), F.col("_id")).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 52)
    joined = rows.join(table, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("_u", point)
    count = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    return joined.select("_row", "_id", "_source",
                         F.when(F.col("cdf").isNull(), F.lit(0)).otherwise(count).alias("_count"))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
           total: float = 1.0, seed: int = SEED) -> DataFrame:
    """``_row, _id, _source, _count, _copy, _place``, globally shuffled.

    ``_place`` is a 60-bit hash of (seed, doc_id, copy).  Rows are dealt to
    partitions by it and sorted by it, so partition after partition is one
    uniformly shuffled order.
    """
    counted = repetitions(docs, source_rates(docs, weights, temperature, total), seed)
    exploded = (counted.where("_count > 0")
                .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
                .withColumn("_place", _hashed(15, F.lit(seed), F.col("_id"), F.col("_copy"))))
    return exploded.repartition("_place").sortWithinPartitions("_place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
        total: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture with the columns of ``docs``: one row per copy, globally shuffled."""
    return copies(docs, weights, temperature, total, seed).select("_row.*")


def mixture_table(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, repetitions, copy, shuffle_key, text`` of the mixture."""
    return copies(docs, seed=seed).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_count").alias("repetitions"),
        F.col("_copy").alias("copy"), F.col("_place").alias("shuffle_key"), F.col("_row.text").alias("text"))


# The same in DuckDB SQL, for the query's seed and temperature.
ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, SUM(length(COALESCE(text, '')) + 1) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, CAST(pow(CAST(size AS DOUBLE), {TEMPERATURE})
           / (SELECT SUM(pow(CAST(size AS DOUBLE), {TEMPERATURE})) FROM sizes)
           * (SELECT CAST(SUM(size) AS DOUBLE) FROM sizes) / CAST(size AS DOUBLE) AS DOUBLE) AS rate
  FROM sizes
), terms AS (
  SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate) - ln(CAST(k + 1 AS DOUBLE)),
         cdf + exp(lg + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM terms WHERE k < ceil(rate + 10 * sqrt(rate) + 40)
), points AS (
  SELECT doc_id, source, text,
         (CAST(CAST('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13)
               AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT p.doc_id, p.source, p.text,
         (SELECT COUNT(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM p.source AND t.cdf <= p.u) AS n
  FROM points p
), exploded AS (
  SELECT doc_id, source, text, n, unnest(range(n)) AS copy FROM counted WHERE n > 0
)
SELECT doc_id, source, CAST(n AS INTEGER) AS repetitions, CAST(copy AS INTEGER) AS copy,
       CAST(CAST('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':'
            || CAST(copy AS VARCHAR)), 1, 15) AS UBIGINT) AS BIGINT) AS shuffle_key, text
FROM exploded
"""
