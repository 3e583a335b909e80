"""Problem 2: percentiles per group by radix selection on order-preserving integers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Stages, small, table

#: Bits of a digit: a histogram has at most 2 ** DIGIT buckets a group.
DIGIT = 16


@F.pandas_udf(T.LongType())
def _double_key(x: pd.Series) -> pd.Series:
    bits = x.to_numpy("float64").view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.DoubleType())
def _key_double(k: pd.Series) -> pd.Series:
    bits = k.to_numpy("int64")
    return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def ordered_key(df: DataFrame, value: str):
    """Column expression of an integer in the order of ``value``; whole numbers are their own key, floating ones go by their bits. NaN is the largest."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(value).cast("long")
    plain = F.col(value).cast("double")
    # one zero, one NaN
    return _double_key(F.when(F.isnan(plain), F.lit(float("nan"))).otherwise(plain + F.lit(0.0)))


def digit_histogram(rows: DataFrame, groups: list[str], shift: int) -> DataFrame:
    """Mergeable summary ``(groups, digit, n, lo, hi)`` of the column ``key``: histograms of days or files add up with :func:`merge_histograms`."""
    return rows.groupBy(*groups, F.shiftright("key", shift).alias("digit")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def merge_histograms(hist: DataFrame, groups: list[str]) -> DataFrame:
    return hist.groupBy(*groups, "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _locate(hist: DataFrame, groups: list[str], ranks) -> DataFrame:
    """The bucket of each wanted rank (1-based ``ranks``, an array column expression of structs (q, r) over the group's total ``total``)."""
    over = Window.partitionBy(*groups)
    run = over.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("upto", F.sum("n").over(run))
    if isinstance(ranks, list):
        h = h.withColumn("total", F.sum("n").over(over))
        r = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(q)) * F.col("total")).cast("long")).alias("r")) for q in ranks])
    else:
        r = F.array(F.struct("q", "r"))
    h = h.withColumn("t", F.explode(F.filter(r, lambda x: (x["r"] > F.col("upto") - F.col("n")) & (x["r"] <= F.col("upto")))))
    return h.select(*groups, F.col("t.q").alias("q"), (F.col("t.r") - (F.col("upto") - F.col("n"))).alias("r"), "digit", "n", "lo", "hi", *(["total"] if "total" in h.columns else []))


def radix_percentiles(rows: DataFrame, groups: list[str], quantiles: list[float], bits: int, hist: DataFrame | None = None, tolerance: float = 0.0, work: Stages | None = None, digit: int = DIGIT) -> DataFrame:
    """``(groups, q, key, total)``: the key of rank ceil(q * n) of each group of ``rows(groups, key)``.

    ``bits`` bounds the bit length of the keys. The first histogram counts the highest digit; then only the bucket of each wanted rank is
    followed, in histograms of the next digit, until its smallest and largest key agree. With ``tolerance`` a bucket holding at most that
    share of its group also ends the search: the rank error is then at most ``tolerance``; at 0 the result is exact. ``hist`` may give the
    first histogram, merged from those of days or files. No rows give no result; rows with a null key are to be left out before; null groups are a group.
    """
    work = work or Stages(rows.sparkSession, "radix")
    shift = max(0, (bits - 1) // digit * digit)
    todo = work.write(_locate(hist if hist is not None else digit_histogram(rows, groups, shift), groups, list(quantiles)))
    parts = []
    while True:
        ended = (F.col("lo") == F.col("hi")) | (F.col("n") <= F.lit(tolerance) * F.col("total"))
        parts.append(todo.where(ended if shift else F.lit(True)).select(*groups, "q", F.col("lo").alias("key"), "total"))
        if not shift:
            break
        left = work.write(todo.where(~ended))
        count = left.count()
        if not count:
            break
        want = small(left.select(*groups, F.col("digit").alias("prefix")).distinct(), count)
        last, shift = shift, shift - digit
        on = [rows[g].eqNullSafe(want[g]) for g in groups] + [F.shiftright(rows["key"], last) == want["prefix"]]
        near = rows.join(want, on).select(*[rows[g] for g in groups], rows["key"], want["prefix"])
        h = digit_histogram(near, [*groups, "prefix"], shift)
        ranks = left.select(*[F.col(g).alias("_" + g) for g in groups], F.col("digit").alias("_prefix"), "q", "r", "total")
        run = Window.partitionBy(*groups, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumn("upto", F.sum("n").over(run))
        ranks = small(ranks, count)
        hit = h.join(ranks, [h[g].eqNullSafe(ranks["_" + g]) for g in groups] + [h["prefix"] == ranks["_prefix"], ranks["r"] > h["upto"] - h["n"], ranks["r"] <= h["upto"]])
        todo = work.write(hit.select(*[h[g] for g in groups], "q", (F.col("r") - (F.col("upto") - F.col("n"))).alias("r"), "digit", "n", "lo", "hi", "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percentiles(df: DataFrame, groups: list[str], value: str, quantiles: list[float], tolerance: float = 0.0) -> DataFrame:
    """``(groups, q, value)``: percentiles of a column of any numeric type; nulls don't count. See :func:`radix_percentiles`."""
    work = Stages(df.sparkSession, "percentiles")
    whole = isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = work.write(df.where(F.col(value).isNotNull()).select(*groups, ordered_key(df, value).alias("key")))
    found = radix_percentiles(rows, groups, quantiles, _bits(rows), tolerance=tolerance, work=work)
    return found.select(*groups, "q", (F.col("key") if whole else _key_double("key")).alias("value"))


def _bits(rows: DataFrame) -> int:
    lo, hi = rows.agg(F.min("key"), F.max("key")).first()
    return 1 if lo is None else max((hi if hi >= 0 else ~hi).bit_length(), (lo if lo >= 0 else ~lo).bit_length(), 1)


def readings(values: DataFrame) -> DataFrame:
    """One row ``(dataset_id, dim_no, obs_day, key)`` per reading. Null and negative coord don't count; a reading delivered again is one. Should
    deliveries of a reading differ, the smallest of each column is kept."""
    v = values.select("reading_id", "dataset_id", "dim_no", "obs_day", "coord").where("coord >= 0 and reading_id is not null and dataset_id is not null and dim_no is not null and obs_day is not null")
    return v.groupBy("reading_id").agg(*[F.min(c).alias(c) for c in ("dataset_id", "dim_no", "obs_day", "coord")]).select("dataset_id", "dim_no", "obs_day", F.col("coord").alias("key"))


def combined_percentiles(hist: DataFrame, groups: list[str], quantiles: list[float]) -> DataFrame:
    """``(groups, q, low, high, rank_error)`` from saved histograms of parts (days, files) alone: the percentile lies between low and high, and any value there is off by at most
    ``rank_error`` of the group's rows. Histograms of parts must have been made with the same shift. No histograms give no rows."""
    at = _locate(merge_histograms(hist, groups), groups, list(quantiles))
    return at.select(*groups, "q", F.col("lo").alias("low"), F.col("hi").alias("high"), (F.col("n") / F.col("total")).alias("rank_error"))


DIM, DAY = ["dataset_id", "dim_no"], ["dataset_id", "dim_no", "obs_day"]


def _day_and_all(spark: SparkSession, sf_dir: str, day_q: list[float], all_q: list[float]) -> tuple[DataFrame, DataFrame]:
    work = Stages(spark, "percentiles")
    rows = work.write(readings(table(spark, sf_dir, "dimension_values")))
    bits = _bits(rows)
    hist = work.write(digit_histogram(rows, DAY, max(0, (bits - 1) // DIGIT * DIGIT)))
    by_day = radix_percentiles(rows, DAY, day_q, bits, hist=hist, work=work)
    by_dim = radix_percentiles(rows.select(*DIM, "key"), DIM, all_q, bits, hist=merge_histograms(hist, DIM), work=work)
    return by_day, by_dim


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, dim = _day_and_all(spark, sf_dir, [0.5], [0.25, 0.75])
    ends = dim.groupBy(*DIM).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return day.join(ends, DIM).where("key < low or key > high").select(*DAY)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days, the day's median beside them as obs_day."""
    qs = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    day, dim = _day_and_all(spark, sf_dir, [0.5], qs)
    return dim.select(*DIM, F.lit(0).alias("obs_day"), "q", F.col("key").alias("value")).unionByName(day.select(*DAY, "q", F.col("key").alias("value")))


def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles over all days from the saved histograms of separate days, with buckets of 2 ** 8 values: whether the exact ones lie within the bounds given."""
    work = Stages(spark, "days")
    rows = work.write(readings(table(spark, sf_dir, "dimension_values")))
    saved = None
    for part in range(2):  # two runs, each over its own days
        hist = work.write(digit_histogram(rows.where(F.pmod("obs_day", F.lit(2)) == part), DIM, 8))
        saved = hist if saved is None else saved.unionByName(hist)
    qs = [0.25, 0.5, 0.75]
    given = combined_percentiles(saved, DIM, qs)
    exact = radix_percentiles(rows.select(*DIM, "key"), DIM, qs, _bits(rows), work=work)
    return given.join(exact.select(*DIM, "q", "key"), [*DIM, "q"]).select(*DIM, "q", ((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")) & (F.col("high") - F.col("low") < 256)).alias("within"))


QUERIES = {"p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_combined": p2_combined}
_READ = "r AS (SELECT reading_id, min(dataset_id) AS dataset_id, min(dim_no) AS dim_no, min(obs_day) AS obs_day, min(coord) AS coord FROM dimension_values WHERE coord >= 0 AND reading_id IS NOT NULL GROUP BY reading_id)"
SQL = {
    "p2_combined": f"WITH {_READ} SELECT DISTINCT dataset_id, dim_no, q::DOUBLE AS q, true AS within FROM r, (SELECT unnest([0.25, 0.5, 0.75]) AS q)",
    "p2_found": f"""WITH {_READ}, d AS (SELECT dataset_id, dim_no, obs_day, quantile_disc(coord, 0.5) AS med FROM r GROUP BY ALL),
a AS (SELECT dataset_id, dim_no, quantile_disc(coord, 0.25) AS low, quantile_disc(coord, 0.75) AS high FROM r GROUP BY ALL)
SELECT dataset_id, dim_no, obs_day FROM d JOIN a USING (dataset_id, dim_no) WHERE med < low OR med > high""",
    "p2_percentiles": f"""WITH {_READ}, q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS q),
n AS (SELECT dataset_id, dim_no, 0 AS obs_day, coord, row_number() OVER (PARTITION BY dataset_id, dim_no ORDER BY coord) AS rn, count(*) OVER (PARTITION BY dataset_id, dim_no) AS n FROM r
UNION ALL SELECT dataset_id, dim_no, obs_day, coord, row_number() OVER (PARTITION BY dataset_id, dim_no, obs_day ORDER BY coord), count(*) OVER (PARTITION BY dataset_id, dim_no, obs_day) FROM r)
SELECT dataset_id, dim_no, obs_day, q, coord AS value FROM n JOIN q ON rn = greatest(1, ceil(q * n)::BIGINT) WHERE obs_day = 0 OR q = 0.5""",
}
