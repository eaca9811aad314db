"""Mixing sources to target weights by Poisson replication, in native DataFrame functions.

A source's mean repetition rate is its target share of the output over its share of the input, both in characters.
Each document draws its number of copies by inverting the Poisson distribution of its source at a uniform number that
is a hash of its id and the seed; copies are then shuffled globally by a hash of id, copy and seed: one range
exchange whose keys are uniform, however large a source is.

Defined cases: a null source is a source of its own; a null or empty text counts 0 characters, and where all texts are
empty every rate is `epochs`; a null doc_id draws like the id ''; repeated rows draw alike; extra columns are kept,
those named like the two this adds are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, written

SEED = "mix-1"
#: Target shares go with the input share to this power: 1 keeps the mixture, 0 makes sources equal.
POWER = 0.5
#: The table of rates is broadcast where its distributions hold at most so many numbers (8 MB).
BROADCAST_NUMBERS = 1 << 20


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the hash of the parts."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate, cdf) for each source: the mean repetition rate and the Poisson probabilities of at most
    0, 1, 2, ... copies. Target shares are `weights` (normalised; sources without one get none), else the input
    shares to the power POWER. One row a source, aggregated before the exchange."""
    mass = docs.groupBy(F.col("`source`").alias("source")).agg(
        F.coalesce(F.sum(F.length("`text`")), F.lit(0)).cast("double").alias("mass"))
    if weights is None:
        wish = F.pow("mass", F.lit(POWER)) if POWER != 0.5 else F.sqrt("mass")
    else:
        known = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else None
        wish = F.coalesce(known[F.col("source")], F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    mass = mass.withColumn("wish", wish)
    whole = mass.agg(F.sum("mass").alias("all_mass"), F.sum("wish").alias("all_wish"))
    rate = F.when((F.col("mass") > 0) & (F.col("all_wish") > 0), F.lit(float(epochs)) * F.col("wish") / F.col(
        "all_wish") * F.col("all_mass") / F.col("mass")).otherwise(F.lit(float(epochs)))
    return _distributions(mass.join(F.broadcast(whole)).select("source", rate.alias("rate")))


def _distributions(rate: DataFrame) -> DataFrame:
    """rate(source, rate) with cdf, P(X <= k) for k = 0, 1, ... until nothing is left, of a Poisson X with that mean. A
    step is a row, summed up in order: work grows with the rate, not with its square."""
    mean = F.col("rate")
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    step = rate.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    run = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(run)
    log_p = F.when(mean > 0, F.col("k") * F.log(mean) - mean - F.col("lf")).otherwise(
        F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    total = step.withColumn("lf", log_fact).withColumn("p", F.sum(F.exp(log_p)).over(run))
    return total.groupBy("source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0,
           seed: str = SEED) -> DataFrame:
    """docs with one row for each copy, and columns copy (from 0) and mix_key, not yet shuffled."""
    own_names = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    of, steps = fresh(docs, "of_source"), fresh(docs, "steps")
    table = written(rates(docs, weights, epochs).select(F.col("source").alias(of), F.col("cdf").alias(steps)), "rates")
    if (table.agg(F.sum(F.size(steps))).first()[0] or 0) <= BROADCAST_NUMBERS:  # else texts are shuffled to it
        table = F.broadcast(table)
    base = docs.select(*[F.col(f"`{c}`") for c in own_names])
    drawn = base.join(table, F.col("`source`").eqNullSafe(F.col(of)))
    u = _uniform(F.lit(seed), F.col("`doc_id`"))
    # the number of steps of the distribution at or below u; the last step stands for certainty
    n = F.size(F.filter(steps, lambda p: p <= u))
    n = F.least(n, F.size(steps) - 1)
    row = drawn.select(*[F.col(f"`{c}`") for c in own_names], F.explode(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")),
                            F.col("copy").cast("string")))
    return row.withColumn("mix_key", key)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0,
          seed: str = SEED) -> DataFrame:
    """The copies in globally shuffled order: sorted by mix_key over all partitions."""
    return copies(docs, weights, epochs, seed).orderBy("mix_key", "doc_id", "copy")
