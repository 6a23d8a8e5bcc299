"""Other weights of dependencies: g3 error, conditional probability, information gain, differential support."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.pairs import sample_pairs


def _contexts(rows: DataFrame, lhs: list[str], rhs: str, *, skip_nulls: bool) -> DataFrame:
    """(lhs..., n, top): each context's rows and those of its commonest value; two sums, both combined before their shuffle."""
    kept = rows
    if skip_nulls:
        for c in [*lhs, rhs]:
            kept = kept.filter(F.col(c).isNotNull())
    return kept.groupBy(*lhs, rhs).agg(F.count(F.lit(1)).alias("n")).groupBy(*lhs).agg(F.sum("n").alias("n"), F.max("n").alias("top"))


def g3_error(rows: DataFrame, lhs: list[str], rhs: str, threshold: float = 0.05) -> DataFrame:
    """(lhs, rhs, n, errors, g3, weight, valid): the share of rows to delete so that lhs determines rhs. Nulls equal each other; no rows give 0."""
    one = _contexts(rows, lhs, rhs, skip_nulls=False).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0)).alias("errors"))
    g3 = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("n")), F.lit(0.0))
    return one.select(F.lit(",".join(lhs)).alias("lhs"), F.lit(rhs).alias("rhs"), "n", "errors", g3.alias("g3"), (1 - g3).alias("weight"), (g3 <= threshold).alias("valid"))


def discover(rows: DataFrame, columns: list[str], rhs: str, most: int = 2, threshold: float = 0.05) -> DataFrame:
    """g3 of every set of at most ``most`` columns towards rhs, valid ones marked; one scan with grouping sets serves all of them."""
    lists = [list(c) for k in range(1, most + 1) for c in combinations([c for c in columns if c != rhs], k)]
    if not lists:
        raise ValueError("there is no column to determine anything")
    others = sorted({c for x in lists for c in x})
    # marked copies tell a null from a column that a set leaves out
    tagged = rows.select(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")).alias(c) for c in [*others, rhs]])
    sets = [[F.col(c) for c in [*x, rhs]] for x in lists]
    counted = tagged.groupingSets(sets, *others, rhs).agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(*others).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    label = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in others])
    out = top.groupBy(label.alias("lhs")).agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("top")).alias("errors"))
    g3 = F.col("errors").cast("double") / F.col("n")
    return out.select("lhs", F.lit(rhs).alias("rhs"), "n", "errors", g3.alias("g3"), (1 - g3).alias("weight"), (g3 <= threshold).alias("valid"))


def conditional_probability(rows: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """(avg_prob, worst_prob, n_contexts): the commonest value's share by context, weighted by support and at worst. Rows with a null take no part; none give 0."""
    share = F.col("top") / F.col("n")
    return _contexts(rows, lhs, rhs, skip_nulls=True).agg(
        F.coalesce(F.try_divide(F.sum("top").cast("double"), F.sum("n")), F.lit(0.0)).alias("avg_prob"), F.coalesce(F.min(share), F.lit(0.0)).alias("worst_prob"), F.count(F.lit(1)).alias("n_contexts")
    )


def confidence(rows: DataFrame, predicate: Column) -> DataFrame:
    """(confidence): the share of rows that fulfil a predicate; null counts as no."""
    return rows.agg(F.coalesce(F.avg(F.coalesce(predicate, F.lit(False)).cast("int")), F.lit(0.0)).alias("confidence"))


def information_gain(rows: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """(h_rhs, h_given, gain): 1 - H(rhs | lhs) / H(rhs), not below 0; 1 if rhs has one value. Rows with a null take no part."""
    kept = rows
    for c in [*lhs, rhs]:
        kept = kept.filter(F.col(c).isNotNull())
    cells = kept.groupBy(*lhs, rhs).agg(F.count(F.lit(1)).alias("n"))
    log = lambda x: x * F.ln(x)
    given = cells.groupBy(*lhs).agg(F.sum("n").alias("n"), F.sum(log(F.col("n").cast("double"))).alias("s")).agg(F.sum(log(F.col("n").cast("double")) - F.col("s")).alias("g"), F.sum("n").alias("total"))
    whole = cells.groupBy(rhs).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("t"), F.sum(log(F.col("n").cast("double"))).alias("s"))
    both = given.join(F.broadcast(whole))  # one row each
    h, hg = F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t"), F.col("g") / F.col("total")
    h, hg = F.greatest(F.coalesce(h, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(hg, F.lit(0.0)), F.lit(0.0))
    return both.select(h.alias("h_rhs"), hg.alias("h_given")).withColumn("gain", F.when(F.col("h_rhs") > 1e-12, F.greatest(F.lit(0.0), 1 - F.col("h_given") / F.when(F.col("h_rhs") > 1e-12, F.col("h_rhs")))).otherwise(1.0))


METHODS = {"average": "avg_prob", "worst_case": "worst_prob", "entropy": "gain"}


def dependency_weight(rows: DataFrame, lhs: list[str], rhs: str, method: str = "average") -> DataFrame:
    """(weight) by one of three methods."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    table = information_gain(rows, lhs, rhs) if method == "entropy" else conditional_probability(rows, lhs, rhs)
    return table.select(F.col(METHODS[method]).alias("weight"))


def distance(pairs: DataFrame, columns: list[str]) -> Column:
    """Euclidean distance of a pair over columns: numbers differ by their difference, anything else by 0 or 1."""
    total = F.lit(0.0)
    for c in columns:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        kind = pairs.schema[f"l_{c}"].dataType.typeName()
        d = F.abs(a.cast("double") - b.cast("double")) if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") else F.when(a == b, 0.0).otherwise(1.0)
        total = total + d * d
    return F.sqrt(total)


def sample_distances(rows: DataFrame, key: str, columns: list[str], most: int = 1000) -> DataFrame:
    """All pairs i < j among the ``most`` rows that come first by md5 of the key; ``most`` bounds the pairs. Adds d."""
    some = rows.select(key, *columns).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(most)
    some = some.withColumn("rn", F.row_number().over(Window.orderBy(key)))  # at most ``most`` rows
    side = lambda p: some.select(F.col("rn").alias(f"{p}rn"), *[F.col(c).alias(f"{p}{c}") for c in columns])
    pairs = side("l_").join(F.broadcast(side("r_")), F.col("l_rn") < F.col("r_rn"))  # at most ``most`` rows
    return pairs.withColumn("d", distance(pairs, columns))


def threshold(rows: DataFrame, key: str, columns: list[str], most: int = 1000, quantile: float = 0.25) -> DataFrame:
    """(theta): the mean over columns of the distances' quantile (0 for a column that isn't numeric)."""
    numeric = [c for c in columns if rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    some = sample_distances(rows, key, numeric or columns[:1], most)
    parts = [F.percentile(F.abs(F.col(f"l_{c}").cast("double") - F.col(f"r_{c}").cast("double")), F.lit(quantile)) if c in numeric else F.lit(0.0) for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return some.agg((total / len(columns)).alias("theta"))


def differential_support(pairs: DataFrame, lhs: list[str], rhs: list[str], theta_l: float, theta_r: float, least: float = 0.9) -> DataFrame:
    """(n_close, n_both, support, valid): of pairs close on the left, how many are close on the right; 0 if none is."""
    close = distance(pairs, lhs) <= theta_l
    both = close & (distance(pairs, rhs) <= theta_r)
    out = pairs.agg(F.count_if(close).alias("n_close"), F.count_if(both).alias("n_both"))
    support = F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_close")), F.lit(0.0))
    return out.withColumn("support", support).withColumn("valid", F.col("support") >= least)


def random_distances(rows: DataFrame, key: str, columns: list[str], pairs: int = 2000, seed: int = 7) -> DataFrame:
    """At most ``pairs`` random ordered pairs of different rows (no more than there are pairs), with d over the columns."""
    n = rows.count()
    sample = sample_pairs(rows.select(*dict.fromkeys([key, *columns])), key, min(pairs, n * (n - 1) // 2), seed)
    return sample.withColumn("d", distance(sample, columns))


def differential_weight(rows: DataFrame, key: str, lhs: list[str], rhs: str, *, theta_l: float | None = None, theta_r: float | None = None, pairs: int = 2000, most: int = 1000, least: float = 0.9, seed: int = 7) -> DataFrame:
    """(lhs, rhs, theta_l, theta_r, n_pairs, n_close, n_both, support, weight, valid) of a differential dependency over random pairs.

    A threshold that isn't given is the mean first quartile of its columns' distances (``threshold``). Weight is the support;
    no close pair gives 0.
    """
    given = lambda theta, columns: rows.sparkSession.createDataFrame([(float(theta),)], "theta double") if theta is not None else threshold(rows, key, columns, most)
    thetas = given(theta_l, lhs).withColumnRenamed("theta", "theta_l").join(given(theta_r, [rhs]).withColumnRenamed("theta", "theta_r"))
    sample = random_distances(rows, key, [*lhs, rhs], pairs, seed).join(F.broadcast(thetas))  # one row
    close = distance(sample, lhs) <= F.col("theta_l")
    both = close & (distance(sample, [rhs]) <= F.col("theta_r"))
    out = sample.agg(F.first("theta_l").alias("theta_l"), F.first("theta_r").alias("theta_r"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(close).alias("n_close"), F.count_if(both).alias("n_both"))
    support = F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_close")), F.lit(0.0))
    return out.select(F.lit(",".join(lhs)).alias("lhs"), F.lit(rhs).alias("rhs"), "*", support.alias("support"), support.alias("weight"), (support >= least).alias("valid"))
