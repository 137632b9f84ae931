"""Vector expressions, in double precision and JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Similarity to a fixed vector, whose length is computed once on the driver.

    Up to 256 dimensions the sums are written out term by term, which compiles
    into the scan; longer ones would not fit a compiled method.
    """
    length = sum(x * x for x in query) ** 0.5
    if len(query) <= 256:
        at = [F.get(a, F.lit(i)).cast("double") for i in range(len(query))]
        add = lambda terms: reduce(lambda s, t: s + t, terms, F.lit(0.0))
        both, own = add([x * F.lit(float(y)) for x, y in zip(at, query)]), add([x * x for x in at])
        return F.when(F.size(a) == len(query), F.try_divide(both, F.sqrt(own) * F.lit(length)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.try_divide(dot(a, q), norm(a) * F.lit(length))


def of_dimension(a: Column, dim: int) -> Column:
    """The vector, or an error where its length is not ``dim``."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"expected a vector of {dim}, got "), F.size(a).cast("string"))).cast("array<float>"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per group the element-wise mean scaled to unit length: ``(*keys, mean)``; null vectors are left out."""
    at = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("pos", "x"))
    avg = at.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # at most one entry per dimension
    mean = avg.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("m"))
    return mean.select(*keys, F.transform("m", lambda x: F.try_divide(x, norm(F.col("m")))).alias("mean"))
