"""Vector functions over arrays, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def int8_scale(v: Column) -> Column:
    most = F.greatest(F.array_max(v), -F.array_min(v)).cast("double") / 127
    return F.when(most == 0, 1.0).otherwise(most)


def int8_codes(v: Column, scale: Column) -> Column:
    """Codes of a vector, rounded half to even and clamped."""
    code = lambda x: F.greatest(F.least(F.bround(x.cast("double") / scale), F.lit(127.0)), F.lit(-128.0)).cast("tinyint")
    return F.transform(v, code)


def quantize(vectors: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """`vectors` with scale and q (tinyint codes); rows of another length are an error."""
    checked = F.col(vector)
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit("vector length "), F.size(vector)))
        checked = F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong)
    out = vectors.withColumn(vector, checked).withColumn("scale", int8_scale(F.col(vector)))
    return out.withColumn("q", int8_codes(F.col(vector), F.col("scale")))


def centroid(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The unit-length mean of the vectors of each group."""
    at = vectors.select(*keys, F.posexplode(vector).alias("pos", "x"))
    mean = at.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return rows.select(*keys, l2_normalize(F.transform("v", lambda p: p["x"])).alias("centroid"))
