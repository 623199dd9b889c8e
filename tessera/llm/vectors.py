"""What the vector operators share: which vectors count, and packing blocks of them into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite numbers, of the vectors' own type if that is an array of floats."""
    kind = dict(df.dtypes)[vec_col]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    numbers = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(numbers, F.lit(False)))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of ``finite`` as double; repeated rows count once."""
    return finite(df, id_col, vec_col).withColumn("vec", F.col("vec").cast("array<double>")).dropDuplicates(["id", "vec"])
