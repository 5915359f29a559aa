"""As-of join by a sorted merge: each left row takes the latest right row of its key at or before its time.

Both sides are laid into one order by key and time and cut into range partitions; the latest known right
row is carried along, and from one partition into the next. Times may be of any orderable type, the
history of any length, and a key may hold any share of either side: nothing is paired or filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.operators.segments import Running, running


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]
) -> DataFrame:
    """``left`` with ``values`` of the latest right row of equal ``by`` keys at or before ``left_time``.

    They are null where there is none, and for a null time or key. Of right rows with equal key and time
    the one with the highest ``values`` counts, in the order given.
    """
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, right_time]))
    found = F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    keys = {f"_by{i}": k for i, k in enumerate(by)}
    none = F.lit(None)
    quotes = known.groupBy(*[F.col(f"`{k}`").alias(n) for n, k in keys.items()], F.col(f"`{right_time}`").alias("_time")).agg(
        F.max(found).alias("_found")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    kind = left.schema[left_time].dataType
    asked = left.select(
        *[F.col(f"`{k}`").alias(n) for n, k in keys.items()], F.col(f"`{left_time}`").alias("_time"),
        F.lit(1).alias("_side"), none.cast(quotes.schema["_found"].dataType).alias("_found"), row.alias("_row"),
    )
    quotes = quotes.select(*keys, F.col("_time").cast(kind), F.lit(0).alias("_side"), "_found", none.cast(asked.schema["_row"].dataType).alias("_row"))
    merged = running(asked.unionByName(quotes), list(keys), ["_time", "_side"], {"_last": Running("last", "_found")})
    return merged.where("_side = 1").select("_row.*", *[F.col(f"_last.v{i}").alias(v) for i, v in enumerate(values)])
