"""Join of many rows per key to one row per key, where a single key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WAYS, _SLOT = "_ways", "_slot"


#: Rows of one key that one task takes, about.
ROWS_PER_SLOT = 1_000_000
#: Most keys that are spread, which bounds the broadcast list of them.
MOST_KEYS = 100_000


def heavy_keys(rows: DataFrame, key: str, per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Keys with more rows than one task takes, with the number of slots to spread each over.

    A slot holds about ``per_slot`` rows whatever the table's size. Above ``MOST_KEYS * per_slot`` rows in all (10^11
    with the defaults) a key must hold more than one in ``MOST_KEYS`` of them, so that the list never exceeds that.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    ways = F.ceil(F.col("_n") / F.lit(per_slot)).cast("int").alias(_WAYS)
    return counts.where((F.col("_n") > per_slot) & (F.col("_n") * MOST_KEYS > total)).select(key, ways)


def spread_join(
    rows: DataFrame, per_key: DataFrame, key: str, spread_by: str, how: str = "inner", per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Inner or left join on ``key``; ``per_key`` has one row per key.

    The rows of a heavy key go to several tasks by the hash of ``spread_by``, and only that key's single partner row
    is repeated for them. Rows without a key are spread as well, as they meet no partner. All other keys join as usual.
    Adaptive execution cannot do this by itself where the partner side is the outcome of further joins.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be spread")
    heavy = heavy_keys(rows, key, per_slot)
    hashed = F.xxhash64(spread_by)
    spread = F.pmod(hashed, F.coalesce(F.col(_WAYS), F.lit(1)).cast("long"))
    slot = F.when(F.col(key).isNull(), hashed).otherwise(spread).alias(_SLOT)
    slots = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(_WAYS), F.lit(1)).cast("long") - 1)
    slotted = rows.join(F.broadcast(heavy), key, "left").select(*rows.columns, slot)
    repeated = per_key.join(F.broadcast(heavy), key, "left").select(*per_key.columns, F.explode(slots).alias(_SLOT))
    return slotted.join(repeated, [key, _SLOT], how).drop(_SLOT)
