"""A keyed store as relations: an operation log replayed to its last state, and lookups on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Load limits, the least capacity and the multiplier of the hash.
LOAD_MAX, LOAD_MIN, LEAST_CAPACITY = 0.70, 0.15, 8
HASH_MULTIPLIER = 0x9E3779B97F4A7C15


def replay(log: DataFrame) -> DataFrame:
    """State ``(k, v)`` after ``log(seq, op, k, v)``; ``op`` is ``set``, ``del`` or ``clear``.

    The last operation of a key decides, which pre-aggregates by key, so a hot key costs one row per
    task.  A ``clear`` (its key is ignored) voids all before it.  Deleting an absent key is no error
    here; ``missing_deletes`` tells where the strict store would raise.
    """
    cleared = log.filter("op = 'clear'").agg(F.max("seq")).first()[0]
    live = log.filter("op <> 'clear'") if cleared is None else log.filter((F.col("op") != "clear") & (F.col("seq") > cleared))
    last = live.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("last"))
    return last.filter("last.op = 'set'").select("k", F.col("last.v").alias("v"))


def missing_deletes(log: DataFrame) -> DataFrame:
    """Deletes ``(seq, k)`` of keys that are absent at that time, each a ``KeyError``."""
    from pyspark.sql.window import Window

    before = F.lag("op").over(Window.partitionBy("k").orderBy("seq"))
    return log.withColumn("was", before).filter("op = 'del' and (was is null or was = 'del')").select("seq", "k")


def lookup(store: DataFrame, keys: DataFrame, default=None) -> DataFrame:
    """``(k, v)`` for every key asked, with the default where the store lacks it."""
    found = keys.select("k").join(store.select("k", "v", F.lit(True).alias("held")), "k", "left")
    return found.select("k", F.when(F.col("held"), F.col("v")).otherwise(F.lit(default)).alias("v"))


def get_item(store: DataFrame, key):
    """The value of a key; ``KeyError`` if it is absent."""
    row = store.filter(F.col("k") == F.lit(key)).first()
    if row is None:
        raise KeyError(key)
    return row["v"]


def contains(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys asked that the store holds."""
    return keys.select("k").join(store.select("k"), "k", "left_semi")


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with ``rows(k, v)`` set."""
    return store.select("k", "v").join(rows.select("k"), "k", "left_anti").unionByName(rows.select("k", "v"))


def remove(store: DataFrame, keys: DataFrame, strict: bool = True) -> DataFrame:
    """The store without the keys; ``KeyError`` for one that it lacks, if strict."""
    if strict:
        absent = keys.select("k").join(store.select("k"), "k", "left_anti").first()
        if absent is not None:
            raise KeyError(absent["k"])
    return store.join(keys.select("k"), "k", "left_anti")


def pop(store: DataFrame, key, *default):
    """Value of a key and the store without it."""
    try:
        value = get_item(store, key)
    except KeyError:
        if not default:
            raise
        return default[0], store
    return value, store.filter(F.col("k") != F.lit(key))


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def _power_of_two(c: Column) -> Column:
    return F.greatest(F.lit(LEAST_CAPACITY), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(c, F.lit(1)))))).cast("long")


def stats(store: DataFrame) -> DataFrame:
    """``(size, capacity, load_factor)`` of a table that doubles above the load limit."""
    n = store.agg(F.count("*").alias("size"))
    return n.select("size", _power_of_two(F.ceil(F.col("size") / LOAD_MAX)).alias("capacity")).select(
        "size", "capacity", F.round(F.col("size") / F.col("capacity"), 6).alias("load_factor")
    )


def probe_lengths(store: DataFrame, capacity: int) -> DataFrame:
    """``(slot, n)``: keys of any type by home slot of a power-of-two table."""
    home = F.pmod(F.shiftrightunsigned(F.xxhash64("k"), 7), F.lit(capacity))
    return store.groupBy(home.alias("slot")).agg(F.count("*").alias("n"))


def probes(store: DataFrame, capacity: int) -> DataFrame:
    """``(k, home, probe)``: how far each integer key lies from its home slot in a table of a power of
    two of slots, probed slot by slot, where a key farther from home goes before a nearer one.

    Keys then stand in the order of their homes, each at its home or one behind the key before it, so
    a place is the key's number plus the largest ``home - number`` up to it.  The table is a ring:
    the keys go around twice, and the second time counts.
    """
    from plexus.operators.sorting import rank_all, running_max

    if capacity > 1 << 31:
        raise ValueError("more slots than the hash reaches")
    home = F.pmod(F.pmod(F.col("k").cast("long"), F.lit(capacity)) * F.lit(HASH_MULTIPLIER % capacity), F.lit(capacity))
    laps = F.explode(F.array(F.lit(0), F.lit(1)))
    keys = store.select("k", home.alias("home"), laps.alias("lap")).withColumn("at", F.col("home") + F.col("lap") * F.lit(capacity))
    ranked = rank_all(keys, [F.col("at"), F.col("k")], "nth")
    placed = running_max(ranked.withColumn("ahead", F.col("at") - F.col("nth")), [F.col("nth")], "ahead", "most")
    return placed.filter("lap = 1").select("k", "home", (F.col("nth") + F.col("most") - F.col("at")).alias("probe"))


def probe_stats(store: DataFrame) -> DataFrame:
    """``stats`` with the longest and the mean probe."""
    sizes = stats(store)
    capacity = sizes.first()["capacity"]
    found = probes(store, capacity).agg(F.coalesce(F.max("probe"), F.lit(0)).cast("long").alias("max_probe"), F.round(F.coalesce(F.avg("probe"), F.lit(0.0)), 6).alias("mean_probe"))
    return sizes.crossJoin(F.broadcast(found))


def shrunk(store: DataFrame, capacity: int) -> int:
    """Capacity after deletions: halved while the load is below the lower limit."""
    size = store.count()
    while capacity > LEAST_CAPACITY and size / capacity < LOAD_MIN:
        capacity //= 2
    return capacity


def encode(rows: DataFrame, col: str) -> DataFrame:
    """Dictionary ``(value, code)`` of a column's distinct values, codes dense from 0 in order."""
    from plexus.operators.sorting import rank_all

    distinct = rows.select(F.col(col).alias("value")).filter("value is not null").distinct()
    return rank_all(distinct, [F.col("value")], "code").select("value", (F.col("code") - 1).alias("code"))
