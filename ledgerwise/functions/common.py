"""Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
LAMPORTS_PER_SOL = 1_000_000_000


def clean_wallet(c: Column | str) -> Column:
    """Trimmed wallet string; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def rnd(c: Column, digits: int = 0) -> Column:
    """Round half away from zero after binary scaling (same rule in any IEEE engine)."""
    scale = float(10**digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def stable_sum(c: Column, scale: int = 6) -> Column:
    """Double sum that does not depend on row order: summed as a decimal."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def stable_avg(c: Column, scale: int = 6) -> Column:
    return F.try_divide(stable_sum(c, scale), F.count(c))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def lookup(mapping: Mapping[str, object], c: Column) -> Column:
    """Look a code up in a small constant dictionary without a join."""
    entries = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*entries), c)


def in_set(c: Column, values: Sequence[str] | frozenset[str]) -> Column:
    return c.isin(*sorted(values))


def codes(*pairs: tuple[Column, str | Column]) -> Column:
    """Ordered array of the codes whose condition holds (null counts as false)."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(code) if isinstance(code, str) else code) for cond, code in pairs])
    )


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def utc_date(ts: Column) -> Column:
    """Calendar date of unix seconds, independent of the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / DAY).cast("int"))


def utc_minute_text(ts: Column) -> Column:
    minute = F.floor(ts / 60)
    return F.concat(
        utc_date(ts).cast("string"),
        F.lit(" "),
        F.lpad((F.floor(minute / 60) % 24).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((minute % 60).cast("string"), 2, "0"),
    )


def both_ends(transfers: DataFrame, *keep: str, self_once: bool = True) -> DataFrame:
    """One row per (transfer, end): ``wallet``, ``counterparty``, ``is_sender`` and ``keep``.

    A self-transfer gives one row when ``self_once``, else two.
    """
    s, r = clean_wallet("sender"), clean_wallet("receiver")
    ends = [
        F.when(s.isNotNull(), F.struct(s.alias("wallet"), r.alias("counterparty"), F.lit(True).alias("is_sender"))),
        F.when(
            r.isNotNull() & (~s.eqNullSafe(r) if self_once else F.lit(True)),
            F.struct(r.alias("wallet"), s.alias("counterparty"), F.lit(False).alias("is_sender")),
        ),
    ]
    return transfers.select(F.explode(F.array(*ends)).alias("end"), *keep).filter("end IS NOT NULL").select("end.*", *keep)


def assemble(base: DataFrame, *parts: DataFrame, key: str = "wallet") -> DataFrame:
    """Columns of all parts side by side for the keys of ``base`` (each part has one row per key).

    One union and one aggregation replace a chain of joins: a single shuffle, and a
    task never holds one sort buffer per joined part.
    """
    rows = base.withColumn("_base", F.lit(True))
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    kept = [c for c in rows.columns if c not in (key, "_base")]
    merged = rows.groupBy(key).agg(F.max("_base").alias("_base"), *[F.any_value(c, True).alias(c) for c in kept])
    return merged.filter("_base").drop("_base")


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None,
             salt_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    Spark limits each map partition to ``n`` rows per key before the shuffle, so a
    hot key ships only (map tasks x n) rows.  For a large ``n`` the key is first
    split over 16 salts, so no single task receives that whole amount.
    """
    name = rank or "_rn"
    if n > 100 and salt_cols:
        salt = F.pmod(F.xxhash64(*salt_cols), F.lit(16))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_pre", F.row_number().over(w))
        df = df.filter(F.col("_pre") <= n).drop("_salt", "_pre")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def split_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
               rank: str = "rank", total: str = "total") -> DataFrame:
    """Exact row number and group size per key, computed bucket by bucket.

    ``bucket`` must be monotone in the leading ``order`` column.  A hot key is
    spread over its buckets: only per-bucket counts meet in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "_bucket",
        (F.sum("_n").over(w.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(w).alias(total),
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_pos", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(rank, F.col("_pos") + F.col("_offset"))
        .drop("_bucket", "_pos", "_offset")
    )


def split_lag(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str,
              out: str) -> DataFrame:
    """Previous row's ``value`` per key, computed bucket by bucket like ``split_rank``."""
    keyed = df.withColumn("_bucket", bucket)
    last = keyed.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        keyed.withColumn("_prev", F.lag(F.struct(value)).over(w))
        .join(carried, [*keys, "_bucket"])
        .withColumn(out, F.coalesce(F.col("_prev"), F.col("_carry"))[value])
        .drop("_bucket", "_prev", "_carry")
    )


def near_in_time(df: DataFrame, key: str, ts: str, before: int, after: int, width: int, out: str,
                 strict: bool = False) -> DataFrame:
    """Rows with a boolean ``out``: does the key have another row in [ts-before, ts+after]?

    Time is cut in buckets of ``width`` seconds; rows near an edge are also placed
    in the neighbouring bucket, so a hot key is spread over its buckets and the
    frame stays exact.  Edges lie half a width off zero, as many times are whole hours or days.
    ``strict`` ignores rows with the same timestamp.
    """
    t = F.col(ts) + width // 2
    home = F.floor(t / width)
    reach = F.array_distinct(F.array(home, F.floor((t + before) / width), F.floor((t - after) / width)))
    spread = df.withColumn("_home", home).withColumn("_bucket", F.explode(reach))
    w = Window.partitionBy(key, "_bucket").orderBy(ts)
    others = F.count(F.lit(1)).over(w.rangeBetween(-before, after))
    if strict:
        others = others - F.count(F.lit(1)).over(w.rangeBetween(0, 0)) + F.lit(1)
    return spread.withColumn(out, others > 1).filter(F.col("_home") == F.col("_bucket")).drop("_home", "_bucket")


def join_skewed(rows: DataFrame, table: DataFrame, key: str, weight: str, share: int = 1_000,
                task_rows: int | None = None) -> DataFrame:
    """Inner join with a table of one row per key, where few keys may hold most rows.

    ``weight`` is the number of rows of each key.  Keys with at least 1 / ``share`` of all rows are at most
    ``share``, whatever the data, so these rows stay in place and meet a broadcast of that size; only the others are
    shuffled by the key, with ``task_rows`` to parts of about that many rows, whatever the session's setting.  Both inputs
    are read twice and should be written tables.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) * share >= F.lit(total)
    few = table.filter(heavy)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    others = table.filter(~heavy)
    if task_rows:
        n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows))
        light, others = light.repartition(n, key), others.repartition(n, key)
    light = light.join(others, key)
    return rows.join(F.broadcast(few), key).unionByName(light)
