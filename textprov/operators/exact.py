"""Exact per-group top-q in a deterministic hash order, without sorting groups.

A naive ``row_number() over (partition by g order by h)`` puts a whole group
in one task; a group holding a third of all rows then sorts a third of the
data on one core.  Here instead:

1. every row gets ``h = md5(seed:id)`` and bucket ``b`` = first ``digits`` hex
   digits of ``h`` (65,536 buckets for 4 digits);
2. a histogram ``(g, b) -> n`` is aggregated (map-side partial aggregation, so
   a hot group costs nothing extra);
3. a running sum over the histogram (at most 16^digits rows per group) finds
   for each group the boundary bucket ``b*`` where the q-th row lies; while a
   boundary bucket holds more than ``max_bucket_rows`` rows, steps 2-3 repeat
   on the next digits inside it (a group of 10^13 rows needs 3 levels);
4. only the rows of the final boundary bucket are ranked, which yields the
   group's *cutoff*: the q-th smallest ``(h, id)``;
5. every row is then decided on its own: taken iff ``(h, id) <= cutoff``.

Steps 1-4 only touch the key columns and tables of one row per (group,
bucket); step 5 is a map-side comparison against the cutoff table (one row
per group, broadcast when the number of groups is under ``max_groups``).
The result equals ``row_number() over (partition by g order by h, id) <= q``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_bucket, seeded_md5

MAX_BROADCAST_GROUPS = 1_000_000
BUCKET_TARGET_ROWS = 200_000  # rows ranked in one task at most (boundary bucket)


def order_key(seed, id_col: str) -> Column:
    return seeded_md5(seed, id_col)


def cutoffs(keys_df: DataFrame, keys: list[str], quota: DataFrame, seed, id_col: str,
            digits: int = 4, n_groups: int | None = None,
            max_groups: int = MAX_BROADCAST_GROUPS,
            max_bucket_rows: int = BUCKET_TARGET_ROWS) -> DataFrame:
    """One row per group with q > 0: ``keys, _cut_h, _cut_id`` (the q-th smallest (h, id)).

    Refines level by level: each level histograms the next ``digits`` hex
    digits of the rows inside the group's current boundary prefix (at most
    16^digits rows per group in the running-sum window), until the boundary
    bucket holds at most ``max_bucket_rows`` rows; only those are ranked.
    ``quota`` has ``keys + ['q']``; only the key and id columns of ``keys_df``
    are read.  Per-level state is one row per group (checkpointed).
    """
    rows = keys_df.select(*keys, id_col).withColumn("_h", order_key(seed, id_col))
    rk = [f"_k{i}" for i in range(len(keys))]
    small = n_groups is not None and n_groups <= max_groups  # state tables: one row per group

    def attach(df, state):
        on = [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, rk)]
        j = df.join(F.broadcast(state) if small else state, on, "inner").drop(*rk)
        return j.filter(F.col("_h").startswith(F.col("_prefix")))

    state = (quota.select(*[F.col(k).alias(r) for k, r in zip(keys, rk)],
                          F.lit("").alias("_prefix"), F.col("q").cast("bigint").alias("_need"))
             .filter(F.col("_need") > 0))
    done_parts = []
    for _ in range(32 // digits):
        sub = attach(rows, state)
        b = F.col("_h").substr(F.length("_prefix") + 1, F.lit(digits))
        hist = sub.groupBy(*keys, "_prefix", "_need", b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = (hist.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
                    .withColumn("_tot", F.sum("_n").over(Window.partitionBy(*keys))))
        # the bucket holding the need-th row; when need >= rows left, the last bucket
        bnd = (hist.filter((F.col("_before") < F.col("_need"))
                           & ((F.col("_before") + F.col("_n") >= F.col("_need"))
                              | (F.col("_before") + F.col("_n") == F.col("_tot"))))
               .select(*[F.col(k).alias(r) for k, r in zip(keys, rk)],
                       F.concat("_prefix", "_b").alias("_prefix"),
                       F.least(F.col("_need") - F.col("_before"), F.col("_n")).alias("_need"),
                       F.col("_n").alias("_bn"))
               .checkpoint(eager=True))
        fin = (F.col("_bn") <= max_bucket_rows) | (F.length("_prefix") >= 32)
        done_parts.append(bnd.filter(fin).drop("_bn"))
        state = bnd.filter(~fin).drop("_bn")
        if state.count() == 0:
            break
    final = done_parts[0]
    for d in done_parts[1:]:
        final = final.unionByName(d)
    brow = attach(rows, final)
    wr = Window.partitionBy(*keys).orderBy("_h", id_col)  # at most max_bucket_rows rows per group
    return (brow.withColumn("_rn", F.row_number().over(wr))
            .filter(F.col("_rn") == F.col("_need"))
            .select(*keys, F.col("_h").alias("_cut_h"), F.col(id_col).alias("_cut_id")))


def taken_expr(seed, id_col: str) -> Column:
    """Row is at or before its group's cutoff (false when the group takes nothing)."""
    h = order_key(seed, id_col)
    return F.coalesce((h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(id_col) <= F.col("_cut_id"))),
                      F.lit(False))


def attach_cutoffs(df: DataFrame, keys: list[str], cut: DataFrame, n_groups: int | None = None,
                   max_groups: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """Left-join the cutoff table; broadcast when the group count is known to be small,
    otherwise a shuffle join (AQE may still broadcast it after measuring it)."""
    rk = [f"_c{i}" for i in range(len(keys))]
    c = cut.select(*[F.col(k).alias(r) for k, r in zip(keys, rk)], "_cut_h", "_cut_id")
    if n_groups is not None and n_groups <= max_groups:
        c = F.broadcast(c)
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, rk)]
    return df.join(c, on, "left").drop(*rk)


def mark_first_q(df: DataFrame, keys: list[str], quota: DataFrame, seed, id_col: str,
                 out_col: str = "taken", digits: int = 4, n_groups: int | None = None) -> DataFrame:
    """Add boolean ``out_col``: row is among the first ``q`` of its group.

    ``quota``: ``keys + ['q']``, one row per group (groups not in it take
    nothing).  Without keys see :func:`first_q_filter`.
    """
    if not keys:
        q = quota.first()
        return df.withColumn(out_col, first_q_filter(df, int(q["q"]) if q else 0, seed, id_col, digits))
    cut = cutoffs(df, keys, quota, seed, id_col, digits, n_groups=n_groups)
    j = attach_cutoffs(df, keys, cut, n_groups=n_groups)
    return j.withColumn(out_col, taken_expr(seed, id_col)).drop("_cut_h", "_cut_id")


def single_cutoff(df: DataFrame, q: int, seed, id_col: str, digits: int = 4,
                  max_bucket_rows: int = BUCKET_TARGET_ROWS):
    """The q-th smallest ``(h, id)`` of the whole table, or None (q = 0 or empty table).

    A histogram on the first ``digits`` hex digits finds the boundary bucket;
    while that bucket holds more than ``max_bucket_rows`` rows the search is
    refined inside it on the next digits.  Only one-row results reach the
    driver, and the final ranking sees at most ``max_bucket_rows`` rows.
    """
    if q <= 0:
        return None
    rows = df.select(id_col).withColumn("_h", order_key(seed, id_col))
    prefix, need, width = "", q, digits
    while True:
        sub = rows.filter(F.col("_h").startswith(prefix)) if prefix else rows
        b = F.substring("_h", len(prefix) + 1, width)
        hist = sub.groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= 16^width rows
        hist = (hist.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
                    .withColumn("_tot", F.sum("_n").over(Window.partitionBy())))
        r = (hist.filter((F.col("_before") < need) & ((F.col("_before") + F.col("_n") >= need)
                                                     | (F.col("_before") + F.col("_n") == F.col("_tot"))))
             .select("_b", "_n", F.least(F.lit(need) - F.col("_before"), F.col("_n")).alias("_need")).first())
        if r is None:
            return None
        prefix, need = prefix + r["_b"], int(r["_need"])
        if r["_n"] <= max_bucket_rows or len(prefix) >= 32:
            break
        width = 4
    wr = Window.orderBy("_h", id_col)  # rows of one small bucket only
    c = (rows.filter(F.col("_h").startswith(prefix)).withColumn("_rn", F.row_number().over(wr))
         .filter(F.col("_rn") == need).select("_h", id_col).first())
    return (c["_h"], c[id_col])


def first_q_filter(df: DataFrame, q: int, seed, id_col: str, digits: int = 4) -> Column:
    """Boolean column: row is among the q smallest ``(h, id)`` of ``df``."""
    cut = single_cutoff(df, q, seed, id_col, digits)
    if cut is None:
        return F.lit(False)
    h = order_key(seed, id_col)
    return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (F.col(id_col) <= F.lit(cut[1])))


def largest_remainder_quota(counts: DataFrame, key: str, frac: float, seed,
                            total_col: str = "n") -> DataFrame:
    """Quota per group: floor share plus one for the largest remainders.

    T = ceil(frac * N) rows in total (as scikit-learn sizes a test split);
    remainders are compared rounded to 9 digits, ties broken by
    ``md5(seed:group)`` then the group name.  ``counts`` has one row per group
    (number of strata: small), so the window over it is tiny.
    """
    allw = Window.partitionBy()
    n = F.col(total_col).cast("double")
    big_n = F.sum(total_col).over(allw).cast("double")
    t = F.ceil(F.lit(frac) * big_n)
    c = (counts.withColumn("_T", t)
         .withColumn("_exact", n * F.col("_T") / big_n)
         .withColumn("_base", F.floor("_exact"))
         .withColumn("_rem", F.round(F.col("_exact") - F.col("_base"), 9)))
    c = c.withColumn("_left", F.col("_T") - F.sum("_base").over(allw))
    rk = Window.partitionBy().orderBy(F.desc("_rem"), seeded_md5(seed, key), F.asc(key))
    c = c.withColumn("_rk", F.row_number().over(rk))
    return c.select(key, total_col,
                    (F.col("_base") + (F.col("_rk") <= F.col("_left")).cast("bigint"))
                    .cast("bigint").alias("q"))
