"""Ids, seeded shuffles, samples and splits (IDX-*, SMP-*, SPL-*, PRT-01).

Randomness is a function of md5(seed ':' id), so results are reproducible,
independent of partitioning, and equal in any engine that has md5. Ranks use
K-RANK (operators.rank), never a single-partition window over the data.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions.labels import seeded_hex
from textcurate.operators import rank

# Fixed values of the reference's splitters.
SEED = 42
TEST_SHARE = Fraction(15, 100)
VALIDATION_SHARE = Fraction(15, 100)
SEQUENTIAL_FRACTIONS = (0.8, 0.1, 0.1)
LABELED_RATIO = 0.7
SAMPLE_CAP = 10000


def shuffle_key(id_col: str, seed: int = SEED) -> Column:
    return seeded_hex(seed, id_col)


def shuffle_rank(df: DataFrame, id_col: str, out: str = "shuffle_rank",
                 partition: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """SMP-01: 1-based position in the seeded shuffle (per partition if given)."""
    staged = df.withColumn("_shk", shuffle_key(id_col, seed))
    out_df = rank.row_number_exact(staged, [F.col("_shk"), F.col(id_col)],
                                   rank.hex_bucket(F.col("_shk")), partition or [], out)
    return out_df.drop("_shk")


def renumber(df: DataFrame, order_col: str = "pos", out: str = "new_id",
             bounds_from: DataFrame | None = None) -> DataFrame:
    """IDX-01: 1..N in input order (range buckets from a quantile sketch)."""
    b = rank.range_bucket(df, order_col, out="_rb", bounds_from=bounds_from)
    return rank.row_number_exact(b, [F.col(order_col)], F.col("_rb"), [], out).drop("_rb")


def sample_n(df: DataFrame, id_col: str, n: int = SAMPLE_CAP, seed: int = SEED) -> DataFrame:
    """SMP-02: the first n rows of the seeded shuffle. orderBy+limit plans as a
    distributed top-k (TakeOrderedAndProject), not a full sort."""
    k = shuffle_key(id_col, seed)
    return df.withColumn("shuffle_key", k).orderBy("shuffle_key", id_col).limit(n)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row. Catalyst drops the
    constant key and plans a broadcast nested-loop join with one row, which adds
    columns and no rows."""
    return (df.withColumn("_one", F.lit(0))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(0))), "_one").drop("_one"))


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def idiv(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative integers, overflow-free: products
    such as quota x class size exceed 64 bits at 1e11 rows, so the arithmetic
    is done in decimal(38,0) and the quotient taken from an exact multiple."""
    a, b = _dec(a), _dec(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def imod(a: Column, b: Column) -> Column:
    return F.pmod(_dec(a), _dec(b)).cast("long")


def _ceil_share(n: Column, share: Fraction) -> Column:
    """ceil(n * p / q) in integer arithmetic."""
    p, q = share.numerator, share.denominator
    return idiv(_dec(n) * p + (q - 1), F.lit(q))


def _largest_remainder(counts: DataFrame, total_col: str, size_col: str, cls: str,
                       label: str, out: str) -> DataFrame:
    """Allocate ``total_col`` over rows proportionally to ``size_col``: floors
    first, leftovers to the largest remainders, ties by label order. Runs on the
    per-class count table (one row per class)."""
    all_rows = Window.partitionBy(F.lit(0))
    n_all = F.sum(size_col).over(all_rows)
    staged = counts.withColumn("_n_all", n_all)
    prod = _dec(F.col(total_col)) * _dec(F.col(size_col))
    staged = staged.withColumn("_f", F.when(F.col("_n_all") == 0, F.lit(0))
                               .otherwise(idiv(prod, F.col("_n_all"))).cast("long"))
    staged = staged.withColumn("_r", F.when(F.col("_n_all") == 0, F.lit(0))
                               .otherwise(imod(prod, F.col("_n_all"))).cast("long"))
    staged = staged.withColumn("_left", F.col(total_col) - F.sum("_f").over(all_rows))
    staged = staged.withColumn("_rk", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("_r").desc(), F.col(label))))
    return staged.withColumn(out, (F.col("_f") + F.when(F.col("_rk") <= F.col("_left"), 1)
                                   .otherwise(0)).cast("long")) \
                 .drop("_n_all", "_f", "_r", "_left", "_rk")


def stratified_quotas(df: DataFrame, label: str, test: Fraction = TEST_SHARE,
                      validation: Fraction = VALIDATION_SHARE) -> DataFrame:
    """SPL-01 quotas per class: test = ceil(test*n), spread by largest
    remainder; validation = ceil(validation/(1-test) * rest), spread likewise.
    A class with fewer than two rows gets no quota (all its rows go to train).
    Input is the per-class count table: one row per label value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    elig = counts.where(F.col("n_c") >= 2)
    n = F.sum("n_c").over(Window.partitionBy(F.lit(0)))
    q = elig.withColumn("_t_total", _ceil_share(n, test))
    q = _largest_remainder(q, "_t_total", "n_c", "n_c", label, "t_c")
    q = q.withColumn("m_c", F.col("n_c") - F.col("t_c"))
    if validation > 0:
        v_share = validation / (1 - test)
        q = q.withColumn("_v_total", _ceil_share(F.sum("m_c").over(Window.partitionBy(F.lit(0))),
                                                 v_share))
        q = _largest_remainder(q, "_v_total", "m_c", "m_c", label, "v_c")
    else:
        q = q.withColumn("v_c", F.lit(0).cast("long"))
    q = q.select(label, "t_c", "v_c")
    return rank.join_null_safe(counts, q, [label], "left").select(
        label, "n_c", F.coalesce("t_c", F.lit(0)).cast("long").alias("t_c"),
        F.coalesce("v_c", F.lit(0)).cast("long").alias("v_c"))


def stratified_split(df: DataFrame, label: str, id_col: str,
                     test: Fraction = TEST_SHARE, validation: Fraction = VALIDATION_SHARE,
                     seed: int = SEED) -> DataFrame:
    """SPL-01/02: adds ``split``. Within each class rows are taken in seeded
    shuffle order: the first t_c go to test, the next v_c to validation. Rows
    without a label form a class. The quota table has one row per class; whether
    it is broadcast is left to its runtime size."""
    quotas = stratified_quotas(df, label, test, validation).drop("n_c")
    ranked = shuffle_rank(df, id_col, "_srk", [label], seed=seed)
    j = rank.join_null_safe(ranked, quotas, [label], "left")
    split = (F.when(F.col("_srk") <= F.col("t_c"), "test")
             .when(F.col("_srk") <= F.col("t_c") + F.col("v_c"), "validation")
             .otherwise("train"))
    return j.withColumn("split", split).drop("_srk", "t_c", "v_c")


def sequential_split(df: DataFrame, id_col: str, fractions=SEQUENTIAL_FRACTIONS,
                     seed: int = SEED) -> DataFrame:
    """SPL-03: unstratified; after the seeded shuffle the first int(n*train)
    rows are train, the next int(n*val) validation, the rest test."""
    tr, va, te = fractions
    if abs(tr + va + te - 1.0) > 1e-9:
        raise ValueError("train/validation/test fractions must sum to 1")
    n = df.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    cuts = n.select(F.floor(F.col("_n") * F.lit(tr)).cast("long").alias("_tr"),
                    F.floor(F.col("_n") * F.lit(va)).cast("long").alias("_va"))
    ranked = shuffle_rank(df, id_col, "_srk", seed=seed)
    j = with_scalars(ranked, cuts)
    split = (F.when(F.col("_srk") <= F.col("_tr"), "train")
             .when(F.col("_srk") <= F.col("_tr") + F.col("_va"), "validation")
             .otherwise("test"))
    return j.withColumn("split", split).drop("_srk", "_tr", "_va")


def partition_labeled(df: DataFrame, id_col: str, label: str, ratio: float = LABELED_RATIO,
                      seed: int = SEED) -> DataFrame:
    """PRT-01: after the seeded shuffle keep the label of the first int(n*ratio)
    rows, null it on the rest. Adds ``is_labeled``."""
    n = df.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    cut = n.select(F.floor(F.col("_n") * F.lit(ratio)).cast("long").alias("_cut"))
    ranked = shuffle_rank(df, id_col, "_srk", seed=seed)
    j = with_scalars(ranked, cut)
    keep = F.col("_srk") <= F.col("_cut")
    return (j.withColumn(label, F.when(keep, F.col(label)))
            .withColumn("is_labeled", keep).drop("_srk", "_cut"))
