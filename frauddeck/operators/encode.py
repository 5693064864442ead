"""Categorical encoders and scalers fitted on one frame and applied to another.

Fitted state is always a DataFrame (value -> code / count / statistic) joined back, so it
is computed with partial aggregation and never gathered on the driver, except the level
lists of wide one-hot encoding, which become columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.functions import scalars as S
from frauddeck.operators import globalrank
from frauddeck.operators.attach import attach_row


def one_hot(df: DataFrame, cols: list[str], *, null_token: str = "unknown",
            levels_from: DataFrame | None = None, drop_source: bool = True) -> DataFrame:
    """``<lower(col)>_<level>`` 0/1 columns for every level seen in ``levels_from`` (default df).

    Every level becomes a column, so this suits the declared low-cardinality categoricals (all
    their levels are read in one job); :func:`one_hot_vector` is the form for any cardinality.
    """
    src = levels_from if levels_from is not None else df
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    seen = src.agg(*[F.sort_array(F.collect_set(S.null_token(c, null_token))).alias(c) for c in cols]).first()
    new_cols = {f"{c.lower()}_{lv}": (S.null_token(c, null_token) == F.lit(lv)).cast("int") for c in cols for lv in seen[c]}
    out = df.withColumns(new_cols)
    return out.drop(*cols) if drop_source else out


def one_hot_vector(df: DataFrame, cols: list[str], *, null_token: str = "unknown", levels_from: DataFrame | None = None) -> DataFrame:
    """I1 for any cardinality: one sparse vector column ``<lower(col)>_vec`` per categorical, levels
    in sorted order; a level unseen in ``levels_from`` is all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    tok = lambda d: d.withColumns({f"_tok_{c}": S.null_token(c, null_token) for c in cols})
    ix = StringIndexer(inputCols=[f"_tok_{c}" for c in cols], outputCols=[f"_ix_{c}" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep")
    oh = OneHotEncoder(inputCols=[f"_ix_{c}" for c in cols], outputCols=[f"{c.lower()}_vec" for c in cols], dropLast=True)
    model = Pipeline(stages=[ix, oh]).fit(tok(levels_from if levels_from is not None else df))
    return model.transform(tok(df)).drop(*[f"_tok_{c}" for c in cols], *[f"_ix_{c}" for c in cols])


def fit_codes(train: DataFrame, col: str, *, null_token: str = "__NA__") -> DataFrame:
    """I2-I4 fit: sorted distinct values -> 0-based code; returns ``(value, code)`` + ``n_classes``.

    Codes come from the distributed running count (no single-partition window).
    """
    vals = train.select(S.null_token(col, null_token).alias("_value")).distinct()
    ranked = globalrank.row_number_within(vals, [], [F.col("_value")], out="_code1")
    n = ranked.agg(F.count(F.lit(1)).alias("n_classes"))  # of the ranked values, which are kept
    return attach_row(ranked.select("_value", (F.col("_code1") - 1).cast("bigint").alias("code")), n)


def value_counts(ref: DataFrame, cols: list[str], *, null_token: str = "__NA__") -> DataFrame:
    """``(_column, _value, _n)``: how often each column has each value, of all columns in one pass; kept, as
    :func:`codes_of` and :func:`log_count_encode` read it for each column."""
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(ref.sparkSession)
    long = ref.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), S.null_token(c, null_token).alias("_value")) for c in cols])))
    return long.groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("_n")).checkpoint()


def codes_of(counts: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """What :func:`fit_codes` returns, for each of ``cols``, from their :func:`value_counts`; ranked once."""
    vals = counts.filter(F.col("_column").isin(cols)).select("_column", "_value")
    ranked = globalrank.row_number_within(vals, ["_column"], [F.col("_value")], out="_code1")
    ranked = ranked.select("_column", "_value", (F.col("_code1") - 1).cast("bigint").alias("code"), F.col("_code1_n").alias("n_classes"))
    return {c: ranked.filter(F.col("_column") == c).drop("_column") for c in cols}


def apply_codes(df: DataFrame, col: str, mapping: DataFrame, *, unseen: str = "minus_one",
                null_token: str = "__NA__", out: str | None = None) -> DataFrame:
    """I2 (unseen -> -1), I3 (unseen -> 0, the first class), I4 (unseen -> number of classes)."""
    out = out or col
    d = df.withColumn("_value", S.null_token(col, null_token))
    j = d.join(mapping.select("_value", F.col("code").alias("_code")), "_value", "left")
    if unseen == "n_classes":
        j = attach_row(j, mapping.agg(F.coalesce(F.max("n_classes"), F.lit(0).cast("bigint")).alias("_ncls")))  # one row
    fill = {"minus_one": lambda: F.lit(-1).cast("bigint"), "first": lambda: F.lit(0).cast("bigint"),
            "n_classes": lambda: F.col("_ncls")}[unseen]()
    return j.withColumn(out, F.coalesce(F.col("_code"), fill)).drop("_value", "_code", "_ncls")


def frequency_encode(df: DataFrame, col: str, out: str, *, reference: DataFrame | None = None) -> DataFrame:
    """Share of rows with this value among non-null rows of ``reference`` (default df); unseen -> 0."""
    ref = reference if reference is not None else df
    tot = ref.agg(F.count(col).alias("_tot"))
    counts = ref.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    freq = attach_row(counts, tot).select(col, (F.col("_c") / F.col("_tot")).alias(out))
    return df.join(freq, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def log_count_encode(df: DataFrame, cols: list[str], *, reference: DataFrame | None = None,
                     null_token: str = "__NA__", counts: DataFrame | None = None) -> DataFrame:
    """``freq_<col>`` = log1p(count of the value in ``reference``); NULL -> token; unseen -> 0.
    ``counts``: the reference's :func:`value_counts`, if they are there already."""
    ref = reference if reference is not None else df
    out = df
    for c in cols:
        if counts is not None:
            cnt = counts.filter(F.col("_column") == c).select(F.col("_value").alias("_v"), "_n")
        else:
            cnt = ref.groupBy(S.null_token(c, null_token).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        out = (out.withColumn("_v", S.null_token(c, null_token)).join(cnt, "_v", "left")
                  .withColumn(f"freq_{c}", F.log1p(F.coalesce(F.col("_n"), F.lit(0)).cast("double")))
                  .drop("_v", "_n"))
    return out


def out_of_fold_target_encode(df: DataFrame, col: str, *, fold: str = "fold", label: str = "TX_FRAUD",
                              alpha: float | None = None, out: str | None = None) -> DataFrame:
    """Each row gets the label mean of its category over the *other* folds.

    One ``groupBy(col, fold)`` gives per-fold sums; out-of-fold = category total - own fold.
    No statistic (category absent from other folds) -> global mean. With ``alpha``
    (I8) the mean is smoothed: ``(n*m + alpha*g) / (n + alpha)`` with g = global mean.
    """
    out = out or f"{col}_te"
    y = F.col(label).cast("double")
    g = df.agg(F.avg(y).alias("_g"))
    per = df.groupBy(col, fold).agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
    from pyspark.sql import Window
    w = Window.partitionBy(col)
    per = per.select(col, fold, (F.sum("_fs").over(w) - F.col("_fs")).alias("_os"),
                     (F.sum("_fn").over(w) - F.col("_fn")).alias("_on"))
    j = attach_row(df.join(per, [col, fold], "left"), g)
    n, s = F.col("_on"), F.col("_os")
    if alpha is None:
        enc = F.when(n > 0, s / n)
    else:
        enc = F.when(n > 0, (s + F.lit(alpha) * F.col("_g")) / (n + F.lit(alpha)))
    return j.withColumn(out, F.coalesce(enc, F.col("_g"))).drop("_os", "_on", "_g")


def out_of_fold_tables(df: DataFrame, cols: list[str], *, fold: str = "fold", label: str = "TX_FRAUD", alpha: float) -> dict[str, DataFrame]:
    """The distinct results of :func:`out_of_fold_target_encode` for each of ``cols`` (text without nulls): a row
    ``(value, fold, <col>_te, _n)`` for each value and fold that has rows. All columns are summed up in one pass."""
    from pyspark.sql import Window
    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    y = F.col(label).cast("double")
    long = df.select(fold, y.alias("_y"), F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in cols])))
    per = long.groupBy("_column", "_value", fold).agg(F.sum("_y").alias("_fs"), F.count("_y").alias("_fn"), F.count(F.lit(1)).alias("_n")).checkpoint()
    w = Window.partitionBy("_column", "_value")
    per = per.withColumns({"_os": F.sum("_fs").over(w) - F.col("_fs"), "_on": F.sum("_fn").over(w) - F.col("_fn")})
    per = attach_row(per, df.agg(F.avg(y).alias("_g")))
    n, s = F.col("_on"), F.col("_os")
    te = F.coalesce(F.when(n > 0, (s + F.lit(alpha) * F.col("_g")) / (n + F.lit(alpha))), F.col("_g"))
    per = per.select("_column", "_value", fold, te.alias("_te"), "_n").checkpoint()
    return {c: per.filter(F.col("_column") == c).select(F.col("_value").alias(c), fold, F.col("_te").alias(f"{c}_te"), "_n") for c in cols}


def apply_target_encoding(rows: DataFrame, encoded_train: DataFrame, col: str, te_col: str | None = None, *, label: str = "TX_FRAUD") -> DataFrame:
    """Test rows get the mean of train's encoded value for their category; unseen (or null) ->
    train's label mean."""
    te_col = te_col or f"{col}_te"
    per = encoded_train.filter(F.col(col).isNotNull()).groupBy(col).agg(F.avg(te_col).alias(te_col))
    g = encoded_train.agg(F.avg(F.col(label).cast("double")).alias("_g"))
    return (attach_row(rows.join(per, col, "left"), g)
                .withColumn(te_col, F.coalesce(F.col(te_col), F.col("_g"))).drop("_g"))


def standard_scale(df: DataFrame, cols: list[str], *, fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / std_pop with statistics from ``fit_on`` (default df); std 0 -> 1."""
    ref = fit_on if fit_on is not None else df
    stats = ref.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = attach_row(df, stats)
    upd = {}
    for c in cols:
        s = F.col(f"_s_{c}")
        upd[c + suffix] = (F.col(c) - F.col(f"_m_{c}")) / F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
    return j.withColumns(upd).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def inverse_standard_scale(df: DataFrame, col: str, mean: Column, std: Column, out: str) -> DataFrame:
    """I10 inverse: x * std + mean."""
    return df.withColumn(out, F.col(col) * std + mean)


def prepare_categoricals(df: DataFrame, cols: list[str], token: str = "MISSING") -> DataFrame:
    """Declared categoricals that are present -> strings with a NULL token."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: S.null_token(c, token) for c in present})
