"""Per-entity history features, skew-safe.

Every history feature is "what happened before this row for the same entity, in
(timestamp, id) order". For ordinary entities that is one plain window per entity key: one
exchange and one sort. It breaks when one customer / terminal / merchant holds a third of the
rows, so :func:`prior_history` first asks whether any key has more than ``rows_per_bucket``
rows (a count, and only for larger inputs a count per key). If so, the rows of every such *hot* entity
are numbered in (entity, timestamp, id) order, a distributed row number, and cut into buckets of
equal numbers of rows, be they spread over years or all in one second; then it works in two levels:

* local windows over ``(entity, bucket)``;
* a per-bucket summary (rows, sums, mean and squared deviations, max/min, last row, last ``n``
  rows), turned into per-bucket offsets with a window over the small bucket table, and joined
  back on ``(entity, bucket)``.

Running counts / sums / max / min, means with squared deviations, lag-1 and last-``n`` frames
all compose across buckets, so both ways define the same values (the tests compare them). A
row with a null key has no history: it is an entity of its own and keeps its place.

Trailing time-window counts (E11) are plain windows per entity, too: one exchange, and the rows keep
their columns. Where an entity has more than ``rows_per_bucket`` rows, "halo" rows are used: each row
is copied into the next bucket of width = the window length, so a RANGE frame inside
``(entity, bucket)`` sees everything it needs. Entities with more than ``rows_per_bucket`` rows in two such buckets are counted by ranks instead:
rows and, for each window, a probe at ``t - w`` are merged in one range-partitioned order, and the
count is the difference of two running counts, wherever a range ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.functions.scalars import epoch_s, epoch_us
from frauddeck.operators import globalrank

US = 1_000_000
DAY = 86_400


def _hot_keys(d: DataFrame, keys: list[str], rows_per_bucket: int, max_hot: int = 100_000, n: int | None = None) -> tuple[DataFrame | None, int]:
    """:func:`_hot_keys_and_rows` without the number of rows."""
    return _hot_keys_and_rows(d, keys, rows_per_bucket, max_hot, n)[:2]


def _hot_keys_and_rows(d: DataFrame, keys: list[str], rows_per_bucket: int, max_hot: int = 100_000, n: int | None = None) -> tuple[DataFrame | None, int, int]:
    """The keys with more rows than a bucket should hold (None without any), that number and the number of all rows.

    The former is ``max(rows_per_bucket, ceil(N / max_hot))``, so there are at most ``max_hot`` such keys.
    ``n`` is the number of rows, if the caller knows it; otherwise it comes of the same job as the keys' counts.
    """
    if n is not None and n <= rows_per_bucket:
        return None, max(rows_per_bucket, -(-n // max_hot)), n
    per = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_kn"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows, most = per.agg(F.sum("_kn"), F.max(F.when(known, F.col("_kn")))).first()
    n = (rows or 0) if n is None else n
    thr = max(rows_per_bucket, -(-n // max_hot))
    if (most or 0) <= thr:
        return None, thr, n
    return per.filter(known & (F.col("_kn") > thr)).select(*keys, F.lit(True).alias("_hot")), thr, n


def _std(n: Column, m2: Column, mn: Column, mx: Column) -> Column:
    """Sample std from count and squared deviations; exactly 0 when all values are equal."""
    return (F.when(n < 2, F.lit(None).cast("double")).when(mn == mx, F.lit(0.0)).otherwise(F.sqrt(m2 / (n - 1))))


def _merged(na: Column, ma: Column, qa: Column, nb: Column, mb: Column, qb: Column) -> Column:
    """Squared deviations of two groups together, from counts, means and squared deviations."""
    return F.when(na == 0, qb).when(nb == 0, qa).otherwise(qa + qb + (mb - ma) * (mb - ma) * na * nb / (na + nb))


def _plain_history(d: DataFrame, keys: list[str], tid: str, lags: list[str], last_n: list[int], p: str) -> dict[str, Column]:
    """The helper columns by plain windows: one exchange on the keys, one sort."""
    wl = Window.partitionBy(*keys).orderBy("_us", tid)
    prior, v = wl.rowsBetween(Window.unboundedPreceding, -1), F.col("_v")
    n, mn, mx = F.count(v).over(prior), F.min(v).over(prior), F.max(v).over(prior)
    out = {f"{p}rn": F.row_number().over(wl).cast("bigint"), f"{p}cnt": n.cast("bigint"), f"{p}sum": F.sum(v).over(prior), f"{p}max": mx, f"{p}min": mn,
           f"{p}std": F.when(mn == mx, F.when(n >= 2, F.lit(0.0))).otherwise(F.stddev_samp(v).over(prior)),
           **{f"{p}prev_{c}": F.lag(c).over(wl) for c in lags}}
    for k in last_n:
        fr = wl.rowsBetween(-k, -1)
        n, mn, mx = F.count(v).over(fr), F.min(v).over(fr), F.max(v).over(fr)
        out |= {f"{p}l{k}_cnt": n.cast("bigint"), f"{p}l{k}_sum": F.sum(v).over(fr), f"{p}l{k}_min": mn, f"{p}l{k}_max": mx,
                f"{p}l{k}_std": F.when(mn == mx, F.when(n >= 2, F.lit(0.0))).otherwise(F.stddev_samp(v).over(fr))}
    return out


def prior_history(df: DataFrame, keys: list[str], *, ts: str = "TX_TS", tid: str = "TX_ID",
                  value: str | None = "TX_AMOUNT", lags: list[str] = (), last_n: list[int] = (),
                  rows_per_bucket: int = 1_000_000, p: str = "_h", n_rows: int | None = None,
                  finer: list[str] = (), finer_p: str = "_f", keys_of: DataFrame | None = None,
                  rows_per_task: int | None = None) -> DataFrame:
    """Add helper columns describing each row's prior history inside ``keys``.

    ``rows_per_bucket`` only chooses the plan (see the module's text), never the values; ``n_rows``,
    the number of rows if it is known, saves counting them. Keys are counted in ``keys_of``, a frame of the
    same rows that is cheaper to read (default ``df``). With ``rows_per_task``, more rows than the session's shuffle
    partitions hold at that number are dealt to more tasks, so that their sorts stay in memory.

    Added columns (``p`` = prefix):
      ``{p}rn``        1-based row number in (ts, tid) order
      ``{p}cnt``       prior non-null values            ``{p}sum / {p}std / {p}max / {p}min``
      ``{p}prev_<c>``  previous row's ``c`` for each ``c`` in ``lags`` (``_us`` = time in us)
      ``{p}l<n>_cnt / _sum / _std / _min / _max``  over the previous ``n`` rows (rows -n..-1)
    With ``finer``, also ``{finer_p}rn`` and ``{finer_p}prev__us`` within ``keys`` and those columns
    together; for ordinary keys that takes a sort, but no exchange of its own.
    """
    keys, finer = list(keys), list(finer)
    lags = list(dict.fromkeys(["_us", *lags]))
    last_n = sorted(set(last_n))
    d = df.withColumn("_us", epoch_us(ts)).withColumn("_v", F.col(value).cast("double") if value else F.lit(None).cast("double"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    names = df.columns
    hot, thr, n = _hot_keys_and_rows(d if keys_of is None else keys_of, keys, rows_per_bucket, n=n_rows)
    tasks = -(-n // rows_per_task) if rows_per_task else 0
    tasks = tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0

    def plain(rows: DataFrame) -> DataFrame:
        # a mark for each key, so that rows dealt out by the first keys need not move for more keys
        solo = {f"_solo_{k}": F.when(F.col(k).isNull(), F.col(tid).cast("string")) for k in [*keys, *finer]}
        rows = rows.withColumns(solo)
        marked = lambda ks: [x for k in ks for x in (k, f"_solo_{k}")]
        rows = rows.repartition(tasks, *marked(keys)) if tasks and hot is None else rows
        cols = _plain_history(rows, marked(keys), tid, lags, last_n, p)
        if finer:
            within = _plain_history(rows, marked([*keys, *finer]), tid, ["_us"], [], finer_p)
            cols |= {x: within[x] for x in (f"{finer_p}rn", f"{finer_p}prev__us")}
        return rows.select(*names, *[c.alias(x) for x, c in cols.items()])

    if hot is None:
        return plain(d)
    rest, finer = finer, []
    out = _bucket_history(d.filter(~missing), names, keys, hot, thr, tid, lags, last_n, p).unionByName(plain(d.filter(missing)))
    if rest:
        within = prior_history(out, [*keys, *rest], ts=ts, tid=tid, value=None, rows_per_bucket=rows_per_bucket, p=finer_p, n_rows=n_rows, keys_of=keys_of)
        out = within.select(*out.columns, f"{finer_p}rn", f"{finer_p}prev__us")
    return out


def _with_buckets(d: DataFrame, keys: list[str], hot: DataFrame, thr: int, tid: str) -> DataFrame:
    """``_b``: 0 for ordinary keys; the rows of hot ones, in (key, time, id) order, in buckets of at
    most half of ``thr`` rows."""
    d = d.join(F.broadcast(hot), keys, "left")  # bounded by _hot_keys
    many = globalrank.row_number_within(d.filter("_hot"), [], [*[F.col(k) for k in keys], F.col("_us"), F.col(tid)], out="_b")
    many = many.withColumn("_b", F.floor((F.col("_b") - 1) / max(thr // 2, 1)).cast("bigint"))
    return many.drop("_hot").unionByName(d.filter(F.col("_hot").isNull()).drop("_hot").withColumn("_b", F.lit(0).cast("bigint")))


def _bucket_history(d: DataFrame, names: list[str], keys: list[str], hot: DataFrame, thr: int, tid: str, lags: list[str], last_n: list[int], p: str) -> DataFrame:
    """The helper columns by local windows and offsets of the buckets before (keys not null)."""
    tail_n = max(last_n) if last_n else 0
    d = _with_buckets(d, keys, hot, thr, tid)
    wl = Window.partitionBy(*keys, "_b").orderBy("_us", tid)
    prior = wl.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "_b")
    v = F.col("_v")
    loc_cols = [
        F.row_number().over(wl).alias("_lrn"),
        F.count(F.lit(1)).over(whole).alias("_lbn"),
        F.count(v).over(prior).alias("_lcnt"),
        F.sum(v).over(prior).alias("_lsum"),
        F.avg(v).over(prior).alias("_lmean"),
        (F.var_pop(v).over(prior) * F.count(v).over(prior)).alias("_lm2"),
        F.max(v).over(prior).alias("_lmax"),
        F.min(v).over(prior).alias("_lmin"),
        *[F.lag(c).over(wl).alias(f"_lprev_{c}") for c in lags],
    ]
    for n in last_n:
        fr = wl.rowsBetween(-n, -1)
        loc_cols += [F.count(v).over(fr).alias(f"_ll{n}_cnt"), F.sum(v).over(fr).alias(f"_ll{n}_sum"),
                     (F.var_pop(v).over(fr) * F.count(v).over(fr)).alias(f"_ll{n}_m2"), F.min(v).over(fr).alias(f"_ll{n}_min"),
                     F.max(v).over(fr).alias(f"_ll{n}_max")]
    loc = d.select("*", *loc_cols)

    # ---- per (entity, bucket) summary: aggregated straight from the input, so Spark combines
    # map-side and shuffles only partial aggregates (one small row per entity and bucket)
    last_key = F.struct("_us", tid)
    bagg = d.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_bn"), F.count(v).alias("_bcnt"), F.sum(v).alias("_bsum"),
        F.avg(v).alias("_bmean"), (F.var_pop(v) * F.count(v)).alias("_bm2"), F.max(v).alias("_bmax"), F.min(v).alias("_bmin"),
        F.max_by(F.struct(*[F.col(c).alias(c) for c in lags]), last_key).alias("_blast"))
    if tail_n:
        # last ``tail_n`` rows of each bucket (bounded list) from the windowed frame
        tail_item = F.struct(F.col("_us").alias("u"), F.col(tid).alias("i"), v.alias("v"))
        tails = (loc.filter(F.col("_lbn") - F.col("_lrn") < tail_n)
                    .groupBy(*keys, "_b").agg(F.collect_list(tail_item).alias("_btail")))
        bagg = bagg.join(tails, [*keys, "_b"], "left")

    wb = Window.partitionBy(*keys).orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    # squared deviations add up about one value near the data: the first bucket's mean
    bagg = bagg.withColumn("_c", F.first("_bmean", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    off = F.col("_bmean") - F.col("_c")
    bp_cols = [
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_orn"),
        F.coalesce(F.sum("_bcnt").over(before), F.lit(0)).alias("_ocnt"),
        F.sum("_bsum").over(before).alias("_osum"),
        F.sum(F.col("_bcnt") * off).over(before).alias("_os1"),
        F.sum(F.col("_bm2") + F.col("_bcnt") * off * off).over(before).alias("_os2"),
        F.col("_c"),
        F.max("_bmax").over(before).alias("_omax"),
        F.min("_bmin").over(before).alias("_omin"),
        F.lag("_blast").over(wb).alias("_oprev"),
    ]
    if tail_n:
        carried = F.sort_array(F.flatten(F.collect_list("_btail").over(wb.rowsBetween(-tail_n, -1))))
        bp_cols.append(carried.alias("_otail_all"))
    bp = bagg.select(*keys, "_b", *bp_cols)
    if tail_n:
        sz = F.size("_otail_all")
        bp = bp.withColumn("_otail", F.transform(
            F.slice("_otail_all", F.greatest(sz - tail_n + 1, F.lit(1)), F.lit(tail_n)), lambda x: x["v"])
        ).drop("_otail_all")

    j = loc.join(bp, [*keys, "_b"], "inner")

    def nz(c):
        return F.coalesce(c, F.lit(0.0))

    on, ln = F.col("_ocnt"), F.col("_lcnt")
    cnt = on + ln
    omean = F.col("_c") + F.col("_os1") / on
    om2 = F.greatest(F.col("_os2") - F.col("_os1") * F.col("_os1") / on, F.lit(0.0))
    mx, mn = F.greatest("_omax", "_lmax"), F.least("_omin", "_lmin")
    out = {
        f"{p}rn": (F.col("_orn") + F.col("_lrn")).cast("bigint"),
        f"{p}cnt": cnt.cast("bigint"),
        f"{p}sum": F.when(cnt > 0, nz(F.col("_osum")) + nz(F.col("_lsum"))),
        f"{p}max": mx,
        f"{p}min": mn,
        f"{p}std": _std(cnt, _merged(on, omean, om2, ln, F.col("_lmean"), F.col("_lm2")), mn, mx),
    }
    for c in lags:
        out[f"{p}prev_{c}"] = F.when(F.col("_lrn") == 1, F.col("_oprev")[c]).otherwise(F.col(f"_lprev_{c}"))
    for n in last_n:
        k = F.greatest(F.lit(n) - F.col("_lrn") + 1, F.lit(0))
        tail = F.slice("_otail", F.greatest(F.size("_otail") - k + 1, F.lit(1)), k)
        tail = F.when(k > 0, tail).otherwise(F.array().cast("array<double>"))
        present = F.filter(tail, lambda x: x.isNotNull())
        ccnt = F.size(present)
        csum = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
        cmean = csum / ccnt
        cm2 = F.aggregate(present, F.lit(0.0), lambda a, x: a + (x - cmean) * (x - cmean))
        cmin = F.least(F.col(f"_ll{n}_min"), F.array_min(present))
        cmax = F.greatest(F.col(f"_ll{n}_max"), F.array_max(present))
        lcnt = F.col(f"_ll{n}_cnt")
        ncnt = lcnt + ccnt
        m2 = _merged(ccnt, cmean, cm2, lcnt, F.col(f"_ll{n}_sum") / lcnt, F.col(f"_ll{n}_m2"))
        out[f"{p}l{n}_cnt"] = ncnt.cast("bigint")
        out[f"{p}l{n}_sum"] = F.when(ncnt > 0, nz(F.col(f"_ll{n}_sum")) + csum)
        out[f"{p}l{n}_min"] = cmin
        out[f"{p}l{n}_max"] = cmax
        out[f"{p}l{n}_std"] = _std(ncnt, m2, cmin, cmax)
    return j.select(*names, *[c.alias(name) for name, c in out.items()])


def history_block(base: DataFrame, keys: list[str], features, *, ts: str = "TX_TS", tid: str = "TX_ID",
                  value: str | None = "TX_AMOUNT", lags: list[str] = (), last_n: list[int] = (),
                  extra: list[str] = (), p: str = "_h", rows_per_bucket: int = 1_000_000, n_rows: int | None = None) -> DataFrame:
    """History features of one entity key computed on a narrow projection: ``(tid, features...)``.

    ``features`` maps output names to Columns over the :func:`prior_history` helper columns
    (prefix ``p``) and the projected columns. Pipelines build one block per key from the same
    base and join the blocks back on the row id, so only narrow rows are shuffled per key,
    the wide table is shuffled once, and the logical plan grows linearly with the blocks.
    """
    cols = list(dict.fromkeys([*keys, ts, tid, *([value] if value else []), *lags, *extra]))
    h = prior_history(base.select(*cols), keys, ts=ts, tid=tid, value=value, lags=lags, last_n=last_n,
                      rows_per_bucket=rows_per_bucket, p=p, n_rows=n_rows)
    feats = features(h) if callable(features) else features
    return h.select(tid, *[c.alias(n) for n, c in feats.items()])


def drop_helpers(df: DataFrame, p: str = "_h") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(p)])


def prior_mean(p: str = "_h") -> Column:
    return F.col(f"{p}sum") / F.col(f"{p}cnt")


def prior_std(p: str = "_h") -> Column:
    return F.col(f"{p}std")


def lastn_mean(n: int, p: str = "_h") -> Column:
    return F.col(f"{p}l{n}_sum") / F.col(f"{p}l{n}_cnt")


def lastn_std(n: int, p: str = "_h") -> Column:
    return F.col(f"{p}l{n}_std")


def seconds_since_prev(p: str = "_h") -> Column:
    """Seconds since the previous row (fractional), NULL for the first row."""
    return (epoch_us(F.col("TX_TS")) - F.col(f"{p}prev__us")) / float(US)


# ------------------------------------------------------------------ feature operators

def add_time_since_last(df: DataFrame, keys: list[str], out: str, default: float, *,
                        ts: str = "TX_TS", tid: str = "TX_ID", whole_seconds: bool = False) -> DataFrame:
    """Gap to the previous row of the same entity; first row -> ``default``.

    ``whole_seconds`` diffs the integer unix seconds (E3 ``cust_prev_tx_time``).
    """
    h = prior_history(df, keys, ts=ts, tid=tid, value=None, p="_t")
    if whole_seconds:
        gap = (epoch_s(ts) - F.floor(F.col("_tprev__us") / US)).cast("double")
    else:
        gap = (epoch_us(ts) - F.col("_tprev__us")) / float(US)
    return drop_helpers(h.withColumn(out, F.coalesce(gap, F.lit(float(default)))), "_t")


def add_running_count(df: DataFrame, keys: list[str], out: str, *, zero_based: bool = False,
                      ts: str = "TX_TS", tid: str = "TX_ID") -> DataFrame:
    """Running count per entity (1-based) or per pair (0-based ``cumcount``)."""
    h = prior_history(df, keys, ts=ts, tid=tid, value=None, p="_t")
    return drop_helpers(h.withColumn(out, F.col("_trn") - (1 if zero_based else 0)), "_t")


def add_recent_row_count(df: DataFrame, keys: list[str], out: str, n: int, *,
                         ts: str = "TX_TS", tid: str = "TX_ID") -> DataFrame:
    """Rows among the last ``n`` (incl. current) minus one = ``least(rn, n) - 1``."""
    h = prior_history(df, keys, ts=ts, tid=tid, value=None, p="_t")
    return drop_helpers(h.withColumn(out, F.least(F.col("_trn"), F.lit(n)) - 1), "_t")


def add_time_window_counts(df: DataFrame, key: str, windows: dict[str, int] | None = None, *,
                           ts: str = "TX_TS", tid: str = "TX_ID", rows_per_bucket: int = 1_000_000, n_rows: int | None = None,
                           unique: bool | None = None, keys_of: DataFrame | None = None) -> DataFrame:
    """Rows of the same entity in ``(t - w, t]`` before this row (pandas tie rule).

    Among rows with the same timestamp only those earlier in id order count; a null key counts
    none. Columns are named ``count_<label>_<key>``; ``tid`` must be unique. Without an entity of over
    ``rows_per_bucket`` rows, rows are dealt out once, by entity; otherwise entities take one exchange of
    halo rows, and those with over ``rows_per_bucket`` rows within two windows are counted by
    ranks (see the module's text); that choice never changes a value. ``n_rows``, the number of rows,
    and ``unique``, whether no ``tid`` repeats, save finding them out; ``keys_of`` as in :func:`prior_history`.
    """
    windows = windows or {"24h": DAY, "7d": 7 * DAY}
    names = {label: f"count_{label}_{key}" for label in windows}
    if _hot_keys(df if keys_of is None else keys_of, [key], rows_per_bucket, n=n_rows)[0] is None and (ids_unique(df, tid) if unique is None else unique):
        return _plain_counts(df, key, windows, names, ts, tid)
    d = df.select(key, tid, epoch_us(ts).alias("_us")).filter(F.col(key).isNotNull())
    width = max(windows.values()) * US
    hot, n = None, d.count()
    if n > rows_per_bucket:
        least = max(rows_per_bucket, -(-n // 100_000)) // 2
        hot = d.groupBy(key, F.floor(F.col("_us") / width).alias("_tb")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
        hot = hot.select(key).distinct()  # at most 200,000 keys
        hot = hot if hot.head(1) else None
    if hot is None:
        counts = _halo_counts(d, key, windows, names, tid, width)
    else:
        hot = F.broadcast(hot)
        counts = _halo_counts(d.join(hot, key, "left_anti"), key, windows, names, tid, width).unionByName(_rank_counts(d.join(hot, key, "left_semi"), key, windows, names, tid))
    return df.join(counts, tid, "left").fillna(0, subset=list(names.values()))


def ids_unique(df: DataFrame, tid: str = "TX_ID") -> bool:
    """Whether no id repeats, told by 64-bit hashes: two ids of one hash, however unlikely, give False."""
    copies = df.groupBy(F.xxhash64(tid)).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (copies or 1) == 1


def _plain_counts(df: DataFrame, key: str, windows: dict[str, int], names: dict[str, str], ts: str, tid: str) -> DataFrame:
    """The counts by windows over whole entities, beside the rows' own columns: one exchange and no join."""
    d = df.withColumns({"_us": epoch_us(ts), "_solo": F.when(F.col(key).isNull(), F.col(tid).cast("string"))})
    part = Window.partitionBy(key, "_solo")
    before = F.row_number().over(part.orderBy("_us", tid)) - 1
    counted = F.col(key).isNotNull() & F.col(tid).isNotNull()
    out = []
    for label, secs in windows.items():
        too_old = F.count(F.lit(1)).over(part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -secs * US))
        out.append(F.when(counted, F.greatest(before - too_old, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(names[label]))
    return d.select(*df.columns, *out)


def _halo_counts(d: DataFrame, key: str, windows: dict[str, int], names: dict[str, str], tid: str, width: int) -> DataFrame:
    """A row lands in its own bucket (as wide as the widest window) and, as a halo, in the next one, so
    each ``(key, bucket)`` is self-contained for every window: one exchange and one sort."""
    own = F.floor(F.col("_us") / F.lit(width)).cast("bigint")
    copies = F.array(F.struct(own.alias("_tb"), F.lit(True).alias("_is_own")), F.struct((own + 1).alias("_tb"), F.lit(False).alias("_is_own")))
    u = d.select(key, tid, "_us", F.inline(copies))
    part = Window.partitionBy(key, "_tb")
    # rows before this one in (ts, id) order, minus those at or before t - w: exactly the
    # earlier rows inside (t - w, t], equal timestamps counted only when earlier by id
    before = F.row_number().over(part.orderBy("_us", tid)) - 1
    too_old = {label: F.count(F.lit(1)).over(part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -secs * US)) for label, secs in windows.items()}
    return u.select(tid, "_is_own", *[F.greatest(before - too_old[x], F.lit(0)).cast("bigint").alias(n) for x, n in names.items()]).filter("_is_own").drop("_is_own")


def _rank_counts(d: DataFrame, key: str, windows: dict[str, int], names: dict[str, str], tid: str) -> DataFrame:
    """Running counts over rows (kind 0) and probes (kind 1, at ``t - w``, after the rows of that time)
    in one order; a row's count less its probe's, less itself, is what lies between."""
    probes = [F.struct((F.col("_us") - secs * US).alias("_at"), F.lit(i + 1).alias("_kind"), F.lit(0).alias("_one")) for i, secs in enumerate(windows.values())]
    own = F.struct(F.col("_us").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    u = d.select(key, tid, F.inline(F.array(own, *probes)))
    ranked = globalrank.prefix_sums(u, [F.col(key), F.col("_at"), F.col("_kind"), F.col(tid)], ["_one"])
    at = {i: F.max(F.when(F.col("_kind") == i, F.col("_cum__one"))) for i in range(len(windows) + 1)}
    return ranked.groupBy(tid).agg(*[F.greatest(at[0] - 1 - at[i + 1], F.lit(0)).cast("bigint").alias(n) for i, n in enumerate(names.values())])


def add_prev_location(df: DataFrame, key: str, x: str, y: str, *, gap_col: str | None = None, first_gap: float | None = None,
                      ts: str = "TX_TS", tid: str = "TX_ID") -> DataFrame:
    """Distance from the previous row's location (NULL -> 0) and velocity = d / max(gap, 1).

    The gap is ``gap_col``, or, with ``first_gap`` (that of a first row), the seconds since the previous row (E1),
    which come of the same windows.
    """
    h = prior_history(df, [key], ts=ts, tid=tid, value=None, lags=[x, y], p="_t")
    dist = F.sqrt(F.pow(F.col(x) - F.col(f"_tprev_{x}"), 2) + F.pow(F.col(y) - F.col(f"_tprev_{y}"), 2))
    h = h.withColumn("dist_prev_terminal", F.coalesce(dist, F.lit(0.0)))
    if gap_col:
        h = h.withColumn("velocity_customer", F.col("dist_prev_terminal") / F.greatest(F.col(gap_col), F.lit(1.0)))
    elif first_gap is not None:
        gap = F.coalesce((epoch_us(ts) - F.col("_tprev__us")) / float(US), F.lit(float(first_gap)))
        h = h.withColumn("velocity_customer", F.col("dist_prev_terminal") / F.greatest(gap, F.lit(1.0)))
    return drop_helpers(h, "_t")


def add_entity_stats(df: DataFrame, key: str, value: str, stats: dict[str, str]) -> DataFrame:
    """Whole-partition statistics of ``value`` per ``key`` joined back.

    ``stats`` maps output name -> one of ``mean, std, count, min, max, sum``. Aggregated with
    partial (map-side) aggregation; the join back lets AQE broadcast a small stats table or
    split a skewed key.
    """
    fn = {"mean": F.avg, "std": F.stddev_samp, "count": F.count, "min": F.min, "max": F.max, "sum": F.sum}
    agg = df.groupBy(key).agg(*[fn[s](value).alias(o) for o, s in stats.items()])
    return df.join(agg, key, "left")


def add_rank_pct(df: DataFrame, value: str, out: str, *, keys: list[str] = (), rows_per_bucket: int = 1_000_000, n_rows: int | None = None, keys_of: DataFrame | None = None) -> DataFrame:
    """Average-method percentile rank (pandas ``rank(pct=True)``): windows by ``keys`` where no
    key has more than ``rows_per_bucket`` rows, else running counts (the same values). Rows with a
    null key or value have no rank."""
    keys = list(keys)
    if not keys or _hot_keys(df if keys_of is None else keys_of, keys, rows_per_bucket, n=n_rows)[0] is not None:
        return globalrank.with_avg_rank_pct(df, value, out, keys=keys)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    d = df.withColumn("_solo", F.when(missing, F.monotonically_increasing_id()))
    whole = Window.partitionBy(*keys, "_solo")
    below = F.rank().over(whole.orderBy(F.col(value).asc_nulls_last())) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_solo", value))
    pct = (below + (ties + 1) / 2.0) / F.count(value).over(whole)
    return d.withColumn(out, F.when(~missing & F.col(value).isNotNull(), pct)).drop("_solo")
