"""Time series: as-of joins, duplicate removal, despiking, averages and trends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a series that are searched together: a long series has many tasks.
STRETCH = 32


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def surrounded(left: DataFrame, points: DataFrame, by: list[str], at: Column, stretch: Column) -> DataFrame:
    """_row (all of left), _t, _before and _after: the last point (_t, _v) at or before `at`, the first strictly after.

    `at` is an expression over left; points are (by, _t, _v), one a place; `stretch` numbers `_t` in ascending stretches. Each stretch
    of a series is filled by itself, then from what the stretches before and after it hold, of which there is one row each. Rows
    whose place or series is NULL have no neighbours.
    """
    none = F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType)
    rows = left.select(*by, at.alias("_t"), F.lit(None).cast(points.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = points.select(*by, "_t", "_v", F.lit(0).alias("_side"), none.alias("_row")).unionByName(rows).withColumn("_s", stretch)
    point = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    ends = both.groupBy(*by, "_s").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_s").asc(), F.col("_s").desc()))
    ends = ends.select(*by, "_s", F.last("_last", ignorenulls=True).over(up).alias("_earlier"), F.last("_first", ignorenulls=True).over(down).alias("_later"))
    own = [*by, "_s"]
    before = F.last(point, ignorenulls=True).over(Window.partitionBy(*own).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, ignorenulls=True).over(Window.partitionBy(*own).orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0))
    filled = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1").join(ends, own, "left")
    placed = F.col("_t").isNotNull()
    for c in by:
        placed = placed & F.col(c).isNotNull()
    return filled.select("_row", "_t", F.when(placed, F.coalesce("_before", "_earlier")).alias("_before"), F.when(placed, F.coalesce("_after", "_later")).alias("_after"))


def by_time(c: Column) -> Column:
    return F.floor(_micros(c) / (STRETCH * 86_400_000_000))


def _points(right: DataFrame, by: list[str], right_ts: str, value: str) -> DataFrame:
    """One point a time: of equal times the first by the other columns."""
    rest = F.struct(*[c for c in right.columns if c not in by])
    return right.where(F.col(right_ts).isNotNull()).groupBy(*by, F.col(right_ts).alias("_t")).agg(F.min_by(value, rest).alias("_v"))


def as_of_next(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, value: str, name: str) -> DataFrame:
    """left with the value of the first point strictly later; NULL if there is none."""
    found = surrounded(left, _points(right, by, right_ts, value), by, F.col(ts), by_time(F.col("_t")))
    return found.select("_row.*", F.col("_after._v").alias(name))


def as_of_nearest(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, value: str, name: str) -> DataFrame:
    """left with the value of the nearest point; ties take the earlier one, times outside the range the end."""
    found = surrounded(left, _points(right, by, right_ts, value), by, F.col(ts), by_time(F.col("_t")))
    gap = lambda a, b: _micros(a) - _micros(b)
    earlier = F.col("_after").isNull() | (gap(F.col("_t"), F.col("_before._t")) <= gap(F.col("_after._t"), F.col("_t")))
    return found.select("_row.*", F.when(F.col("_before").isNotNull() & earlier, F.col("_before._v")).otherwise(F.col("_after._v")).alias(name))


def without_duplicates(df: DataFrame, site: list[str], ts: str, length: str, points: str, satname: str, ties: list[str], seconds: int = 300) -> DataFrame:
    """Scenes without the worse of each pair of neighbours within `seconds`.

    Both go if both have fewer than two points; a single such one goes; of L9 and L7 the L7 goes; else the shorter, of equals the
    later. A row goes by either of its pairs, whether or not its partner went.
    """
    w = Window.partitionBy(*site).orderBy(ts, *ties)
    pick = F.struct(F.col(ts).alias("t"), F.col(length).alias("l"), F.col(points).alias("n"), F.col(satname).alias("s"))
    df = df.withColumn("_a", F.lag(pick).over(w)).withColumn("_b", F.lead(pick).over(w)).withColumn("_c", pick)

    def goes(own: str, other: str, own_is_later: bool) -> Column:
        o, p = F.col(own), F.col(other)
        close = F.abs(_micros(o["t"]) - _micros(p["t"])) <= seconds * 1_000_000
        few_o, few_p = o["n"] < 2, p["n"] < 2
        pair = F.array_sort(F.array(o["s"], p["s"])) == F.array(F.lit("L7"), F.lit("L9"))
        worse = (o["l"] <= p["l"]) if own_is_later else (o["l"] < p["l"])
        return F.coalesce(close & F.when(few_o, True).when(few_p, False).when(pair, o["s"] == "L7").otherwise(worse), F.lit(False))

    return df.where(~(goes("_c", "_b", False) | goes("_c", "_a", True))).drop("_a", "_b", "_c")


def despiked(v: np.ndarray, limit: float) -> np.ndarray:
    """Which values stay: one spike is taken out at a time, from the front; see the rules of `_spike`.

    What a value is judged by ends two places before it and behind it, so after a removal the scan goes on two places earlier: those
    before were no spikes and still aren't. A removal at the end or next to it ends all."""
    alive, own, k = list(range(len(v))), v.tolist(), 0
    while len(own) > 1 and k < len(own):
        if not _spike(own, k, limit):
            k += 1
            continue
        last = k + 1 >= len(own) - 1
        del alive[k], own[k]
        if last:
            break
        k = max(0, k - 2)
    keep = np.zeros(len(v), bool)
    keep[alive] = True
    return keep


def _spike(v: list[float], k: int, c: float) -> bool:
    n, sign = len(v), lambda x: int(x > 0) - int(x < 0)
    if k == 0:
        return abs(v[0] - v[1]) > c
    if k == n - 1:
        return abs(v[k] - v[k - 1]) > c
    m1, p1 = v[k] - v[k - 1], v[k] - v[k + 1]
    if abs(m1) > c and abs(p1) > c and sign(m1) == sign(p1):
        return True
    if not 2 <= k < n - 2:
        return False
    m2, p2 = v[k - 1] - v[k - 2], v[k + 1] - v[k + 2]
    pairs = (abs(m1) > c and abs(p2) > c and sign(m1) == sign(p2)) or (abs(p1) > c and abs(m2) > c and sign(p1) == sign(m2))
    triple = abs(m2) > 1.5 * c and abs(p2) > 1.5 * c and abs(m1) <= c and abs(p1) <= c and sign(m2) == sign(p2)
    return bool(pairs or triple)


def reject_outliers(df: DataFrame, by: list[str], ts: str, value: str, limit: float, ties: list[str], threshold: str | None = None, bounds: tuple[float, float] | None = None, least: int = 30) -> DataFrame:
    """df with NULL for thresholds out of bounds and for spikes. Series with fewer than `least` values within the bounds go.

    The scan is sequential by nature, so a series is one task's; series without a step over `limit` are told apart at once and stay as
    they are."""
    inside = F.col(value).isNotNull()
    if threshold and bounds:
        inside = inside & F.coalesce(F.col(threshold).between(*bounds), F.lit(False))
    kept = F.when(inside, F.col(value))
    own = df.withColumn(value, kept).withColumn("_n", F.count(value).over(Window.partitionBy(*by))).where(F.col("_n") >= max(1, least)).drop("_n")
    schema = own.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_series(batches, by):
            yield from table.set_column(table.schema.get_field_index(value), value, _spikeless(_edges(table, by), table[value], limit).cast(table.schema.field(value).type)).to_batches()

    return own.repartition(*by).sortWithinPartitions(*by, ts, *ties).mapInArrow(run, schema)


def _whole_series(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a series does, of batches ordered by series."""
    held: list[pa.RecordBatch] = []
    name = lambda batch, k: [batch[c][k].as_py() for c in by]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and name(held[-1], -1) != name(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.flatnonzero(_edges(pa.Table.from_batches([batch]), by))[-1])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _edges(table: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row's series isn't that of the row before."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in by:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _spikeless(edges: np.ndarray, values: pa.ChunkedArray, limit: float) -> pa.ChunkedArray:
    v = values.combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    at = np.flatnonzero(~np.isnan(v))
    own = np.cumsum(edges)[at]
    far = np.flatnonzero((np.abs(np.diff(v[at])) > limit) & (own[1:] == own[:-1]))
    for name in np.unique(own[far]):
        part = at[np.searchsorted(own, name) : np.searchsorted(own, name, "right")]
        v[part[~despiked(v[part], limit)]] = np.nan
    return pa.chunked_array([pa.array(v, from_pandas=True)])


def seasonal_average(df: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Means of Dec-Feb, Mar-May, Jun-Aug and Sep-Nov, dated by quarter; a season's year must be one that the series has data in."""
    start = F.date_trunc("quarter", F.add_months(F.col(ts), 1)).cast("date")
    years = df.select(*by, F.year(ts).alias("_year")).distinct()
    means = df.groupBy(*by, start.alias("season")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.join(years, (F.year("season") == F.col("_year")) & _same(means, years, by), "left_semi")


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & (a[c] == b[c])
    return out


def monthly_average(df: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Means of calendar months, dated the 15th; months whose 15th is later than 30 days before the last date are left out. Readings are
    averaged where they lie before months meet their series' last date."""
    month = (F.date_trunc("month", F.col(ts)) + F.expr("INTERVAL 14 DAYS")).cast("date").alias("month")
    means = df.groupBy(*by, month).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.max(ts).cast("timestamp").alias("_last"))
    last = F.max("_last").over(Window.partitionBy(*by))
    return means.withColumn("_last", last).where(F.col("month").cast("timestamp") <= F.col("_last") - F.expr("INTERVAL 30 DAYS")).drop("_last")


def differences(df: DataFrame, by: list[str], ts: str, value: str, ties: list[str]) -> DataFrame:
    """df with the steps to the neighbours: m1 and m2 from one and two places before, p1 and p2 to one and two places behind."""
    w = Window.partitionBy(*by).orderBy(ts, *ties)
    at = lambda k: F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
    return df.select("*", (F.col(value) - at(1)).alias("m1"), (at(1) - at(2)).alias("m2"), (F.col(value) - at(-1)).alias("p1"), (at(-1) - at(-2)).alias("p2"))


def _line(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """by, slope, start, n and `first`: least squares over years since 2000, moved to the series' first date afterwards, so that readings
    are summed up where they lie."""
    x = _years(day)
    sums = df.groupBy(*by).agg(F.regr_slope(value, x).alias("slope"), F.regr_intercept(value, x).alias("_zero"), F.min(x).alias("first"), F.count(value).alias("n"))
    return sums.select(*by, "slope", (F.col("_zero") + F.col("slope") * F.col("first")).alias("start"), "n", "first")


def _years(day: str) -> Column:
    return F.datediff(F.to_date(day), F.lit("2000-01-01").cast("date")) / 365.2425


def trend(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Least squares over years since the first date: slope a year and the value at the start."""
    return _line(df, by, day, value).drop("first")


def fitted(df: DataFrame, by: list[str], day: str, value: str, name: str = "fitted") -> DataFrame:
    """df with the value of its series' trend at each date."""
    line = _line(df, by, day, value).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("slope").alias("_slope"), F.col("start").alias("_start"), F.col("first").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(line[f"_{c}"])
    return df.join(line, same).select(*df.columns, (F.col("_start") + F.col("_slope") * (_years(day) - F.col("_first"))).alias(name))


def contour_position(df: DataFrame, by: list[str], elevation: str, chainage: str, level: float) -> DataFrame:
    """Where a profile crosses `level`: linear in elevation between the points around it; NULL outside."""
    w = Window.partitionBy(*by).orderBy(elevation, chainage)
    e0, c0 = F.lag(elevation).over(w), F.lag(chainage).over(w)
    own = df.withColumn("_e0", e0).withColumn("_c0", c0)
    at = F.when((F.col("_e0") <= level) & (F.col(elevation) >= level) & (F.col(elevation) > F.col("_e0")), F.col("_c0") + (level - F.col("_e0")) / (F.col(elevation) - F.col("_e0")) * (F.col(chainage) - F.col("_c0")))
    exact = F.when(F.col(elevation) == level, F.col(chainage))
    return own.groupBy(*by).agg(F.min_by(F.coalesce(at, exact), F.when(F.coalesce(at, exact).isNotNull(), F.col(elevation))).alias("position"))
