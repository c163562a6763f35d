"""The registered queries: each operator over whole driver tables that stand in for scenes, series and rasters, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.operators import catalog, pixels, series, transects, validation
from strandline.plans.registry import query, r6, table


def scenes_and_tides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even events as scenes, odd ones as tide readings; a user is a site."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("site"), "ts", "value")
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select("site", F.col("ts").alias("t"), F.col("value").alias("tide"), "event_id")


_POINTS = """WITH s AS (SELECT event_id, user_id AS site, ts, value FROM events WHERE event_id % 2 = 0),
p AS (SELECT user_id AS site, ts AS t, arg_min(value, event_id) AS tide FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"""


@query(_POINTS + """, b AS (SELECT s.*, p.t AS bt, p.tide AS bv FROM s ASOF LEFT JOIN p ON s.site = p.site AND s.ts >= p.t),
a AS (SELECT s.event_id, p.t AS aft, p.tide AS av FROM s ASOF LEFT JOIN p ON s.site = p.site AND s.ts <= p.t)
SELECT b.event_id, round(b.value + (CASE WHEN bt IS NOT NULL AND (aft IS NULL OR epoch_us(b.ts) - epoch_us(bt) <= epoch_us(aft) - epoch_us(b.ts)) THEN bv ELSE av END - CAST(0.7 AS DOUBLE)) / CAST(0.1 AS DOUBLE), 6) AS corrected
FROM b JOIN a USING (event_id)""")
def tide_nearest_correction(spark, d):
    s, t = scenes_and_tides(spark, d)
    near = series.as_of_nearest(s, t, ["site"], "ts", "t", "tide", "tide")
    return near.select("event_id", r6(scalar.tidal_correction(F.col("value"), F.col("tide"), 0.7, 0.1), "corrected"))


@query(_POINTS + " SELECT s.event_id, round(p.tide, 6) AS tide FROM s ASOF LEFT JOIN p ON s.site = p.site AND s.ts < p.t")
def tide_next_after(spark, d):
    s, t = scenes_and_tides(spark, d)
    return series.as_of_next(s, t, ["site"], "ts", "t", "tide", "tide").select("event_id", r6(F.col("tide"), "tide"))


_DUP = """WITH e AS (SELECT event_id, user_id AS site, ts, value AS l, event_id % 5 AS n, CASE WHEN event_id % 3 = 0 THEN 'L7' WHEN event_id % 3 = 1 THEN 'L9' ELSE 'S2' END AS s FROM events),
w AS (SELECT *, lag(struct_pack(t := ts, l := l, n := n, s := s)) OVER o AS a, lead(struct_pack(t := ts, l := l, n := n, s := s)) OVER o AS b FROM e WINDOW o AS (PARTITION BY site ORDER BY ts, event_id))
SELECT event_id, site, s AS satname FROM w WHERE
NOT coalesce(abs(epoch_us(ts) - epoch_us(b.t)) <= 300000000 AND CASE WHEN n < 2 THEN TRUE WHEN b.n < 2 THEN FALSE WHEN (s = 'L7' AND b.s = 'L9') OR (s = 'L9' AND b.s = 'L7') THEN s = 'L7' ELSE l < b.l END, FALSE)
AND NOT coalesce(abs(epoch_us(ts) - epoch_us(a.t)) <= 300000000 AND CASE WHEN n < 2 THEN TRUE WHEN a.n < 2 THEN FALSE WHEN (s = 'L7' AND a.s = 'L9') OR (s = 'L9' AND a.s = 'L7') THEN s = 'L7' ELSE l <= a.l END, FALSE)"""


@query(_DUP)
def dedup_5min(spark, d):
    sat = F.when(F.col("event_id") % 3 == 0, "L7").when(F.col("event_id") % 3 == 1, "L9").otherwise("S2")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("site"), "ts", F.col("value").alias("l"), (F.col("event_id") % 5).alias("n"), sat.alias("satname"))
    return series.without_duplicates(e, ["site"], "ts", "l", "n", "satname", ["event_id"]).select("event_id", "site", "satname")


@query("""WITH m AS (SELECT o_orderpriority AS name, CAST(date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) AS DATE) AS season, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY ALL)
SELECT name, season, round(mean, 4) AS mean, n FROM m WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = name AND year(o_orderdate) = year(season))""")
def seasonal_mean(spark, d):
    o = table(spark, d, "orders").withColumn("name", F.col("o_orderpriority"))
    return series.seasonal_average(o, ["name"], "o_orderdate", "o_totalprice").select("name", "season", F.round("mean", 4).alias("mean"), "n")


@query("""WITH o AS (SELECT o_orderpriority AS name, o_totalprice, CAST(date_trunc('month', o_orderdate) + INTERVAL 14 DAY AS DATE) AS month, max(o_orderdate) OVER (PARTITION BY o_orderpriority) AS last FROM orders)
SELECT name, month, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM o WHERE CAST(month AS TIMESTAMP) <= last - INTERVAL 30 DAY GROUP BY ALL""")
def monthly_mean(spark, d):
    o = table(spark, d, "orders").withColumn("name", F.col("o_orderpriority"))
    return series.monthly_average(o, ["name"], "o_orderdate", "o_totalprice").select("name", "month", F.round("mean", 4).alias("mean"), "n")


@query("""WITH o AS (SELECT o_custkey, o_totalprice AS y, date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) / CAST(365.2425 AS DOUBLE) AS x FROM orders)
SELECT o_custkey, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS start, count(y) AS n FROM o GROUP BY ALL HAVING count(DISTINCT x) > 1""")
def trend(spark, d):
    o = table(spark, d, "orders")
    t = series.trend(o, ["o_custkey"], "o_orderdate", "o_totalprice").where("slope is not null")
    return t.select("o_custkey", F.round("slope", 3).alias("slope"), F.round("start", 3).alias("start"), "n")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def not_downloaded(spark, d):
    present = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.not_downloaded(table(spark, d, "orders"), present, ["o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus, p AS l_partkey, q AS l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, struct_pack(n := l_linenumber, p := l_partkey, q := l_quantity)) AS p, arg_min(l_quantity, struct_pack(n := l_linenumber, p := l_partkey, q := l_quantity)) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def first_match(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return catalog.first_match(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], ["l_partkey", "l_quantity"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND month(l_shipdate) IN (1, 2, 12) AND l_discount <= CAST(0.05 AS DOUBLE) * 100 AND l_quantity <= 25")
def months_cloud_filter(spark, d):
    own = catalog.in_dates(table(spark, d, "lineitem"), "l_shipdate", "1996-01-01", "1998-01-01")
    return catalog.not_cloudy(catalog.in_months(own, "l_shipdate", [1, 2, 12]), "l_discount", 0.05).where("l_quantity <= 25").select("l_orderkey", "l_linenumber", "l_discount")


@query("""WITH u AS (SELECT o_orderkey AS k, o_custkey AS site, o_orderdate AS ts, 'L8' AS satname, 0 AS o FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_custkey, o_orderdate, 'S2', 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderdate, 'L9', 2 FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
SELECT k, site, satname, CAST(row_number() OVER (PARTITION BY site ORDER BY ts, o, k) - 1 AS INTEGER) AS idx FROM u""")
def tier_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("ts"), "o_orderstatus")
    merged = catalog.merged_missions({"L8": o.where("o_orderstatus = 'O'"), "S2": o.where("o_orderstatus = 'F'"), "L9": o.where("o_orderstatus not in ('O', 'F')")})
    return catalog.chronological(merged, ["site"], "ts", ["sat_ord", "k"]).select("k", "site", "satname", "idx")


@query("""WITH o AS (SELECT event_id, strftime(ts, '%Y-%m-%d') || '_' || event_type || '_' || user_id AS base, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT event_id, CASE WHEN n = 0 THEN base ELSE base || '_dup' || n END AS name FROM o""")
def dup_suffix(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    name = F.concat_ws("_", F.date_format("day", "yyyy-MM-dd"), "event_type", F.col("user_id").cast("string"))
    return catalog.with_suffixes(e, ["user_id", "event_type", "day"], ["ts", "event_id"], name).select("event_id", "name")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'PASSED' WHEN '5-LOW' THEN 'FAILED' END AS flag, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 20 END AS rmse FROM orders) WHERE CASE WHEN flag = 'PASSED' THEN TRUE WHEN flag = 'FAILED' THEN FALSE ELSE rmse <= 10 AND rmse <> -1 END")
def georef_filter(spark, d):
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", "PASSED").when(F.col("o_orderpriority") == "5-LOW", "FAILED")
    o = table(spark, d, "orders").select("o_orderkey", flag.alias("geo_flag"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_orderkey") % 20).cast("double").alias("geo_rmse"))
    return catalog.accurately_placed(o, 10).select("o_orderkey")


@query("SELECT o_orderpriority AS satname, o_orderstatus AS tier, count(*) AS n_images FROM orders GROUP BY ALL")
def availability(spark, d):
    return catalog.availability(table(spark, d, "orders").select(F.col("o_orderpriority").alias("satname"), F.col("o_orderstatus").alias("tier")))


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS site, o_orderpriority AS sat, o_totalprice AS cloud, list_position(['1-URGENT', '3-MEDIUM', '5-LOW'], o_orderpriority) AS rank FROM orders)
SELECT site, arg_min(o_orderkey, struct_pack(r := rank, k := o_orderkey)) AS o_orderkey FROM o WHERE rank > 0 AND cloud <= 200000 GROUP BY site""")
def first_cloud_free(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("site"), F.col("o_orderpriority").alias("sat"), F.col("o_totalprice").alias("cloud"))
    return catalog.first_cloud_free(o, ["site"], "sat", "cloud", 200000, ["o_orderkey"], ("1-URGENT", "3-MEDIUM", "5-LOW")).select("site", "o_orderkey")


def points_and_lines(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("scene"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    n = table(spark, d, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(0.0).alias("x0"), (F.col("n_nationkey") * 4).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (F.col("n_nationkey") * 5).cast("double").alias("y1"))
    return e, n


_LINES = """WITH p AS (SELECT user_id AS scene, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events),
t AS (SELECT 'T' || n_nationkey AS name, 0.0::DOUBLE AS x0, n_nationkey * 4.0::DOUBLE AS y0, 300 / sqrt(90000 + (n_nationkey * 1.0)::DOUBLE ** 2) AS ux, n_nationkey / sqrt(90000 + (n_nationkey * 1.0)::DOUBLE ** 2) AS uy FROM nation),
j AS (SELECT scene, name, (x - x0) * ux + (y - y0) * uy AS c FROM p, t WHERE abs((x - x0) * uy - (y - y0) * ux) <= {along} AND sqrt((x - x0) ** 2 + (y - y0) ** 2) <= 1000)"""


@query(_LINES.format(along=10).replace("<= 1000)", "<= 1000 AND abs(atan2(uy, ux) - atan2(y - y0, x - x0)) < pi() / 2)") + " SELECT scene, name, round(median(c), 6) AS chainage FROM j GROUP BY ALL")
def transect_intersection(spark, d):
    p, t = points_and_lines(spark, d)
    return transects.intersections(p, t, 10, "scene").select("scene", "name", r6(F.col("chainage"), "chainage"))


@query(_LINES.format(along=25) + """, k AS (SELECT scene, name, CASE WHEN c >= 5 THEN c END AS c FROM j),
s AS (SELECT scene, name, stddev_pop(c) AS std, median(c) AS med, max(c) AS most, min(c) AS low, CASE WHEN count(c) > 0 THEN count(*) ELSE 0 END AS n FROM k GROUP BY ALL),
f AS (SELECT DISTINCT user_id AS scene, 'T' || n_nationkey AS name FROM events, nation),
g AS (SELECT scene, name, std, med, most, low, coalesce(n, 0) AS n, avg(CASE WHEN std > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY name) AS share FROM f LEFT JOIN s USING (scene, name))
SELECT scene, name, n, round(CASE WHEN std <= 40 AND most - low <= 120 AND n >= 3 THEN med WHEN share > 0.3 AND n >= 3 THEN most END, 6) AS chainage FROM g""")
def transect_qc(spark, d):
    p, t = points_and_lines(spark, d)
    return transects.quality_checked(p, t, p, "scene", 25, 3, 40, 120, 5, "auto", 0.3).select("scene", "name", "n", r6(F.col("chainage"), "chainage"))


#: The scan as a recursion over lists: `hit` is the first spike of the values left.
_DESPIKE = """WITH RECURSIVE o AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders GROUP BY 1 HAVING count(*) >= 3),
s AS (SELECT o_custkey, v, k, 0 AS step, TRUE AS more FROM o UNION ALL
  SELECT o_custkey, v[:hit - 1] || v[hit + 1:], k[:hit - 1] || k[hit + 1:], step + 1, hit < len(v) - 1 FROM (
    SELECT *, list_filter(range(1, len(v) + 1), lambda i: CASE
      WHEN i = 1 THEN abs(v[1] - v[2]) > c WHEN i = len(v) THEN abs(v[i] - v[i-1]) > c
      WHEN abs(v[i] - v[i-1]) > c AND abs(v[i] - v[i+1]) > c AND sign(v[i] - v[i-1]) = sign(v[i] - v[i+1]) THEN TRUE
      WHEN i < 3 OR i > len(v) - 2 THEN FALSE
      ELSE (abs(v[i] - v[i-1]) > c AND abs(v[i+1] - v[i+2]) > c AND sign(v[i] - v[i-1]) = sign(v[i+1] - v[i+2]))
        OR (abs(v[i] - v[i+1]) > c AND abs(v[i-1] - v[i-2]) > c AND sign(v[i] - v[i+1]) = sign(v[i-1] - v[i-2]))
        OR (abs(v[i-1] - v[i-2]) > 1.5 * c AND abs(v[i+1] - v[i+2]) > 1.5 * c AND abs(v[i] - v[i-1]) <= c AND abs(v[i] - v[i+1]) <= c AND sign(v[i-1] - v[i-2]) = sign(v[i+1] - v[i+2])) END)[1] AS hit
    FROM (SELECT *, 150000.0::DOUBLE AS c FROM s WHERE more AND len(v) > 1)) WHERE hit IS NOT NULL),
kept AS (SELECT unnest(k) AS o_orderkey FROM (SELECT arg_max(k, step) AS k FROM s GROUP BY o_custkey))
SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM kept) THEN o_totalprice END AS o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM o)"""


@query(_DESPIKE)
def despike(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return series.reject_outliers(o, ["o_custkey"], "o_orderdate", "o_totalprice", 150000, ["o_orderkey"], least=3)


def grid(spark, d) -> DataFrame:
    """Embedding components as a raster: a row for each vector, a column for each position."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("r"), "label", F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))


_GRID = "WITH g AS (SELECT CAST(vec_id AS INTEGER) AS r, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("SELECT vec_id, round(CASE WHEN label % 3 <> 0 THEN (a - b) / nullif(a + b, 0) END, 4) AS idx FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) + 2 AS a, CAST(embedding[2] AS DOUBLE) + 2 AS b FROM embeddings)")
def nd_index(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (F.col("embedding")[k].cast("double") + 2 for k in (0, 1))
    return e.select("vec_id", F.round(scalar.nd_index(a, b, F.col("label") % 3 == 0), 4).alias("idx"))


@query("SELECT p_partkey, (p_partkey & 14) <> 0 AS landsat, (p_partkey * 8) IN (1024, 2048) AS sentinel, p_partkey % 100 > 60 AS likely FROM part")
def cloud_bits(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalar.cloud_by_bits(k).alias("landsat"), scalar.cloud_by_values(k * 8).alias("sentinel"), scalar.cloud_by_probability(k % 100).alias("likely"))


@query(_GRID + " SELECT label, round(avg(CASE WHEN v > 0.1 OR v < -0.2 THEN 1 ELSE 0 END), 6) AS combined, round(count(*) FILTER (WHERE (v > 0.1) <> (v < -0.2)) / count(*) FILTER (WHERE NOT v < -0.2), 6) AS cover FROM g GROUP BY label")
def cover_ratio(spark, d):
    c = pixels.cover(grid(spark, d), ["label"], F.col("v") > 0.1, F.col("v") < -0.2)
    return c.select("label", r6(F.col("combined"), "combined"), r6(F.col("cover"), "cover"))


@query(_GRID + ", z AS (SELECT r, c, label, CASE WHEN r % 100 < 3 OR c > 60 THEN 0 ELSE v END AS v, r % 100 AS rr FROM g) SELECT label, min(rr) FILTER (WHERE v <> 0) AS top, max(rr) - max(rr) FILTER (WHERE v <> 0) AS bottom, min(c) FILTER (WHERE v <> 0) AS \"left\", max(c) - max(c) FILTER (WHERE v <> 0) AS \"right\" FROM z GROUP BY label")
def edge_padding(spark, d):
    g = grid(spark, d).withColumn("r", F.col("r") % 100)
    return pixels.edge_padding(g.withColumn("v", F.when((F.col("r") < 3) | (F.col("c") > 60), 0.0).otherwise(F.col("v"))), ["label"], "v")


@query(_GRID + ", t AS (SELECT label, quantile_cont(v, 0.999) AS top FROM g GROUP BY label) SELECT r, c, round(least(greatest(v, 0), top) / top, 6) AS stretched FROM g JOIN t USING (label)")
def intensity_stretch(spark, d):
    return pixels.stretched(grid(spark, d), ["label"], "v").select("r", "c", r6(F.col("stretched"), "stretched"))


@query(_GRID + """, n AS (SELECT max(r) + 1 AS rows, 64 AS cols FROM g), o AS (SELECT unnest(range(-1, 2)) AS k),
s AS (SELECT a.r, a.c, a.v AS own, CASE WHEN a.r + i.k < 0 THEN 1 WHEN a.r + i.k >= rows THEN rows - 2 ELSE a.r + i.k END AS rr, CASE WHEN a.c + j.k < 0 THEN 1 WHEN a.c + j.k >= cols THEN cols - 2 ELSE a.c + j.k END AS cc FROM g a, n, o i, o j)
SELECT s.r, s.c, round(sqrt(greatest(0, avg(b.v * b.v) - avg(b.v) ** 2)), 6) AS std FROM s JOIN g b ON b.r = s.rr AND b.c = s.cc GROUP BY ALL""")
def local_std(spark, d):
    g = grid(spark, d)
    rows = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    g = g.withColumn("rows", F.lit(int(rows))).withColumn("cols", F.lit(64))
    return pixels.local_std(g, [], "v", "rows", "cols").select("r", "c", r6(F.col("std"), "std"))


_OTSU = """, e AS (SELECT min(v) AS lo, max(v) AS hi FROM x), h AS (SELECT least(floor((v - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS h, any_value(lo) AS lo, any_value(hi) AS hi FROM x, e GROUP BY 1),
c AS (SELECT bin, h, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS centre FROM h),
w AS (SELECT bin, centre, sum(h) OVER u AS w1, sum(h) OVER d AS w2, sum(h * centre) OVER u / sum(h) OVER u AS m1, sum(h * centre) OVER d / sum(h) OVER d AS m2 FROM c WINDOW u AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT round(arg_max(centre, struct_pack(b := round(coalesce(w1 * w2 * (m1 - m2) ** 2, -1), 9), k := -bin)), 6) AS threshold, CAST((SELECT sum(h) FROM h) AS BIGINT) AS n FROM w"""


@query(_GRID + ", x AS (SELECT v FROM g)" + _OTSU)
def otsu(spark, d):
    return pixels.otsu(grid(spark, d), [], "v").select(r6(F.col("threshold"), "threshold"), "n")


@query(_GRID + ", q AS (SELECT v, label % 2 AS k, row_number() OVER (PARTITION BY label % 2 ORDER BY (13 + r * 7919 + c * 7921) % 1000003, r, c) AS n FROM g), m AS (SELECT min(z) AS m FROM (SELECT count(*) AS z FROM q GROUP BY k)), x AS (SELECT v FROM q, m WHERE n <= m)" + _OTSU)
def balanced_otsu(spark, d):
    g = grid(spark, d).withColumn("k", F.col("label") % 2).withColumn("r", F.col("r").cast("long")).withColumn("c", F.col("c").cast("long"))
    return pixels.otsu(pixels.balanced(g, [], "k", ["r", "c"]), [], "v").select(r6(F.col("threshold"), "threshold"), "n")


@query(_GRID + """, a AS (SELECT r, c, v, lead(v) OVER (PARTITION BY r ORDER BY c) AS w FROM g), b AS (SELECT g.r, g.c, g.v, h.v AS w FROM g JOIN g h ON h.c = g.c AND h.r = g.r + 1)
SELECT CAST(r AS DOUBLE) AS "row", round(c + (0.1 - v) / (w - v), 5) AS col FROM a WHERE (v > 0.1) <> (w > 0.1) UNION ALL SELECT round(r + (0.1 - v) / (w - v), 5), CAST(c AS DOUBLE) FROM b WHERE (v > 0.1) <> (w > 0.1)""")
def contour_points(spark, d):
    return pixels.contour_points(grid(spark, d), [], "v", F.lit(0.1)).select(F.round("row", 5).alias("row"), F.round("col", 5).alias("col"))


@query("""WITH p AS (SELECT event_id, value AS x, CAST(event_id * 37 % 1000 AS DOUBLE) AS y FROM events WHERE event_id % 2 = 0), k AS (SELECT value AS x, CAST(event_id * 37 % 1000 AS DOUBLE) AS y FROM events WHERE event_id % 2 = 1)
SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE sqrt((p.x - k.x) ** 2 + (p.y - k.y) ** 2) < 4)""")
def cloud_distance_antijoin(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("event_id") * 37 % 1000).cast("double").alias("y"))
    return pixels.away_from(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), 4).select("event_id")


@query(_GRID + " SELECT r % 200 AS r, c, round(arg_max(v, r), 6) AS v FROM g WHERE v <> 0 AND label % 4 <> 1 GROUP BY r % 200, c")
def mosaic_last_wins(spark, d):
    g = grid(spark, d).withColumn("file", F.col("r")).withColumn("r", F.col("r") % 200).withColumn("v", F.when(F.col("label") % 4 == 1, 0.0).otherwise(F.col("v")))
    return pixels.mosaic(g, "v", 0.0, "file").select("r", "c", r6(F.col("v"), "v"))


@query("""WITH s AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS q FROM (SELECT c_acctbal AS v, count(*) AS n FROM customer GROUP BY 1)), t AS (SELECT v AS tv, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS q FROM (SELECT s_acctbal AS v, count(*) AS n FROM supplier GROUP BY 1)),
b AS (SELECT s.v, s.q, t.q AS q0, t.tv AS v0 FROM s ASOF LEFT JOIN t ON s.q >= t.q), a AS (SELECT s.v, t.q AS q1, t.tv AS v1 FROM s ASOF LEFT JOIN t ON s.q <= t.q),
m AS (SELECT v, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q1 = q0 THEN v0 ELSE v0 + (q - q0) * (v1 - v0) / (q1 - q0) END AS matched FROM a JOIN b USING (v))
SELECT c_custkey, round(matched, 4) AS matched FROM customer JOIN m ON v = c_acctbal""")
def hist_match(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v0"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v0"))
    return pixels.histogram_matched(c, s, ["c_custkey"], "v0").select("c_custkey", F.round("matched", 4).alias("matched"))


_ERR = "WITH e AS (SELECT event_type, value AS est, avg(value) OVER (PARTITION BY user_id) AS truth FROM events)"


def estimates(spark, d):
    e = table(spark, d, "events")
    means = e.groupBy("user_id").agg(F.avg("value").alias("truth"))
    return e.join(means, "user_id").select("event_type", F.col("value").alias("est"), "truth")


@query(_ERR + " SELECT event_type, count(*) AS n, round(regr_slope(est, truth), 6) AS slope, round(regr_r2(est, truth), 6) AS r2, round(sqrt(avg((est - truth) ** 2)), 6) AS rmse, round(avg(est - truth), 6) AS mean_error, round(stddev_pop(est - truth), 6) AS std_error, round(quantile_cont(abs(est - truth), 0.9), 6) AS q90 FROM e GROUP BY 1")
def error_stats(spark, d):
    s = validation.error_statistics(estimates(spark, d), ["event_type"], "est", "truth")
    return s.select("event_type", "n", *(r6(F.col(c), c) for c in ("slope", "r2", "rmse", "mean_error", "std_error", "q90")))


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events) SELECT CAST(least(floor((value - lo) / 25), greatest(1, ceil((hi - lo) / 25)) - 1) AS BIGINT) AS bin, count(*) AS n_bin, round(count(*) / (max(n) * 25.0::DOUBLE), 9) AS density FROM events, m GROUP BY 1")
def error_hist(spark, d):
    return validation.histogram(table(spark, d, "events"), "value", 25.0).select("bin", "n_bin", F.round("density", 9).alias("density"))


@query("""WITH m AS (SELECT event_type, count(value)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1),
g AS (SELECT event_type, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, avg(((value - mean) / std) ** 3) AS g1, avg(((value - mean) / std) ** 4) AS b2 FROM events JOIN m USING (event_type) GROUP BY 1),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM g),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS zs, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM s),
k AS (SELECT *, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM z)
SELECT event_type, n::BIGINT AS n, round(mean, 5) AS mean, round(std, 5) AS std, round(g1, 5) AS skewness, round(b2 - 3, 5) AS kurtosis, round(zs * zs + zk * zk, 2) AS k2, round(exp(-(zs * zs + zk * zk) / 2), 5) AS p FROM k""")
def error_normality(spark, d):
    n = validation.normality(table(spark, d, "events"), ["event_type"], "value")
    return n.select("event_type", "n", *(F.round(c, 5).alias(c) for c in ("mean", "std", "skewness", "kurtosis")), F.round("k2", 2).alias("k2"), F.round("p", 5).alias("p"))


@query("SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS share FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)")
def confusion_matrix(spark, d):
    return validation.confusion_matrix(table(spark, d, "labels"), "quality", "toxic").select("quality", "toxic", "n", r6(F.col("share"), "share"))


@query("SELECT event_type AS satname, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1")
def mission_medians(spark, d):
    m = validation.by_mission(table(spark, d, "events").withColumnRenamed("event_type", "satname"), "value")
    return m.select("satname", r6(F.col("median"), "median"), "n")


@query("""WITH s AS (SELECT event_id, user_id AS profile, CAST(ts AS DATE) AS day, value FROM events WHERE event_id % 3 <> 0), v AS (SELECT user_id AS profile, CAST(ts AS DATE) AS t, min(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
b AS (SELECT s.*, v.t AS bt, v.v AS bv FROM s ASOF LEFT JOIN v ON s.profile = v.profile AND s.day >= v.t), a AS (SELECT s.event_id, v.t AS aft, v.v AS av FROM s ASOF LEFT JOIN v ON s.profile = v.profile AND s.day < v.t),
g AS (SELECT b.event_id, bv, av, bt, aft, day, date_diff('day', bt, day) AS gb, date_diff('day', day, aft) AS ga FROM b JOIN a USING (event_id))
SELECT event_id, round(CASE WHEN least(gb, ga) > 2 THEN NULL WHEN least(gb, ga) < 1 THEN CASE WHEN ga IS NULL OR gb <= ga THEN bv ELSE av END ELSE bv + date_diff('day', bt, day) * (av - bv) / date_diff('day', bt, aft) END, 5) AS survey FROM g""")
def survey_match(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("profile"), F.to_date("ts").alias("day"), "value")
    surveys = e.where("event_id % 3 = 0").select("profile", F.col("day").alias("survey_day"), F.col("value").alias("position"))
    m = validation.survey_match(e.where("event_id % 3 <> 0"), surveys, ["profile"], "day", "value", "survey_day", "position", 1, 2)
    return m.select("event_id", F.round("survey", 5).alias("survey"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(event_id AS VARCHAR) || CASE WHEN event_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN event_id % 10 = 1 THEN 'st' WHEN event_id % 10 = 2 THEN 'nd' WHEN event_id % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, strftime(ts, '%Y-%m-%d-%H-%M-%S') || '_' || event_type || '_SITE_ms.tif' AS name, date_trunc('second', ts) AS parsed FROM events")
def meta_parse(spark, d):
    name = scalar.filename(F.col("ts"), F.col("event_type"), F.lit("SITE"), F.lit("ms"))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), scalar.ordinal(F.col("event_id")).alias("ordinal"), name.alias("name"), scalar.date_of_filename(name).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, round(1000.0 + (event_id % 64) * 15.0, 6) AS x, round(2000.0 - (event_id // 64) * 15.0, 6) AS y, CAST(event_id % 64 AS DOUBLE) AS col, CAST(event_id // 64 AS DOUBLE) AS \"row\" FROM events")
def pixel_coordinates(spark, d):
    geo = (1000.0, 15.0, 0.0, 2000.0, 0.0, -15.0)
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).cast("double").alias("r"), (F.col("event_id") % 64).cast("double").alias("c"))
    x, y = scalar.pix_to_world(F.col("r"), F.col("c"), geo)
    e = e.withColumn("x", x).withColumn("y", y)
    col, row = scalar.world_to_pix(F.col("x"), F.col("y"), geo)
    return e.select("event_id", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(col, "col"), r6(row, "row"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT ts, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM (SELECT CAST(ts AS DATE) AS ts, event_type, value FROM events) GROUP BY ts")
def wide_series(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("ts"), F.col("event_type").alias("name")).agg(F.max("value").alias("chainage"))
    return transects.wide_series(e, "ts", _TYPES)


@query("WITH s AS (SELECT user_id, sqrt((lead(value) OVER w - value) ** 2 + ((lead(event_id) OVER w - event_id) % 50) ** 2) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n_points FROM s GROUP BY 1 HAVING sum(l) >= 500")
def long_contours(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))
    # the vertical step is taken within 50, as the stand-in has no second coordinate
    step = (F.lead("y").over(Window.partitionBy("user_id").orderBy("o")) - F.col("y")) % 50
    e = e.withColumn("y", F.coalesce(F.sum(step).over(Window.partitionBy("user_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return pixels.polyline_length(e, ["user_id"], "o", 500).select("user_id", "n_points")


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 20 AND value < 120 AND event_id % 100 > 10 AND event_id % 100 < 80) WHERE n >= 3")
def area_filter(spark, d):
    ring = [(20.0, 10.0), (120.0, 10.0), (120.0, 80.0), (20.0, 80.0)]
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return pixels.within_area(e, ["user_id"], [ring]).select("event_id")


@query(_GRID + """, p AS (SELECT DISTINCT CAST(event_id % 500 * 3 AS INTEGER) AS r, CAST(event_id // 500 * 29 % 64 AS INTEGER) AS c FROM events)
SELECT r, c, EXISTS (SELECT 1 FROM p WHERE p.r > 0 AND p.c > 0 AND (p.r - g.r) ** 2 + (p.c - g.c) ** 2 <= 9) AS near FROM g""")
def reference_buffer(spark, d):
    p = table(spark, d, "events").select((F.col("event_id") % 500 * 3 + 0.5).alias("row"), (F.floor(F.col("event_id") / 500) * 29 % 64 + 0.5).alias("col"))
    return pixels.reference_buffer(grid(spark, d), [], p, 3).select("r", "c", "near")


def sized_grid(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return grid(spark, d).withColumn("rows", F.lit(int(rows))).withColumn("cols", F.lit(64))


@query(_GRID + """, n AS (SELECT max(r) + 1 AS rows FROM g), k AS (SELECT unnest(range(2)) AS k),
t AS (SELECT CAST(g.r * 2 + i.k AS INTEGER) AS r, CAST(g.c * 2 + j.k AS INTEGER) AS c FROM g, k i, k j),
y AS (SELECT r, c, least(greatest((r + 0.5::DOUBLE) / 2 - 0.5, 0), rows - 1) AS y, least(greatest((c + 0.5::DOUBLE) / 2 - 0.5, 0), 63) AS x FROM t, n),
w AS (SELECT y.r, y.c, CAST(floor(y) + i.k AS INTEGER) AS sr, CAST(floor(x) + j.k AS INTEGER) AS sc, (1 - abs(y - floor(y) - i.k)) * (1 - abs(x - floor(x) - j.k)) AS w FROM y, k i, k j)
SELECT w.r, w.c, round(sum(w * v) / sum(w), 6) AS v FROM w JOIN g ON g.r = sr AND g.c = sc WHERE w > 0 GROUP BY ALL""")
def bilinear_resample(spark, d):
    return pixels.bilinear_resampled(sized_grid(spark, d), [], "v", "rows", "cols", 2).select("r", "c", r6(F.col("v"), "v"))


@query(_GRID + """, f AS (SELECT r, c, CASE WHEN r % 50 < 10 AND c < 8 THEN 1 ELSE v END AS v FROM g), n AS (SELECT max(r) + 1 AS rows, 64 AS cols FROM g), o AS (SELECT CAST(unnest(range(-1, 2)) AS INTEGER) AS k),
s AS (SELECT a.r, a.c, CASE WHEN a.r + i.k < 0 THEN 1 WHEN a.r + i.k >= rows THEN rows - 2 ELSE a.r + i.k END AS rr, CASE WHEN a.c + j.k < 0 THEN 1 WHEN a.c + j.k >= cols THEN cols - 2 ELSE a.c + j.k END AS cc FROM f a, n, o i, o j),
z AS (SELECT s.r, s.c FROM s JOIN f b ON b.r = s.rr AND b.c = s.cc GROUP BY ALL HAVING sqrt(greatest(0, avg(b.v * b.v) - avg(b.v) ** 2)) < 1e-6),
m AS (SELECT DISTINCT z.r + i.k AS r, z.c + j.k AS c FROM z, o i, o j)
SELECT f.r, f.c, m.r IS NOT NULL AS artefact FROM f LEFT JOIN m ON m.r = f.r AND m.c = f.c""")
def edge_artefacts(spark, d):
    g = sized_grid(spark, d).withColumn("v", F.when((F.col("r") % 50 < 10) & (F.col("c") < 8), 1.0).otherwise(F.col("v")))
    return pixels.edge_artefacts(g, [], "v", "rows", "cols").select("r", "c", "artefact")


@query("""SELECT user_id, CAST(floor(min((value - 10) / 2)) AS BIGINT) AS x_min, CAST(ceil(max((value - 10) / 2)) AS BIGINT) AS x_max,
CAST(floor(min((event_id % 1000 - 1000) / -2)) AS BIGINT) AS y_min, CAST(ceil(max((event_id % 1000 - 1000) / -2)) AS BIGINT) AS y_max FROM events GROUP BY user_id""")
def pixel_rectangles(spark, d):
    col, row = scalar.world_to_pix(F.col("value"), (F.col("event_id") % 1000).cast("double"), [10, 2, 0, 1000, 0, -2])
    return pixels.rectangle(table(spark, d, "events"), ["user_id"], col, row, whole=True)


@query("""WITH s AS (SELECT user_id, value AS x, CAST(event_id % 50 AS DOUBLE) AS y, lead(value) OVER w - value AS dx, lead(CAST(event_id % 50 AS DOUBLE)) OVER w - event_id % 50 AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, x, y, dx, dy, sqrt(dx * dx + dy * dy) AS d FROM s), e AS (SELECT *, unnest(range(CAST(ceil(d) AS BIGINT))) AS k FROM k WHERE d > 0)
SELECT user_id, count(*) AS n, round(avg(x + k * dx / d), 4) AS x, round(avg(y + k * dy / d), 4) AS y FROM e GROUP BY user_id""")
def densified_lines(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return pixels.densified(e, ["user_id"], "o").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity AS x0, l_quantity + l_tax * 500 AS x1, l_discount AS y0, l_discount + l_tax AS y1 FROM lineitem),
h AS (SELECT *, x0 <= min(x0) OVER g AND x1 >= max(x1) OVER g AND y0 <= min(y0) OVER g AND y1 >= max(y1) OVER g AS holds FROM s WINDOW g AS (PARTITION BY l_suppkey, l_shipdate)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY holds DESC, l_orderkey, l_linenumber) AS place, bool_or(holds) OVER (PARTITION BY l_suppkey, l_shipdate) AS held FROM h)
SELECT l_orderkey, l_linenumber FROM r WHERE NOT held OR place = 1""")
def contained_footprints(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.col("l_quantity").alias("x_min"), (F.col("l_quantity") + F.col("l_tax") * 500).alias("x_max"), F.col("l_discount").alias("y_min"), (F.col("l_discount") + F.col("l_tax")).alias("y_max"))
    return catalog.without_contained(s, ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""WITH o AS (SELECT event_id, user_id % 10 AS site, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 300000000, TRUE) AS opens FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id)),
u AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY site ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT event_id, first_value(event_id) OVER w AS first, CAST(row_number() OVER w AS INTEGER) AS place, lead(event_id) OVER w AS follower FROM u WINDOW w AS (PARTITION BY site, run ORDER BY ts, event_id))
SELECT event_id, first, place, CASE WHEN place = 1 AND follower IS NULL THEN 'single' WHEN place = 1 THEN 'base' WHEN place <= 3 THEN 'merge' ELSE 'drop' END AS action FROM p""")
def merge_plan(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("site"), "ts")
    return catalog.merge_plan(e, ["site"], "ts", ["event_id"], "event_id").select("event_id", "first", "place", "action")


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || CASE WHEN event_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN event_id % 10 = 1 THEN 'st' WHEN event_id % 10 = 2 THEN 'nd' WHEN event_id % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
strftime(ts, '%Y-%m-%d-%H-%M-%S') || '_L8_' || event_type || '_ms.tif' AS name, epoch_us(date_trunc('second', ts)) AS at FROM events""")
def scene_names(spark, d):
    e = table(spark, d, "events").withColumn("name", scalar.filename(F.col("ts"), F.lit("L8"), F.col("event_type"), F.lit("ms")))
    return e.select("event_id", scalar.ordinal(F.col("event_id")).alias("nth"), "name", F.unix_micros(scalar.date_of_filename(F.col("name")).cast("timestamp")).alias("at"))


@query("""SELECT l_suppkey, round(c0 + (25.5 - e0) / (e1 - e0) * (c1 - c0), 6) AS position FROM (SELECT l_suppkey, max(l_quantity) FILTER (WHERE l_quantity < 25.5) AS e0, min(l_quantity) FILTER (WHERE l_quantity > 25.5) AS e1,
max(l_extendedprice) FILTER (WHERE l_quantity = lo) AS c0, min(l_extendedprice) FILTER (WHERE l_quantity = hi) AS c1
FROM (SELECT *, max(l_quantity) FILTER (WHERE l_quantity < 25.5) OVER (PARTITION BY l_suppkey) AS lo, min(l_quantity) FILTER (WHERE l_quantity > 25.5) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem) GROUP BY l_suppkey)""")
def survey_contour(spark, d):
    return series.contour_position(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 25.5).select("l_suppkey", r6(F.col("position"), "position"))


@query("SELECT event_id, round(radians(event_id % 360 - 180) * 6378137, 3) AS x, round(ln(tan(0.7853981633974483 + radians(event_id % 160 - 80) / 2)) * 6378137, 3) AS y FROM events")
def web_mercator(spark, d):
    x, y = scalar.lonlat_to_mercator(F.col("event_id") % 360 - 180, F.col("event_id") % 160 - 80)
    return table(spark, d, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919 + 13) % 1000003, event_id) <= 150")
def class_subsample(spark, d):
    return validation.subsample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 150)
