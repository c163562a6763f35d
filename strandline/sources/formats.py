"""GeoJSON, KML, scene metadata, mapped shorelines, CSV series and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import date_of_filename

_COORDINATES = "array<array<double>>"
SHORELINES = (
    "dates array<string>, shorelines array<array<array<double>>>, filename array<string>, cloud_cover array<double>, geoaccuracy array<string>, "
    "idx array<int>, MNDWI_threshold array<double>, satname array<string>"
)


def transects_geojson(spark: SparkSession, path: str) -> DataFrame:
    """name, x0, y0, x1, y1 of the line features: their first and last vertex."""
    schema = f"features array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: {_COORDINATES}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    line = F.col("geometry.coordinates")
    first, last = line[0], F.element_at(line, -1)
    return rows.select(F.col("properties.name").alias("name"), first[0].alias("x0"), first[1].alias("y0"), last[0].alias("x1"), last[1].alias("y1"))


def polygon_geojson(spark: SparkSession, path: str) -> DataFrame:
    """pt_idx, x, y of the exterior ring of the first feature."""
    schema = f"features array<struct<geometry: struct<coordinates: array<{_COORDINATES}>>>>"
    ring = F.col("features")[0]["geometry"]["coordinates"][0]
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode(ring).alias("pt_idx", "p"))
    return rows.select("pt_idx", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def polygon_kml(spark: SparkSession, path: str) -> DataFrame:
    """pt_idx, x, y (longitude, latitude) of the first <coordinates> block."""
    block = F.regexp_extract("value", r"(?s)<coordinates>\s*(.*?)\s*</coordinates>", 1)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(block, r"\s+")).alias("pt_idx", "p"))
    xy = F.split("p", ",")
    return rows.select("pt_idx", F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")).where("x is not null")


def metadata_fields(text: Column) -> Column:
    """Key-value lines, parted by a tab, as a map; keys and values are trimmed, empty lines left out."""
    pairs = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.split(x, "\t", 2)), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value"))))


def scene_metadata(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """filename, epsg, geo_rmse, geo_flag, im_quality, im_width, im_height, acq_ts of metadata texts."""
    m = df.withColumn("_m", metadata_fields(F.col(text)))
    georef = F.col("_m")["acc_georef"]
    return m.select(
        *keep, F.col("_m")["filename"].alias("filename"), F.coalesce(F.col("_m")["epsg"].try_cast("double").try_cast("int"), F.lit(-1)).alias("epsg"),
        georef.try_cast("double").alias("geo_rmse"), F.when(georef.isin("PASSED", "FAILED"), georef).alias("geo_flag"), F.coalesce(F.col("_m")["image_quality"], F.lit("")).alias("im_quality"),
        F.col("_m")["im_width"].try_cast("int").alias("im_width"), F.col("_m")["im_height"].try_cast("int").alias("im_height"), date_of_filename(F.col("_m")["filename"]).alias("acq_ts"),
    )


def metadata_folder(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Scene metadata of all text files below path, of dates in [start, midnight of end], in order of file names."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return scene_metadata(rows, "value", "file").where(F.col("acq_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy("file")


def shorelines_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene of a file of parallel arrays; empty shorelines stay as empty arrays."""
    rows = spark.read.schema(SHORELINES).option("multiLine", True).json(path)
    zipped = rows.select(F.inline(F.arrays_zip("dates", "shorelines", "filename", "cloud_cover", "geoaccuracy", "idx", "MNDWI_threshold", "satname")))
    pts = F.transform(F.coalesce("shorelines", F.lit([]).cast("array<array<double>>")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    flag = F.when(F.col("geoaccuracy").isin("PASSED", "FAILED"), F.col("geoaccuracy"))
    return zipped.select(F.to_timestamp("dates").alias("acq_ts"), "satname", "filename", "cloud_cover", F.col("geoaccuracy").try_cast("double").alias("geo_rmse"), flag.alias("geo_flag"), "idx", F.col("MNDWI_threshold").alias("mndwi_threshold"), pts.alias("pts"))


def tides_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dates timestamp, tide double").option("header", True).csv(path).select(F.col("dates").alias("ts"), "tide")


def series_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """name, acq_ts, chainage of a file of dates and one column for each transect."""
    wide = spark.read.schema(", ".join(["dates timestamp", *(f"`{n}` double" for n in names)])).option("header", True).csv(path)
    return wide.select("dates", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("chainage")) for n in names)))).withColumnRenamed("dates", "acq_ts")


def surveys_csv(spark: SparkSession, path: str) -> DataFrame:
    """profile, survey_date, chainage, elevation; columns go by their place."""
    return spark.read.schema("profile string, survey_date date, chainage double, elevation double").option("header", True).option("enforceSchema", True).csv(path)


def frames_in_order(df: DataFrame, path: str) -> DataFrame:
    """path and frame, its place from 0, in order of file names."""
    name = F.element_at(F.split(path, "/"), -1)
    return df.select(path, (F.row_number().over(Window.partitionBy(F.regexp_replace(path, "[^/]*$", "")).orderBy(name, path)) - 1).alias("frame"))


def exploded_points(df: DataFrame, pts: str, *keep: str) -> DataFrame:
    """keep, pt_idx, x, y of lines as arrays."""
    return df.select(*keep, F.posexplode(pts).alias("pt_idx", "_p")).select(*keep, "pt_idx", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def collected_points(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, pts: points (x, y) as arrays in order."""
    own = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y"))).alias("pts"))
    return own.withColumn("pts", F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def transects_json(df: DataFrame) -> DataFrame:
    """One GeoJSON feature (`value`) a transect (name, x0, y0, x1, y1)."""
    end = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return features_json(df.withColumn("_line", F.array(end(0), end(1))), "_line", "lines", ["name"])


def shorelines_arrays(df: DataFrame) -> DataFrame:
    """One row of parallel arrays, as shorelines_json reads them, of a site's shorelines (acq_ts, satname, filename, cloud_cover,
    geo_rmse, geo_flag, idx, mndwi_threshold, pts) in order of time: a file of one site; write with df.write.json."""
    row = F.struct(
        F.date_format("acq_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("dates"), F.transform("pts", lambda p: F.array(p["x"], p["y"])).alias("shorelines"), "filename", "cloud_cover",
        F.coalesce("geo_flag", F.col("geo_rmse").cast("string")).alias("geoaccuracy"), "idx", F.col("mndwi_threshold").alias("MNDWI_threshold"), "satname",
    )
    rows = df.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("acq_ts", "idx", row.alias("row")))), lambda r: r["row"]).alias("r"))
    names = ["dates", "shorelines", "filename", "cloud_cover", "geoaccuracy", "idx", "MNDWI_threshold", "satname"]
    return rows.select("site", *(F.col("r")[n].alias(n) for n in names))


def geometry_json(pts: Column, kind: str) -> Column:
    """A GeoJSON geometry of an array of (x, y): 'lines' of two points and more, 'points' of one and more; NULL otherwise."""
    if kind not in ("lines", "points"):
        raise ValueError(f"unknown geometry {kind}")
    name, least = ("LineString", 2) if kind == "lines" else ("MultiPoint", 1)
    shape = F.struct(F.lit(name).alias("type"), F.transform(pts, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return F.when(F.size(pts) >= least, F.to_json(shape))


def features_json(df: DataFrame, pts: str, kind: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row (`value`), rows without enough points left out; write with df.write.text."""
    rows = df.withColumn("_g", geometry_json(F.col(pts), kind)).where("_g is not null")
    head = F.to_json(F.struct(*properties))
    return rows.select(F.concat(F.lit('{"type":"Feature","properties":'), head, F.lit(',"geometry":'), F.col("_g"), F.lit("}")).alias("value"))


def write_wide_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def metadata_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key-value lines of each row (`value`)."""
    return df.select(F.concat_ws("\n", *(F.concat(F.lit(c + "\t"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)).alias("value"))
