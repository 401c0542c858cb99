"""Readers and writers of the feeds' formats, on Spark's own sources where they exist."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "array<double>"


def read_geojson(spark: SparkSession, path: str, properties: str, coordinates: str = f"array<{POSITION}>", lines: bool = False) -> DataFrame:
    """One row a feature: its properties, geometry type and coordinates. Compressed files are known by suffix. properties: their schema, so that nothing is inferred. lines: one collection a line, as `to_geojson` writes, not a file."""
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coordinates}>>"
    rows = spark.read.schema(f"features array<{feature}>").option("multiLine", not lines).json(path)
    return rows.select(F.explode("features").alias("f"), F.col("_metadata.file_path").alias("file")).select("file", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def to_geojson(df: DataFrame, geometry: str, kind: str, properties: list[str]) -> DataFrame:
    """One FeatureCollection line a row. geometry: coordinates as GeoJSON nests them."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), F.col(geometry).alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))


def line_of(coordinates: str | Column) -> Column:
    """[[x, y, ...], ...] as array<struct<x,y>>."""
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_rdb(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tables with # comments, a header line and a format line, which goes; blanks are null, every column a string."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("nullValue", "").csv(path)
    first = rows.columns[0]
    return rows.where(~F.coalesce(F.col(first).rlike(r"^\d+[sdn]$"), F.lit(False)))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints: name, lat, lon."""
    rows = spark.read.format("xml").option("rowTag", "wpt").schema("_lat double, _lon double, name string, sym string").load(path)
    return rows.select("name", "sym", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks: name, and the line string as array<struct<x,y>>."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, LineString struct<coordinates:string>").load(path)
    pair = lambda t: F.transform(F.split(t, ","), lambda v: v.cast("double"))
    return rows.select("name", line_of(F.transform(F.split(F.trim("LineString.coordinates"), r"\s+"), pair)).alias("line"))


def gpkg_wkb(blob: str | Column) -> Column:
    """The geometry in a GeoPackage blob: its header's length depends on the envelope's kind."""
    blob = F.col(blob) if isinstance(blob, str) else blob
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    kind = F.shiftright(flags.bitwiseAND(F.lit(14)), 1)
    head = 8 + F.element_at(F.array(*map(F.lit, (0, 32, 48, 48, 64))), kind + 1)
    return F.substring(blob, head + 1, F.octet_length(blob))


def wkb_parts(data: bytes) -> tuple[str, list[list[list[tuple[float, float]]]]]:
    """Kind and parts (each a list of rings or one line) of a WKB point, line, polygon or their multi forms, with Z and M dropped."""
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def one() -> tuple[int, list]:
        order = "<" if take("B")[0] else ">"
        (code,) = take(order + "I")
        extra = (code >> 31 & 1) + (code >> 30 & 1) if code > 0xFFFF else (0, 1, 1, 2)[code // 1000]
        kind = (code & 0xFFFF) % 1000
        run = lambda: [take(order + "d" * (2 + extra))[:2] for _ in range(take(order + "I")[0])]
        if kind == 1:
            return kind, [[[take(order + "d" * (2 + extra))[:2]]]]
        if kind == 2:
            return kind, [[run()]]
        if kind == 3:
            return kind, [[run() for _ in range(take(order + "I")[0])]]
        return kind, [p for _ in range(take(order + "I")[0]) for p in one()[1]]

    kind, parts = one()
    return {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}.get(kind, "collection"), parts


def decode_wkb(blob: str | Column) -> Column:
    """struct<kind, parts array<array<array<struct<x,y>>>>>; null where it can't be read."""

    @F.pandas_udf("kind string, parts array<array<array<struct<x:double,y:double>>>>")
    def run(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for b in blobs:
            try:
                kind, parts = wkb_parts(bytes(b))
                rows.append((kind, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]))
            except (struct.error, TypeError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["kind", "parts"])

    return run(blob)


# Fixed value: the graph format's magic number, little-endian.
GRAPH_MAGIC = 0x47574D54


def pack_graph(nodes: list[tuple[float, float, int]], edges: list[tuple[int, int]], layer: int = 0, base: int = 0) -> bytes:
    """A graph file: a header, positions in 1e-7 degrees, edge pairs, a depth byte a node."""
    head = struct.pack("<IBBHII", GRAPH_MAGIC, 1, layer, base, len(nodes), len(edges))
    at = b"".join(struct.pack("<ii", round(lon * 1e7), round(lat * 1e7)) for lon, lat, _ in nodes)
    return head + at + b"".join(struct.pack("<II", *e) for e in edges) + bytes(d for _, _, d in nodes)


def read_graphs(spark: SparkSession, path: str, what: str) -> DataFrame:
    """nodes (file, id, lon, lat, depth) or edges (file, src, dst) of graph files; one of another magic has none."""
    schema = {"nodes": "file string, id long, lon double, lat double, depth int", "edges": "file string, src long, dst long"}[what]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                magic, _, _, _, n, m = struct.unpack_from("<IBBHII", data)
                if magic != GRAPH_MAGIC:
                    continue
                flat = struct.unpack_from(f"<{2 * n}i", data, 16)
                pairs = struct.unpack_from(f"<{2 * m}I", data, 16 + 8 * n)
                if what == "nodes":
                    depth = data[16 + 8 * n + 8 * m : 16 + 9 * n + 8 * m]
                    yield pd.DataFrame({"file": file, "id": range(n), "lon": [x / 1e7 for x in flat[::2]], "lat": [x / 1e7 for x in flat[1::2]], "depth": list(depth)})
                else:
                    yield pd.DataFrame({"file": file, "src": pairs[::2], "dst": pairs[1::2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_layers(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by partition; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """file, row, fields (map of trimmed strings) of dBASE tables; deleted rows go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                n, head, width = struct.unpack_from("<IHH", data, 4)
                fields, at = [], 32
                while data[at] != 0x0D:
                    fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
                    at += 32
                rows = []
                for r in range(n):
                    row = data[head + r * width : head + (r + 1) * width]
                    if row[:1] == b"*":
                        continue
                    out, at = {}, 1
                    for name, size in fields:
                        out[name] = row[at : at + size].decode("latin-1").strip()
                        at += size
                    rows.append((file, r, out))
                yield pd.DataFrame(rows, columns=["file", "row", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, fields map<string,string>")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """file, row, rings (array<array<struct<x,y>>>) of the polygons of shapefiles; other shapes have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                at, rows = 100, []
                while at + 8 <= len(data):
                    number, words = struct.unpack_from(">II", data, at)
                    kind = struct.unpack_from("<I", data, at + 8)[0]
                    rings = []
                    if kind in (5, 15, 25):
                        parts, points = struct.unpack_from("<II", data, at + 44)
                        starts = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
                        xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
                        rings = [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
                    rows.append((file, number - 1, rings))
                    at += 8 + 2 * words
                yield pd.DataFrame(rows, columns=["file", "row", "rings"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, rings array<array<struct<x:double,y:double>>>")


def write_gpx(waypoints: DataFrame, path: str) -> None:
    """Waypoints (name, sym, lat, lon) as XML that `read_gpx` reads."""
    rows = waypoints.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "name", "sym")
    rows.write.format("xml").option("rootTag", "gpx").option("rowTag", "wpt").save(path)


def read_series(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """name, unit, t, value of JSON series whose values are [time in ms, value, ...] rows, the unit told beside them; null values stay null. lines: one document a line."""
    rows = spark.read.schema("name string, units string, `values` array<array<double>>").option("multiLine", not lines).json(path)
    return rows.select("name", F.col("units").alias("unit"), F.explode("values").alias("v")).select("name", "unit", F.timestamp_millis(F.col("v")[0].cast("long")).alias("t"), F.col("v")[1].alias("value"))


def read_map_features(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon, tags (a map) of the nodes of map extracts in XML; nodes without tags have an empty map."""
    rows = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>").load(path)
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    return rows.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.map_from_entries(pairs).alias("tags"))


def read_paged(spark: SparkSession, path: str, item: str) -> DataFrame:
    """layer, offset, total and the items of a paged service's answers, landed as JSON lines. item: the fields of one."""
    rows = spark.read.schema(f"layer string, offset long, total long, features array<struct<{item}>>").json(path)
    return rows.select("layer", "offset", "total", F.explode_outer("features").alias("item"))


def page_gaps(items: DataFrame) -> DataFrame:
    """layer, got, total, complete: whether the pages that were landed hold as many items as the service said, each page once."""
    got = items.groupBy("layer").agg(F.count("item").alias("got"), F.max("total").alias("total"))
    return got.withColumn("complete", F.col("got") == F.col("total"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and doubled quotes, as `read_csv` reads."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
