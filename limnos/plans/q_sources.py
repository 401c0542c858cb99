"""Queries over sources and sinks: tables written in a feed's format in the shared folder and read back."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from limnos.functions import geo, labels
from limnos.operators import text
from limnos.plans.registry import query
from limnos.plans.surrogates import LEGS, POINTS, SERIES, legs, points, series, table
from limnos.sources import readers
from limnos.sources.shared import shared_dir


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/limnos/source-{name}-{uuid.uuid4().hex}"


@query(f"""WITH {POINTS} SELECT id, grp, 'Point' AS geometry_type, lon, lat FROM points""")
def source_geojson(spark, sf_dir):
    path = place(spark, "geojson")
    p = points(spark, sf_dir).withColumn("at", F.array("lon", "lat"))
    readers.to_geojson(p, "at", "Point", ["id", "grp"]).write.text(path)
    out = readers.read_geojson(spark, path, "id long, grp int", "array<double>", lines=True)
    return out.select("id", "grp", "geometry_type", F.col("coordinates")[0].alias("lon"), F.col("coordinates")[1].alias("lat"))


@query(f"""WITH {LEGS} SELECT id, round(sqrt(power((lon2 - lon) * cos(radians((lat + lat2) / 2)) * 111320.0, 2) + power((lat2 - lat) * 110570.0, 2)), 2) AS length_m FROM legs""")
def source_geojson_lines(spark, sf_dir):
    """Line strings, read as lines and measured."""
    path = place(spark, "lines")
    leg = legs(spark, sf_dir).withColumn("line", F.array(F.array("lon", "lat"), F.array("lon2", "lat2")))
    readers.to_geojson(leg, "line", "LineString", ["id"]).write.text(path)
    out = readers.read_geojson(spark, path, "id long", lines=True)
    return out.select("id", F.round(geo.line_length_m(readers.line_of(F.col("coordinates"))), 2).alias("length_m"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS site_no, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS station_nm, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def source_rdb(spark, sf_dir):
    """A tab-separated table under comments and a line of formats."""
    path = place(spark, "rdb")
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("site_no"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("station_nm"), F.col("c_nationkey").alias("nation"))
    head = spark.createDataFrame([("# made for a round trip\nsite_no\tstation_nm\tnation\n5s\t15s\t3n",)], "value string")
    head.write.text(path)
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)  # each file under a head of its own
    return readers.read_rdb(spark, path)


@query("""SELECT s_suppkey, s_name || ', "Inc"' || chr(10) || 'x' AS name, round(s_acctbal, 2) AS balance FROM supplier""")
def source_csv(spark, sf_dir):
    """Quotes, commas and line feeds within fields."""
    path = place(spark, "csv")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "Inc"\nx')).alias("name"), F.round("s_acctbal", 2).alias("balance"))
    readers.write_csv(s, path)
    return readers.read_csv(spark, path, "s_suppkey long, name string, balance double")


@query(f"""WITH {POINTS} SELECT 'P' || id AS name, 'sym' || grp AS sym, lat, lon FROM points""")
def source_gpx(spark, sf_dir):
    path = place(spark, "gpx")
    p = points(spark, sf_dir).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("sym"), F.col("grp").cast("string")).alias("sym"), "lat", "lon")
    readers.write_gpx(p, path)
    return readers.read_gpx(spark, path)


@query(f"""WITH {LEGS} SELECT 'L' || id AS name, CAST(2 AS INTEGER) AS n, lon AS x0, lat AS y0, lon2 AS x1, lat2 AS y1 FROM legs""")
def source_kml(spark, sf_dir):
    path = place(spark, "kml")
    pair = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"), F.lit("0"))
    rows = legs(spark, sf_dir).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("name"), F.struct(F.concat_ws(" ", pair("lon", "lat"), pair("lon2", "lat2")).alias("coordinates")).alias("LineString"))
    rows.write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").save(path)
    out = readers.read_kml(spark, path)
    at = lambda i, c: F.col("line")[i][c]
    return out.select("name", F.size("line").alias("n"), at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1"))


@query(f"""WITH {SERIES} SELECT 'u' || user_id AS name, event_type AS unit, to_timestamp(t) AT TIME ZONE 'UTC' AS t, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM series""")
def source_series(spark, sf_dir):
    """One JSON document a series; null values stay null."""
    path = place(spark, "series")
    item = F.array((F.col("t") * 1000).cast("double"), F.when(F.col("event_id") % 5 != 0, F.col("value")))
    by = series(spark, sf_dir).groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("units")).agg(F.collect_list(item).alias("values"))
    by.write.option("ignoreNullFields", False).json(path)
    return readers.read_series(spark, path, lines=True).withColumn("t", F.col("t").cast("timestamp_ntz"))


@query(f"""WITH {POINTS} SELECT id, 'polygon' AS kind, 4 AS corners, lon AS x, lat AS y FROM points""")
def source_wkb(spark, sf_dir):
    """A triangle about every point as a GeoPackage blob: its header, then WKB with a Z."""

    @F.pandas_udf("binary")
    def blob(lon: pd.Series, lat: pd.Series) -> pd.Series:
        ring = lambda x, y: [(x, y, 0.0), (x + 1, y, 0.0), (x, y + 1, 0.0), (x, y, 0.0)]
        head = b"GP\0\x01" + struct.pack("<i", 4326)
        return pd.Series([head + struct.pack("<BIII", 1, 1003, 1, 4) + b"".join(struct.pack("<ddd", *p) for p in ring(x, y)) for x, y in zip(lon, lat, strict=True)])

    out = points(spark, sf_dir).select("id", readers.decode_wkb(readers.gpkg_wkb(blob("lon", "lat"))).alias("g"))
    corner = F.col("g.parts")[0][0]
    return out.select("id", "g.kind", F.size(corner).alias("corners"), corner[0]["x"].alias("x"), corner[0]["y"].alias("y"))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders""")
def source_layers(spark, sf_dir):
    """A second write replaces the partitions that it holds, and no others."""
    path = place(spark, "layers")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    readers.write_layers(o, path, ["o_orderstatus"])
    readers.write_layers(o.where("o_orderstatus = 'O'").withColumn("price", F.col("price") + 1), path, ["o_orderstatus"])
    return spark.read.parquet(path)


@query("""SELECT conv_id, turn, 'Turn ' || turn || ' & more' AS title, 'https://x.example/' || conv_id AS link, '2024-01-0' || (1 + turn % 9) AS published FROM conversations""")
def source_rss(spark, sf_dir):
    """A feed document a conversation, an item a turn."""
    n = F.col("turn").cast("string")
    item = F.concat(F.lit("<item><title><![CDATA[Turn "), n, F.lit(" & more]]></title><link>https://x.example/"), F.col("conv_id").cast("string"), F.lit("</link><pubDate>2024-01-0"), (1 + F.col("turn") % 9).cast("string"), F.lit("</pubDate></item>"))
    feeds = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<rss>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), ""), F.lit("</rss>")).alias("xml"))
    return feeds.select("conv_id", F.posexplode(text.rss_items(F.col("xml"))).alias("turn", "i")).select("conv_id", F.col("turn").cast("long").alias("turn"), "i.title", "i.link", "i.published")


@query(f"""WITH {POINTS} SELECT id, lat, lon, ['BOAT_RAMP', 'DAM', 'PIER'][id % 4 + 1] AS kind FROM points WHERE id % 4 < 3""")
def source_map_features(spark, sf_dir):
    """Points as a map extract: ramps, dams and piers by their tags, and for every fourth a tag that bears on no water."""
    path = place(spark, "map")
    tag = lambda k, v: F.array(F.struct(F.lit(k).alias("_k"), F.lit(v).alias("_v")))
    i = F.col("id") % 4
    tags = F.when(i == 0, tag("leisure", "slipway")).when(i == 1, tag("waterway", "dam")).when(i == 2, tag("man_made", "pier")).otherwise(tag("shop", "bait"))
    nodes = points(spark, sf_dir).select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tags.alias("tag"))
    nodes.write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(path)
    return readers.read_map_features(spark, path).where(labels.worth_keeping("tags")).select("id", "lat", "lon", labels.kind_of("tags").alias("kind"))


@query("""WITH o AS (SELECT o_orderstatus AS layer, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders), t AS (SELECT layer, count(*) AS total FROM o GROUP BY 1)
 SELECT layer, count(CASE WHEN layer <> 'P' OR n >= 100 THEN 1 END) AS got, any_value(total) AS total, count(CASE WHEN layer <> 'P' OR n >= 100 THEN 1 END) = any_value(total) AS complete FROM o JOIN t USING (layer) GROUP BY layer""")
def source_paged(spark, sf_dir):
    """A service's pages of a hundred items, the first of one layer lost."""
    from pyspark.sql import Window

    path = place(spark, "paged")
    by = Window.partitionBy("layer")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("layer"), F.col("o_orderkey").alias("k"))
    o = o.withColumn("n", F.row_number().over(by.orderBy("k")) - 1).withColumn("total", F.count("*").over(by)).withColumn("offset", (F.floor(F.col("n") / 100) * 100).cast("long"))
    pages = o.groupBy("layer", "offset", "total").agg(F.collect_list(F.struct("k")).alias("features"))
    pages.where("not (layer = 'P' and offset = 0)").write.json(path)
    return readers.page_gaps(readers.read_paged(spark, path, "k long"))
