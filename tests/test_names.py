"""Keys and matches of names: a river is not the lake of its name, a county is not a lake, a tailwater is not a pool."""

import pytest
from pyspark.sql import functions as F

from limnos.operators import entity, reports


def column(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, n string").orderBy("i").select(fn("n")).collect()]


def test_keys_keep_rivers_apart(spark):
    names = ["Lake Wateree", "Wateree Lake, SC", "Wateree River", "Parr Shoals (upper) Reservoir", "Old Mill Pond", "Santee State Park", None]
    assert column(spark, names, entity.loose_key) == ["wateree", "wateree", "watereeriver", "parrshoals", "old", "santee", None]
    names = ["Lake Edwin B. Johnson", "Lake Edwin Johnson", "Johnson River 7, SC", "Mill Pond of the Lake", "The Lake GA"]
    assert column(spark, names, entity.sorted_key) == ["edwin johnson", "edwin johnson", "7 johnson river", "lake mill of pond the", "lake the"]


@pytest.mark.parametrize(
    ("text", "name", "hit"),
    [
        ("Zach Neill's Lake Junaluska largemouth", "Lake Junaluska", True),
        ("Brantley Hawkins' Marion County bass", "Lake Marion", False),
        ("https://x.com/brantley-hawkins-marion-county-bass/", "Lake Marion", False),
        ("Lake Marion in Marion County", "Lake Marion", True),
        ("crappie on Wateree", "Wateree River", False),
        ("Marionville", "Lake Marion", False),
        ("stripers at Fort Loudoun", "Ft. Loudoun Reservoir", True),
        ("the lake", "The Lake", False),
        (None, "Lake Marion", False),
    ],
)
def test_texts_that_name_a_water(spark, text, name, hit):
    df = spark.createDataFrame([(text, name)], "t string, n string")
    assert df.select(reports.names_all(F.col("t"), reports.report_tokens(F.col("n")))).first()[0] is hit


def test_names_against_names(spark):
    waters = spark.createDataFrame([(1, "Norris Lake"), (2, "Charleston Harbor, SC"), (3, "Wateree River"), (4, "Lake Marion"), (5, "Lake Moultrie"), (6, "Mountain Lake"), (7, None), (8, "Lake Hartwell Marion")], "water int, wname string")
    names = spark.createDataFrame([("a", "Norris Tailwater"), ("b", "charleston"), ("c", "Wateree"), ("d", "santee cooper lake marion lake moultrie"), ("e", "Mountain Island Lake"), ("f", "Marion Hartwell"), ("g", "the lake"), ("h", None)], "k string, name string")
    loose = {r["k"]: (r["water"], r["shared"]) for r in reports.matched_names(names, waters, "k", "name", "water", "wname").collect()}
    assert loose == {"b": (2, 1), "d": (4, 1), "e": (6, 1), "f": (8, 2)}
    strict = {r["k"]: r["water"] for r in reports.matched_names(names, waters, "k", "name", "water", "wname", broader=False).collect()}
    assert strict == {"b": 2, "f": 8}
