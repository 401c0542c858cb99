"""Names and records: normalised keys, ordered passes of lookups, merges, latest-wins upserts and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators import spatial
from limnos.operators.dealing import dealt_join

# What the loose key leaves out, and the words and states that the sorted key does. River and creek stay in both: a river is not the lake of its name.
GENERIC_WORDS = r"\b(lake|lakes|reservoir|pond|millpond|mill\s+pond|impoundment|sp|state\s+park|the)\b"
STOP_WORDS = ("lake", "lakes", "reservoir", "rsvr", "pond", "millpond", "mill", "the", "of", "impoundment")
STATES = ("al", "ar", "fl", "ga", "il", "in", "ky", "la", "mo", "ms", "nc", "sc", "tn", "va", "wv")


def clean(name: Column | str) -> Column:
    """Lower case, signs as spaces, single spaces."""
    name = F.col(name) if isinstance(name, str) else name
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " +", " "))


def tokens(name: Column | str) -> Column:
    return F.filter(F.split(clean(name), " "), lambda t: t != "")


def plain_name(name: Column | str) -> Column:
    """The name without its parentheses and what follows its first comma, cleaned."""
    name = F.col(name) if isinstance(name, str) else name
    return clean(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"(?s),.*$", ""))


def loose_key(name: Column | str, generic: str = GENERIC_WORDS) -> Column:
    """The plain name without generic words, run together in order. Not enough on its own to make two records one: a lake and a pond of one name share it."""
    return F.regexp_replace(F.regexp_replace(plain_name(name), generic, " "), "[^a-z0-9]+", "")


def sorted_key(name: Column | str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens but states, single letters (not digits) and stop words, sorted; with the stop words where none is left."""
    said = F.filter(tokens(name), lambda t: ~t.isin(*STATES) & ((F.length(t) > 1) | t.rlike("^[0-9]+$")))
    kept = F.filter(said, lambda t: ~t.isin(*stop))
    return F.array_join(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(said)), " ")


def slug(name: Column | str) -> Column:
    return F.replace(clean(name), F.lit(" "), F.lit("-"))


def gnis(value: Column | str) -> Column:
    """An id out of `gnis:0123.0` and such; other prefixes, 0 and no digits are null."""
    v = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "^gnis:", ""), r"\.0$", ""), "[^0-9]", "")
    return F.when(~v.rlike("^(slug|nhd):"), F.nullif(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0)))


def pid(value: Column | str) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, "[{}]", ""))), F.lit(""))


def resolve(queries: DataFrame, registry: DataFrame, key: str, row_id: str, passes: list[tuple[Column, Column]]) -> DataFrame:
    """key, row_id, pass: each query's registry row by the first pass whose keys match. A pass that matches several rows is
    ambiguous: the result is null, and no later pass is asked. passes: (query's key, registry's key), both Columns over one frame each."""
    q = queries.select(key, F.posexplode(F.array(*(a for a, _ in passes))).alias("_p", "_k")).where("_k is not null and _k != ''")
    r = registry.select(F.col(row_id).alias("_id"), F.posexplode(F.array(*(b for _, b in passes))).alias("_p", "_k")).where("_k is not null and _k != ''").distinct()
    r = r.groupBy("_p", "_k").agg(F.count("*").alias("_n"), F.min("_id").alias("_id"))
    hit = q.join(r, ["_p", "_k"]).groupBy(key).agg(F.min(F.struct("_p", "_n", "_id")).alias("_h"))
    out = hit.select(key, F.when(F.col("_h._n") == 1, F.col("_h._id")).alias(row_id), F.col("_h._p").alias("pass"))
    return queries.select(key).join(out, key, "left")


def weak_tokens(names: DataFrame, name: str, at_least: int = 6) -> DataFrame:
    """Tokens that so many names share that they tell nothing."""
    return names.select(F.explode(F.array_distinct(tokens(name))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def containment(a: Column, b: Column) -> Column:
    """Whether one token array holds the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def prefer(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_wins(changes: DataFrame, keys: list[str], version: list[str], deleted: str | None = None) -> DataFrame:
    """The last version of every key, tombstones left out: a map-side combined max, no sort."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*")
    return last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last


def change_feed(changes: DataFrame, keys: list[str], version: str, since: Column, limit: int | None = None) -> DataFrame:
    """The last change of each key after a mark, in order of version; limit is the feed's page."""
    fresh = latest_wins(changes.where(F.col(version) > since), keys, [version]).orderBy(version, *keys)
    return fresh.limit(limit) if limit else fresh


def fill(primary: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A full outer merge: the primary's values, the other's where they are missing, and both sides' rows; `source` tells whose."""
    a = primary.select(*keys, *(F.col(f).alias(f"_a_{f}") for f in fields), F.lit(1).alias("_a"))
    b = other.select(*keys, *(F.col(f).alias(f"_b_{f}") for f in fields), F.lit(1).alias("_b"))
    source = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "primary").otherwise("other")
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(f"_a_{f}", f"_b_{f}").alias(f) for f in fields), source.alias("source"))


def append_missing(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """base and those of more's rows whose keys it lacks."""
    return base.unionByName(more.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, old, new, verdict (added, lost, changed beyond tolerance) of what differs."""
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    verdict = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "lost").when(F.abs(F.col("new") - F.col("old")) > tolerance, "changed")
    return a.join(b, keys, "full_outer").withColumn("verdict", verdict).where("verdict is not null")


def disambiguate(rows: DataFrame, name: str, label: Column, among: Column, out: str) -> DataFrame:
    """Names that several of the rows in `among` bear get the label appended."""
    n = F.count(F.when(among, 1)).over(Window.partitionBy(name))
    return rows.withColumn(out, F.when(among & (n > 1), F.concat(F.col(name), F.lit(" ("), label, F.lit(")"))).otherwise(F.col(name)))


def changed_documents(store: DataFrame, fresh: DataFrame, key: str, print_: str, version: str = "version") -> DataFrame:
    """fresh rows whose fingerprint is not their key's latest, with the next version: what a content-addressed store has to append."""
    last = store.groupBy(key).agg(F.max_by(print_, version).alias("_p"), F.max(version).alias("_v"))
    new = fresh.join(last, key, "left").where(F.col("_p").isNull() | (F.col("_p") != F.col(print_)))
    return new.withColumn(version, F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_p", "_v")


def first_sightings(snapshots: DataFrame, live: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """Of the newest so many days' snapshots the rows that are no longer live, each key once, as last seen."""
    newest = snapshots.join(F.broadcast(snapshots.select(day).distinct().orderBy(F.desc(day)).limit(days)), day, "left_semi")
    gone = newest.join(live.select(key), key, "left_anti")
    return prefer(gone, [key], F.desc(day))


def merge_records(pairs: DataFrame, keeper: str, retiree: str, lists: list[str], maps: list[str], scalars: list[str]) -> DataFrame:
    """keeper rows with a retired one's fields folded in. pairs has each field twice, as keep_<f> and gone_<f>: lists are joined without repeats in
    order, maps united with the keeper's values first, scalars filled where empty."""
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    out = [F.col(keeper), F.col(retiree)]
    for f in lists:
        out.append(F.array_distinct(F.concat(F.coalesce(f"keep_{f}", F.array()), F.coalesce(f"gone_{f}", F.array()))).alias(f))
    for f in maps:
        out.append(F.map_zip_with(F.coalesce(F.col(f"keep_{f}"), F.create_map()), F.coalesce(F.col(f"gone_{f}"), F.create_map()), lambda k, a, b: F.coalesce(a, b)).alias(f))
    for f in scalars:
        out.append(F.when(blank(F.col(f"keep_{f}")), F.col(f"gone_{f}")).otherwise(F.col(f"keep_{f}")).alias(f))
    return pairs.select(*out)


def deletions(name: Column, edits: int) -> Column:
    """The name and all it becomes by dropping up to so many letters: two names within that edit distance share one of them."""
    out = F.array(name)
    level = out
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        out = F.array_distinct(F.concat(out, level))
    return out


def near_names(queries: DataFrame, registry: DataFrame, key: str, name: str, row_id: str, row_name: str, edits: int = 1) -> DataFrame:
    """key, row_id, edits of every pair of names 1 to `edits` apart: names meet in a hashed join on their deletions, and the distance is then taken."""
    q, r = queries.select(key, F.col(name).alias("_a")).distinct(), registry.select(row_id, F.col(row_name).alias("_b")).distinct()
    spelt = lambda df, c: df.select(c).distinct().select(c, F.explode(deletions(F.col(c), edits)).alias("_d"))
    # Names are compared once, however many rows bear them.
    pairs = spelt(q, "_a").join(spelt(r, "_b"), "_d").select("_a", "_b").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("_a", "_b")).where(F.col("edits").between(1, edits))
    return dealt_join(q, r.join(pairs, "_b").select(row_id, "_a", "edits"), ["_a"]).select(key, row_id, "edits")


def merge_places(left: DataFrame, right: DataFrame, row_id: str, name: str, fields: list[str], metres: float = 50.0) -> DataFrame:
    """One table of two sources' places: rows of one cleaned name within so many metres are one, with the left's values and the right's where those are
    missing; others stay. A right row joins the nearest left one. Columns: row_id, lon, lat, name, fields, source."""
    a = left.withColumn("_k", clean(name))
    b = right.select(clean(name).alias("_n"), F.col(row_id).alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), *(F.col(f).alias(f"_{f}") for f in fields))
    # Names and cells are keys of one join: rows of a common name meet only where they are close.
    near = spatial.radius_join(a, b, ("lon", "lat"), ("_lon", "_lat"), metres, [("_k", "_n")], "_m")
    pairs = prefer(prefer(near, ["_id"], F.col("_m"), F.col(row_id)), [row_id], F.col("_m"), F.col("_id"))
    filled = a.join(pairs.select(row_id, "_id", *(f"_{f}" for f in fields)), row_id, "left")
    source = F.when(F.col("_id").isNull(), "left").otherwise("both")
    kept = filled.select(row_id, "lon", "lat", name, *(F.coalesce(f, f"_{f}").alias(f) for f in fields), source.alias("source"))
    rest = right.join(pairs.select(F.col("_id").alias(row_id)), row_id, "left_anti").select(row_id, "lon", "lat", name, *fields, F.lit("right").alias("source"))
    return kept.unionByName(rest)


def fresh(table: DataFrame, loaded_at: str, now: Column, ttl_s: float) -> DataFrame:
    """Rows whose time to live is not over."""
    return table.where(now - F.col(loaded_at) <= ttl_s)


def new_defaults(defaults: DataFrame, saved: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Defaults that are neither saved nor were seen before, so that what a user deleted stays so."""
    return defaults.join(saved.select(key), key, "left_anti").join(seen.select(key), key, "left_anti")
