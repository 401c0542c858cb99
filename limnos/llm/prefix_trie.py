"""Trie of conversations' prefixes: a z-fast trie in tables, filled in batches by fat binary search.

A conversation is a sequence of prefix hashes: the one at depth d tells its first d turns. Equal sequences are one. The trie is
compacted: an edge runs from the node above (`lo`) to a branching or an end (`hi`) and lists the hashes it passes. Its handle
is the hash at the two-fattest depth within (lo, hi], the one with most zero bits at its end.

* `locate` finds for each sequence the deepest node it passes: it halves an interval of depths at their two-fattest number and joins
  the hash there with the edges' handles, so a sequence of n turns needs as many lookups as n has bits. A last join by the
  next turn's hash gives the edge on which the sequence leaves the trie.
* `insert` takes a batch: edges that sequences leave halfway are cut there; what is new is grouped by hash, and a chain of new
  nodes belongs to the least sequence that passes them, which cuts it into edges where others branch off or end.
* `expanded` gives a row for each node, edges' inner ones included. Sums over subtrees double their reach up the compacted trie in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: The root's hash; how many times as large each batch is as those before it; how many of them; conversation ids that are joined into one string.
ROOT, GROWTH, BATCHES, IDS_PER_PIECE = b"\0" * 16, 8, 2, 4096
_WORDS = r"[^\x20\x09-\x0D]+"
PATH = "array<struct<p: binary, w: long, c: long>>"
EDGE = ["key", "lo", "hi", "up", "handle", "first", "path"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest (16 bytes of role and text), words: a conversation's turns by turn (null first), role and text. Null role and text are empty; rows without conv_id belong to none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("mark")).alias("by"), F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")
    )
    return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("by")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id and turns, an array of (pos, digest, words): the first h turns of the conversation whose id is the last multiple of `every`, then its own after its first h; h is the id's crc32 modulo `most`."""
    own_h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    all_ids = turns.where("pos = 1").select("conv_id")
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    heads = heads.groupBy("base").agg(F.collect_list(F.struct("pos", "digest", "words")).alias("head"))
    own = turns.where(F.col("pos") > own_h).groupBy("conv_id").agg(F.collect_list(F.struct("pos", "digest", "words")).alias("own"))
    none = F.array().cast("array<struct<pos: int, digest: binary, words: long>>")
    joined = all_ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").join(own, "conv_id", "left")
    head = F.filter(F.coalesce("head", none), lambda x: x["pos"] <= own_h)
    return joined.select("conv_id", F.concat(F.array_sort(head), F.array_sort(F.coalesce("own", none))).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, words, ends = batch.column(1), batch.column(2).values.to_pylist(), batch.column(1).offsets.to_pylist()
        each, hashes, sums = digests.values.to_pylist(), [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            p, c = ROOT, 0
            for d, w in zip(each[a:b], words[a:b], strict=True):
                p, c = hashlib.blake2b(p + d, digest_size=16).digest(), c + w
                hashes.append(p)
                sums.append(c)
        items = pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(words, pa.int64()), pa.array(sums, pa.int64())], ["p", "w", "c"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["conv_id", "path"])


def prefixes(sequences: DataFrame) -> DataFrame:
    """conv_id, path and key: the prefix hash, own and summed words at each depth, and the whole sequence's hash (the root's if it has no turn).

    A task holds a conversation's hashes, 32 bytes a turn.
    """
    rows = sequences.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    out = rows.mapInArrow(_chain, f"conv_id long, path {PATH}")
    return out.withColumn("key", F.coalesce(F.try_element_at("path", F.lit(-1))["p"], F.lit(ROOT)))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that most powers of two divide: high without the bits below the highest in which it differs from low."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return (high - high % F.call_function("shiftleft", F.lit(1).cast("long"), bits)).cast("int")


def _handle(lo: str = "lo", hi: str = "hi") -> Column:
    return F.get("path", fattest(F.col(lo).cast("long"), F.col(hi).cast("long")) - F.col(lo) - 1)["p"]


def _with_handles(edges: DataFrame) -> DataFrame:
    return edges.select("key", "lo", "hi", "up", _handle().alias("handle"), F.get("path", F.lit(0))["p"].alias("first"), "path")


def locate(edges: DataFrame | None, seqs: DataFrame) -> DataFrame:
    """seqs (key, path and others) with n (turns), `depth` of the deepest node passed, `at`, how many turns are in the trie, and the edge on which they end inside, if so: edge, edge_lo."""
    s = seqs.withColumn("n", F.size("path"))
    if edges is None:
        return s.select("*", F.lit(0).alias("at"), F.lit(None).cast("binary").alias("edge"))
    longest = s.agg(F.max("n")).first()[0] or 0
    known = edges.select(F.col("handle").alias("h"), F.col("key").alias("h_key"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"))
    s = s.withColumns({"a": F.lit(0), "b": F.col("n")})
    for _ in range(longest.bit_length()):
        f = F.when(F.col("a") < F.col("b"), fattest(F.col("a").cast("long"), F.col("b").cast("long")))
        s = s.withColumn("f", f)
        # A sequence that is done asks for its own hash, and disregards the answer.
        probe = F.coalesce(F.get("path", F.col("f") - 1)["p"], "key")
        s = s.withColumn("probe", probe).join(known, F.col("probe") == F.col("h"), "left")
        found = F.col("f").isNotNull() & F.col("h").isNotNull()
        whole = found & (F.col("h_hi") <= F.col("n")) & F.coalesce(F.get("path", F.col("h_hi") - 1)["p"] == F.col("h_key"), F.lit(False))
        a = F.when(whole, F.col("h_hi")).when(found, F.col("h_lo")).otherwise(F.col("a"))
        b = F.when(whole, F.col("b")).when(found, F.col("h_lo")).when(F.col("f").isNotNull(), F.col("f") - 1).otherwise(F.col("b"))
        s = s.withColumns({"a": a, "b": b}).drop("f", "probe", "h", "h_key", "h_lo", "h_hi")
    # The edge that goes on from there, if the sequence has more turns: what of it they share.
    nexts = edges.select(F.col("first").alias("e_first"), F.col("key").alias("edge"), F.col("path").alias("e_path"))
    s = s.join(nexts, F.coalesce(F.get("path", F.col("a"))["p"], F.concat(F.col("key"), F.lit(b"-"))) == F.col("e_first"), "left")
    shared = F.size(F.filter("e_path", lambda x, i: F.coalesce(x["p"] == F.get("path", F.col("a") + i)["p"], F.lit(False))))
    return s.withColumn("at", F.col("a") + F.when(F.col("edge").isNull(), 0).otherwise(shared)).drop("a", "b", "e_first", "e_path")


def _pieces(path: Column, lo: Column, up: Column, ends: Column) -> Column:
    """Edges that a path from depth lo is cut into at `ends`, ascending depths, the last of them its own."""
    starts = F.concat(F.array(lo), ends)

    def piece(hi: Column, i: Column) -> Column:
        begin = F.get(starts, i)
        part = F.slice(path, begin - lo + 1, hi - begin)
        return F.struct(F.element_at(part, -1)["p"].alias("key"), begin.alias("lo"), hi.alias("hi"), F.when(i == 0, up).otherwise(F.get(path, begin - lo - 1)["p"]).alias("up"), part.alias("path"))

    return F.transform(ends, piece)


def insert(edges: DataFrame | None, seqs: DataFrame) -> DataFrame:
    """The trie's edges with the sequences (key, path, low: an id of each) in it. Sequences that it holds already change nothing; none twice in a batch."""
    placed = materialize(locate(edges, seqs), "trie-placed")
    new = placed.where("at < n").select("low", "at", F.posexplode("path").alias("i", "x"), "n", "path").where("i >= at")
    nodes = new.select(
        F.col("x.p").alias("p"), F.when(F.col("i") == 0, F.lit(ROOT)).otherwise(F.get("path", F.col("i") - 1)["p"]).alias("up"), (F.col("i") + 1).alias("d"), F.col("x.w").alias("w"), F.col("x.c").alias("c"), "low", (F.col("i") + 1 == F.col("n")).alias("end")
    )
    nodes = nodes.groupBy("p", "up", "d", "w", "c").agg(F.min("low").alias("low"), F.max("end").alias("end"))
    forks = nodes.groupBy(F.col("up").alias("p")).agg(F.count("*").alias("k")).where("k > 1").select("p", F.lit(True).alias("fork"))
    marked = nodes.join(forks, "p", "left").withColumn("cut", F.col("end") | F.col("fork").isNotNull())
    chains = marked.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("d", "p", "w", "c", "up", "cut"))).alias("chain"))
    path = F.transform("chain", lambda x: F.struct(x["p"].alias("p"), x["w"].alias("w"), x["c"].alias("c")))
    ends = F.filter("chain", lambda x: x["cut"])["d"]
    head = F.get("chain", F.lit(0))
    fresh = chains.select(path.alias("path"), (head["d"] - 1).alias("lo"), head["up"].alias("up"), ends.alias("ends"))
    out = fresh.select(F.inline(_pieces(F.col("path"), F.col("lo"), F.col("up"), F.col("ends"))))
    if edges is not None:
        cuts = placed.where("edge is not null").groupBy(F.col("edge").alias("key")).agg(F.collect_set("at").alias("cuts"))
        old = edges.join(cuts, "key", "left")
        ends = F.array_sort(F.array_union(F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda x: (x > F.col("lo")) & (x < F.col("hi"))), F.array("hi")))
        out = out.unionByName(old.select(F.inline(_pieces(F.col("path"), F.col("lo"), F.col("up"), ends))))
    after = materialize(_with_handles(out), "trie-edges")
    discard(placed)
    return after


def build(seqs: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """The edges of all sequences, inserted in batches, each `growth` times as large as those before it together, chosen by hash."""
    share = F.pmod(F.xxhash64("key"), F.lit(growth ** (batches - 1)))
    edges = None
    for k in range(batches):
        low, high = (0 if k == 0 else growth ** (k - 1)), growth**k
        before, edges = edges, insert(edges, seqs.where((share >= low) & (share < high)))
        if before is not None:
            discard(before)
    return edges


def subtree_sums(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """key, up, kids, n, low, leaves, weight, below: for each edge's lower node and the root its children, and over its subtree the members, the least member, the childless nodes,
    the members' words, and the words of all nodes' last turns, its edge's included. `ends`: key, m (members that end there), low."""
    last = F.element_at("path", -1)
    kids = edges.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"))
    rows = edges.select("key", F.when(F.col("up") != F.lit(ROOT), F.col("up")).alias("up"), last["c"].alias("c"), (last["c"] - F.get("path", F.lit(0))["c"] + F.get("path", F.lit(0))["w"]).alias("below"))
    rows = rows.join(kids, "key", "left").join(ends, "key", "left")
    zero = F.lit(0).cast("long")
    t = rows.select("key", "up", F.coalesce("kids", zero).alias("kids"), F.coalesce("m", zero).alias("n"), "low", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), (F.coalesce("m", zero) * F.col("c")).alias("weight"), "below")
    t = materialize(t.withColumn("above", F.col("up")), "trie-sums")
    sums = {"n": F.sum, "low": F.min, "leaves": F.sum, "weight": F.sum, "below": F.sum}
    # Each row holds the sums over what is less than `reach` edges below it, and `above` is the node as many above it.
    while not t.where("above is not null").isEmpty():
        add = t.where("above is not null").groupBy("above").agg(*(f(k).alias(f"add_{k}") for k, f in sums.items())).withColumnRenamed("above", "key")
        more = {k: (F.least(k, f"add_{k}") if k == "low" else F.col(k) + F.coalesce(f"add_{k}", zero)) for k in sums}
        added = t.join(add, "key", "left").withColumns(more).drop(*(f"add_{k}" for k in sums))
        climb = added.where("above is not null").join(t.select(F.col("key").alias("above"), F.col("above").alias("next")), "above").drop("above").withColumnRenamed("next", "above")
        before, t = t, materialize(added.where("above is null").unionByName(climb), "trie-sums")
        discard(before)
    return t.drop("above")


def root_row(sums: DataFrame, ends: DataFrame) -> DataFrame:
    """The root's own row, from the edges below it and the members without turns; none if there is no member at all."""
    top = sums.where("up is null").select("n", "low", "leaves", "weight", "below", F.lit(1).cast("long").alias("kids"))
    zero = F.lit(0).cast("long")
    bare = ends.where(F.col("key") == F.lit(ROOT)).select(F.col("m").alias("n"), "low", zero.alias("leaves"), zero.alias("weight"), zero.alias("below"), zero.alias("kids"))
    total = top.unionByName(bare).agg(*(F.sum(k).alias(k) for k in ("n", "leaves", "weight", "below", "kids")), F.min("low").alias("low")).where("n is not null")
    return total.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("up"), "kids", "n", "low", F.greatest("leaves", F.lit(1).cast("long")).alias("leaves"), "weight", "below")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, joined by commas, as they come in order of key."""
    current, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == current:
                digest.update(b"," + text.encode())
            else:
                if current is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = key, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out])], ["key", "ends_sha256"])
    if current is not None:
        yield done()


def ends_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256 of the conversations (conv_id, key) that end at each node: their decimal ids, ascending and joined by commas. Ids are joined in pieces of near ids first, and no node's ids are held as one."""
    piece = F.floor(F.col("conv_id") / IDS_PER_PIECE)
    joined = members.groupBy("key", piece.alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return joined.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(_hash_pieces, "key binary, ends_sha256 string")


def expanded(edges: DataFrame, sums: DataFrame, root: DataFrame, digests: DataFrame) -> DataFrame:
    """A row for each node: the root and every depth of every edge."""
    none = F.lit(hashlib.sha256(b"").hexdigest())
    own = edges.select("key", "lo", "hi", F.col("up").alias("parent"), "path").join(sums, "key")
    top = own.where(F.col("parent") == F.lit(ROOT)).select("*", F.lit(None).cast("long").alias("up_low"))
    under = own.where(F.col("parent") != F.lit(ROOT)).join(sums.select(F.col("key").alias("parent"), F.col("low").alias("up_low")), "parent")
    all_edges = top.unionByName(under).join(digests, "key", "left")
    root_low = root.first()
    if root_low is None:  # no conversation at all
        return all_edges.limit(0).select(*_columns(F.lit(0), F.lit(None).cast("long"), F.col("kids"), F.lit(0).cast("long"), none))
    rows = all_edges.select("*", F.posexplode("path").alias("i", "x"))
    # Of the subtree's words what lies above this node: the edge's earlier turns, and all turns above it once a member.
    above = F.col("x.c") - F.col("x.w")
    start = F.get("path", F.lit(0))["c"] - F.get("path", F.lit(0))["w"]
    saved = (F.col("weight") - F.col("n") * above) - (F.col("below") - (above - start))
    at_end = F.col("lo") + F.col("i") + 1 == F.col("hi")
    parent = F.when(F.col("i") > 0, F.col("low")).otherwise(F.coalesce("up_low", F.lit(root_low["low"])))
    inner = rows.select(*_columns(F.col("lo") + F.col("i") + 1, parent, F.when(at_end, F.col("kids")).otherwise(1), saved, F.when(at_end, F.coalesce("ends_sha256", none)).otherwise(none)))
    tip = root.join(digests, "key", "left").select(*_columns(F.lit(0), F.lit(None).cast("long"), F.col("kids"), F.col("weight") - F.col("below"), F.coalesce("ends_sha256", none)))
    return inner.unionByName(tip)


def _columns(depth: Column, parent: Column, kids: Column, saved: Column, digest: Column) -> list[Column]:
    return [
        F.col("low").alias("conv_id"),
        depth.cast("long").alias("depth"),
        parent.cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        kids.cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        digest.alias("ends_sha256"),
    ]


def prefix_trie(conversations: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """The nodes of all rebuilt conversations with their counts.

    Turns go by turn (null first), equal ones by role, then by a hash of the text; repeated rows are turns of their own. Null role or text is empty, rows without conv_id are
    left out, and a conversation whose turns all go is a member of the root alone. Texts of any length are hashed whole (128 bits). Columns besides conv_id, turn, role
    and text aren't read. An empty table has no node.
    """
    members = materialize(prefixes(rebuilt(turns_of(conversations))), "trie-members")
    ends = materialize(members.groupBy("key").agg(F.count("*").alias("m"), F.min("conv_id").alias("low")), "trie-ends")
    seqs = ends.where(F.col("key") != F.lit(ROOT)).select("key", "low").join(members.select(F.col("conv_id").alias("low"), "path"), "low")
    edges = build(seqs, batches, growth)
    sums = subtree_sums(edges, ends)
    return expanded(edges, sums, root_row(sums, ends), ends_digests(members.select("conv_id", "key")))
