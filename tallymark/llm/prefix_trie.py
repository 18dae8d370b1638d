"""The trie of conversation prefixes, by digests of fixed-length blocks of turns.

Each conversation is cut into blocks of ``BLOCK`` turns. The digest of a block combines those of its turns with their
places, and the digest of a prefix those of its blocks, so that equal prefixes and no others have equal digests (two
64-bit hashes of the 128-bit digests of role and text). Conversations are grouped by successive block digests first.
Where all conversations that share the blocks before go on with one and the same block, its turns are nodes as they
are. Only where siblings diverge are turn boundaries refined: there the distinct blocks, not the conversations, are
opened and grouped turn by turn.

Sums over subtrees need no walk down the tree. A node belongs to its least conversation, and a conversation owns the
nodes from some depth to its end. So for a node v with members M, least member m and ``before`` code points before
its last text, the (n_convs - 1) * code points of its subtree are: all code points of M from v on, less those of the
distinct nodes, which are the owned ones of M without m, and m's from v on. Both are sums over members, as is the
number of leaves (a leaf counts for its owner). A prefix as deep as a third of all rows takes no more rounds than a
short one: running values of a conversation are taken in two levels, within ``BUCKET`` turns and over such buckets.

Cases: rows with a null conversation take no part; a null turn stands first, turns of one number in the order of
their digests; a null role or text is empty; a conversation without turns is a member of the root alone, which has no
text; repeated rows are turns of their own; an empty table has no root; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.vocabulary import write_shared
from tallymark.llm.words import map_partition

BLOCK = 8  #: turns
BUCKET = 1024  #: turns, a multiple of BLOCK
IDS = 12  #: bits: so many conversation ids go into one string at a time
KEY = ["depth", "d1", "d2"]  #: of a node
NO_TURN = -(1 << 62)


def turns_of(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``p`` (0-based place), ``t`` (digest) and ``chars`` of every turn. Texts go no further than this scan."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, x).cast("binary"))).alias("t"),
        F.length(x).cast("long").alias("chars"),
    )
    rows = rows.withColumn("bucket", F.coalesce(F.shiftright("turn", BUCKET.bit_length() - 1), F.lit(NO_TURN)))
    counts = rows.groupBy("conv", "bucket").count()
    earlier = F.sum("count").over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("conv", "bucket", earlier.alias("earlier")).filter("earlier > 0")
    nth = F.row_number().over(Window.partitionBy("conv", "bucket").orderBy("turn", "t"))
    placed = rows.withColumn("nth", nth).join(earlier, ["conv", "bucket"], "left")
    return placed.select("conv", (F.col("nth") - 1 + F.coalesce("earlier", F.lit(0))).alias("p"), "t", "chars")


def rebuilt(turns: DataFrame, base: Column, kept: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's turns after its first ``kept``, behind the first ``kept`` (at most ``most``) turns of the conversation ``base``.

    Returns the turns and one row per conversation (conv).
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", base.alias("base"), kept.cast("long").alias("kept"))
    convs = write_shared(convs, "conversations")
    lead = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("of_base")), "base", "left")
    lead = lead.select("conv", "base", "kept", F.least("kept", F.coalesce("of_base", F.lit(0))).alias("lead"))
    first = turns.filter(F.col("p") < most).select(F.col("conv").alias("base"), "p", "t", "chars")
    taken = lead.join(first, "base").filter("p < kept").select("conv", "p", "t", "chars")
    own = turns.join(lead, "conv").filter("p >= kept").select("conv", (F.col("p") - F.col("kept") + F.col("lead")).alias("p"), "t", "chars")
    return taken.union(own), convs.select("conv")


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns, and what comes before it (digest x1, x2, code points ``before``)."""
    hashed = turns.select("conv", "p", "chars", F.xxhash64("t", "p").alias("h1"), F.xxhash64("p", "t", F.lit(7)).alias("h2"))
    own = hashed.groupBy("conv", F.expr(f"p div {BLOCK}").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("p", "h1", "h2", "chars"))).alias("turns"),  # at most BLOCK
        F.bit_xor("h1").alias("b1"),
        F.bit_xor("h2").alias("b2"),
        F.sum("chars").alias("chars"),
    )
    own = own.withColumn("bucket", F.expr(f"k div {BUCKET // BLOCK}"))

    def so_far(window) -> list[Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(f(c).over(frame), F.lit(0)).alias(a) for f, c, a in ((F.bit_xor, "b1", "x1"), (F.bit_xor, "b2", "x2"), (F.sum, "chars", "before"))]

    buckets = own.groupBy("conv", "bucket").agg(F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("chars").alias("chars"))
    earlier = buckets.select("conv", "bucket", *so_far(Window.partitionBy("conv").orderBy("bucket"))).toDF("conv", "bucket", "y1", "y2", "earlier")
    inside = own.select("*", *so_far(Window.partitionBy("conv", "bucket").orderBy("k")))
    both = inside.join(earlier.filter("bucket > 0"), ["conv", "bucket"], "left")

    def mixed(a: str, b: str) -> Column:
        return F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0)))

    both = both.withColumns({"x1": mixed("x1", "y1"), "x2": mixed("x2", "y2"), "before": F.col("before") + F.coalesce("earlier", F.lit(0))})
    return both.select("conv", "k", "turns", "x1", "x2", mixed("x1", "b1").alias("e1"), mixed("x2", "b2").alias("e2"), "before", "chars")


def opened(classes: DataFrame, values: list[str]) -> DataFrame:
    """A node for every turn of every block class: its key, its parent's digest (q1, q2), code points before and in its last text."""

    def node(i: Column) -> Column:
        def upto(h: str, x: str, n: Column) -> Column:
            return F.aggregate(F.slice("turns", F.lit(1), n), F.col(x), lambda a, t: a.bitwiseXOR(t[h]))

        last = F.get("turns", i)
        earlier = F.aggregate(F.slice("turns", F.lit(1), i), F.col("before"), lambda a, t: a + t["chars"])
        return F.struct(
            (last["p"] + 1).alias("depth"),
            upto("h1", "x1", i + 1).alias("d1"),
            upto("h2", "x2", i + 1).alias("d2"),
            upto("h1", "x1", i).alias("q1"),
            upto("h2", "x2", i).alias("q2"),
            earlier.alias("before"),
            last["chars"].alias("chars"),
        )

    return classes.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("turns") - 1), node)), *[F.col(v).alias(f"_{v}") for v in values])


def nodes_of(blocks: DataFrame, sums: list[str], values: list[str]) -> DataFrame:
    """The nodes below the root, with ``n`` members, ``least`` (of ``values``) and the totals of ``sums`` over members."""
    grouped = blocks.groupBy("k", "x1", "x2", "e1", "e2").agg(
        F.count("*").alias("n"),
        F.min(F.struct(*values)).alias("least"),
        F.first("turns").alias("turns"),
        F.first("before").alias("before"),
        *(F.sum(s).alias(s) for s in sums),
    )
    classes = write_shared(grouped, "classes")
    shared = classes.groupBy("k", "x1", "x2").agg((F.count("*") > 1).alias("diverge"))
    marked = classes.join(shared, ["k", "x1", "x2"])
    kept = ["n", "least", *sums]
    straight = opened(marked.filter("not diverge"), kept).withColumnsRenamed({f"_{v}": v for v in kept})
    refined = opened(marked.filter("diverge"), kept).groupBy(*KEY).agg(
        *(F.first(c).alias(c) for c in ("q1", "q2", "before", "chars")),
        F.sum("_n").alias("n"),
        F.min("_least").alias("least"),
        *(F.sum(f"_{s}").alias(s) for s in sums),
    )
    return straight.unionByName(refined)


def ends_of(ends: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node: strings of ids by id range, hashed one after the other as they come."""
    strings = ends.groupBy(*KEY, F.shiftright("conv", IDS).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")  # at most 2^IDS
    )

    def rows(batches):
        at, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if key != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield made(done)
        if at is not None:
            yield made([(*at, digest.hexdigest())])

    def made(done):
        columns = list(zip(*done)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    ordered = strings.select(*KEY, "range", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "range")
    return map_partition(ordered, rows, "depth long, d1 long, d2 long, ends_sha256 string")


def root_of(convs: DataFrame, sums: list[str], values: list[str]) -> DataFrame:
    none = [F.lit(0).cast("long").alias(c) for c in (*KEY, "q1", "q2", "before", "chars")]
    whole = convs.agg(F.count("*").alias("n"), F.min(F.struct(*values)).alias("least"), *(F.sum(s).alias(s) for s in sums)).filter("n > 0")
    return whole.select(*none, "n", "least", *sums)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (``turns``: conv, p, t, chars; ``convs``: conv, also those without turns)."""
    blocks = write_shared(blocks_of(turns), "blocks")
    last = blocks.groupBy("conv").agg(F.max(F.struct("k", F.size("turns").alias("size"), "e1", "e2")).alias("end"), F.sum("chars").alias("total"))
    convs = convs.join(last, "conv", "left").select(
        "conv",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.col("end.k") * BLOCK + F.col("end.size"), F.lit(0)).cast("long").alias("depth"),
        F.coalesce("end.e1", F.lit(0)).alias("d1"),
        F.coalesce("end.e2", F.lit(0)).alias("d2"),
    )
    convs = write_shared(convs, "ends")
    # Who owns which nodes, and who owns a leaf.
    first = write_shared(nodes_of(blocks, [], ["conv"]).unionByName(root_of(convs, [], ["conv"])), "nodes")
    parents = first.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2")).distinct()
    leaves = first.join(parents, KEY, "left_anti").select("least.conv").distinct().withColumn("leaf", F.lit(1))
    owned = first.groupBy("least.conv").agg(F.min(F.struct("depth", "before")).alias("start")).select("conv", F.col("start.before").alias("start"))
    valued = convs.join(owned, "conv", "left").join(leaves, "conv", "left").withColumns(
        {"own": F.coalesce(F.col("total") - F.col("start"), F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0)).cast("long")}
    )
    valued = write_shared(valued.select("conv", "total", "own", "leaf"), "valued")

    values, sums = ["conv", "own", "total"], ["total", "own", "leaf"]
    nodes = write_shared(nodes_of(blocks.drop("chars").join(valued, "conv"), sums, values).unionByName(root_of(valued, sums, values)), "nodes")
    # A node, its children and its ends meet under its key.
    row = F.struct("q1", "q2", "before", "n", "least", *sums)
    own = nodes.select(*KEY, row.alias("row"), F.lit(0).cast("long").alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
    empty = own.schema["row"].dataType
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("d1"), F.col("q2").alias("d2")).agg(F.count("*").alias("child"))
    children = children.select(*KEY, F.lit(None).cast(empty).alias("row"), "child", F.lit(None).cast("string").alias("ends_sha256"))
    ends = ends_of(convs).select(*KEY, F.lit(None).cast(empty).alias("row"), F.lit(0).cast("long").alias("child"), "ends_sha256")
    met = own.union(children).union(ends).groupBy(*KEY).agg(
        F.first("row", ignorenulls=True).alias("row"), F.sum("child").alias("n_children"), F.first("ends_sha256", ignorenulls=True).alias("ends_sha256")
    )
    met = met.select(*KEY, "row.*", "n_children", "ends_sha256")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("least.conv").alias("parent_conv_id"))
    found = met.join(above, ["depth", "q1", "q2"], "left")
    distinct = F.col("own") - F.col("least.own") + F.col("least.total") - F.col("before")
    return found.select(
        F.col("least.conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaf").alias("n_leaves"),
        (F.col("total") - F.col("n") * F.col("before") - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame,
    base: Column | None = None,
    kept: Column | None = None,
    most: int = 0,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``base`` and ``kept`` (of ``conv``) rebuild each conversation behind the first ``kept`` turns, at most ``most``, of another.
    """
    turns = write_shared(turns_of(conversations, conv, turn, role, text), "turns")
    if base is None:
        return trie(turns, turns.select("conv").distinct())
    whole, convs = rebuilt(turns, base, kept, most)
    return trie(write_shared(whole, "rebuilt"), convs)
