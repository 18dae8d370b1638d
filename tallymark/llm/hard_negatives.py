"""Hard negatives by anchor-clustered shared lists: the members of an anchor cluster walk one list of candidates, best bound first.

Anchors are clustered by angle. For a cluster with centre c and radius r (the largest angle of a member to c), no
member a has an inner product with candidate x beyond ``|a| |x| cos(max(0, angle(x, c) - r))``. So each cluster
sorts the candidates once by ``|x| cos(max(0, angle(x, c) - r))``, and every member walks that list until the bound
times its own length is below the least score that could still enter its result: then it has certainly ended.

The lists are cut into shards, so that no vector is held once per cluster: a task holds one shard of the candidates,
sorts it for one cluster at a time and lets the anchors, which come ordered by cluster, walk it in strides. What an
anchor must reach is known beforehand from the head of its cluster's list (``HEAD`` candidates in all, of every
shard together), so that most walks end early; the walk through the shards itself leaves nothing out. It is
done twice: for the positives (the best rows of the same label), then for the negatives of each positive (the best
rows of other labels within two shares of the positive's score).

Only the centres (at most ``CLUSTERS``, fitted on at most ``FITTED`` anchors, which are taken by the hash of their
id), the radii and the heads, bounded in values by ``HEAD_VALUES``, pass through the driver; every row is a
candidate whatever the centres are, so they change the time only. Scores are exact integers.

Cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; an
id that stands in several rows counts once, by its least label and then vector; vectors of different lengths are
compared as if the shorter one ended in zeros; a zero vector scores 0 with all; an anchor without positives or
positives without negatives give no rows; scores are 64-bit and those beyond wrap; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.vocabulary import send, write_shared
from tallymark.llm.words import map_partition

CLUSTERS, FITTED, ROUNDS = 64, 4096, 8
HEAD_VALUES, HEAD = 4_000_000, 1024
SHARD_VALUES = 8_000_000  #: components of a shard, about
STRIDE = 1024
SPARE = 1e-7  #: by which bounds are raised, as they are computed in floating point


@dataclass(frozen=True)
class Task:
    """What is mined: positives an anchor, negatives a positive, and the shares of its score between which a negative lies, in percent."""

    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90


# --- vectors inside tasks ------------------------------------------------------------------------------------


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A column of integer lists as rows of ``dim`` numbers, shorter ones ending in zeros."""
    lists = lists.cast(pa.list_(pa.int64()))
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


def cosines(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each vector with each (unit) centre; 1 for a zero vector, whose bound is zero anyway."""
    length = lengths(vectors)
    dots = vectors.astype(np.float64) @ centres.T / np.maximum(length, 1e-300)[:, None]
    return np.where(length[:, None] > 0, np.clip(dots, -1, 1), 1.0)


class Vectors:
    """Integer vectors whose inner products are taken exactly: in floating point where no sum can lose a digit."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.float = rows.astype(np.float64)
        self.length = lengths(rows)
        self.longest = float(self.length.max(initial=0.0))

    def scores(self, mine: np.ndarray, others: Vectors, theirs: np.ndarray) -> np.ndarray:
        if self.longest * others.longest < 2**52:
            return (self.float[mine] @ others.float[theirs].T).astype(np.int64)
        return self.rows[mine] @ others.rows[theirs].T


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each owner: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[nth < k]


@dataclass
class Wants:
    """What members of one cluster look for, one row per want (an anchor, or one of its positives)."""

    anchor: np.ndarray  #: its place among the members
    same: bool  #: rows of the same label, or of others
    least: np.ndarray  #: a row below this score is not wanted; rises during the walk
    most: np.ndarray
    k: int


def walk(members: Vectors, ids: np.ndarray, labels: np.ndarray, wants: Wants, shard: Vectors, shard_ids: np.ndarray, shard_labels: np.ndarray, bound: np.ndarray, order: np.ndarray):
    """The wanted rows of a shard as (want, place in the shard, score), found in the list's order until no want can gain."""
    want, place, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(order), STRIDE):
        reach = bound[order[at]] * (1 + SPARE) + SPARE
        open_ = np.flatnonzero(reach * members.length[wants.anchor] * (1 + SPARE) + SPARE >= wants.least)
        if not len(open_):
            break
        some = order[at : at + STRIDE]
        who, back = np.unique(wants.anchor[open_], return_inverse=True)
        scores = members.scores(who, shard, some)
        alike = labels[who][:, None] == shard_labels[some][None, :]
        good = alike if wants.same else ~alike
        good &= ids[who][:, None] != shard_ids[some][None, :]
        for low in range(0, len(open_), 4096):  # wants in blocks, as an anchor may have several
            part, b = open_[low : low + 4096], back[low : low + 4096]
            s = scores[b]
            w, p = np.nonzero(good[b] & (s >= wants.least[part][:, None]) & (s <= wants.most[part][:, None]))
            if len(w):
                want, place, score = np.append(want, part[w]), np.append(place, some[p]), np.append(score, s[w, p])
        if len(want):
            keep = best(want, score, shard_ids[place], wants.k)
            want, place, score = want[keep], place[keep], score[keep]
            raise_least(wants, want, score)
    return want, place, score


def raise_least(wants: Wants, want: np.ndarray, score: np.ndarray) -> None:
    """Wants that have ``k`` rows (in order, by want) take no row below the last of them."""
    count = np.bincount(want, minlength=len(wants.least))
    last = np.cumsum(count) - 1
    full = count == wants.k
    wants.least[full] = np.maximum(wants.least[full], score[last[full]])


# --- the steps -------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``id``, ``label``, ``vec`` (components times 256, rounded down) of the rows that take part, one per id."""
    x = F.col(vector)
    ill = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    rows = vectors.filter(F.col(key).isNotNull() & label.isNotNull() & x.isNotNull() & ~F.coalesce(ill, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vec"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("_row")).select("id", "_row.label", "_row.vec")


def fit(anchors: DataFrame, dim: int) -> np.ndarray:
    """Unit centres of the anchors' directions, by k-means on a bounded sample of them."""
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(FITTED).select("vec").toArrow()
    rows = matrix(sample.column("vec").combine_chunks(), dim).astype(np.float64)
    length = lengths(rows)
    rows = rows[length > 0] / length[length > 0][:, None]
    if not len(rows):
        return np.zeros((1, dim))
    k = int(np.clip(np.sqrt(len(rows)) / 2, 1, CLUSTERS))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = lengths(sums)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def clustered(anchors: DataFrame, centres, dim: int) -> DataFrame:
    """Anchors with their cluster and their angle to its centre."""

    def rows(batches):
        for batch in batches:
            cos = cosines(matrix(batch.column(2), dim), centres.value)
            own = cos.argmax(1)
            angle = np.arccos(cos[np.arange(len(own)), own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], ["id", "label", "vec", "cluster", "angle"])

    return map_partition(anchors.select("id", "label", "vec"), rows, "id long, label long, vec array<long>, cluster int, angle double")


def bounds(vectors: Vectors, cos: np.ndarray, radius: float) -> np.ndarray:
    """The list's key: what no member of the cluster, at unit length, can pass with each vector."""
    return vectors.length * np.cos(np.maximum(0.0, np.arccos(cos) - radius - SPARE))


def heads(rows: DataFrame, centres, radii, dim: int) -> dict[int, tuple]:
    """The first candidates of every cluster's list: (ids, labels, vectors) by cluster."""
    k = max(8, min(HEAD, HEAD_VALUES // max(1, dim * len(radii.value))))

    def first(batches):
        for batch in batches:
            vectors = Vectors(matrix(batch.column(2), dim))
            cos = cosines(vectors.rows, centres.value)
            for c, radius in radii.value.items():
                bound = bounds(vectors, cos[:, c], radius)
                top = np.argpartition(-bound, k)[:k] if len(bound) > k else np.arange(len(bound))
                part = batch.take(pa.array(top))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(top), c, np.int32)), pa.array(bound[top])], ["id", "label", "vec", "cluster", "bound"])

    own = map_partition(rows.select("id", "label", "vec"), first, "id long, label long, vec array<long>, cluster int, bound double")
    order = Window.partitionBy("cluster").orderBy(F.col("bound").desc(), "id")
    table = own.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("id", "label", "vec", "cluster").toArrow().combine_chunks()
    cluster = table.column("cluster").to_numpy()
    out = {}
    for c in np.unique(cluster).tolist():
        part = table.filter(pa.array(cluster == c)).combine_chunks()
        out[c] = (part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vec").combine_chunks(), dim))
    return out


ANCHOR = "id long, label long, vec array<long>, cluster int"


def by_cluster(batch: pa.RecordBatch):
    """The parts of a batch of anchors that are of one cluster each."""
    cluster = batch.column(batch.schema.get_field_index("cluster")).to_numpy()
    for c in np.unique(cluster).tolist():
        yield c, batch.filter(pa.array(cluster == c))


class Mining:
    """One run over one table; both walks share the shards and the clusters."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, task: Task):
        self.spark, self.task = rows.sparkSession, task
        self.rows = rows
        state = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.n, self.dim = state[0], max(1, state[1] or 1)
        slots = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # As many shards as keep one in memory, or as there are tasks to give work to, but none of a few rows.
        self.shards = max(-(-self.n * self.dim // SHARD_VALUES), min(slots, self.n // 2048), 1)
        self.centres = send(self.spark, fit(anchors, self.dim))
        self.anchors = write_shared(clustered(anchors, self.centres, self.dim), "anchors")
        found = self.anchors.groupBy("cluster").agg(F.max("angle")).collect()  # at most CLUSTERS rows
        self.radii = send(self.spark, dict((r[0], r[1]) for r in found))
        self.heads = send(self.spark, heads(rows, self.centres, self.radii, self.dim))

    def from_heads(self, wanted: DataFrame, make_wants, schema: str) -> DataFrame:
        """``wanted`` anchors with ``least``: a score that enough rows of the head reach for each of their wants."""
        held, dim = self.heads, self.dim

        def rows(batches):
            for batch in batches:
                for c, part in by_cluster(batch):
                    members, wants = make_wants(part, dim)
                    if c in held.value:
                        ids, labels, vectors = held.value[c]
                        shard = Vectors(vectors)
                        walk(Vectors(members), *own_columns(part), wants, shard, ids, labels, shard.length, np.argsort(-shard.length))
                    yield pa.RecordBatch.from_arrays([*part.columns, wants_column(wants, part)], [*part.schema.names, "least"])

        return map_partition(wanted, rows, f"{schema}, least array<long>")

    def through_shards(self, wanted: DataFrame, make_wants, schema: str, out: str, emit) -> DataFrame:
        """Every wanted anchor through every shard; ``emit`` makes rows of what a walk has found."""
        shards, dim, centres, radii = self.shards, self.dim, self.centres, self.radii
        names = [f.split()[0] for f in schema.replace(", ", ",").split(",")]
        own = self.rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_anchor"), "id", "label", "vec")
        sent = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_anchor"), *names)
        both = own.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "is_anchor", "cluster", "id")

        def rows(batches):
            at, parts, shard, lists = None, [], None, None
            for batch in batches:
                number, anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                    part = batch.slice(a, b - a)
                    if not len(part):
                        continue
                    if number[a] != at:
                        at, parts, shard, lists = number[a], [], None, None
                    if not anchor[a]:
                        parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4), dim)))
                        continue
                    if not parts and shard is None:
                        continue  # a shard without candidates
                    if shard is None:
                        ids, labels, vectors = (np.concatenate(x) for x in zip(*parts))
                        shard, parts = Vectors(vectors), []
                        cos = cosines(shard.rows, centres.value).astype(np.float64)
                        lists = (None, None, None)
                    for c, some in by_cluster(part.select(names)):
                        if lists[0] != c:
                            bound = bounds(shard, cos[:, c], radii.value[c])
                            lists = (c, bound, np.argsort(-bound, kind="stable"))
                        members, wants = make_wants(some, dim)
                        found = walk(Vectors(members), *own_columns(some), wants, shard, ids, labels, lists[1], lists[2])
                        yield emit(some, wants, ids, *found)

        return map_partition(both, rows, out)

    def positives(self) -> DataFrame:
        """anchor, nth (from 1), id and score of the best rows of its label."""
        k = self.task.positives

        def wants(part, dim):
            n = len(part)
            least = part.column(part.schema.get_field_index("least")).to_numpy() if "least" in part.schema.names else np.full(n, np.iinfo(np.int64).min)
            return matrix(part.column(2), dim), Wants(np.arange(n), True, least.copy(), np.full(n, np.iinfo(np.int64).max), k)

        def emit(part, _, ids, want, place, score):
            anchor = part.column(0).take(pa.array(want))
            return pa.RecordBatch.from_arrays([anchor, pa.array(ids[place]), pa.array(score)], ["anchor", "positive", "score"])

        known = self.from_heads(self.anchors.select("id", "label", "vec", "cluster"), wants, ANCHOR).withColumn("least", F.get("least", F.lit(0)))
        found = self.through_shards(known, wants, f"{ANCHOR}, least long", "anchor long, positive long, score long", emit)
        order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "positive")
        return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """anchor, positive, positive_score, negative, score of the best rows of other labels within the shares."""
        task = self.task

        def wants(part, dim):
            lists = part.column(4)
            each = np.diff(lists.offsets.to_numpy())
            score = lists.flatten().field("score").to_numpy()
            low, high = -(-task.least_percent * score // 100), task.most_percent * score // 100
            if "least" in part.schema.names:
                low = np.maximum(low, part.column(5).flatten().to_numpy())
            return matrix(part.column(2), dim), Wants(np.repeat(np.arange(len(part)), each), False, low.copy(), high, task.negatives)

        def emit(part, wanted, ids, want, place, score):
            positives_ = part.column(4).flatten().take(pa.array(want))
            anchor = part.column(0).take(pa.array(wanted.anchor[want]))
            return pa.RecordBatch.from_arrays(
                [anchor, positives_.field("positive"), positives_.field("score"), pa.array(ids[place]), pa.array(score)],
                ["anchor", "positive", "positive_score", "negative", "score"],
            )

        # No row lies between two shares of a score below zero.
        per = positives.filter("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "score"))).alias("positives"))
        joined = self.anchors.join(per.withColumnRenamed("anchor", "id"), "id").select("id", "label", "vec", "cluster", "positives")
        schema = f"{ANCHOR}, positives array<struct<positive:long;score:long>>"
        known = self.from_heads(joined, wants, schema.replace(";", ","))
        out = "anchor long, positive long, positive_score long, negative long, score long"
        found = self.through_shards(known, wants, f"{schema}, least array<long>", out, emit)
        order = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "negative")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= task.negatives)


def own_columns(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column(0).to_numpy(), part.column(1).to_numpy()


def wants_column(wants: Wants, part: pa.RecordBatch) -> pa.Array:
    """What each anchor's wants must reach, as one list an anchor."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(wants.anchor, minlength=len(part)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(wants.least))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    task: Task = Task(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors`` is a condition on ``id``."""
    rows = write_shared(usable(vectors, key, vector, F.col("label") if label is None else label), "vectors")
    mining = Mining(rows, rows.filter(anchors), task)
    positives = write_shared(mining.positives(), "positives")
    return mining.negatives(positives).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        F.col("positive_score"),
        F.col("score").alias("negative_score"),
    )
