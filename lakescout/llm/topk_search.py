"""Exact top-k search by inner product over two cover trees.

Queries and data are both indexed. The first level of either tree is the same few pivots, taken from a bounded sample
by farthest-first traversal: a row belongs to its nearest pivot, and the rows of a pivot, in blocks of a bounded size,
are subtrees that Spark deals out. Within a block a cover tree goes on: the centres of a node's children are points
that farthest-first traversal finds, so they are at least as far apart as the radius within which they cover the
node's points. For a query node with centre p and radius r, and a data node with centre c and radius s, no inner
product exceeds

    p.c + |p| s + |c| r + r s

so a pair of nodes whose bound is below the worst kth score of the node's queries is left out with all its points.
Each query block is first searched in the data block that promises most. That gives kth scores to begin with, and
only the data blocks whose bounds reach them are sent to the query block in a second pass. A query leaf meets
data leaves with the largest bounds first, a matrix of scores at a time.

Data without clusters in many dimensions can't be pruned by any radius; every block then meets every query block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.llm.common import arrow_schema, durable, map_batches, rows_to_batch, slices

TOP = 20
SCALE = 64
BLOCK = 8_192
QUERY_BLOCK = 4_096
LEAF, QUERY_LEAF = 128, 16
#: Points that a group of queries meets at first, and at once later on, best bounds first.
FIRST_POINTS, POINTS = 256, 2_048
#: Children of a node, and pivots of the first level with the rows that those are chosen from, at most.
CHILDREN, PIVOTS, SAMPLE = 32, 1_024, 16_384
#: Bytes of block summaries that tasks are given at once.
SUMMARY_BYTES = 32 << 20


def farthest_first(points: np.ndarray, start: int, most: int, reach: float = 0.0, far: np.ndarray | None = None):
    """(centres, owners, distances): points that are each the farthest from all before, until they cover all within
    ``reach`` or are ``most``. No two are nearer to each other than the largest distance that is left."""
    centres = [start]
    near = distances(points, points[start]) if far is None else far.copy()
    owner = np.zeros(len(points), int)
    while len(centres) < most and near.max(initial=0.0) > reach:
        centres.append(int(near.argmax()))
        now = distances(points, points[centres[-1]])
        closer = now < near
        near[closer], owner[closer] = now[closer], len(centres) - 1
    return centres, owner, near


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class CoverTree:
    """A cover tree whose levels have the radii that the data gives: a node's points lie within its radius of its
    centre, which is one of them, and the centres of its children are at least as far apart as the radius that covers
    its points from them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            everything = np.arange(len(points))
            self.root = self._node(0, everything, distances(points, points[0]))

    def _node(self, centre: int, members: np.ndarray, far: np.ndarray) -> int:
        number, radius = len(self.centre), float(far.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.members.append(members)
        self.children.append([])
        if len(members) > self.leaf and radius > 0:
            centres, owner, near = farthest_first(self.points[members], int(np.flatnonzero(members == centre)[0]), CHILDREN, radius / 2, far)
            self.members[number] = members[:0]
            for i, c in enumerate(centres):
                own = owner == i
                if own.any():
                    self.children[number].append(self._node(int(members[c]), members[own], near[own]))
        return number


def search(queries: np.ndarray, data: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, scored: list | None = None):
    """For each query the (score, id) of its k best data vectors other than those of its own id, ties to smaller ids.

    Scores under a query's ``least`` need not be found. ``scored`` gets the number of pairs of each product made.

    Vectors hold integers; own are the ids of queries, ids those of data. Products that may exceed what doubles hold
    exactly are summed in extended precision."""
    largest = max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0))
    kind = np.float64 if largest * largest * max(1, data.shape[1]) < 2.0**53 else np.longdouble
    best_score = np.full((len(queries), k), -np.inf, kind)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    least = np.full(len(queries), -np.inf) if least is None else least
    if not len(queries) or not len(data):
        return best_score, best_id
    q_tree, d_tree = CoverTree(queries, QUERY_LEAF), CoverTree(data)
    q_norm = np.sqrt((queries * queries).sum(1))
    centres, radii = data[d_tree.centre], np.array(d_tree.radius)
    norms, sizes = np.sqrt((centres * centres).sum(1)), np.array([len(m) for m in d_tree.members])
    branch = sizes == 0
    slack = 1e-9 * (1 + q_norm.max() * np.sqrt((data * data).sum(1)).max())

    def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
        p, r = q_tree.centre[a], q_tree.radius[a]
        return centres[nodes] @ queries[p] + q_norm[p] * radii[nodes] + norms[nodes] * r + r * radii[nodes] + slack

    def worst(a: int) -> float:
        """The least kth score of a node's queries."""
        if q_tree.children[a]:
            return min(worst(x) for x in q_tree.children[a])
        members = q_tree.members[a]
        return float(np.maximum(best_score[members, -1], least[members]).min())

    def opened(nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The nodes, of which these branches are replaced by their children."""
        return np.concatenate([nodes[~which], *(np.array(d_tree.children[n]) for n in nodes[which])]).astype(int)

    def score(rows: np.ndarray, nodes: np.ndarray) -> None:
        cols = np.concatenate([d_tree.members[n] for n in nodes])
        if scored is not None:
            scored.append(len(rows) * len(cols))
        scores = queries[rows].astype(kind, copy=False) @ data[cols].astype(kind, copy=False).T
        scores[own[rows][:, None] == ids[cols][None, :]] = -np.inf
        better = (scores >= best_score[rows, -1:]).any(1)
        rows, scores = rows[better], scores[better]
        merged = np.concatenate((best_score[rows], scores), axis=1)
        names = np.concatenate((best_id[rows], np.broadcast_to(ids[cols], scores.shape)), axis=1)
        names = np.where(np.isneginf(merged), np.iinfo(np.int64).max, names)
        # Of a query's scores, only those that reach its kth can matter: the k largest and their ties.
        if k < merged.shape[1]:
            row, col = np.nonzero(merged >= np.partition(merged, -k, axis=1)[:, -k][:, None])
        else:
            row, col = np.nonzero(np.ones(merged.shape, bool))
        found, name = merged[row, col], names[row, col]
        order = np.lexsort((name, -found, row))
        row, found, name = row[order], found[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, found, name, rank = row[rank < k], found[rank < k], name[rank < k], rank[rank < k]
        best_score[rows[row], rank], best_id[rows[row], rank] = found, name

    def visit(a: int, nodes: np.ndarray) -> None:
        """Search a query node in data nodes that hold all points which may matter to it."""
        nodes = nodes[bounds(a, nodes) >= worst(a)]
        if q_tree.children[a]:
            nodes = opened(nodes, branch[nodes] & (radii[nodes] >= q_tree.radius[a]))
            for child in q_tree.children[a]:
                visit(child, nodes)
            return
        while branch[nodes].any():
            nodes = opened(nodes, branch[nodes])
            nodes = nodes[bounds(a, nodes) >= worst(a)]
        limits = bounds(a, nodes)
        order = np.argsort(-limits, kind="stable")
        nodes, limits = nodes[order], limits[order]
        rows = q_tree.members[a]
        own_limits = queries[rows] @ centres[nodes].T + q_norm[rows, None] * radii[nodes] + slack
        ends, at, most = np.cumsum(sizes[nodes]), 0, FIRST_POINTS
        while at < len(nodes) and limits[at] >= (now := worst(a)):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            stop = at + max(1, int((limits[at:stop] >= now).sum()))
            # Of both leaves, the queries and the data nodes that a query's own bound leaves open.
            reach = own_limits[:, at:stop] >= np.maximum(best_score[rows, -1], least[rows])[:, None]
            if reach.any():
                score(rows[reach.any(1)], nodes[at:stop][reach.any(0)])
            at, most = stop, min(2 * most, POINTS)

    visit(q_tree.root, np.array([d_tree.root]))
    return best_score, best_id


def vectors(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, embedding) of the rows that take part; uid numbers rows, repeated ones too."""
    good = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double)) and vec_id is not null")
    taking = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    return durable(taking.withColumn("uid", F.monotonically_increasing_id()))


def as_integers(embeddings: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors; shorter ones end in zeros. A product beyond what a double holds stays finite."""
    out = np.zeros((len(embeddings), width))
    with np.errstate(over="ignore"):
        for i, row in enumerate(embeddings):
            out[i, : len(row)] = np.floor(scale * np.asarray(row, np.float64))
    return np.clip(out, -np.finfo(float).max, np.finfo(float).max, out=out)


def choose_pivots(taking: DataFrame, rows: int, width: int, scale: int, block: int) -> np.ndarray:
    """Centres of the first level: as many as there will be blocks, up to PIVOTS, from at most SAMPLE rows."""
    wanted = min(PIVOTS, 1 + rows // block)
    sample = taking.orderBy(F.xxhash64("embedding"), "uid").limit(min(SAMPLE, 16 * wanted)).select("embedding").collect()
    points = as_integers([r[0] for r in sample], width, scale)
    if not len(points):
        return np.zeros((1, width))
    return points[farthest_first(points, 0, wanted)[0]]


def dealt(taking: DataFrame, pivots: np.ndarray, width: int, scale: int, most: int) -> DataFrame:
    """(block, uids, vec_ids, vectors, centre, radius, norm): blocks of about ``most`` rows of one pivot at most; the
    vectors are floor(scale * x), the centre is the pivot and covers the block within the radius."""
    ddl = "uid long, vec_id long, pivot int, vector binary"
    schema = arrow_schema(ddl)

    def place(batches):
        for _, uids, ids, found in slices(batches, "uid", "vec_id", "embedding", rows=2048):
            x = as_integers(found, width, scale)
            # Which pivot is only a matter of speed; the radius is that of the exact distances.
            near = ((pivots * pivots).sum(1) - 2 * x @ pivots.T).argmin(1) if len(x) else np.zeros(0, int)
            yield rows_to_batch(schema, [uids, ids, near.astype(np.int32), [row.tobytes() for row in x]])

    placed = durable(map_batches(taking, place, ddl))
    # A row for each pivot, PIVOTS at most: how many blocks its rows are dealt out to.
    parts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows")).select("pivot", F.ceil(F.col("rows") / most).cast("long").alias("parts"))
    block = F.col("pivot").cast("long") * (1 << 40) + F.pmod(F.xxhash64("uid"), F.col("parts"))
    gathered = placed.join(F.broadcast(parts), "pivot").groupBy(block.alias("block"), "pivot").agg(F.collect_list(F.struct("uid", "vec_id", "vector")).alias("rows"))
    out_ddl = "block long, uids binary, vec_ids binary, vectors binary, centre binary, radius double, norm double"
    out_schema = arrow_schema(out_ddl)

    def pack(batches):
        for _, blocks, places, all_rows in slices(batches, "block", "pivot", "rows", rows=1):
            for number, pivot, rows in zip(blocks, places, all_rows, strict=True):
                rows.sort(key=lambda r: r["uid"])
                x = np.frombuffer(b"".join(r["vector"] for r in rows), np.float64).reshape(-1, width)
                ids = [np.array([r[c] for r in rows], np.int64).tobytes() for c in ("uid", "vec_id")]
                radius, norm = float(distances(x, pivots[pivot]).max()), float(np.sqrt((x * x).sum(1)).max())
                yield rows_to_batch(out_schema, [[number], [ids[0]], [ids[1]], [x.tobytes()], [pivots[pivot].tobytes()], [radius], [norm]])

    return durable(map_batches(gathered, pack, out_ddl))


def promising(asked: DataFrame, summary: list, width: int, first: bool) -> DataFrame:
    """(part, block): the data block of each query block whose bound is the largest or, otherwise, all other data
    blocks whose bounds reach the kth score of some query; ``asked`` then has the kth scores as ``least``."""
    ddl = "part long, block long, bound double"
    schema = arrow_schema(ddl)
    numbers, radii = np.array([r[0] for r in summary], np.int64), np.array([r[2] for r in summary])
    centres = np.frombuffer(b"".join(bytes(r[1]) for r in summary), np.float64).reshape(-1, width)

    def run(batches):
        for _, parts, vectors, centre, radius, least, had in slices(batches, "block", "vectors", "centre", "radius", "least", "had", rows=1):
            for number, raw, p, r, kth, before in zip(parts, vectors, centre, radius, least, had, strict=True):
                p, norms = np.frombuffer(p, np.float64), np.sqrt((centres * centres).sum(1))
                bounds = (centres @ p + np.sqrt(p @ p) * radii + norms * r + r * radii) * (1 + 1e-9) + 1e-6
                if first:
                    at = [int(np.argmax(centres @ p - np.sqrt(p @ p) * radii * 1e-3))] if len(numbers) else []
                else:
                    # Of the pairs of blocks whose bound reaches the worst kth score, those where a query's own does.
                    x, kth = np.frombuffer(raw, np.float64).reshape(-1, width), np.frombuffer(kth, np.float64)
                    at = np.flatnonzero((bounds >= kth.min()) & (numbers != before))
                    for a in range(0, len(x), 1024):
                        some = x[a : a + 1024]
                        reach = some @ centres[at].T + np.sqrt((some * some).sum(1))[:, None] * radii[at]
                        own = (reach * (1 + 1e-9) + 1e-6 >= kth[a : a + 1024, None]).any(0)
                        bounds[at[own]] = np.inf
                    at = at[np.isinf(bounds[at])]
                yield rows_to_batch(schema, [[number] * len(at), numbers[at], bounds[at]])

    return map_batches(asked.select("block", "vectors", "centre", "radius", "least", "had"), run, ddl)


def searched(pairs: DataFrame, asked: DataFrame, data: DataFrame, width: int, k: int) -> DataFrame:
    """(uid, query_id, vec_id, score, part, at): the k best of every query of each pair of blocks."""
    left = asked.select(F.col("block").alias("part"), F.col("uids").alias("own_uids"), F.col("vec_ids").alias("own_ids"), F.col("vectors").alias("queries"), "least")
    both = pairs.select("part", "block").join(left, "part").join(data.select("block", "vec_ids", "vectors"), "block")
    ddl = "uid long, query_id long, vec_id long, score long, part long, at int, exact double"
    schema = arrow_schema(ddl)

    def run(batches):
        limits = np.iinfo(np.int64)
        for _, parts, uids, own, queries, least, ids, vectors in slices(batches, "part", "own_uids", "own_ids", "queries", "least", "vec_ids", "vectors", rows=1):
            for part, uid, mine, wanted, kth, other, some in zip(parts, uids, own, queries, least, ids, vectors, strict=True):
                uid, mine, other = (np.frombuffer(x, np.int64) for x in (uid, mine, other))
                wanted, some = (np.frombuffer(x, np.float64).reshape(-1, width) for x in (wanted, some))
                score, name = search(wanted, some, mine, other, k, None if kth is None else np.frombuffer(kth, np.float64))
                i, j = np.nonzero(~np.isneginf(score))
                found = score[i, j]
                whole = np.where(found >= 2.0**63, limits.max, np.where(found < -(2.0**63), limits.min, np.where(np.abs(found) < 2.0**63, found, 0).astype(np.int64)))
                yield rows_to_batch(schema, [uid[i], mine[i], name[i, j], whole, np.full(len(i), part), i.astype(np.int32), found.astype(np.float64)])

    return map_batches(both.select("part", "own_uids", "own_ids", "queries", "least", "vec_ids", "vectors"), run, ddl)


def top_k(embeddings: DataFrame, k: int = TOP, every: int = 20, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query with the other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Null vectors, those with null or non-finite
    components and null vec_ids take no part; an empty vector has the product 0 with all. A row that repeats a
    vec_id is a candidate and a query of its own, but never a candidate for its id's queries. Scores beyond a long
    become its limits. Vectors of several lengths count as ending in zeros.
    """
    taking = vectors(embeddings)
    rows, width = taking.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    width = max(1, width or 0)
    pivots = choose_pivots(taking, rows, width, scale, block)
    data = dealt(taking, pivots, width, scale, block)
    asked = dealt(taking.where(F.col("vec_id") % every == 0), pivots, width, scale, query_block)
    # A row of one vector for each block of thousands; many of them go to the tasks a share at a time.
    blocks = data.select("block", "centre", "radius").orderBy("block").collect()
    share = max(1, SUMMARY_BYTES // (8 * width + 16))
    shares = [blocks[at : at + share] for at in range(0, len(blocks), share)] or [[]]
    begun = asked.withColumn("least", F.lit(None).cast("binary")).withColumn("had", F.lit(None).cast("long"))
    tried = reduce(DataFrame.union, [promising(begun, some, width, True) for some in shares])
    best_first = durable(tried.groupBy("part").agg(F.max(F.struct("bound", "block")).getField("block").alias("block")))
    found = durable(searched(best_first, begun, data, width, k))
    # The kth scores by the position of queries in their blocks; a query with fewer results has none.
    kth = found.groupBy("part", "at").agg(F.count(F.lit(1)).alias("n"), F.min("exact").alias("least")).where(F.col("n") >= k)
    scores = kth.groupBy("part").agg(F.collect_list(F.struct("at", "least")).alias("known"))
    schema = arrow_schema("block long, least binary, had long")

    def in_order(batches):
        for _, parts, uids, known, had in slices(batches, "block", "uids", "known", "had", rows=1):
            for part, uid, pairs, before in zip(parts, uids, known, had, strict=True):
                least = np.full(len(uid) // 8, -np.inf)
                for pair in pairs or []:
                    least[pair["at"]] = pair["least"]
                yield rows_to_batch(schema, [[part], [least.tobytes()], [before]])

    met = asked.select("block", "uids").join(best_first.select(F.col("part").alias("block"), F.col("block").alias("had")), "block").join(scores.withColumnRenamed("part", "block"), "block", "left")
    worst = durable(map_batches(met.select("block", "uids", "known", "had"), in_order, "block long, least binary, had long"))
    known = asked.join(worst, "block")
    rest = reduce(DataFrame.union, [promising(known, some, width, False) for some in shares])
    found = found.union(searched(rest, known, data, width, k)).select("uid", "query_id", "vec_id", "score")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
