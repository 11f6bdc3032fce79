"""Approximate nearest neighbours over a graph built by NN-descent.

Vectors are scaled to length 1, and equal directions are one point. A point's first neighbours come from blocks of
points that lie close along random projections. Then rounds of Spark joins improve them until few change: every point introduces its
neighbours, and those that it is a neighbour of, to each other, and each keeps the nearest it has met. Pairs of
which both were introduced before are not looked at again. The graph holds every point, so nothing is sampled but
how many neighbours a point introduces in a round.

Rounds compare codes of one byte a component, which order points almost as their vectors do.

A query enters the graph at its own point and walks greedily: in each step it opens the best
points of its beam that it hasn't opened, meets their neighbours, and keeps the nearest, until it has opened all. At the end the whole beam is
scored anew: scores are cosines of the original vectors in double precision.

Points are numbered, and a bundle is the points of a range of numbers with their codes and lists. Bundles exchange
messages, packed records for all points of another bundle, so that Spark shuffles a row for two bundles and not one
for each edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.llm.common import durable, map_batches, ship

TOP = 5
NEIGHBOURS = 40
#: Neighbours, and points it is a neighbour of, that a point introduces to each other in a round, and how many of
#: the others each of them keeps in mind.
INTRODUCED, MET = 20, 12
#: Rounds go on until no larger share of all list entries is new.
SETTLED = 0.01
PROJECTIONS, BLOCK_POINTS = 6, 4_096
BEAM, OPENED = 256, 64

#: A bundle holds 2 ** so many points.
BUNDLE_BITS = 12
#: Hosts, or rows of a block, that are compared at once.
HOSTS_AT_ONCE, ROWS_AT_ONCE = 128, 512

#: What a row of data holds for the bundle that it is sent to; ``fresh`` and ``entries`` count list entries of a
#: bundle's points, or points that its queries have yet to open.
MESSAGES = "to long, kind int, data binary, fresh long, entries long"
BUNDLE, EDGE, ASK, GUEST, MEETING, WANTED, QUERY, CODE, OPEN, TRY = range(10)
PAIR = np.dtype([("at", "i8"), ("other", "i8")])
EDGES = np.dtype([("at", "i8"), ("other", "i8"), ("new", "?")])
MEETINGS = np.dtype([("at", "i8"), ("other", "i8"), ("s", "f4")])


def points_type(width: int) -> np.dtype:
    """A point of a bundle: its number, code and list, nearest first; -1 ends a list."""
    return np.dtype([("p", "i8"), ("code", "i1", (width,)), ("q", "i8", (NEIGHBOURS,)), ("s", "f4", (NEIGHBOURS,)), ("new", "?", (NEIGHBOURS,))])


def guests_type(width: int) -> np.dtype:
    return np.dtype([("at", "i8"), ("other", "i8"), ("new", "?"), ("worst", "f4"), ("code", "i1", (width,))])


def queries_type(width: int) -> np.dtype:
    return np.dtype([("p", "i8"), ("code", "i1", (width,)), ("beam", "i8", (BEAM,)), ("s", "f4", (BEAM,)), ("opened", "?", (BEAM,))])


def codes_type(width: int) -> np.dtype:
    return np.dtype([("bundle", "i8"), ("p", "i8"), ("worst", "f4"), ("code", "i1", (width,))])


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose vector isn't null, zero or holding null or non-finite components."""
    good = F.expr("vec_id is not null and embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)


def stacked(values: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows; shorter ones end in zeros."""
    flat, offsets = np.asarray(values.flatten(), np.float64), np.asarray(values.offsets) - values.offsets[0].as_py()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)] = flat
    return out


def unit(codes: np.ndarray) -> np.ndarray:
    """Codes as unit rows."""
    codes = codes.astype(np.float32)
    return codes / np.sqrt((codes * codes).sum(-1, keepdims=True))


def packed(kind: int, records: np.ndarray, bundles: np.ndarray):
    """Messages (to, kind, data, fresh, entries) that hold the records for each bundle."""
    order = np.argsort(bundles, kind="stable")
    records, bundles = records[order], bundles[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(bundles)), bool), bundles[1:] != bundles[:-1])))
    for a, b in zip(first.tolist(), np.append(first, len(bundles))[1:].tolist(), strict=True):
        yield int(bundles[a]), kind, records[a:b].tobytes(), 0, 0


def records_of(dtype: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(columns["at"]), dtype)
    for name, values in columns.items():
        out[name] = values
    return out


def rank_in(groups: np.ndarray) -> np.ndarray:
    """The place of each entry in its group, where equal groups are next to each other."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(groups)), bool), groups[1:] != groups[:-1])))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def nearest_lists(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, mark: np.ndarray, rows: int, k: int):
    """Tables (rows, k) of the nearest distinct others of each owner (a row), nearest first, with sims and marks. -1
    ends a row. Of a repeated other one is taken, a marked one if there is any."""
    # One key of 64 bits sorts in a fraction of the time of several keys.
    pair = owner << 48 | other << 1 | ~mark
    order = np.argsort(pair)
    pair = pair[order] >> 1
    order = order[np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]))]
    owner, other, sim, mark = owner[order], other[order], sim[order], mark[order]
    order = np.argsort(owner << 31 | ((2 - sim.astype(np.float64)) * (1 << 28)).astype(np.int64))
    owner, other, sim, mark = owner[order], other[order], sim[order], mark[order]
    rank = rank_in(owner)
    kept = rank < k
    at = owner[kept], rank[kept]
    q, s, m = np.full((rows, k), -1, np.int64), np.full((rows, k), -2, np.float32), np.zeros((rows, k), bool)
    q[at], s[at], m[at] = other[kept], sim[kept], mark[kept]
    return q, s, m


def parts_of(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(messages: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()
    columns = list(zip(*messages, strict=True)) if messages else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["to", "kind", "data", "fresh", "entries"])


def exchanged(answer, tasks: int, *messages: DataFrame) -> DataFrame:
    """``answer`` (bundle, its data by kind) gives new messages; a bundle is called once, with all sent to it. There are
    no more tasks than bundles, however many shuffle partitions there are."""
    sent = messages[0].select("to", "kind", "data")
    for more in messages[1:]:
        sent = sent.union(more.select("to", "kind", "data"))
    gathered = sent.groupBy("to").agg(F.collect_list("kind").alias("kind"), F.collect_list("data").alias("data"))

    def run(batches):
        for part in parts_of(batches, 1):
            by_kind = {}
            for kind, data in zip(part.column(1).flatten().to_pylist(), part.column(2).flatten().to_pylist(), strict=True):
                by_kind.setdefault(kind, []).append(data)
            yield batch_of(list(answer(part.column(0)[0].as_py(), {k: b"".join(d) for k, d in by_kind.items()})))

    return map_batches(gathered.coalesce(tasks), run, MESSAGES)


def each_bundle(bundles: DataFrame, answer) -> DataFrame:
    """``answer`` (bundle, data) gives messages, for every row by itself."""

    def run(batches):
        for part in parts_of(batches, 1):
            yield batch_of(list(answer(part.column(0)[0].as_py(), part.column(1)[0].as_py())))

    return map_batches(bundles.select("to", "data"), run, MESSAGES)


def bundled(points: DataFrame, width: int, tasks: int) -> DataFrame:
    """The bundles of (p, code), with empty lists."""
    gathered = points.groupBy(F.shiftright("p", BUNDLE_BITS).alias("to")).agg(F.collect_list("p").alias("p"), F.collect_list("code").alias("code"))
    kind = points_type(width)

    def run(batches):
        for part in parts_of(batches, 1):
            ids = np.asarray(part.column(1).flatten())
            out = np.zeros(len(ids), kind)
            out["p"], out["q"], out["s"] = ids, -1, -2
            out["code"] = np.frombuffer(b"".join(part.column(2).flatten().to_pylist()), np.int8).reshape(-1, width)
            yield batch_of([(part.column(0)[0].as_py(), BUNDLE, out[np.argsort(ids)].tobytes(), 0, 0)])

    return map_batches(gathered.coalesce(tasks), run, MESSAGES)


def merged(bundles: DataFrame, meetings: DataFrame, width: int, tasks: int) -> DataFrame:
    """The bundles with the nearest of what their points had and met; what they had is no longer new."""
    kind, mask = points_type(width), (1 << BUNDLE_BITS) - 1

    def answer(bundle, data):
        own, met = np.frombuffer(data[BUNDLE], kind).copy(), np.frombuffer(data.get(MEETING, b""), MEETINGS)
        row, place = np.nonzero(own["q"] >= 0)
        owner = np.concatenate((row, met["at"] & mask))
        other, sim = np.concatenate((own["q"][row, place], met["other"])), np.concatenate((own["s"][row, place], met["s"]))
        q, s, had = nearest_lists(owner, other, sim, np.arange(len(owner)) < len(row), len(own), NEIGHBOURS)
        own["q"], own["s"], own["new"] = q, s, (q >= 0) & ~had
        yield bundle, BUNDLE, own.tobytes(), int(own["new"].sum()), int((q >= 0).sum())

    return exchanged(answer, tasks, bundles, meetings)


def top_of(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at least the k greatest of each row."""
    rows, n = sims.shape
    groups = 128
    if n < 8 * groups or k > groups // 2:
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.repeat(np.arange(rows), k), near.ravel()
    # k groups of columns have a maximum that is no less than the kth greatest maximum.
    greatest = sims[:, : n // groups * groups].reshape(rows, -1, groups).max(1)
    least = np.partition(greatest, groups - k, axis=1)[:, groups - k]
    return np.divmod(np.flatnonzero(sims >= least[:, None]), n)


def first_neighbours(points: DataFrame, width: int, parts: int) -> DataFrame:
    """Meetings in blocks of points that are next to each other along random projections.

    All projections are sorted in one job. A worker numbers its points of each projection; a small table of
    (projection, worker) counts tells where its numbers start, so blocks don't depend on how the sort was dealt out.
    """
    ddl = "projection int, p long, code binary, worker int, number long"
    schema = pa.schema([("projection", pa.int32()), ("p", pa.int64()), ("code", pa.binary()), ("worker", pa.int32()), ("number", pa.int64())])

    def number(batches):
        worker, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            projections = np.asarray(batch.column(0))
            numbers = np.empty(len(projections), np.int64)
            for x in np.unique(projections).tolist():
                at = np.flatnonzero(projections == x)
                numbers[at] = seen.get(x, 0) + np.arange(len(at))
                seen[x] = seen.get(x, 0) + len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(projections), worker, np.int32)), pa.array(numbers)], schema=schema)

    directions = np.random.default_rng(100).standard_normal((PROJECTIONS, width))
    along = [F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, d.tolist())), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) for d in directions]
    rows = points.select("p", "code", F.posexplode(F.array(*along)).alias("projection", "along"))
    ordered = rows.repartitionByRange(parts, "projection", "along").sortWithinPartitions("projection", "along", "p")
    numbered = durable(map_batches(ordered.select("projection", "p", "code"), number, ddl))
    counts = numbered.groupBy("projection", "worker").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("projection")
    # Workers hold ranges of the sort in the order of their numbers.
    starts = counts.select("projection", "worker", (F.sum("n").over(each.orderBy("worker")) - F.col("n")).alias("first"), F.sum("n").over(each).alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_POINTS)
    placed = numbered.join(F.broadcast(starts), ["projection", "worker"]).select("projection", F.floor((F.col("first") + F.col("number")) * blocks / F.col("total")).alias("block"), "p", "code")
    gathered = placed.groupBy("projection", "block").agg(F.collect_list("p").alias("p"), F.collect_list("code").alias("code"))

    def run(batches):
        for part in parts_of(batches, 1):
            ids = np.asarray(part.column(0).flatten())
            codes = unit(np.frombuffer(b"".join(part.column(1).flatten().to_pylist()), np.int8).reshape(-1, width))
            k, met = min(NEIGHBOURS, len(ids) - 1), []
            for at in range(0, len(ids) if k else 0, ROWS_AT_ONCE):
                sims = codes[at : at + ROWS_AT_ONCE] @ codes.T
                sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
                row, column = top_of(sims, k)
                met.append(records_of(MEETINGS, at=ids[at + row], other=ids[column], s=sims[row, column]))
            if met:
                met = np.concatenate(met)
                yield batch_of(list(packed(MEETING, met, met["at"] >> BUNDLE_BITS)))

    return map_batches(gathered.select("p", "code"), run, MESSAGES)


def mixed(host: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """A hash of pairs, from 0 to 2 ** 48."""
    x = host.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ guest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(16)).astype(np.int64)


def introduced(host: np.ndarray, guest: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which guests each host (numbers within a bundle) introduces: new ones first, the rest by a hash."""
    order = np.argsort(host << 49 | (~new).astype(np.int64) << 48 | mixed(host, guest))
    return order[rank_in(host[order]) < INTRODUCED]


def meetings_of(guests: np.ndarray) -> np.ndarray:
    """What guests of the same host, of which one is new to it, meet that is nearer than their farthest neighbour."""
    guests = guests[np.argsort(guests["at"], kind="stable")]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(guests)), bool), guests["at"][1:] != guests["at"][:-1])))
    sizes, out = np.diff(np.append(first, len(guests))), []
    new_hosts = np.add.reduceat(guests["new"].astype(np.int64), first) if len(first) else sizes
    first, sizes = first[(sizes > 1) & (new_hosts > 0)], sizes[(sizes > 1) & (new_hosts > 0)]
    for at in range(0, len(first), HOSTS_AT_ONCE):
        start, size = first[at : at + HOSTS_AT_ONCE], sizes[at : at + HOSTS_AT_ONCE]
        widest = np.arange(size.max())
        there = widest < size[:, None]
        held = guests[np.where(there, start[:, None] + widest, start[:, None])]
        codes, ids = unit(held["code"]), held["other"]
        new, worst = held["new"] & there, np.where(there, held["worst"], np.float32(2))
        sims = codes @ codes.transpose(0, 2, 1)
        met = (sims > worst[:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, None, :]
        met[:, widest, widest] = False
        many = met.sum(2) > MET
        if many.any():
            rows = np.where(met[many], sims[many], np.float32(-3))
            met[many] &= rows >= np.partition(rows, -MET, axis=1)[:, -MET, None]
        h, i, j = np.nonzero(met)
        out.append(records_of(MEETINGS, at=ids[h, i], other=ids[h, j], s=sims[h, i, j]))
    return np.concatenate(out) if out else np.empty(0, MEETINGS)


def improved(graph: DataFrame, width: int, tasks: int) -> DataFrame:
    """One round of NN-descent: points introduce their neighbours, and those they are a neighbour of, to each other."""
    kind, coded, mask = points_type(width), guests_type(width), (1 << BUNDLE_BITS) - 1

    def reverse(bundle, data):
        own = np.frombuffer(data, kind)
        row, place = np.nonzero(own["q"] >= 0)
        edges = records_of(EDGES, at=own["q"][row, place], other=own["p"][row], new=own["new"][row, place])
        return packed(EDGE, edges, edges["at"] >> BUNDLE_BITS)

    def ask(bundle, data):
        own, back = np.frombuffer(data[BUNDLE], kind), np.frombuffer(data.get(EDGE, b""), EDGES)
        row, place = np.nonzero(own["q"] >= 0)
        hosts, guests, news = row, own["q"][row, place], own["new"][row, place]
        ways = [(x[k], y[k], z[k]) for x, y, z in ((hosts, guests, news), (back["at"] & mask, back["other"], back["new"])) for k in [introduced(x, y, z)]]
        host, guest, new = (np.concatenate(x) for x in zip(*ways, strict=True))
        order = np.lexsort((~new, guest, host))
        host, guest, new = host[order], guest[order], new[order]
        keep = np.ones(len(host), bool)
        keep[1:] = (host[1:] != host[:-1]) | (guest[1:] != guest[:-1])
        asked = records_of(EDGES, at=guest[keep], other=own["p"][host[keep]], new=new[keep])
        return packed(ASK, asked, asked["at"] >> BUNDLE_BITS)

    def come(bundle, data):
        own, asked = np.frombuffer(data[BUNDLE], kind), np.frombuffer(data.get(ASK, b""), EDGES)
        at = asked["at"] & mask
        # A list that isn't full ends in -2: everybody is nearer.
        guests = records_of(coded, at=asked["other"], other=asked["at"], new=asked["new"], worst=own["s"][at, -1], code=own["code"][at])
        return packed(GUEST, guests, guests["at"] >> BUNDLE_BITS)

    def meet(bundle, data):
        met = meetings_of(np.frombuffer(data[GUEST], coded))
        return packed(MEETING, met, met["at"] >> BUNDLE_BITS)

    asked = exchanged(ask, tasks, graph, each_bundle(graph, reverse))
    met = exchanged(meet, tasks, exchanged(come, tasks, graph, asked))
    return merged(graph, met, width, tasks)


def new_share(graph: DataFrame) -> float:
    """The share of list entries that the round before didn't have."""
    new, entries = graph.agg(F.sum("fresh"), F.sum("entries")).first()
    return (new or 0) / max(1, entries or 0)


def build_graph(points: DataFrame, width: int, parts: int, tasks: int, settled: float = SETTLED) -> DataFrame:
    """The bundles of (p, embedding, code) with their lists, a written table. Lists only get better, so rounds end."""
    graph = durable(merged(bundled(points.select("p", "code"), width, tasks), first_neighbours(points, width, parts), width, tasks))
    while True:
        graph = durable(improved(graph, width, tasks))
        if new_share(graph) <= settled:
            return graph


def walk(wanted: DataFrame, graph: DataFrame, width: int, tasks: int) -> DataFrame:
    """(p, q): for each wanted p the points of its beam after a greedy walk from it, itself too. Steps go on
    until every point of every beam was opened; a beam only gets better, so what has left it never comes back."""
    kind, state, coded, mask = points_type(width), queries_type(width), codes_type(width), (1 << BUNDLE_BITS) - 1

    def sent(what: int, pairs: np.ndarray, codes: np.ndarray):
        """Pairs, and the code of each pair's query once for a bundle. Codes are in the order of p."""
        bundles = pairs["at"] >> BUNDLE_BITS
        yield from packed(what, pairs, bundles)
        used = np.unique(records_of(PAIR, at=bundles, other=pairs["other"]))
        out = codes[np.searchsorted(codes["p"], used["other"])]
        yield from packed(CODE, out, used["at"])

    def known(data) -> np.ndarray:
        codes = np.frombuffer(data.get(CODE, b""), coded)
        return codes[np.unique(codes["p"], return_index=True)[1]]

    def unopened(queries: np.ndarray) -> np.ndarray:
        left = (queries["beam"] >= 0) & ~queries["opened"]
        return left & (np.cumsum(left, axis=1) <= OPENED)

    def enter(bundle, data):
        own, wants = np.frombuffer(data[BUNDLE], kind), np.frombuffer(data.get(WANTED, b""), np.int64)
        if not len(wants):
            return
        own, near = own[np.unique(wants) & mask], min(BEAM - 1, NEIGHBOURS)
        out = np.zeros(len(own), state)
        out["p"], out["code"], out["beam"], out["s"] = own["p"], own["code"], -1, -2
        out["beam"][:, 0], out["s"][:, 0], out["opened"][:, 0] = own["p"], 1, True
        out["beam"][:, 1 : near + 1], out["s"][:, 1 : near + 1] = own["q"][:, :near], own["s"][:, :near]
        yield bundle, QUERY, out.tobytes(), int(unopened(out).sum()), 0

    def request(bundle, data):
        queries = np.frombuffer(data, state)
        row, place = np.nonzero(unopened(queries))
        codes = np.empty(len(queries), coded)
        codes["p"], codes["worst"], codes["code"] = queries["p"], queries["s"][:, -1], queries["code"]
        return sent(OPEN, records_of(PAIR, at=queries["beam"][row, place], other=queries["p"][row]), codes)

    def lead_on(bundle, data):
        if OPEN not in data:
            return
        own, opens = np.frombuffer(data[BUNDLE], kind), np.frombuffer(data[OPEN], PAIR)
        further = own["q"][opens["at"] & mask]
        row, place = np.nonzero(further >= 0)
        pairs = records_of(PAIR, at=further[row, place], other=opens["other"][row])
        yield from sent(TRY, pairs, known(data))

    def measure(bundle, data):
        if TRY not in data:
            return
        own, pairs, codes = np.frombuffer(data[BUNDLE], kind), np.frombuffer(data[TRY], PAIR), known(data)
        place = np.searchsorted(codes["p"], pairs["other"])
        both = np.unique(place << BUNDLE_BITS | pairs["at"] & mask)
        place, at = both >> BUNDLE_BITS, both & mask
        points, queries, sims = unit(own["code"]), unit(codes["code"]), np.empty(len(both), np.float32)
        for a in range(0, len(both), 8192):
            sims[a : a + 8192] = np.einsum("ij,ij->i", points[at[a : a + 8192]], queries[place[a : a + 8192]])
        nearer = sims > codes["worst"][place]
        met = records_of(MEETINGS, at=codes["p"][place[nearer]], other=own["p"][at[nearer]], s=sims[nearer])
        yield from packed(MEETING, met, met["at"] >> BUNDLE_BITS)

    def keep(bundle, data):
        queries, met = np.frombuffer(data[QUERY], state).copy(), np.frombuffer(data.get(MEETING, b""), MEETINGS)
        queries["opened"] |= unopened(queries)
        row, place = np.nonzero(queries["beam"] >= 0)
        owner = np.concatenate((row, np.searchsorted(queries["p"], met["at"])))
        other, sim = np.concatenate((queries["beam"][row, place], met["other"])), np.concatenate((queries["s"][row, place], met["s"]))
        opened = np.concatenate((queries["opened"][row, place], np.zeros(len(met), bool)))
        queries["beam"], queries["s"], queries["opened"] = nearest_lists(owner, other, sim, opened, len(queries), BEAM)
        yield bundle, QUERY, queries.tobytes(), int(unopened(queries).sum()), 0

    def wants(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            yield batch_of(list(packed(WANTED, ids, ids >> BUNDLE_BITS)))

    def beams(batches):
        for part in parts_of(batches, 1):
            queries = np.frombuffer(part.column(0)[0].as_py(), state)
            row, place = np.nonzero(queries["beam"] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(queries["p"][row], pa.int64()), pa.array(queries["beam"][row, place], pa.int64())], names=["p", "q"])

    queries = durable(exchanged(enter, tasks, graph, map_batches(wanted.select("p"), wants, MESSAGES)))
    while queries.agg(F.sum("fresh")).first()[0]:
        tried = exchanged(lead_on, tasks, graph, each_bundle(queries, request))
        queries = durable(exchanged(keep, tasks, queries, exchanged(measure, tasks, graph, tried)))
    return durable(map_batches(queries.select("data"), beams, "p long, q long"))


def nearest(embeddings: DataFrame, k: int = TOP, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id is divisible by ``every``.

    Null vectors, zero ones, those with null or non-finite components and rows with a null vec_id take no part.
    Copies of a vector are one point of the graph, and a result lists them by vec_id. A vec_id that is repeated with
    equal vectors counts once, and one with several vectors is a candidate, and a query, with each of them. Shorter
    vectors end in zeros.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = durable(taking_part(embeddings))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    width = max(1, width or 0)
    parts = max(1, min(PROJECTIONS * n // (4 * BLOCK_POINTS), 100_000))
    # A point is a distinct vector and has a number; k + 1 of its copies are all that a result can list.
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    copies = durable(rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1))
    # A task's numbers start where those of the tasks before it end.
    dealt = durable(copies.where("n = 1").select(F.monotonically_increasing_id().alias("p"), "embedding"))
    task = F.shiftright("p", 33)
    counts = dealt.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("count"))
    starts = counts.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("start"))
    numbered = dealt.withColumn("task", task).join(F.broadcast(starts), "task").select((F.col("start") + F.col("p").bitwiseAND((1 << 33) - 1)).alias("p"), "embedding")
    members = durable(copies.join(numbered, "embedding").select("p", "vec_id"))

    def coded(batches):
        for batch in batches:
            v = stacked(batch.column(1), width)
            v = np.round(v / np.abs(v).max(1, keepdims=True) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in v], pa.binary())], names=["p", "embedding", "code"])

    points = durable(map_batches(numbered, coded, "p long, embedding array<double>, code binary"))
    tasks = (n >> BUNDLE_BITS) + 1
    graph = build_graph(points, width, parts, tasks)
    queries = durable(rows.where(F.col("vec_id") % every == 0).distinct().join(points.select("p", "embedding"), "embedding").select("vec_id", "p"))
    beams = walk(queries.select("p").distinct(), graph, width, tasks)

    def scored(batches):
        for part in parts_of(batches, 4000):
            a, b = stacked(part.column(2), width), stacked(part.column(3), width)
            sims = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sims, pa.float64())], names=["from", "p", "score"])

    both = beams.join(points.select(F.col("p").alias("q"), F.col("embedding").alias("v")), "q").join(points.select("p", "embedding"), "p").select("p", "q", "embedding", "v")
    found = map_batches(both, scored, "from long, p long, score double")
    near = Window.partitionBy("from").orderBy(F.desc("score"), "vec_id")
    listed = found.join(members.select("p", "vec_id"), "p").withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).select("from", "vec_id", "score")
    # Every query of a point gets the point's list without itself.
    ranked = listed.groupBy("from").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("list"))
    own = queries.select(F.col("vec_id").alias("query_id"), "p").join(ranked, F.col("p") == F.col("from"))
    kept = own.select("query_id", F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return kept.select("query_id", F.posexplode("list").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
