"""Near-duplicate documents by circulant MinHash, with links confirmed on full shingle sets.

Two permutations of the 32-bit integers make every signature coordinate: one scatters the shingles of a set, and
coordinate k is the least image under the other of the scattered shingles shifted circularly by k. Coordinates
are banded; sets that share a band are candidates. Sets that agree in everything are one node from the start, so
exact copies cost nothing, and sets of fewer than six shingles link to equal ones only.

Within a band, all pairs are never made. A shingle that only one candidate set holds lies in no intersection, so a
set with too many of those has no link and goes. What sets are left meet the leader of each of their bands, the set
with the fewest such shingles, which is as good as the text that the others were made from; confirmed links are
merged into components. In bands that then still hold several components, a member outside of the largest one is
compared to a member of another only if the shingles that others hold too, counted in buckets, allow a link: the
intersection is at most the sum of the smaller counts. Every pair of a band is so confirmed, in one component
already, or refuted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.llm.common import SLICE_ROWS, Scratch, arrow_schema, map_batches, rows_to_batch, slices

ROWS = 4


@dataclass(frozen=True)
class Rule:
    """What a link is: words of a shingle, percent of a union that the intersection reaches, and bands of a signature.

    With the default, a pair at the similarity shares none of 20 bands of 4 with a chance of
    (1 - 0.85 ** 4) ** 20 < 4e-7; with FIVE_WORDS, (1 - 0.8 ** 4) ** 30 < 2e-7.
    """

    words: int = 3
    percent: int = 85
    bands: int = 20

    @property
    def least(self) -> int:
        """Sets with fewer shingles can't reach the similarity without being equal."""
        return -(-self.percent // (100 - self.percent))


THREE_WORDS, FIVE_WORDS = Rule(), Rule(5, 80, 30)
CACHE_WORDS = 400_000
#: Buckets that a set's shared shingles are counted in; more refute more.
BUCKETS = 32
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, known: WordHashes, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of so many words; of all its words, if it has fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        h = (h ^ (h >> np.uint64(32))) * MIX[0] + w[at : at + len(h)] * MIX[2]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    return np.unique(h ^ (h >> np.uint64(32)))


def permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(first)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(second)
    return x ^ (x >> np.uint32(16))


def signature(found: np.ndarray, bands: int) -> np.ndarray:
    """Circulant MinHash of a set that isn't empty: ROWS coordinates for each band."""
    shifts = np.arange(bands * ROWS, dtype=np.uint32)[:, None]
    scattered = permuted((found ^ (found >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    least = np.full(len(shifts), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(scattered), 1024):
        shifted = scattered[None, at : at + 1024] + shifts
        np.minimum(least, permuted(shifted, 0x85EBCA6B, 0xC2B2AE35).min(1), out=least)
    return least


def band_keys(coordinates: np.ndarray) -> list[int]:
    """A 64-bit key for each band: its coordinates and number."""
    rows = coordinates.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * MIX[2]
    for row in rows.T:
        key = (key ^ row) * MIX[0]
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def marked(documents: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark is a digest of the text, which tells rows that repeat a doc_id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("mark"))


def sketch(documents: DataFrame, rule: Rule = THREE_WORDS) -> DataFrame:
    """(doc_id, mark, n_shingles, node, bands) of every whole text; node is a digest of the set, null for no shingles
    or a null doc_id, and bands are null for sets too small to have near copies."""
    ddl = "doc_id long, mark binary, n_shingles long, node binary, bands array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        known = WordHashes()
        for _, keys, texts, marks in slices(batches, "doc_id", "text", "mark"):
            counts, nodes, bands = [], [], []
            for key, text in zip(keys, texts, strict=True):
                found = shingles(text, known, rule.words)
                counts.append(len(found))
                linked = key is not None and len(found) > 0
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if linked else None)
                bands.append(band_keys(signature(found, rule.bands)) if linked and len(found) >= rule.least else None)
            yield rows_to_batch(schema, [keys, marks, counts, nodes, bands])

    return map_batches(marked(documents), run, ddl)


def candidate_sets(documents: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(number, node, n, shingles) of the wanted (doc_id, mark, node), a row for each; numbers are long and unique."""
    ddl = "node binary, n long, shingles array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        known = WordHashes()
        for _, nodes, texts in slices(batches, "node", "text"):
            found = [shingles(t, known, rule.words).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.diff(ends).astype(np.int64)), lists], schema=schema)

    # Rows that repeat id and text lie next to each other after the join; one of them is enough.
    texts = marked(documents).join(wanted, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    return map_batches(texts.select("node", "text"), run, ddl).select(F.monotonically_increasing_id().alias("number"), "node", "n", "shingles")


def profiles(sets: DataFrame, rule: Rule) -> DataFrame:
    """(number, n, alone, shared) of the sets that may have a link: how many of a set's shingles no other set holds,
    and in buckets how many of them others do."""
    elements = sets.select("number", F.explode("shingles").alias("element"))
    lone = elements.groupBy("element").agg(F.count(F.lit(1)).alias("holders"), F.min("number").alias("number")).where("holders = 1")
    gathered = lone.groupBy("number").agg(F.collect_list("element").alias("lone"))
    ddl = "number long, n long, alone long, shared array<int>"
    schema = arrow_schema(ddl)

    def counted(lists: pa.Array, rows: int) -> np.ndarray:
        """How many elements of each list fall in each bucket."""
        sizes = np.diff(np.asarray(lists.offsets))
        buckets = np.asarray(lists.flatten()) & (BUCKETS - 1)
        return np.bincount(np.repeat(np.arange(rows), sizes) * BUCKETS + buckets, minlength=rows * BUCKETS).reshape(rows, BUCKETS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                numbers, n, shingled, lone = (part.column(part.schema.get_field_index(c)) for c in ("number", "n", "shingles", "lone"))
                alone = counted(lone, part.num_rows)
                shared = counted(shingled, part.num_rows) - alone
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BUCKETS)
                yield pa.RecordBatch.from_arrays([numbers, n, pa.array(alone.sum(1)), pa.ListArray.from_arrays(offsets, pa.array(shared.astype(np.int32).ravel()))], schema=schema)

    both = sets.select("number", "n", "shingles").join(gathered, "number", "left").withColumn("lone", F.coalesce("lone", F.expr("cast(array() as array<bigint>)")))
    return map_batches(both, run, ddl).where(100 * (F.col("n") - F.col("alone")) >= rule.percent * F.col("n"))


def reaches(both, n, m, rule: Rule):
    """Whether sets of n and m elements are similar enough with ``both`` of them in common."""
    return (100 + rule.percent) * both >= rule.percent * (n + m)


def allowed(pairs: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """The distinct (a, b) whose shared shingles allow a link."""
    a = known.select(F.col("number").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    b = known.select(F.col("number").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("shared_b"))
    both = pairs.distinct().join(a, "a").join(b, "b")
    return both.where(reaches(most_in_common("shared_a", "shared_b"), F.col("n_a"), F.col("n_b"), rule)).select("a", "b")


def most_in_common(left: str, right: str):
    """At most so many elements lie in both sets, by the counts of their shared ones in buckets."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The (a, b) whose full sets reach the similarity."""
    a, b = sets.select(F.col("number").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("number").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(a, "a").join(b, "b").where(reaches(F.size(F.array_intersect("left", "right")), F.size("left"), F.size("right"), rule)).select("a", "b")


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """(number, root) of all numbers in links (a, b): the least number that each reaches. Labels travel along links
    and then jump to their labels' labels, so the rounds grow with the logarithm of the longest chain."""
    both = work.write(links.union(links.select("b", "a")).toDF("number", "other").distinct())
    labels = work.write(both.groupBy("number").agg(F.least(F.min("other"), F.col("number")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("number").alias("other"), "root"), "other").groupBy("number").agg(F.min("root").alias("near"))
        moved = labels.join(near, "number").select("number", F.least("root", "near").alias("to"), F.col("root").alias("before"))
        jump = labels.select(F.col("number").alias("to"), F.col("root").alias("further"))
        new = work.write(moved.join(jump, "to").select("number", F.least("to", "further").alias("root"), (F.least("to", "further") < F.col("before")).alias("changed")))
        labels = new.select("number", "root")
        if new.where("changed").isEmpty():
            return labels


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, number, root, main) of the bands whose members aren't all in one component; main is the band's largest."""
    labelled = members.join(roots, "number", "left").select("band", "number", F.coalesce("root", "number").alias("root"))
    sizes = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    mains = sizes.groupBy("band").agg(F.max(F.struct("size", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return labelled.join(mains.select("band", "main"), "band")


def led(open_bands: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): the members of a band with its leader, the member outside of its largest component with the fewest
    shingles of its own; with no component known, ``main`` is null and all members count."""
    outside = open_bands.where("main is null or root <> main").join(known.select("number", "alone"), "number")
    leaders = outside.groupBy("band").agg(F.min(F.struct("alone", "number", "root")).alias("leader")).select("band", F.col("leader.number").alias("leader"), F.col("leader.root").alias("own"))
    return open_bands.join(leaders, "band").where("root <> own").select(F.least("number", "leader").alias("a"), F.greatest("number", "leader").alias("b"))


def across(open_bands: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): the pairs of a band's members from different components that their shared shingles don't refute."""
    full = open_bands.join(known, "number").select("band", "number", "root", "main", "n", "alone", "shared")
    other = full.where("root <> main").select("band", *(F.col(c).alias(f"x_{c}") for c in ("number", "root", "n", "alone", "shared")))
    sizes = (F.col("n"), F.col("x_n"))
    shared = F.least(F.col("n") - F.col("alone"), F.col("x_n") - F.col("x_alone"))
    met = full.join(other, "band").where((F.col("root") != F.col("x_root")) & reaches(shared, *sizes, rule) & reaches(most_in_common("shared", "x_shared"), *sizes, rule))
    return met.select(F.least("number", "x_number").alias("a"), F.greatest("number", "x_number").alias("b")).distinct()


def link(documents: DataFrame, sketched: DataFrame, rule: Rule, work: Scratch) -> DataFrame:
    """(node, root) of the nodes that have confirmed links to other nodes; roots are numbers."""
    nodes = sketched.where("bands is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark", "bands")).alias("first"))
    banded = nodes.select("node", "first.doc_id", "first.mark", F.explode("first.bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    members = work.write(banded.join(shared, "band"))
    sets = work.write(candidate_sets(documents, members.select("doc_id", "mark", "node").distinct(), rule))
    known = work.write(profiles(sets, rule))
    active = work.write(members.select("band", "node").join(sets.join(known.select("number"), "number", "left_semi").select("node", "number"), "node").select("band", "number"))
    open_bands, links, size = active.select("band", "number", F.col("number").alias("root"), F.lit(None).cast("long").alias("main")), None, active.count()
    while size:
        # Leaders join what they can, as long as that closes most of what is open; what is left comes after.
        new = work.write(confirmed(allowed(led(open_bands, known), known, rule), sets, rule))
        links = new if links is None else links.union(new)
        roots, before = components(links, work), size
        open_bands = work.write(still_open(active, roots))
        size = open_bands.count()
        if 2 * size > before:
            break
    if size:
        rest = work.write(confirmed(work.write(across(open_bands, known, rule)), sets, rule))
        if not rest.isEmpty():
            roots = components(links.union(rest), work)
    return roots.join(sets.select("number", "node"), "number").select("node", "root") if links is not None else sets.select("node", F.col("number").alias("root")).limit(0)


def grouped(documents: DataFrame, rule: Rule, kept: Scratch) -> DataFrame:
    """(doc_id, mark, n_shingles, root, component_id), a row for each row of documents; root tells components apart
    and is null, as component_id is, for rows that are linked with nothing."""
    work = Scratch(documents.sparkSession, "near-dedup-work")
    sketched = kept.write(sketch(documents, rule))
    roots = link(documents, sketched.select("doc_id", "mark", "node", "bands"), rule, work)
    ids = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(roots, "node", "left").select("node", "least", F.coalesce(F.col("root").cast("string").cast("binary"), "node").alias("root"))
    by_node = work.write(named)
    least = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    found = kept.write(by_node.join(least, "root").select("node", "root", "component_id"))
    work.clear()
    return sketched.select("doc_id", "mark", "n_shingles", "node").join(found, "node", "left")


def near_duplicates(documents: DataFrame, rule: Rule = THREE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with a null doc_id are linked
    with nothing either: their component_id is null and they are kept. Rows that repeat a doc_id are one document
    if their texts agree, and otherwise sets of their own that share the id.
    """
    out = grouped(documents, rule, Scratch(documents.sparkSession, "near-dedup"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_documents(documents: DataFrame, rule: Rule = FIVE_WORDS) -> DataFrame:
    """One row of each near-duplicate component with all its columns, and every row that is linked with nothing.

    The row that stays has the component's smallest doc_id; of rows that repeat that id, the one whose text has the
    smallest digest, and of rows that repeat the text as well, any one."""
    kept = Scratch(documents.sparkSession, "near-dedup")
    rows = grouped(documents, rule, kept).where("root is not null").select("root", "doc_id", "mark")
    firsts = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", "first")
    copies = kept.write(rows.join(firsts, "root").select("doc_id", "mark", (F.struct("doc_id", "mark") == F.col("first")).alias("stays")).groupBy("doc_id", "mark", "stays").agg(F.count(F.lit(1)).alias("times")))
    id_name, mark_name = ("_".join(("near_dedup", c, *documents.columns)) for c in ("id", "mark"))
    keys = [F.col("doc_id").alias(id_name), F.col("mark").alias(mark_name)]
    same = [F.col("doc_id").cast("long") == F.col(id_name), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))) == F.col(mark_name)]
    out = documents.join(copies.where("not stays or times > 1").select(*keys), same, "left_anti")
    repeated = copies.where("stays and times > 1")
    if repeated.isEmpty():
        return out
    again = documents.join(repeated.select(*keys), same).dropDuplicates([id_name, mark_name])
    return out.union(again.drop(id_name, mark_name))
