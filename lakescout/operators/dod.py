"""View search: from attributes and sample cells to join graphs and assembled views."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.operators import joins
from lakescout.operators import search as search_by


@dataclass(frozen=True)
class Filter:
    number: int
    attribute: str
    cell: str = ""


def joint_filters(nodes: DataFrame, values: DataFrame, filters: list[Filter]) -> DataFrame:
    """(filter_id, nid, source_name): columns with the attribute's name and, if given, the cell among their values."""
    out = None
    for f in filters:
        named = nodes.where(F.col("field_name") == f.attribute)
        if f.cell:
            holding = values.where(F.lower(F.trim("value")) == f.cell.strip().lower()).select("nid").distinct()
            named = named.join(holding, "nid", "left_semi")
        rows = named.select(F.lit(f.number).alias("filter_id"), "nid", "source_name")
        out = rows if out is None else out.union(rows)
    return out


def individual_filters(names: DataFrame, texts: DataFrame, filters: list[Filter], n: int = 200) -> DataFrame:
    """(filter_id, kind, nid, score): columns named like each attribute, and the n whose values match each cell best.

    ``names`` and ``texts`` are (nid, text) of names and of values. Cells are numbered behind the attributes.
    """
    parts = [search_by.exact_name(names, f.attribute, n).select(F.lit(f.number).alias("filter_id"), F.lit("ATTR").alias("kind"), "nid", "score") for f in filters]
    parts += [search_by.bm25(texts, f.cell, n).select(F.lit(len(filters) + f.number).alias("filter_id"), F.lit("CELL").alias("kind"), "nid", "score") for f in filters if f.cell]
    return reduce(DataFrame.union, parts)


def covering_tables(found: DataFrame) -> DataFrame:
    """(source_name, filters, n): tables with the filters they fulfil, most first."""
    sets = found.groupBy("source_name").agg(F.array_sort(F.collect_set("filter_id")).alias("filters"))
    return sets.select("source_name", "filters", F.size("filters").alias("n")).orderBy(F.desc("n"), F.desc("source_name"))


def candidate_groups(tables: list[tuple[str, frozenset[int]]], wanted: frozenset[int]) -> Iterator[tuple[list[str], frozenset[int]]]:
    """Groups of tables that cover the filters: each table in turn begins a group, and a later one joins if it adds a
    filter; full covers come first, partial ones at the end, none twice."""
    seen, partial = set(), []
    for at, (name, own) in enumerate(tables):
        group, cover = [name], set(own)
        for other, theirs in tables[at + 1 :] + tables[:at]:
            if cover >= wanted:
                break
            if theirs - cover:
                group.append(other)
                cover |= theirs
        key = frozenset(group)
        if key in seen:
            continue
        seen.add(key)
        if cover >= wanted:
            yield group, frozenset(cover)
        else:
            partial.append((group, frozenset(cover)))
    yield from partial


def every_group(tables: list[tuple[str, frozenset[int]]]) -> Iterator[tuple[list[str], frozenset[int]]]:
    """All groups of tables with what they cover: largest covers first, then smaller groups, then by name."""
    groups = []
    for size in range(1, len(tables) + 1):
        for group in combinations(sorted(tables), size):
            cover = frozenset().union(*(own for _, own in group))
            groups.append((-len(cover), size, [name for name, _ in group], cover))
    for _, _, group, cover in sorted(groups, key=lambda g: g[:3]):
        yield group, cover


def hop_pairs(path: list[tuple[str, str]]) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of neighbouring columns of a path that lie in different tables."""
    return [(a, b) for a, b in zip(path[::2], path[1::2], strict=False) if a[0] != b[0]]


def graph_id(hops: list[tuple[str, str, str, str]]) -> str:
    """The same for equal sets of columns, in every process."""
    return "|".join(sorted({f"{a}.{ca}" for a, ca, _, _ in hops} | {f"{b}.{cb}" for _, _, b, cb in hops}))


def can_materialise(tables: dict[str, DataFrame], hops: list[tuple[str, str, str, str]], cells: dict[str, dict[str, str]]) -> bool:
    """Whether some row survives all cell filters and joins; every hop is probed for one row."""
    filtered = {n: joins.cell_filter(df, cells.get(n, {})) for n, df in tables.items()}
    return joins.has_rows(joins.fold(filtered, hops).limit(1))


def materialise(tables: dict[str, DataFrame], hops: list[tuple[str, str, str, str]], cells: dict[str, dict[str, str]], attributes: list[str]) -> DataFrame:
    """The view of a join graph: filtered tables folded along the hops, and the wanted attributes."""
    filtered = {n: joins.cell_filter(df, cells.get(n, {})) for n, df in tables.items()}
    return joins.fold(filtered, hops).select(*attributes)


def search(tables: dict[str, DataFrame], nodes: DataFrame, values: DataFrame, hops_of, filters: list[Filter]) -> Iterator[tuple[list[str], DataFrame]]:
    """Views for the filters, best group first. ``hops_of(group)`` gives the join graphs that connect
    a group's tables, in the order to try; ``joingraphs.discovered`` makes it from the lake's key edges."""
    found = joint_filters(nodes, values, filters)
    rows = [(r["source_name"], frozenset(r["filters"])) for r in covering_tables(found).collect()]
    wanted, cells = frozenset(f.number for f in filters), {}
    for f in filters:
        if f.cell:
            for name, own in rows:
                if f.number in own:
                    cells.setdefault(name, {})[f.attribute] = f.cell
    for group, cover in candidate_groups(rows, wanted):
        if cover < wanted:
            continue
        attributes = [f.attribute for f in filters]
        if len(group) == 1:
            yield group, joins.cell_filter(tables[group[0]], cells.get(group[0], {})).select(*attributes)
            continue
        for hops in hops_of(group):
            if can_materialise(tables, hops, cells):
                yield group, materialise(tables, hops, cells, attributes)
