"""Assignment of pages to slips in order of arrival: the newest slip of the family that lacks the page takes it.

A family is a slip reference without its copy number. Where no slip of the family lacks the page, the newest slip of the
same district and ballot type does; else a new copy opens. Families that share a district and type influence each other,
so the fold runs over connected components; within one it is sequential by definition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.operators.components import components
from tallyweave.tables import Scratch

#: What a slip holds; `made` is the arrival that opened it, by which slips are older or newer, `expected` its pages' largest total.
SLIP = "slip_key string, base string, voting_district string, ballot_type string, is_vote_related boolean, made bigint, pages array<int>, expected int"
#: A row of the fold: a slip as it was, or a page as it arrives (made is its ingest_seq, expected its page total).
ROW = f"comp string, is_page boolean, {SLIP}, page_number int, request_id string"
#: A row after the fold: a page with the slip it went to, or a slip as it is now and whether a page of this run went to it.
FOLDED = f"comp string, is_page boolean, {SLIP}, request_id string, touched boolean"
_BATCH = 8192
#: So many slips of a group are looked through one by one.
_FEW = 8


class Group:
    """The slips of a family or a district, oldest first. The newest that lacks a page is sought from the end; once there
    are more than a few, by links past those that have it, one set of links for each page number."""

    __slots__ = ("held", "past")

    def __init__(self) -> None:
        self.held: list[Slip] = []
        self.past: dict[int | None, dict[int, int]] | None = None

    def add(self, slip: Slip) -> None:
        self.held.append(slip)
        if self.past is not None:
            self._link(len(self.held) - 1, slip)
        elif len(self.held) > _FEW:
            self.past = {}
            for at, other in enumerate(self.held):
                self._link(at, other)

    def _link(self, at: int, slip: Slip) -> None:
        slip.places = (*slip.places, (self, at))
        for page in slip.pages:
            self.past.setdefault(page, {})[at] = at - 1

    def newest(self, page: int | None) -> Slip | None:
        if self.past is None:
            for slip in reversed(self.held):
                if page not in slip.pages:
                    return slip
            return None
        at, past = len(self.held) - 1, self.past.get(page, ())
        while at in past:
            to = past[at]
            past[at] = past.get(to, to)
            at = to
        return self.held[at] if at >= 0 else None


@dataclass(slots=True)
class Slip:
    key: str
    base: str
    district: str | None
    kind: str | None
    votes: bool
    made: int
    pages: set[int]
    expected: int | None = None
    touched: bool = False
    #: Its places in the groups that have links.
    places: tuple[tuple[Group, int], ...] = ()

    def give(self, page: int | None) -> None:
        self.pages.add(page)
        for group, at in self.places:
            group.past.setdefault(page, {})[at] = at - 1


class Desk:
    """The state of one component: its slips by family and by district, oldest first.

    The newest slip of a group that lacks a page is found by links past those that have it, halved as they are followed;
    so a page costs about the same however many slips are open.
    """

    def __init__(self, slips: Iterable[Slip] = ()) -> None:
        self.slips: list[Slip] = []
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}
        self.open: dict[str | tuple, Group] = {}
        for slip in slips:
            self._open(slip, self._groups(slip.base, slip.district, slip.kind))

    def _open(self, slip: Slip, groups: tuple) -> None:
        self.slips.append(slip)
        self.taken.add(slip.key)
        if slip.votes:
            for name in groups:
                group = self.open.get(name)
                if group is None:
                    group = self.open[name] = Group()
                group.add(slip)

    @staticmethod
    def _groups(base: str, district: str | None, kind: str | None) -> tuple:
        return (base, (district, kind)) if district and district.upper() != "UNKNOWN" else (base,)

    def place(self, base: str, district: str | None, kind: str | None, page: int, votes: bool = True, seq: int = 0) -> str:
        return self.take(base, district, kind, page, votes, seq).key

    def take(self, base: str, district: str | None, kind: str | None, page: int, votes: bool = True, seq: int = 0) -> Slip:
        """The slip that gets the page."""
        groups = self._groups(base, district, kind) if votes else ()
        if votes:
            for name in groups:
                group = self.open.get(name)
                if group is not None and (slip := group.newest(page)):
                    slip.give(page)
                    return slip
            key = base
            if key in self.taken:
                n = self.next.get(base, 2)
                while key in self.taken:
                    key, n = f"{base} ({n})", n + 1
                self.next[base] = n
        else:  # a page that isn't about votes never joins another
            key = base if base not in self.taken else f"{base} #{seq}"
        slip = Slip(key, base, district, kind, bool(votes), seq, {page})
        self._open(slip, groups)
        return slip

    def close(self) -> list[Slip]:
        """The slips; groups and slips let go of each other, which spares the search for cycles."""
        for group in self.open.values():
            group.past = None
            group.held.clear()
        return self.slips


def base_of(reference: Column) -> Column:
    """A slip reference without its copy number."""
    return F.regexp_replace(F.coalesce(reference, F.lit("")), r"^(.*) \([0-9]+\)$", "$1")


def fold(rows: Iterable[tuple]) -> list[str]:
    desk = Desk()
    return [desk.place(*r) for r in rows]


def with_components(records: DataFrame) -> DataFrame:
    """Adds base and comp: the smallest base reachable over shared (district, type)."""
    d = records.withColumn("base", base_of(F.col("slip_reference")))
    known = F.coalesce(F.upper("voting_district"), F.lit("UNKNOWN")) != "UNKNOWN"
    scratch = Scratch(records.sparkSession)
    sites = d.select("base", F.when(known, F.to_json(F.struct("voting_district", "ballot_type"))).alias("site"))
    # A site is a node as well: its name can't be a base's. A family without one is a component of its own.
    links = sites.where("site IS NOT NULL").select(F.concat(F.lit("b"), "base").alias("a"), F.concat(F.lit("s"), "site").alias("b")).distinct()
    links = scratch.cut(links, "sites")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    found = components(ids.select("id", F.col("id").alias("comp")), links, scratch).where("startswith(id, 'b')")
    comp = scratch.end(found.select(F.substring("id", 2, 1 << 30).alias("base"), F.substring("comp", 2, 1 << 30).alias("comp")), "components")
    return d.join(comp, "base", "left").withColumn("comp", F.coalesce("comp", "base"))


def _values(column: pa.Array) -> list:
    """The values as Python objects, nulls as None; by way of numpy, as Arrow takes ten times as long over each."""
    if pa.types.is_list(column.type):
        flat, ends = _values(column.flatten()), column.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]  # null as an empty one
    if not column.null_count or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    found = column.fill_null(0 if pa.types.is_integer(column.type) else False).to_numpy(zero_copy_only=False).astype(object)
    found[column.is_null().to_numpy(zero_copy_only=False)] = None
    return found.tolist()


def _alone(comps: list[str], is_page: np.ndarray) -> np.ndarray:
    """Which rows are of a component that has no page here; the first and the last may go on in other batches."""
    names = np.array(comps, dtype=object)
    starts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1))
    idle = ~np.logical_or.reduceat(is_page, starts)
    idle[[0, -1]] = False
    return np.repeat(idle, np.diff(np.append(starts, len(comps))))


def fold_arrivals(rows: DataFrame, by: Iterable[str | Column] = ("comp",), states: bool = True) -> DataFrame:
    """(FOLDED) of rows (ROW): each page with the slip it went to, and each slip as it is now (unless `states` is false).

    The rows of a component follow each other, slips by age and then pages by arrival, so a task holds the slips of one
    component at a time and none of its pages. `by` deals out the rows, those of a component to one task. Rows go in and
    out as flat columns: building a dict for each costs more than its place does. Slips of components without a page are
    passed on as they came.
    """
    given, told = to_arrow_schema(StructType.fromDDL(ROW)), to_arrow_schema(StructType.fromDDL(FOLDED))
    used = ("comp", "is_page", "made", "base", "voting_district", "ballot_type", "is_vote_related", "page_number", "slip_key", "pages", "expected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, desk, old = None, None, []
        held: list[Slip] = []
        comps: list[str] = []

        def close() -> None:
            slips = desk.close() if desk else old
            if states:
                held.extend(slips)
                comps.extend([now] * len(slips))

        def batch_of(n: int, **columns: list | pa.Array) -> pa.RecordBatch:
            full = [columns.get(f.name) for f in told]
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(told, full, strict=True)], schema=told)

        def slips() -> pa.RecordBatch:
            pages = [sorted(s.pages, key=lambda p: (p is None, p)) if None in s.pages else sorted(s.pages) for s in held]
            names = {"slip_key": "key", "base": "base", "voting_district": "district", "ballot_type": "kind", "is_vote_related": "votes", "made": "made", "expected": "expected", "touched": "touched"}
            out = batch_of(len(held), comp=comps, is_page=[False] * len(held), pages=pages, **{to: list(map(attrgetter(name), held)) for to, name in names.items()})
            held.clear()
            comps.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=given.names)
            is_page = batch.column("is_page").to_numpy(zero_copy_only=False)
            idle = _alone(_values(batch.column("comp")), is_page) if states else np.zeros(len(is_page), bool)
            if idle.any():
                kept = batch.filter(pa.array(idle))
                yield batch_of(kept.num_rows, touched=[False] * kept.num_rows, **{f.name: kept.column(f.name) for f in told if f.name != "touched"})
                batch, is_page = batch.filter(pa.array(~idle)), is_page[~idle]
            keys = []
            for comp, arrives, seq, base, district, kind, votes, number, key, pages, expected in zip(*[_values(batch.column(c)) for c in used], strict=True):
                if comp != now:
                    close()
                    now, desk, old = comp, None, []
                if not arrives:
                    old.append(Slip(key, base, district, kind, votes, seq, set(pages), expected))
                    continue
                desk = desk or Desk(old)
                slip = desk.take(base, district, kind, number, votes, seq)
                slip.touched = True
                if expected is not None and (slip.expected is None or expected > slip.expected):
                    slip.expected = expected
                keys.append(slip.key)
            if keys:
                arrived = batch.filter(pa.array(is_page))
                yield batch_of(len(keys), is_page=[True] * len(keys), slip_key=keys, made=arrived.column("made"), request_id=arrived.column("request_id"))
            if len(held) >= _BATCH:
                yield slips()
        close()
        yield slips()

    name = F.xxhash64("comp")  # names begin alike, hashes don't
    d = rows.select(*given.names).repartition(*by).sortWithinPartitions(name, "comp", "is_page", "made")
    return d.mapInArrow(run, FOLDED)


def page_rows(records: DataFrame) -> DataFrame:
    """(ROW) of page records with comp and base, as fold_arrivals takes them."""
    none = lambda of: F.lit(None).cast(of)
    here = {"comp": "comp", "base": "base", "voting_district": "voting_district", "ballot_type": "ballot_type", "made": "ingest_seq", "expected": "page_total", "page_number": "page_number"}
    # An empty list, not a null: Spark asks each row for its batch's size, and Arrow then counts all nulls of a list anew.
    rest = {"is_page": F.lit(True), "is_vote_related": F.coalesce("is_vote_related", F.lit(True)), "slip_key": none("string"), "pages": F.array().cast("array<int>"), "request_id": F.col("request_id") if "request_id" in records.columns else none("string")}
    found = {k: F.col(c) for k, c in here.items()} | rest
    return records.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ROW)])


def assign_pages(records: DataFrame) -> DataFrame:
    """(ingest_seq, slip_key) for each page record; ingest_seq orders the arrivals and must be unique.

    An empty table gives an empty one; a null reference is a family of its own name, the empty one.
    """
    return fold_arrivals(page_rows(with_components(records)), states=False).select(F.col("made").alias("ingest_seq"), "slip_key")
