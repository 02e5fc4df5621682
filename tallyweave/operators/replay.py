"""Edits in order: a log of commands replayed against slips and pages, each as the state was when it came.

Whether a command acts depends on what came before: a link needs its page and its target to be there, the removal of a
slip's last page deletes the slip, a deletion takes the pages that are on it at that moment and none that come later. The
log is therefore replayed one after another within each component of slips and pages that commands tie together; slips and
pages that no command names are left alone and never meet a task. A replay gives intervals of seq, [since, until): lives
of slips and stays of pages. What a slip looked like when it was to be approved is read off those, and the gates of
approval are evaluated for these versions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.operators import slips as rules_of
from tallyweave.operators.components import components
from tallyweave.operators.workflow import EDITABLE, REASONS
from tallyweave.tables import Scratch

#: seq, whether the command acted, and else why not; of an approval the slip as it was: its origin, edits and pages.
OUTCOME = "seq: bigint, done: boolean, why: string, slip_id: string, origin: string, edits: map<string,string>, pages: array<string>, party_slip: string"
STAY = "page_id: string, slip_id: string, since: bigint, until: bigint"
#: origin is the slip of the table that a slip's fields come from, edits what was changed since.
LIFE = "slip_id: string, origin: string, page_id: string, since: bigint, until: bigint, edits: map<string,string>"
_COMMAND = ("seq", "action", "slip_id", "page_id", "party_id", "field", "value", "reason", "bad", "own")
_BATCH = 2048
#: What a new slip of a single page starts with.
_ZEROS = {f: "0" for f in ("total_valid_votes", "total_spoilt_votes", "total_votes_cast", "special_votes", "section_24a_votes")}
STATUS = {"reject_slip": "rejected", "flag_slip": "flagged", "approve_slip": "approved"}


@dataclass
class Replay:
    outcomes: DataFrame
    stays: DataFrame
    lives: DataFrame


def own_slip(slip: str | None, page: str, seq: int) -> str:
    """The name of the slip that a page is unlinked to."""
    return f"{slip or page}_unlinked_{hashlib.sha256(f'{page}|{seq}'.encode()).hexdigest()[:4]}"


class State:
    """Slips and pages of one component while its commands are replayed."""

    def __init__(self) -> None:
        self.slips: dict[str, dict] = {}
        self.pages: dict[str, dict] = {}
        self.on: dict[str, set[str]] = {}
        self.past: list[tuple[str, dict]] = []

    def open(self, slip: str, origin: str, since: int | None, edits: dict, page: str | None = None) -> None:
        self.slips[slip] = {"slip_id": slip, "origin": origin, "page_id": page, "since": since, "until": None, "edits": dict(edits)}
        self.on.setdefault(slip, set())

    def put(self, page: str, slip: str, since: int | None) -> None:
        self.pages[page] = {"page_id": page, "slip_id": slip, "since": since, "until": None}
        self.on.setdefault(slip, set()).add(page)

    def leave(self, page: str, seq: int) -> str:
        stay = self.pages.pop(page)
        self.on[stay["slip_id"]].discard(page)
        self.past.append(("stay", stay | {"until": seq}))
        return stay["slip_id"]

    def close(self, slip: str, seq: int) -> None:
        for page in sorted(self.on.pop(slip, ())):
            self.on[slip] = {page}
            self.leave(page, seq)
        self.on.pop(slip, None)
        self.past.append(("life", self.slips.pop(slip) | {"until": seq}))

    def act(self, c: dict) -> str | None:
        """Does a command, or says why it can't be done."""
        action, slip, page, seq = c["action"], c["slip_id"], c["page_id"], c["seq"]
        if action == "create_slip":
            if slip is None or slip in self.slips:
                return "slip is there"
            self.open(slip, slip, seq, {})
            return None
        if action == "clear_all_slips":
            for s in list(self.slips):
                self.close(s, seq)
            for p in list(self.pages):
                self.leave(p, seq)
            return None
        if action in ("manual_link_page", "manual_unlink_page", "remove_page", "override_party_votes"):
            if page not in self.pages:
                return "no such page"
            at = self.pages[page]["slip_id"]
            if action.startswith("manual") and len((c["reason"] or "").strip()) < 5:
                return "a reason of 5 characters is needed"
            if action in ("remove_page", "override_party_votes") and slip is not None and slip != at:
                return "not on this slip"
            if action == "override_party_votes":
                return c["bad"]
            if action == "manual_link_page":
                if c["value"] not in self.slips:
                    return "no such slip"
                if c["value"] != at:
                    self.leave(page, seq)
                    self.put(page, c["value"], seq)
                return None
            if action == "manual_unlink_page":
                old = self.slips.get(at)
                if old is None:
                    return "no such slip"
                self.leave(page, seq)
                self.open(c["own"], old["origin"], seq, old["edits"] | _ZEROS | {"status": "incomplete"}, page)
                self.put(page, c["own"], seq)
                return None
            self.leave(page, seq)
            if not self.on.get(at) and at in self.slips:  # it was the last
                self.close(at, seq)
            return None
        if slip not in self.slips:
            return "no such slip"
        if action == "delete_slip":
            self.close(slip, seq)
        elif action == "edit_slip_field":
            if c["bad"]:
                return c["bad"]
            self.slips[slip]["edits"][c["field"]] = c["value"]
        elif action not in STATUS:
            return "no such action"
        return None


def _bad(slips: DataFrame) -> Column:
    """Why an edit or an override can't be taken whatever the state."""
    kinds = {f: slips.schema[f].dataType.simpleString() for f in EDITABLE if f in slips.columns}
    wrong = F.lit(False)
    for f, kind in kinds.items():
        wrong |= (F.col("field") == f) & F.col("value").isNotNull() & F.expr(f"try_cast(value AS {kind})").isNull()
    edit = F.when(~F.coalesce(F.col("field").isin(*kinds), F.lit(False)), "not editable").when(F.coalesce(wrong, F.lit(False)), "bad value")
    votes = F.when(F.expr("try_cast(value AS INT)").isNull(), "bad value")
    return F.when(F.col("action") == "edit_slip_field", edit).when(F.col("action") == "override_party_votes", votes)


def replay(slips: DataFrame, pages: DataFrame, commands: DataFrame, party: DataFrame | None = None) -> Replay:
    """The replay of commands (workflow.COMMANDS, seq unique) against slips (id, ...) and pages (id, slip_id).

    A command without a slip, or on one that isn't there, is refused; a null seq takes no part. Overrides name a party row,
    whose page is looked up in `party`. A clearing of all starts every component anew. Pages of slips that aren't there
    stay where they are and can be linked, but not unlinked.
    """
    scratch = Scratch(slips.sparkSession)
    c = commands.where("seq IS NOT NULL").withColumn("bad", _bad(slips))
    if party is not None:
        place = party.select(F.col("id").alias("party_id"), F.col("page_id").alias("__page"))
        c = c.join(place, "party_id", "left").withColumn("page_id", F.when(F.col("action") == "override_party_votes", F.col("__page")).otherwise(F.col("page_id")))
    name = F.substring(F.sha2(F.concat_ws("|", "page_id", F.col("seq").cast("string")), 256), 1, 4)
    c = c.withColumn("own", F.when(F.col("action") == "manual_unlink_page", F.concat(F.coalesce("slip_id", "page_id"), F.lit("_unlinked_"), name)))
    c = scratch.cut(c.select(*_COMMAND), "commands")
    # Clearings are few, acts of an administrator: each begins an epoch, in which a component starts from nothing.
    clears = sorted(r.seq for r in c.where("action = 'clear_all_slips'").select("seq").distinct().collect())
    epoch = lambda seq: F.size(F.filter(F.array(*[F.lit(s) for s in clears]).cast("array<bigint>"), lambda s: s < seq)) if clears else F.lit(0)

    # Nodes are slips and pages that commands name, and the pages of those slips. A page ties its slips to the smallest of
    # them, so that components are sought among slips alone, and is in the component of that one.
    at = pages.select(F.col("id").alias("page_id"), F.col("slip_id").alias("at"))
    named = c.where("action <> 'clear_all_slips'")
    moved = named.where("page_id IS NOT NULL").select("page_id").distinct().join(at, "page_id", "left")
    touched = named.select("slip_id").union(named.where("action = 'manual_link_page'").select("value")).union(named.select("own")).union(moved.select("at"))
    touched = scratch.cut(touched.where("slip_id IS NOT NULL").distinct(), "touched")
    own_pages = at.join(touched, at.at == touched.slip_id, "left_semi")
    s = lambda x: F.concat(F.lit("s"), x)
    p = lambda x: F.concat(F.lit("p"), x)
    acts = named.where("page_id IS NOT NULL")
    tied = acts.select("page_id", F.explode(F.array("slip_id", F.when(F.col("action") == "manual_link_page", F.col("value")), "own")).alias("slip_id"))
    tied = scratch.cut(tied.union(own_pages.select("page_id", "at")).distinct(), "ties")
    least = scratch.cut(tied.groupBy("page_id").agg(F.min("slip_id").alias("least")), "least")
    links = tied.join(least, "page_id").where("slip_id <> least").select(s(F.col("slip_id")).alias("a"), s(F.col("least")).alias("b")).distinct()
    ids = touched.select(s(F.col("slip_id")).alias("id"))
    of_slips = components(ids.select("id", F.col("id").alias("comp")), links, scratch).select("id", "comp")
    of_pages = least.select(p(F.col("page_id")).alias("page"), s(F.col("least")).alias("id")).join(of_slips, "id", "left").select(F.col("page").alias("id"), F.coalesce("comp", "page").alias("comp"))
    comp = scratch.cut(of_slips.union(of_pages), "comps")

    none = lambda kind: F.lit(None).cast(kind)
    node = F.coalesce(p(F.col("page_id")), s(F.col("slip_id")), F.lit(""))
    first = lambda d, node, what, *cols: d.withColumn("id", node).join(comp, "id").select("comp", F.lit(0).alias("epoch"), F.lit(what).alias("what"), *cols)
    blank = [none(c.schema[f].dataType).alias(f) for f in _COMMAND]
    rows = first(slips.select(F.col("id").alias("slip_id")), s(F.col("slip_id")), "slip", F.col("slip_id").alias("slip"), none("string").alias("page"), *blank)
    rows = rows.union(first(own_pages.select("page_id", "at").union(moved.where("at IS NOT NULL").select("page_id", "at")).distinct(), p(F.col("page_id")), "page", F.col("at"), F.col("page_id"), *blank))
    orders = named.withColumn("id", node).join(comp, "id", "left").select(F.coalesce("comp", F.lit("")).alias("comp"), epoch(F.col("seq")).alias("epoch"), F.lit("act").alias("what"), none("string"), none("string"), *_COMMAND)
    rows = rows.union(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, State(), []

        def told() -> list[dict]:
            end = clears[now[1]] if now and now[1] < len(clears) else None
            if end is not None:
                state.act({"action": "clear_all_slips", "slip_id": None, "page_id": None, "seq": end})
            rows = [*state.past, *(("life", x) for x in state.slips.values()), *(("stay", x) for x in state.pages.values())]
            return [x | {"kind": k} | ({"edits": list(x["edits"].items())} if k == "life" else {}) for k, x in rows]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in fields], schema=arrow)

        def values(col: pa.Array) -> list:  # far faster than to_pylist; numbers are null in rows that don't use them
            return (col.fill_null(0) if pa.types.is_integer(col.type) else col).to_numpy(zero_copy_only=False).tolist()

        for batch in batches:
            for comp, epoch, what, slip, page, *act in zip(*map(values, batch.columns), strict=True):
                if (comp, epoch) != now:
                    out += told()
                    now, state = (comp, epoch), State()
                if what == "slip":
                    state.open(slip, slip, None, {})
                elif what == "page":
                    state.put(page, slip, None)
                else:
                    act = dict(zip(_COMMAND, act, strict=True))
                    party_slip = state.pages[act["page_id"]]["slip_id"] if act["page_id"] in state.pages else None
                    was = state.slips.get(act["slip_id"]) if act["action"] == "approve_slip" else None
                    why = state.act(act)
                    whole = {"origin": was["origin"], "edits": list(was["edits"].items()), "pages": sorted(state.on.get(act["slip_id"], ()))} if was else {}
                    out.append({"kind": "outcome", "seq": act["seq"], "done": why is None, "why": why, "slip_id": act["slip_id"], "party_slip": party_slip, **whole})
                if len(out) >= _BATCH:
                    yield batch_of(out)
                    out = []
        out += told()
        for i in range(0, len(out), _BATCH):
            yield batch_of(out[i : i + _BATCH])

    schema = f"kind string, {OUTCOME}, page_id string, since bigint, until bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    fields = [(f.name, f.type) for f in arrow]
    order = F.when(F.col("what") == "slip", 0).when(F.col("what") == "page", 1).otherwise(2)
    # Rows are few bytes but much work in Python: as many tasks as Spark shuffles to, not as few as would hold the bytes.
    tasks = int(slips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = scratch.cut(rows.repartition(tasks, "comp").sortWithinPartitions("comp", "epoch", order, "seq").mapInArrow(run, schema), "replayed")
    of = lambda kind, columns: done.where(F.col("kind") == kind).select(*[f.name for f in StructType.fromDDL(columns)])

    # What no command names is there until the first clearing.
    end = F.lit(clears[0] if clears else None).cast("bigint")
    idle = slips.select(s(F.col("id")).alias("id"), F.col("id").alias("slip_id")).join(comp, "id", "left_anti")
    lives = of("life", LIFE).unionByName(idle.select("slip_id", F.col("slip_id").alias("origin"), none("string").alias("page_id"), none("bigint").alias("since"), end.alias("until"), none("map<string,string>").alias("edits")))
    still = at.select(p(F.col("page_id")).alias("id"), "page_id", "at").join(comp, "id", "left_anti")
    stays = of("stay", STAY).unionByName(still.select("page_id", F.col("at").alias("slip_id"), none("bigint").alias("since"), end.alias("until")))
    return Replay(of("outcome", OUTCOME), stays, lives)


def pages_now(pages: DataFrame, r: Replay) -> DataFrame:
    """Pages after the log, on the slip that each belongs to now."""
    now = r.stays.where("until IS NULL").select(F.col("page_id").alias("id"), F.col("slip_id").alias("__slip"))
    return pages.join(now, "id").withColumn("slip_id", F.col("__slip")).select(pages.columns)


def party_now(party: DataFrame, commands: DataFrame, r: Replay) -> DataFrame:
    """Party rows after the log: of pages that are left, under their slip, votes as last corrected by a command that acted,
    never below 0; what was read is kept beside."""
    acted = commands.where("action = 'override_party_votes'").join(r.outcomes.where("done").select("seq"), "seq", "left_semi")
    last = acted.groupBy(F.col("party_id").alias("id")).agg(F.max_by(F.struct("value", "user_id"), "seq").alias("__v"))
    now = r.stays.where("until IS NULL").select("page_id", F.col("slip_id").alias("__slip"))
    d = party.join(now, "page_id").join(last, "id", "left")
    read = F.coalesce("original_ocr_votes", "votes") if "original_ocr_votes" in party.columns else F.col("votes")
    has = F.col("__v").isNotNull()
    new = {"slip_id": F.col("__slip"), "original_ocr_votes": read, "votes": F.when(has, F.greatest(F.lit(0), F.expr("CAST(__v.value AS INT)"))).otherwise(F.col("votes")), "is_overridden": has | F.col("is_overridden"), "overridden_by": F.when(has, F.col("__v.user_id"))}
    return d.withColumns(new).select(*dict.fromkeys([*party.columns, *new]))


def _dressed(slips: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of slips from the origin of each row, with its edits; `keep` are columns of rows."""
    d = rows.join(slips.withColumnRenamed("id", "origin"), "origin")
    edited = {f: F.when(F.map_contains_key(F.coalesce("edits", F.create_map().cast("map<string,string>")), F.lit(f)), F.try_element_at("edits", F.lit(f)).cast(slips.schema[f].dataType)).otherwise(F.col(f)) for f in [*EDITABLE, "status"] if f in slips.columns}
    return d.withColumns(edited).select(*keep, *[c for c in slips.columns if c != "id"])


def decisions(slips: DataFrame, pages: DataFrame, party: DataFrame, commands: DataFrame, rules: DataFrame, r: Replay) -> DataFrame:
    """(seq, decision) of each approval that found its slip: `approved`, or the first gate that blocked, with slip, pages and
    party rows as they were at that command. All other approved slips count as twins by their state in the table."""
    asked = r.outcomes.where("origin IS NOT NULL").withColumn("id", F.col("seq").cast("string"))
    version = _dressed(slips, asked, ["id", "seq"])
    on = asked.select("id", "seq", F.explode("pages").alias("page_id"))
    then_pages = on.join(pages.drop("slip_id").withColumnRenamed("id", "page_id"), "page_id").withColumnRenamed("id", "slip_id").withColumnRenamed("page_id", "id")
    acted = commands.where("action = 'override_party_votes'").join(r.outcomes.where("done").select("seq"), "seq", "left_semi")
    then = on.join(party.drop("slip_id").withColumnRenamed("id", "party_id"), "page_id")
    fixed = then.select("id", "seq", "party_id").join(acted.select("party_id", F.col("seq").alias("s"), F.col("value").alias("v")), "party_id").where("s < seq").groupBy("id", "party_id").agg(F.max_by("v", "s").alias("v"))
    then = then.join(fixed, ["id", "party_id"], "left").withColumns({"votes": F.when(F.col("v").isNotNull(), F.greatest(F.lit(0), F.col("v").cast("int"))).otherwise(F.col("votes")), "is_overridden": F.col("v").isNotNull() | F.col("is_overridden")})
    then = then.drop("v", "seq").withColumnRenamed("id", "slip_id").withColumnRenamed("party_id", "id")
    whole, _ = rules_of.consolidate(version.drop("seq"), then_pages.drop("seq"), then)
    metrics = rules_of.slip_metrics(whole, then_pages.drop("seq"), then)
    found = rules_of.approval(metrics, rules_of.evaluate_rules(metrics, rules), then)
    return found.select(F.col("id").cast("bigint").alias("seq"), "decision")


def slips_now(slips: DataFrame, commands: DataFrame, r: Replay, approvals: DataFrame | None = None) -> DataFrame:
    """Slips after the log, with new ones of unlinked pages: fields as last edited in the slip's present life, the status of
    the last rejection, flag or approval in it that acted. With `approvals` (seq, decision) blocked ones don't count."""
    done = r.outcomes.where("done").select("seq")
    if approvals is not None:
        done = done.join(approvals.where("decision <> 'approved'").select("seq"), "seq", "left_anti")
    acted = commands.where(F.col("action").isin(*STATUS)).join(done, "seq", "left_semi").select("seq", "action", "slip_id", "reason", "user_id", "at")
    alive = r.lives.where("until IS NULL")
    in_life = acted.join(alive.select("slip_id", "since"), "slip_id").where("since IS NULL OR seq > since")
    last = in_life.groupBy("slip_id").agg(F.max_by(F.struct("action", "reason", "user_id", "at"), "seq").alias("s"))
    d = _dressed(slips, alive.join(last, "slip_id", "left"), ["slip_id", "page_id", "s"])
    action = F.col("s.action")
    table = lambda kv: F.element_at(F.create_map(*[F.lit(x) for pair in kv.items() for x in pair]), action)
    new = {"id": F.col("slip_id"), "status": F.coalesce(table(STATUS), "status"), "rejection_reason": F.when(action == "reject_slip", F.coalesce("s.reason", table(REASONS)))}
    new |= {"approved_by": F.when(action == "approve_slip", F.col("s.user_id")), "approved_at": F.when(action == "approve_slip", F.col("s.at"))}
    if "slip_reference" in slips.columns:
        new["slip_reference"] = F.when(F.col("page_id").isNotNull(), F.concat("slip_reference", F.lit("_unlinked_"), F.substring_index("slip_id", "_", -1))).otherwise(F.col("slip_reference"))
    return d.withColumns(new).select(*dict.fromkeys([*slips.columns, *(k for k in new if k != "slip_reference")]))


def refused(commands: DataFrame, r: Replay, approvals: DataFrame | None = None) -> DataFrame:
    """(seq, action, why) of commands that didn't act."""
    d = commands.select("seq", "action").join(r.outcomes.select("seq", "done", "why"), "seq")
    if approvals is not None:
        d = d.join(approvals.where("decision <> 'approved'"), "seq", "left").withColumns({"done": F.col("done") & F.col("decision").isNull(), "why": F.coalesce("why", "decision")})
    return d.where("NOT done").select("seq", "action", "why")


def audit_rows(commands: DataFrame, r: Replay) -> DataFrame:
    """(seq, slip_id, page_id, user_id, action, field_name, old_value, new_value, reason, at) of links, unlinks and removals
    that acted: of the slip a page was on and the one it went to."""
    moves = commands.where(F.col("action").isin("manual_link_page", "manual_unlink_page", "remove_page")).join(r.outcomes.where("done").select("seq", "party_slip"), "seq")
    to = r.stays.where("since IS NOT NULL").select("page_id", F.col("since").alias("seq"), F.col("slip_id").alias("to"))
    d = moves.join(to, ["page_id", "seq"], "left")
    gone = F.col("action") == "remove_page"
    name = F.when(gone, "remove_page_image").otherwise(F.col("action"))
    return d.select("seq", F.when(gone, F.col("party_slip")).otherwise(F.coalesce("to", "party_slip")).alias("slip_id"), "page_id", "user_id", name.alias("action"), F.when(gone, "page_image").otherwise("slip_id").alias("field_name"), F.when(~gone, F.col("party_slip")).alias("old_value"), F.when(~gone, F.coalesce("to", "party_slip")).alias("new_value"), "reason", "at")
