"""Tabs of workspaces, queues of edits, and the rules of project packages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.scans import before

# fixed values: closed tabs that are kept, and the events that change tabs
CLOSED = 8
KINDS = ("tab-opened", "tab-closed", "tab-restored", "mode-changed", "tab-pinned", "tab-unpinned", "tabs-reordered")
# fixed value: how the id of an edit begins that follows another object's edit
FOLLOWS = "p2-reflow:"


def tab_state(events: DataFrame, most: int = CLOSED) -> DataFrame:
    """workspace, project, state (open or closed), position (from 1), mode, pinned, active, at of events(workspace, project, id, kind, mode, at).

    Events are folded in the order of at and id. tab-opened and mode-changed open a project's tab behind the others if it
    is not open, set its mode and make it active; tab-closed puts an open tab on top of the closed ones, of which the
    newest ``most`` are kept at every close, so that one pushed out never returns, and the last tab gets active where the
    closed one was; tab-restored takes a project, or the newest where it is null, from the closed ones and opens it with the
    mode and pin it had; tab-pinned and tab-unpinned mark an open tab; tabs-reordered puts the open tabs of ``order``, an
    optional column of projects, first. Opening does not take a project from the closed ones. Other kinds change nothing.
    at is when a tab became active or was closed. Open tabs are in their order, closed ones newest first.

    A workspace's events go through one task in batches; only its tabs are held. Events without a workspace are one, those
    without a time come first.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    order = F.col("order") if "order" in types else F.lit(None).cast(f"array<{types['project']}>")
    rows = events.where(F.col("kind").isin(*KINDS)).select("workspace", "project", "id", "kind", "mode", "at", order.alias("order"))
    rows = rows.repartition("workspace").sortWithinPartitions(F.col("workspace").asc_nulls_first(), F.col("at").asc_nulls_first(), "id")
    schema = f"workspace {types['workspace']}, project {types['project']}, state string, position int, mode string, pinned boolean, active boolean, at {types['at']}"
    names = ["workspace", "project", "state", "position", "mode", "pinned", "active", "at"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tabs, now = None, None, ()
        arrow = None
        for batch in batches:
            done: list[tuple] = []
            arrow = arrow or pa.schema([(n, t) for n, t in zip(names, [batch.schema.field("workspace").type, batch.schema.field("project").type, pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), batch.schema.field("at").type])])
            for workspace, project, kind, mode, at, wanted in zip(*(batch.column(c).to_pylist() for c in ("workspace", "project", "kind", "mode", "at", "order"))):
                if tabs is None or (workspace,) != now:
                    done += [(out, *row) for row in tabs.rows()] if tabs else []
                    tabs, now, out = _Tabs(most), (workspace,), workspace
                tabs.take(kind, project, mode, at, wanted or [])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=arrow)
        if tabs:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (out, *r))) for r in tabs.rows()], schema=arrow)

    return rows.mapInArrow(fold, schema)


class _Tabs:
    """The open tabs of a workspace in order, and the closed ones, newest first."""

    def __init__(self, most: int) -> None:
        self.most, self.open, self.closed, self.active = most, {}, [], None

    def take(self, kind: str, project, mode, at, order: list) -> None:
        tab = self.open.get(project)
        if kind in ("tab-opened", "mode-changed"):
            tab = self.open.setdefault(project, {"mode": None, "pinned": False})
            tab |= {"mode": tab["mode"] if mode is None else mode, "at": at}
            self.active = (project,)
        elif kind == "tab-closed" and tab:
            del self.open[project]
            self.closed = [(project, tab | {"at": at}), *(c for c in self.closed if c[0] != project)][: self.most]
            if self.active == (project,):
                self.active = (list(self.open)[-1],) if self.open else None
        elif kind == "tab-restored":
            found = next((c for c in self.closed if project is None or c[0] == project), None)
            if found:
                self.closed.remove(found)
                self.open.setdefault(found[0], found[1] | {"at": at})
                self.active = (found[0],)
        elif kind in ("tab-pinned", "tab-unpinned") and tab:
            tab["pinned"] = kind == "tab-pinned"
        elif kind == "tabs-reordered":
            first = {p: self.open[p] for p in order if p in self.open}
            self.open = first | {p: t for p, t in self.open.items() if p not in first}

    def rows(self) -> list[tuple]:
        opened = [(p, "open", i, t["mode"], t["pinned"], self.active == (p,), t["at"]) for i, (p, t) in enumerate(self.open.items(), 1)]
        return opened + [(p, "closed", i, t["mode"], t["pinned"], False, t["at"]) for i, (p, t) in enumerate(self.closed, 1)]


def _owners(edit_id: Column) -> Column:
    """Every object id that an edit with this id could follow: what stands between the beginning and one of the colons."""
    parts = F.split(F.substring(edit_id, len(FOLLOWS) + 1, 1 << 30), ":")
    ends = F.when(edit_id.startswith(FOLLOWS) & (F.size(parts) > 1), F.sequence(F.lit(1), F.size(parts) - 1))
    return F.transform(ends, lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))


def merge_edits(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_id, id, object_id, kind, follower, page_number, source (current or incoming) of the queue after a batch of edits.

    Incoming edits replace all edits of their objects, and a text edit that is no follower itself removes the edits
    that follow its object.
    """
    columns = ["doc_id", "id", "object_id", "kind", "follower", "page_number"]
    objects = incoming.select("doc_id", "object_id").distinct()
    leaders = incoming.where("kind = 'text' and not coalesce(follower, false)").select("doc_id", F.col("object_id").alias("_owner")).distinct()
    followers = current.select("doc_id", "id", F.explode(_owners(F.col("id"))).alias("_owner")).join(leaders, ["doc_id", "_owner"], "left_semi").select("doc_id", "id").distinct()
    kept = current.join(objects, ["doc_id", "object_id"], "left_anti").join(followers, ["doc_id", "id"], "left_anti")
    return kept.select(*columns, F.lit("current").alias("source")).unionByName(incoming.select(*columns, F.lit("incoming").alias("source")))


def edit_conflicts(current: DataFrame, plans: DataFrame) -> DataFrame:
    """doc_id, object_id, conflict_id: the first edit of current(doc_id, position, id, object_id, kind, follower) in the way of plans(doc_id, object_id, followers).

    A text edit that makes the object follow another comes first, then any edit of its followers that is not its own.
    """
    own = F.concat(F.lit(FOLLOWS), F.col("plan_object"), F.lit(":"))
    asked = plans.select("doc_id", F.col("object_id").alias("plan_object"), "followers")
    edits = current.select("doc_id", "position", "id", F.col("object_id").alias("edit_object"), "kind", "follower")
    selected = asked.select("doc_id", "plan_object", F.col("plan_object").alias("edit_object")).join(edits.where("kind = 'text' and follower"), ["doc_id", "edit_object"]).withColumn("_rank", F.lit(0))
    foreign = asked.select("doc_id", "plan_object", F.explode(F.array_distinct("followers")).alias("edit_object")).join(edits, ["doc_id", "edit_object"]).withColumn("_rank", F.lit(1))
    both = selected.unionByName(foreign).where(~F.col("id").startswith(own))
    return both.groupBy("doc_id", F.col("plan_object").alias("object_id")).agg(F.min_by("id", F.struct("_rank", "position")).alias("conflict_id"))


def changed_pages(edits: DataFrame) -> DataFrame:
    """doc_id, page_number of the pages with edits."""
    return edits.select("doc_id", "page_number").distinct()


def validate_packages(packages: DataFrame, assets: DataFrame, objects: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """package_id, rule, item of every rule that a package breaks.

    packages(package_id, source_length, payload_length, declared_length, payload_checksum, declared_checksum),
    assets(package_id, id, start, length), objects(package_id, id, type, asset_id), jobs(package_id, id),
    pages(package_id, job_id, page_number, start, length); a page may have no range. Rules: ids are not blank and
    unique, references exist, a page of a job comes once, ranges begin after the source, end in the payload and do
    not begin before an earlier one ends, length and checksum are as declared. A package's ranges are spread over tasks.
    """
    told = lambda rows, *found: rows.select("package_id", F.inline(F.filter(F.array(*found), lambda b: b["rule"].isNotNull())))
    breaks = lambda rule, item, when=None: F.struct((F.lit(rule) if when is None else F.when(when, rule)).alias("rule"), item.cast("string").alias("item"))
    none = F.lit(None)
    # each table is counted by its keys once
    ids = [rows.select("package_id", F.lit(name).alias("_name"), F.when(F.trim("id") != "", F.col("id")).alias("_id")) for name, rows in (("asset", assets), ("object", objects), ("job", jobs))]
    ids = ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("package_id", "_name", "_id").agg(F.count("*").cast("int").alias("_n")).where("_id is null or _n > 1")
    times = F.when(F.col("_id").isNull(), F.col("_n")).otherwise(1)
    rule = F.concat("_name", F.when(F.col("_id").isNull(), "-id-blank").otherwise("-id-duplicated"))
    parts = [ids.select("package_id", rule.alias("rule"), F.col("_id").cast("string").alias("item"), F.explode(F.sequence(F.lit(1), times))).drop("col")]
    key = lambda rows, name: rows.select("package_id", F.col("id").alias(name)).distinct()
    parts.append(told(objects.where("type = 'image'").join(key(assets, "asset_id"), ["package_id", "asset_id"], "left_anti"), breaks("asset-missing", F.col("id"))))
    page = F.concat_ws(":", "job_id", F.col("page_number").cast("string"))
    parts.append(told(pages.join(key(jobs, "job_id"), ["package_id", "job_id"], "left_anti"), breaks("job-missing", page)))
    counted = pages.groupBy("package_id", "job_id", "page_number").agg(F.count("*").cast("int").alias("_n"))
    wrong = F.when(~F.coalesce(F.col("page_number") > 0, F.lit(False)), F.array_repeat(F.lit("page-number"), F.col("_n"))).otherwise(F.array().cast("array<string>"))
    twice = F.when(F.col("_n") > 1, F.array(F.lit("page-duplicated"))).otherwise(F.array().cast("array<string>"))
    parts.append(counted.select("package_id", F.explode(F.concat(wrong, twice)).alias("rule"), page.alias("item")))
    label = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
    ranges = assets.select("package_id", label("asset", F.col("id")).alias("item"), "start", "length").unionByName(pages.where("start is not null or length is not null").select("package_id", label("page", page).alias("item"), "start", "length"))
    held = ranges.join(packages.select("package_id", "source_length", "payload_length"), "package_id")
    whole = F.coalesce((F.col("start") >= 0) & (F.col("length") > 0), F.lit(False))
    # ranges that are not whole have no end, so they overlap nothing
    laid = held.withColumn("_whole", whole).withColumn("_end", F.when(F.col("_whole"), F.col("start") + F.col("length"))).withColumn("_row", F.monotonically_increasing_id())
    laid = before(laid, ["package_id"], ["start", "_end", "item", "_row"], _before=(F.max, F.col("_end")))
    after = F.col("start") >= F.col("source_length")
    item, ok = F.col("item"), F.col("_whole")
    parts.append(told(laid, breaks("range-invalid", item, ~ok), breaks("range-in-source", item, ok & (F.col("start") < F.col("source_length"))), breaks("range-truncated", item, ok & after & (F.col("_end") > F.col("payload_length"))), breaks("range-overlaps", item, ok & (F.col("start") < F.col("_before")))))
    same = lambda name: F.col(f"declared_{name}").eqNullSafe(F.col(f"payload_{name}"))
    parts.append(told(packages, breaks("payload-length", none, ~same("length")), breaks("payload-checksum", none, ~same("checksum"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
