"""Queries over stored records and page plans, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.storage import written
from folio.operators import health, ingest, pageplan, workspace
from folio.plans.governed import _docs, _events, _pages, f7_mask_diagnostics
from folio.sources import derived, views


def _store(spark, sf_dir) -> dict[str, DataFrame]:
    return derived.store({n: views.table(spark, sf_dir, n) for n in ("documents", "events", "conversations")})


def h2_page_plan(spark, sf_dir):
    plan = pageplan.select_items(pageplan.page_plan(_pages(spark, sf_dir)), (2, 3, 5))
    plan = pageplan.rotate_items(plan, F.col("pos") % 2 == 0, 450)
    plan = pageplan.duplicate_items(plan, F.col("source_page") % 4 == 3)
    plan = pageplan.delete_items(plan, F.col("source_page") == 1)
    plan = pageplan.move_items(plan, F.col("source_page") % 5 == 4, 1)
    return pageplan.reverse_items(pageplan.reverse_items(plan, selected_only=True))


def h6_page_labels(spark, sf_dir):
    return pageplan.page_labels(_pages(spark, sf_dir), header="報告", footer="draft", page_numbers=True, start=4.5)


def _sized(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_number", F.when(F.col("doc_id") % 9 == 0, 100.0).otherwise(612.0).alias("width"), F.lit(792.0).alias("height"))


def h8_crop_report(spark, sf_dir):
    return pageplan.crop_report(_sized(spark, sf_dir), views.spans(_docs(spark, sf_dir)), top=80, right=20, bottom=30, left=75)


RECIPES = [
    (0, '{"schemaVersion": 1, "name": "legacy", "rotate": 90, "removeMetadata": true}'),
    (1, '{"schemaVersion": 2, "name": "blanks", "steps": [{"id": "a", "type": "blank-pages", "count": 30, "position": "end"}, {"id": "b", "type": "rotate", "degrees": 180}, {"id": "c", "type": "rotate", "degrees": 270}]}'),
    (2, '{"schemaVersion": 3, "name": "split", "steps": [{"id": "a", "type": "split-fixed", "pagesPerFile": 3}]}'),
    (3, '{"schemaVersion": 4, "name": "future", "steps": [{"id": "a", "type": "rotate", "degrees": 90}]}'),
    (4, "{not json"),
    (5, '{"schemaVersion": 3, "name": "odd", "steps": [{"id": "a", "type": "explode"}]}'),
    (6, '{"schemaVersion": 3, "name": "early", "steps": [{"id": "a", "type": "split-fixed", "pagesPerFile": 2}, {"id": "b", "type": "rotate", "degrees": 90}]}'),
    (7, '{"schemaVersion": 3, "name": " ", "steps": [{"id": "a", "type": "rotate", "degrees": 90}]}'),
    (8, '{"schemaVersion": 3, "name": "crop", "steps": [{"id": "a", "type": "crop", "topMm": 5, "rightMm": 200, "bottomMm": 5, "leftMm": 5}]}'),
]


def h9_run_recipe(spark, sf_dir):
    recipes = spark.createDataFrame(RECIPES, "recipe_id int, json string")
    sizes = _sized(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"), F.min("width").alias("width"), F.min("height").alias("height"))
    return pageplan.run_recipe(sizes.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 10).cast("int").alias("recipe_id"), "page_count", "width", "height"), recipes)


def j3_recover_transactions(spark, sf_dir):
    manifests = views.manifests(_docs(spark, sf_dir))
    kind = F.element_at(F.array(*map(F.lit, ["edit", "merge", "split", "rotate"])), (F.col("project_id") % 4 + 1).cast("int"))
    derived_ = manifests.select("project_id", "parent_id", (F.col("parent_id") * 10).alias("parent_revision_id"), kind.alias("operation"), (F.col("project_id") * 60).alias("created_at"))
    parent = F.floor(F.col("project_id") / 2).cast("long")
    asked = manifests.select((F.col("project_id") + 1).alias("transaction_id"), parent.alias("project_id"), F.when(F.col("project_id") % 3 == 0, "preparing").otherwise("committed").alias("status"), (F.col("project_id") * 60 - 90).alias("started_at"), F.when(F.col("project_id") % 6 == 0, parent * 10).alias("source_revision_id"), kind.alias("operation"))
    return health.recover_transactions(asked, derived_)


def j4_health_audit(spark, sf_dir):
    return health.health_audit(_store(spark, sf_dir))


def j5_repair(spark, sf_dir):
    tables = health.repair(_store(spark, sf_dir), ("orphan-ocr-jobs", "ocr-count", "orphan-assets", "orphan-workspace-events", "interrupted-job"))
    rows = lambda name, key, value: tables[name].select(F.lit(name).alias("store"), key.cast("string").alias("record"), value.cast("string").alias("value"))
    c = F.col
    out = rows("jobs", c("job_id"), c("completed_pages")).unionByName(rows("pages", F.concat_ws(":", c("job_id").cast("string"), c("page_number").cast("string")), c("status")))
    out = out.unionByName(rows("events", c("id"), c("project_id"))).unionByName(rows("projects", c("project_id"), c("interrupted_job")))
    return out.unionByName(rows("assets", F.concat_ws("/", c("project_id").cast("string"), c("asset_id")), F.lit(None)))


def j10_tab_state(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for pair in (("signup", "tab-opened"), ("view", "mode-changed"), ("purchase", "tab-pinned"), ("click", "tab-restored"), ("error", "tab-closed")) for x in pair))
    modes = F.when(F.col("event_type").isin("view", "error"), F.concat(F.lit("m"), F.col("event_id") % 4))
    project = F.when(~((F.col("event_type") == "click") & (F.col("event_id") % 5 == 0)), F.col("user_id") % 23)
    kind = F.when(F.col("event_id") % 31 == 0, "tab-unpinned").otherwise(kinds[F.col("event_type")])
    events = _events(spark, sf_dir).select((F.col("user_id") % 3).alias("workspace"), project.alias("project"), F.col("event_id").alias("id"), kind.alias("kind"), modes.alias("mode"), F.col("ts").alias("at"))
    return workspace.tab_state(events).withColumn("at", F.col("at").cast("timestamp_ntz"))


def _edits(spark, sf_dir):
    n = F.col("page_number")
    pages = _pages(spark, sf_dir)
    owner = F.concat(F.lit("o:"), n - 1)
    follows = (n % 4 == 3)
    edit_id = F.when(follows, F.concat(F.lit(workspace.FOLLOWS), owner, F.lit(":f"), n)).otherwise(F.concat(F.lit("e"), n))
    current = pages.select("doc_id", n.alias("position"), edit_id.alias("id"), F.concat(F.lit("o:"), n).alias("object_id"), F.when(n % 5 == 0, "image").otherwise("text").alias("kind"), follows.alias("follower"), "page_number")
    incoming = pages.where("(doc_id + page_number) % 3 = 0").select("doc_id", F.concat(F.lit("n"), n).alias("id"), F.concat(F.lit("o:"), n).alias("object_id"), F.when(n % 7 == 0, "image").otherwise("text").alias("kind"), F.lit(False).alias("follower"), "page_number")
    return current, incoming


def j12_merge_edits(spark, sf_dir):
    return workspace.merge_edits(*_edits(spark, sf_dir))


def j12_edit_conflicts(spark, sf_dir):
    current, incoming = _edits(spark, sf_dir)
    n = F.col("page_number")
    plans = incoming.select("doc_id", "object_id", F.array(F.concat(F.lit("o:"), n + 1), F.concat(F.lit("o:"), n + 2)).alias("followers"))
    return workspace.edit_conflicts(current, plans)


def j14_validate_packages(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("page_number")
    # what the rules need of a text, so that texts are read once
    docs = _docs(spark, sf_dir).where("text is not null")
    docs = written(docs.select("doc_id", F.octet_length("text").cast("long").alias("_size"), F.sha2(F.col("text").cast("binary"), 256).alias("_digest"), F.size(F.split("text", "\n")).alias("_lines")))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.floor((F.col("_lines") - 1) / views.LINES).cast("int") + 1)).alias("page_number"))
    placed = pages.join(docs.select("doc_id", "_size"), "doc_id")
    size, digest = F.col("_size"), F.col("_digest")
    packages = docs.select(d.alias("package_id"), size.alias("source_length"), (size + 10_000).alias("payload_length"), (size + 10_000 + F.when(d % 11 == 0, 1).otherwise(0)).alias("declared_length"), digest.alias("payload_checksum"), F.when(d % 13 == 0, "?").otherwise(digest).alias("declared_checksum"))
    assets = placed.where("page_number <= 12").select(d.alias("package_id"), F.when((d + n) % 17 == 0, " ").when((d + n) % 19 == 0, "a1").otherwise(F.concat(F.lit("a"), n)).alias("id"), (F.col("_size") + n * 100 - F.when((d + n) % 7 == 0, 150).otherwise(0)).alias("start"), F.lit(100).cast("long").alias("length"))
    objects = pages.select(d.alias("package_id"), F.concat(F.lit("o"), n).alias("id"), F.when(n % 2 == 0, "image").otherwise("text").alias("type"), F.concat(F.lit("a"), n).alias("asset_id"))
    jobs = docs.where("doc_id % 4 <> 0").select(d.alias("package_id"), F.lit("j1").alias("id"))
    scans = placed.where("page_number <= 3").select(d.alias("package_id"), F.lit("j1").alias("job_id"), F.when(d % 8 == 1, F.lit(1)).otherwise(n).alias("page_number"), F.when(n == 3, F.col("_size") + 9_950).alias("start"), F.when(n == 3, 100).cast("long").alias("length"))
    return workspace.validate_packages(packages, assets, objects, jobs, scans)


def s9_support_bundle(spark, sf_dir):
    issues = health.health_audit(_store(spark, sf_dir)).where("project_id is null").select("code", "severity", "records")
    logs = f7_mask_diagnostics(spark, sf_dir).where("position <= 2").select("id", "owner", "message")
    receipts = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), "event_id").alias("filename"), F.lit("report").alias("kind"))
    return ingest.support_bundle(issues, logs, receipts)


QUERIES = {f.__name__: f for f in (h2_page_plan, h6_page_labels, h8_crop_report, h9_run_recipe, j3_recover_transactions, j4_health_audit, j5_repair, j10_tab_state, j12_merge_edits, j12_edit_conflicts, j14_validate_packages, s9_support_bundle)}

_WITH = "with " + views.SQL + "," + derived.SQL
_ORPHANS = """, orphans as (select 'orphan-assets' as code, count(*) as records from st_assets a where not exists (select 1 from st_projects p where p.project_id = a.project_id)
    union all select 'orphan-ocr-jobs', count(*) from st_jobs a where a.project_id is not null and not exists (select 1 from st_projects p where p.project_id = a.project_id)
    union all select 'orphan-ocr-pages', count(*) from st_pages a where not exists (select 1 from st_jobs j where j.job_id = a.job_id) or (a.project_id is not null and not exists (select 1 from st_projects p where p.project_id = a.project_id))
    union all select 'orphan-workspace-events', count(*) from st_events a where not exists (select 1 from st_projects p where p.project_id = a.project_id)
    union all select 'orphan-workspace-checkpoints', count(*) from st_events a where event_type = 'purchase' and not exists (select 1 from st_projects p where p.project_id = a.project_id)
    union all select 'stale-workspace-tabs', count(*) from st_events a where event_type = 'signup' and not exists (select 1 from st_projects p where p.project_id = case when a.project_id % 3 = 0 then a.project_id + 10000000 else a.project_id end)
    union all select 'orphan-document-revisions', count(*) from st_revisions a where not exists (select 1 from st_projects p where p.project_id = a.project_id)
    union all select 'orphan-document-transactions', count(*) from st_transactions a where not exists (select 1 from st_projects p where p.project_id = a.project_id))"""
_EDITS = """, ed as (select doc_id, page_number, page_number as position, case when page_number % 4 = 3 then 'p2-reflow:o:' || (page_number - 1) || ':f' || page_number else 'e' || page_number end as id, 'o:' || page_number as object_id,
    case when page_number % 5 = 0 then 'image' else 'text' end as kind, page_number % 4 = 3 as follower from doc_pages),
    nw as (select doc_id, page_number, 'n' || page_number as id, 'o:' || page_number as object_id, case when page_number % 7 = 0 then 'image' else 'text' end as kind, false as follower from doc_pages where (doc_id + page_number) % 3 = 0)"""

ORACLES = {
    "h2_page_plan": _WITH + """, a as (select doc_id, page_number - 1 as pos, page_number as source_page, page_number::varchar as item_id, page_number in (2, 3, 5) as selected, case when page_number % 2 = 1 then 90 else 0 end as rotation from doc_pages),
        b as (select doc_id, pos, 0 as c, source_page, item_id, selected, rotation from a union all select doc_id, pos, 1, source_page, item_id || '-copy', true, rotation from a where source_page % 4 = 3),
        d as (select *, bool_and(source_page = 1) over (partition by doc_id) as lone from b), e as (select *, row_number() over (partition by doc_id order by pos, c) - 1 as p from d where source_page <> 1 or lone),
        f as (select *, source_page % 5 = 4 as moves, count(*) filter (source_page % 5 <> 4) over (partition by doc_id order by p) - 1 as r, count(*) filter (source_page % 5 <> 4 and p < 1) over (partition by doc_id) as first_at from e),
        g as (select *, row_number() over (partition by doc_id order by case when moves then 1 when r < first_at then 0 else 2 end, p) - 1 as q from f),
        s as (select doc_id, q, row_number() over (partition by doc_id order by q) as k, row_number() over (partition by doc_id order by q desc) as z from g where selected),
        t as (select g.* exclude (q), case when selected then y.q else g.q end as q from g left join s x on x.doc_id = g.doc_id and x.q = g.q left join s y on y.doc_id = x.doc_id and y.k = x.z)
        select doc_id, (row_number() over (partition by doc_id order by q desc) - 1)::int as pos, item_id, source_page, rotation, selected from t""",
    "h6_page_labels": _WITH + """ select doc_id, page_number, unnest(['header', 'footer', 'number']) as element, unnest(['報告', 'draft', (page_number + 4)::varchar]) as text, unnest(['center', 'left', 'right']) as align, unnest(['zh-Hans', null, null]) as language from doc_pages""",
    "h8_crop_report": _WITH + """, p as (select doc_id, page_number, 75.0::double as x0, 80.0::double as y0, case when doc_id % 9 = 0 then 100 - 20 else 592 end::double as x1, 762.0::double as y1, doc_id % 9 = 0 as small from doc_pages),
        h as (select p.doc_id, p.page_number, count(*) as hidden from p join boxes b using (doc_id, page_number) where b.x >= x1 or b.x + b.w <= x0 or b.y >= y1 or b.y + b.h <= y0 group by 1, 2)
        select doc_id, page_number, case when not small then x0 end as x0, case when not small then y0 end as y0, case when not small then x1 end as x1, case when not small then y1 end as y1, coalesce(hidden, 0) as hidden,
        case when small then 'Crop margins leave page ' || page_number || ' too small.' end as error from p left join h using (doc_id, page_number)""",
    "h9_run_recipe": _WITH + """, n as (select doc_id as item_id, (doc_id % 10)::int as recipe_id, count(*) as c from doc_pages group by 1),
        e as (select *, case recipe_id when 3 then 'This Batch recipe was created by a newer version.' when 4 then 'Recipe file is not valid JSON.' when 5 then 'Recipe JSON contains an unsupported processing step.' when 6 then 'Multi-output Batch steps must be the final recipe step.'
            when 7 then 'Recipe JSON is missing a name.' when 9 then 'No such recipe.' when 8 then case when item_id % 9 = 0 then 'Crop margins leave page 1 too small.' end end as error from n)
        select item_id, recipe_id, case when error is null then 'complete' else 'error' end as status, error, case when error is null then c + case when recipe_id = 1 then 20 else 0 end end as pages, case when error is null then c + case when recipe_id = 1 then 20 else 0 end end as expected_pages,
        case when error is null then case recipe_id when 0 then 90 when 1 then 90 else 0 end end as rotation, case when error is null then recipe_id <> 0 end as has_metadata, case when error is null then case when recipe_id = 2 then (c + 2) // 3 else 1 end end as files from e""",
    "j4_health_audit": _WITH + _ORPHANS + """, h as (select * from st_projects where stored_checksum is not null), d as (select job_id, count(*) as done from st_pages where status = 'complete' group by 1)
        select 'source-missing' as code, 'error' as severity, project_id, null::varchar as item, 1 as records, false as repairable from st_projects where stored_checksum is null
        union all select 'source-size', 'error', project_id, null, 1, false from h where stored_length <> byte_length union all select 'source-checksum', 'error', project_id, null, 1, false from h where stored_checksum <> checksum
        union all select 'editor-asset-missing', 'error', o.project_id, object_id, 1, false from st_objects o join h using (project_id) where type = 'image' and not exists (select 1 from st_assets a where a.project_id = o.project_id and a.asset_id = o.asset_id)
        union all select 'ocr-count', 'warning', j.project_id, j.job_id::varchar, 1, true from st_jobs j join h using (project_id) left join d using (job_id) where completed_pages <> coalesce(done, 0)
        union all select 'interrupted-job', 'warning', project_id, interrupted_job, 1, true from h where interrupted_job is not null union all select code, 'warning', null, null, records, true from orphans where records > 0""",
    "j5_repair": _WITH + """, j as (select * from st_jobs a where project_id is null or exists (select 1 from st_projects p where p.project_id = a.project_id)),
        g as (select * from st_pages a where (project_id is null or exists (select 1 from st_projects p where p.project_id = a.project_id)) and exists (select 1 from j where j.job_id = a.job_id)), d as (select job_id, count(*) as done from g where status = 'complete' group by 1)
        select 'jobs' as store, job_id::varchar as record, coalesce(done, 0)::varchar as value from j left join d using (job_id) union all select 'pages', job_id || ':' || page_number, status from g
        union all select 'events', id::varchar, project_id::varchar from st_events a where exists (select 1 from st_projects p where p.project_id = a.project_id) union all select 'projects', project_id::varchar, null from st_projects
        union all select 'assets', project_id || '/' || asset_id, null from st_assets a where exists (select 1 from st_projects p where p.project_id = a.project_id)""",
    # one event of every workspace a round, with the tabs as lists
    "j10_tab_state": """with recursive e as (select user_id % 3 as w, case when event_type = 'click' and event_id % 5 = 0 then null else user_id % 23 end as p,
            case when event_id % 31 = 0 then 'unpin' else map {'signup': 'open', 'view': 'open', 'purchase': 'pin', 'click': 'restore', 'error': 'close'}[event_type] end as k,
            case when event_type in ('view', 'error') then 'm' || event_id % 4 end as m, ts as a, row_number() over (partition by user_id % 3 order by ts, event_id) as n from events),
        f as (select distinct w, 0::bigint as n, []::struct(p bigint, m varchar, pin boolean, a timestamp)[] as tabs, []::struct(p bigint, m varchar, pin boolean, a timestamp)[] as closed, null::bigint as active from e
            union all select w, n, case when k = 'open' and tab is null then tabs || [{'p': p, 'm': m, 'pin': false, 'a': a}] when k = 'open' then list_transform(tabs, lambda t: case when t.p = p then {'p': t.p, 'm': coalesce(m, t.m), 'pin': t.pin, 'a': a} else t end)
                    when k = 'close' then others when k = 'restore' and hit is not null and not list_contains(list_transform(tabs, lambda t: t.p), hit.p) then tabs || [{'p': hit.p, 'm': hit.m, 'pin': hit.pin, 'a': a}]
                    when k in ('pin', 'unpin') then list_transform(tabs, lambda t: case when t.p = p then {'p': t.p, 'm': t.m, 'pin': k = 'pin', 'a': t.a} else t end) else tabs end,
                case when k = 'close' and tab is not null then ([{'p': p, 'm': tab.m, 'pin': tab.pin, 'a': a}] || list_filter(closed, lambda c: c.p <> p))[:8] when k = 'restore' and hit is not null then list_filter(closed, lambda c: c.p <> hit.p) else closed end,
                case when k = 'open' then p when k = 'close' and tab is not null and active = p then others[-1].p when k = 'restore' and hit is not null then hit.p else active end
            from (select f.w, e.n, e.p, e.k, e.m, e.a, tabs, closed, active, list_filter(tabs, lambda t: t.p = e.p)[1] as tab, list_filter(tabs, lambda t: t.p <> e.p) as others, list_filter(closed, lambda c: e.p is null or c.p = e.p)[1] as hit from f join e on e.w = f.w and e.n = f.n + 1)),
        z as (select * from f qualify row_number() over (partition by w order by n desc) = 1), o as (select w, active, unnest(tabs) as t, generate_subscripts(tabs, 1)::int as i from z), c as (select w, unnest(closed) as t, generate_subscripts(closed, 1)::int as i from z)
        select w as workspace, t.p as project, 'open' as state, i as position, t.m as mode, t.pin as pinned, coalesce(t.p = active, false) as active, t.a as "at" from o
        union all select w, t.p, 'closed', i, t.m, t.pin, false, t.a from c""",
    "j12_merge_edits": _WITH + _EDITS + """ select doc_id, id, object_id, kind, follower, page_number, 'current' as source from ed e where not exists (select 1 from nw n where n.doc_id = e.doc_id and (n.object_id = e.object_id or (n.kind = 'text' and starts_with(e.id, 'p2-reflow:' || n.object_id || ':'))))
        union all select doc_id, id, object_id, kind, follower, page_number, 'incoming' from nw""",
    "j12_edit_conflicts": _WITH + _EDITS + """, c as (select n.doc_id, n.object_id, e.id, 0 as k, e.position from nw n join ed e on e.doc_id = n.doc_id and e.object_id = n.object_id and e.kind = 'text' and e.follower and not starts_with(e.id, 'p2-reflow:' || n.object_id || ':')
        union all select n.doc_id, n.object_id, e.id, 1, e.position from nw n join ed e on e.doc_id = n.doc_id and e.page_number in (n.page_number + 1, n.page_number + 2) and not starts_with(e.id, 'p2-reflow:' || n.object_id || ':'))
        select doc_id, object_id, arg_min(id, (k, position)) as conflict_id from c group by 1, 2""",
    "j14_validate_packages": _WITH + """, d as (select doc_id, strlen(text) as z, sha256(text) as s from documents where text is not null),
        a as (select doc_id, page_number as n, case when (doc_id + page_number) % 17 = 0 then ' ' when (doc_id + page_number) % 19 = 0 then 'a1' else 'a' || page_number end as id, z, z + page_number * 100 - case when (doc_id + page_number) % 7 = 0 then 150 else 0 end as b, 100 as len from doc_pages join d using (doc_id) where page_number <= 12),
        g as (select doc_id, page_number as o, case when doc_id % 8 = 1 then 1 else page_number end as n, z, case when page_number = 3 then z + 9950 end as b, 100 as len from doc_pages join d using (doc_id) where page_number <= 3),
        r as (select doc_id, 'asset ' || id as item, z, b, len from a union all select doc_id, 'page j1:' || n, z, b, len from g where b is not null),
        l as (select *, max(b + len) over (partition by doc_id order by b, b + len, item rows between unbounded preceding and 1 preceding) as before from r where b >= 0)
        select doc_id as package_id, 'asset-id-blank' as rule, null::varchar as item from a where trim(id) = '' union all select doc_id, 'asset-id-duplicated', id from a where trim(id) <> '' group by 1, 3 having count(*) > 1
        union all select p.doc_id, 'asset-missing', 'o' || page_number from doc_pages p where page_number % 2 = 0 and not exists (select 1 from a where a.doc_id = p.doc_id and a.id = 'a' || p.page_number)
        union all select doc_id, 'job-missing', 'j1:' || n from g where doc_id % 4 = 0 union all select doc_id, 'page-duplicated', 'j1:' || n from g group by doc_id, n having count(*) > 1
        union all select doc_id, 'range-invalid', item from r where b < 0 union all select doc_id, 'range-in-source', item from r where b >= 0 and b < z union all select doc_id, 'range-truncated', item from r where b >= z and b + len > z + 10000 union all select doc_id, 'range-overlaps', item from l where b < before
        union all select doc_id, 'payload-length', null from d where doc_id % 11 = 0 union all select doc_id, 'payload-checksum', null from d where doc_id % 13 = 0""",
    "s9_support_bundle": _WITH + _ORPHANS + """, l as (select user_id as owner, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events where event_type = 'error'),
        m as (select owner, id, case id % 4 when 0 then '([blob-url]) lost' when 1 then 'open [file-url]' when 2 then 'read [local-path] failed' else 'value [long-value] of ' || id end as message from l where position <= 2)
        select 'storageHealth' as section, code as key, to_json({'code': code, 'records': records, 'severity': 'warning'})::varchar as body from orphans where records > 0 union all select 'diagnostics', id::varchar, to_json({'id': id, 'message': message, 'owner': owner})::varchar from m
        union all select 'activity', event_id::varchar, to_json({'filename': '[filename omitted]', 'id': event_id, 'kind': 'report'})::varchar from events where event_type = 'purchase'""",
}
