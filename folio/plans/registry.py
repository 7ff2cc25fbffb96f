"""All registered queries of the library itself, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import assembly, compare, integrity, records, search
from folio.plans import compared, filed, governed, measured, paired, stored, structured
from folio.sources import views


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_pages(views.table(spark, sf_dir, "documents"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))


def _prints(pages: DataFrame) -> DataFrame:
    return integrity.object_fingerprints(views.page_objects(pages))


def c1_search_pages(spark, sf_dir):
    return search.search_pages(_pages(spark, sf_dir), "the", whole_word=True)


def d1_page_presence(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return compare.page_presence(pages, views.revised_pages(pages))


def d2_text_fingerprint(spark, sf_dir):
    return compare.text_fingerprint(_pages(spark, sf_dir)).select("doc_id", "page_number", F.length("normalized").alias("n_chars"), F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def d3_page_similarity(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return compare.page_similarity(pages, views.revised_pages(pages))


def e1_object_fingerprints(spark, sf_dir):
    return _prints(_pages(spark, sf_dir))


def e2_category_digests(spark, sf_dir):
    return integrity.category_digests(_prints(_pages(spark, sf_dir)))


def e3_contract_verdict(spark, sf_dir):
    return integrity.contract_verdict(e3_compare_contract(spark, sf_dir))


def e3_compare_contract(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    policy = spark.createDataFrame([("text", "preserve"), ("pages", "remove")], "category string, rule string")
    return integrity.compare_contract(integrity.category_digests(_prints(pages)), integrity.category_digests(_prints(views.revised_pages(pages))), policy, "edit")


def e4_fingerprint_delta(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return integrity.fingerprint_delta(_prints(pages), _prints(views.revised_pages(pages)))


def h1_select_pages(spark, sf_dir):
    choices = F.array(*map(F.lit, ["all,!last", "1-3,odd", "last-2", "!even", "2,99", "x"]))
    counts = _counts(spark, sf_dir)
    return assembly.select_pages(counts.withColumn("expression", F.element_at(choices, (F.col("doc_id") % 6 + 1).cast("int"))))


def h4_imposition(spark, sf_dir):
    return assembly.imposition(_counts(spark, sf_dir))


def h4_imposition_4up(spark, sf_dir):
    return assembly.imposition(_counts(spark, sf_dir), "4-up").unionByName(assembly.imposition(_counts(spark, sf_dir), "2-up").withColumn("side", F.col("side") + 1000))


def h4_imposition_rtl(spark, sf_dir):
    return assembly.imposition(_counts(spark, sf_dir), direction="rtl")


def s7_split_fixed(spark, sf_dir):
    return assembly.split_fixed(_pages(spark, sf_dir), 4)


def j1_dedupe_by_checksum(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    stored = F.concat("checksum", F.when(F.col("project_id") % 19 == 0, "x").otherwise(""))
    return records.dedupe_by_checksum(docs, views.manifests(docs).withColumn("stored_checksum", stored))


def j6_storage_budget(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("_n", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    use = docs.groupBy("source", "_n").agg(F.sum(F.octet_length("text")).alias("usage"))
    quota = F.when(F.col("_n") % 4 == 0, None).when(F.col("_n") % 4 == 1, F.col("usage") + 1).when(F.col("_n") % 4 == 2, F.col("usage") + 20_000_000).otherwise(F.col("usage") + 900_000_000)
    asked = use.select("source", F.lit(1_000_000).alias("requested"), "usage", quota.cast("long").alias("quota"))
    return records.storage_budget(asked)


def j7_budget_classes(spark, sf_dir):
    sizes = views.table(spark, sf_dir, "documents").select(F.size(F.split("text", "\n")).alias("page_count"), F.octet_length("text").cast("long").alias("byte_length"))
    return records.budget_classes(sizes)


def _receipts(spark, sf_dir):
    ends = F.array(*map(F.lit, ["pdf", "json", "CSV", "backup", "bin"]))
    events = views.table(spark, sf_dir, "events")
    name = F.concat(F.lit("f"), F.col("event_id"), F.lit("."), F.element_at(ends, (F.col("event_id") % 5 + 1).cast("int")))
    digest = F.when(F.col("event_id") % 13 != 0, F.sha2(F.col("event_id").cast("string").cast("binary"), 256))
    return events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("schema_version"), digest.alias("sha256"), name.alias("filename"), F.lit("").alias("mime_type"), F.col("ts").alias("created_at"))


def j8_activity_receipts(spark, sf_dir):
    return records.activity_receipts(_receipts(spark, sf_dir), 10).select("owner", "position", "id", "kind")


def j8_activity_receipts_full(spark, sf_dir):
    return records.activity_receipts(_receipts(spark, sf_dir)).select("owner", "position", "id", "kind")


def _timeline(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))


def j9_event_timeline(spark, sf_dir):
    return records.event_timeline(_timeline(spark, sf_dir), 20).select("project", "position", "id", "kind")


def j9_event_timeline_full(spark, sf_dir):
    return records.event_timeline(_timeline(spark, sf_dir)).select("project", "position", "id", "kind")


def j11_merge_history(spark, sf_dir):
    key = F.when(F.col("event_id") % 10 != 0, F.col("event_type"))
    entries = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at_ms"), key.alias("merge_key"))
    return records.merge_history(entries)


QUERIES = {f.__name__: f for f in (c1_search_pages, d1_page_presence, d2_text_fingerprint, d3_page_similarity, e1_object_fingerprints, e2_category_digests, e3_compare_contract, e3_contract_verdict, e4_fingerprint_delta, h1_select_pages, h4_imposition, h4_imposition_4up, h4_imposition_rtl, s7_split_fixed, j1_dedupe_by_checksum, j6_storage_budget, j7_budget_classes, j8_activity_receipts, j8_activity_receipts_full, j9_event_timeline, j9_event_timeline_full, j11_merge_history)} | governed.QUERIES | compared.QUERIES | paired.QUERIES | structured.QUERIES | stored.QUERIES | measured.QUERIES | filed.QUERIES

_WITH = "with " + views.SQL
_PRINTS = r""", prints as (select doc_id, category, object_id, sha256(category || '|' || object_id || '|' || value) as digest from page_objects),
rprints as (select doc_id, category, object_id, sha256(category || '|' || object_id || '|' || value) as digest from revised_objects),
digests as (select doc_id, category, count(*) as object_count, sha256(string_agg(digest, '|' order by digest)) as digest from prints group by all),
rdigests as (select doc_id, category, count(*) as object_count, sha256(string_agg(digest, '|' order by digest)) as digest from rprints group by all)"""
_FINGER = r""", f as (select *, left(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), 5000) as normalized from (select 'l' as side, * from doc_pages union all select 'r', * from revised_pages)),
t as (select side, doc_id, page_number, w, min(i) as i from (select side, doc_id, page_number, unnest(string_split(normalized, ' ')) as w, generate_subscripts(string_split(normalized, ' '), 1) as i from f) where length(w) >= 2 group by all),
k as (select side, doc_id, page_number, list(w order by i)[1:64] as tokens from t group by all),
p as (select f.side, f.doc_id, f.page_number, normalized, coalesce(tokens, []) as tokens from f left join k using (side, doc_id, page_number))"""

ORACLES = {
    "c1_search_pages": _WITH + r""", h as (select *, len(regexp_extract_all(text, '(?i)\bthe\b')) as match_count, instr(lower(text), 'the') - 1 as pos from doc_pages)
        select doc_id, page_number, match_count, (case when greatest(0, pos - 70) > 0 then '…' else '' end) || substring(text, greatest(0, pos - 70) + 1, least(length(text), pos + 103) - greatest(0, pos - 70))
        || (case when least(length(text), pos + 103) < length(text) then '…' else '' end) as snippet from h where match_count > 0""",
    "d1_page_presence": _WITH + """ select doc_id, page_number, l.doc_id is not null as in_left, r.doc_id is not null as in_right from doc_pages l full join revised_pages r using (doc_id, page_number)""",
    "d2_text_fingerprint": _WITH + _FINGER + """ select doc_id, page_number, length(normalized) as n_chars, len(tokens) as n_tokens, array_to_string(tokens, ' ') as tokens from p where side = 'l'""",
    "d3_page_similarity": _WITH + _FINGER + """ select l.doc_id, l.page_number, round(case when l.normalized = r.normalized and length(l.normalized) >= 8 then 1.0 when l.normalized = '' or r.normalized = '' then 0.0
        else least(1.0, len(list_intersect(l.tokens, r.tokens))::double / greatest(len(list_distinct(l.tokens || r.tokens)), 1) * 0.78::double
        + least(length(l.normalized), length(r.normalized))::double / greatest(length(l.normalized), length(r.normalized)) * 0.22::double) end, 6)::double as similarity
        from p l join p r on l.doc_id = r.doc_id and l.page_number = r.page_number and l.side = 'l' and r.side = 'r'""",
    "e1_object_fingerprints": _WITH + _PRINTS + " select * from prints",
    "e2_category_digests": _WITH + _PRINTS + " select * from digests",
    "e3_compare_contract": _WITH + _PRINTS + """, b as (select doc_id, category, coalesce(s.object_count, 0) as a, coalesce(o.object_count, 0) as z, s.digest as x, o.digest as y from digests s full join rdigests o using (doc_id, category)),
        c as (select doc_id, category, case when category = 'text' and a <> z then 'count' when category = 'text' and x is distinct from y then 'objects' when category = 'pages' and z <> 0 then 'not removed' else '' end as detail from b)
        select doc_id, category, case when detail = '' then 'passed' else 'failure' end as outcome, detail from c""",
    "e3_contract_verdict": _WITH + _PRINTS + """, b as (select doc_id, category, coalesce(s.object_count, 0) as a, coalesce(o.object_count, 0) as z, s.digest as x, o.digest as y from digests s full join rdigests o using (doc_id, category)),
        c as (select doc_id, (category = 'text' and (a <> z or x is distinct from y)) or (category = 'pages' and z <> 0) as bad from b)
        select doc_id, count(*) filter (bad) as failures, 0 as warnings, count(*) filter (bad) = 0 as passed from c group by 1""",
    "e4_fingerprint_delta": _WITH + _PRINTS + """, b as (select doc_id, category, object_id, case when o.digest is null then 'missing' when s.digest is null then 'added' when s.digest <> o.digest then 'modified' end as change
        from prints s full join rprints o using (doc_id, category, object_id)), n as (select *, row_number() over (partition by doc_id, category order by change = 'added', object_id) as position from b where change is not null)
        select doc_id, category, position, object_id, change from n where position <= 3""",
    "h1_select_pages": _WITH + """, n as (select doc_id, count(*)::int as c from doc_pages group by 1), s as (select doc_id, c, (doc_id % 6)::int as k, unnest(range(1, c + 1))::int as page_number from n)
        select doc_id, page_number, null::varchar as error from s where (k = 0 and page_number < c) or (k = 1 and (page_number <= 3 or page_number % 2 = 1)) or (k = 2 and page_number between least(2, c) and greatest(2, c))
        or (k = 3 and page_number % 2 = 1) or (k = 4 and (page_number = 2 or page_number = 99)) union all
        select doc_id, null, 'Page 99 is outside 1-' || c || '.' from n where doc_id % 6 = 4 and c < 99 union all select doc_id, null, 'Page 2 is outside 1-' || c || '.' from n where doc_id % 6 = 4 and c < 2
        union all select doc_id, null, 'Unsupported token: x' from n where doc_id % 6 = 5""",
    "h4_imposition": _WITH + """, n as (select doc_id, count(*)::int as c, ((count(*) + 3) // 4 * 4)::int as p from doc_pages group by 1), s as (select *, unnest(range(0, p // 2))::int as side from n), t as (select *, unnest([0, 1])::int as slot from s),
        u as (select *, case when (side % 2 = 0) = (slot = 0) then p - side else side + 1 end as q from t) select doc_id, side, slot, case when q <= c then q end::int as page_number from u""",
    "h4_imposition_4up": _WITH + """, n as (select doc_id, count(*)::int as c from doc_pages group by 1), u as (select doc_id, c, per, unnest(range(0, (c + per - 1) // per))::int as side from n, (select unnest([4, 2]) as per)), v as (select *, unnest(range(0, per))::int as slot from u)
        select doc_id, (side + case when per = 2 then 1000 else 0 end)::int as side, slot, case when side * per + slot + 1 <= c then side * per + slot + 1 end::int as page_number from v""",
    "h4_imposition_rtl": _WITH + """, n as (select doc_id, count(*)::int as c, ((count(*) + 3) // 4 * 4)::int as p from doc_pages group by 1), s as (select *, unnest(range(0, p // 2))::int as side from n), t as (select *, unnest([0, 1])::int as slot from s),
        u as (select *, case when (side % 2 = 0) = (slot = 1) then p - side else side + 1 end as q from t) select doc_id, side, slot, case when q <= c then q end::int as page_number from u""",
    "s7_split_fixed": _WITH + """ select doc_id, ((page_number - 1) // 4)::int as chunk, printf('pages-%04d-%04d', min(page_number), max(page_number)) as name, min(page_number) as first_page, max(page_number) as last_page, count(*) as page_count from doc_pages group by 1, 2""",
    "j1_dedupe_by_checksum": """with d as (select doc_id, sha256(coalesce(text, '')) as checksum from documents), f as (select checksum, min(doc_id) as p from d where doc_id % 5 < 3 group by 1)
        select doc_id, checksum, case when p % 19 <> 0 then p else doc_id end as project_id, coalesce(p % 19 <> 0, false) as reused from d left join f using (checksum)""",
    "j6_storage_budget": """with u as (select source, regexp_extract(source, '([0-9]+)$', 1)::int as n, sum(strlen(text))::bigint as usage from documents group by 1, 2),
        q as (select source, 1000000 as requested, usage, case n % 4 when 0 then null when 1 then usage + 1 when 2 then usage + 20000000 else usage + 900000000 end as quota from u)
        select source, requested, usage, quota, 1080000::bigint as required, case when quota is not null then greatest(25000000, ceil(quota * 0.05::double))::bigint end as reserve,
        case when quota is null then 'warning' when quota - usage - 1080000 < 0 then 'blocked' when quota - usage - 1080000 < greatest(25000000, ceil(quota * 0.05::double)) then 'warning' else 'ok' end as status from q""",
    "j7_budget_classes": """select case when len(string_split(text, chr(10))) >= 1000 or strlen(text) >= 500000000 then 'extreme' when len(string_split(text, chr(10))) >= 250 or strlen(text) >= 100000000 then 'large' else 'normal' end as budget_class,
        count(*) as documents, sum(strlen(text))::bigint as bytes from documents group by 1""",
    "j8_activity_receipts": """with r as (select user_id as owner, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events where event_id % 11 <> 0 and event_id % 13 <> 0)
        select owner, position, id, ['document-output', 'report', 'report', 'backup', 'other'][id % 5 + 1] as kind from r where position <= 10""",
    "j9_event_timeline": """with r as (select user_id as project, event_id as id, event_type as kind, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events) select project, position, id, kind from r where position <= 20""",
    "j8_activity_receipts_full": """with r as (select user_id as owner, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events where event_id % 11 <> 0 and event_id % 13 <> 0)
        select owner, position, id, ['document-output', 'report', 'report', 'backup', 'other'][id % 5 + 1] as kind from r where position <= 300""",
    "j9_event_timeline_full": """with r as (select user_id as project, event_id as id, event_type as kind, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events) select project, position, id, kind from r where position <= 100""",
    "j11_merge_history": """with e as (select user_id as owner, event_id as id, epoch_us(ts) // 1000000 as at_ms, case when event_id % 10 <> 0 then event_type end as merge_key from events),
        g as (select *, case when merge_key = lag(merge_key) over w and at_ms - lag(at_ms) over w < 800 then 0 else 1 end as s from e window w as (partition by owner order by at_ms, id)),
        h as (select *, sum(s) over (partition by owner order by at_ms, id) as grp from g), m as (select owner, grp, arg_max(id, (at_ms, id)) as id, arg_max(coalesce(merge_key, chr(0)), (at_ms, id)) as merge_key, count(*) as merged from h group by 1, 2),
        n as (select *, row_number() over (partition by owner order by grp desc) - 1 as position from m) select owner, position, id, nullif(merge_key, chr(0)) as merge_key, merged from n where position <= 80""",
} | governed.ORACLES | compared.ORACLES | paired.ORACLES | structured.ORACLES | stored.ORACLES | measured.ORACLES | filed.ORACLES


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.d4_similar_pages(spark, sf_dir)
