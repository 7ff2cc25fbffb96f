"""Records, page plans, samples, images and the cases that results once got wrong."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import assembly, compare, compliance, fidelity, health, images, ingest, pageplan, records, search, similar, workspace
from folio.streaming import flows


def test_matches_fold_case_of_any_letter(spark):
    pages = spark.createDataFrame([(1, 1, "École ÉCOLE école"), (2, 1, "a" * 80 + " Straße école " + "b" * 120), (3, 1, "other")], "doc_id long, page_number int, text string")
    found = {r.doc_id: (r.match_count, r.snippet) for r in search.search_pages(pages, "école").collect()}
    assert found[1] == (3, "École ÉCOLE école") and found[2][0] == 1 and found[2][1].startswith("…") and "école" in found[2][1]
    asked = spark.createDataFrame([("école",), ("—",), ("e é",), ("STRASSE",)], "query string")
    rows = search.search_many(spark.createDataFrame([(1, 1, "École e é — x—y")], "doc_id long, page_number int, text string"), asked, whole_word=False).collect()
    assert {r["query"]: r.match_count for r in rows} == {"école": 1, "—": 2, "e é": 1}


def test_fingerprints_are_normal(spark):
    pages = spark.createDataFrame([(1, "ﬁne Ｆｕｌｌ x² ﬁ"), (2, "plain Text"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.n for r in pages.select("doc_id", compare.normal_text(F.col("text")).alias("n")).collect()}
    assert found == {1: "fine full x2 fi", 2: "plain text", 3: None}


def test_fingerprints_read_pages_once(spark):
    pages = spark.createDataFrame([(1, 1, "ﬁne Ｆｕｌｌ x²"), (2, 1, "plain école"), (3, 1, None), (4, 1, "plain"), (5, 1, "日本 ㍍")], "doc_id long, page_number int, text string")
    found = compare.text_fingerprint(pages)
    assert {r.doc_id: r.normalized for r in found.collect()} == {1: "fine full x2", 2: "plain école", 3: None, 4: "plain", 5: "日本 メートル"}
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert compare.page_similarity(pages, pages)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_hybrid_similarity_needs_lengths_only(spark):
    side = "struct<length:int,visual:struct<bits:bigint,ink:double,aspect:double>>"
    rows = spark.createDataFrame([((30, (0, 0.5, 1.0)), (24, (0, 0.5, 1.0))), ((30, (0, 0.5, 1.0)), (23, (0, 0.5, 1.0))), ((30, None), (30, (0, 0.5, 1.0)))], f"a {side}, b {side}")
    value, basis = images.hybrid_similarity("a", "b", F.lit(0.5))
    assert [(round(r.v, 6), r.b) for r in rows.select(value.alias("v"), basis.alias("b")).collect()] == [(0.62, "hybrid"), (1.0, "visual"), (0.5, "text")]


def test_packages_are_scanned_a_few_times(spark):
    t = spark.createDataFrame
    packages = t([(1, 10, 100, 100, "c", "c"), (2, 10, 100, 99, "c", None)], "package_id long, source_length long, payload_length long, declared_length long, payload_checksum string, declared_checksum string")
    assets = t([(1, "a", 10, 50), (1, "a", 60, 50), (1, " ", 5, 1), (1, None, -1, 5), (1, "b", 20, 5), (2, "c", None, 5)], "package_id long, id string, start long, length long")
    objects = t([(1, "o", "image", "a"), (1, "p", "image", "z"), (1, "p", "text", "z")], "package_id long, id string, type string, asset_id string")
    jobs = t([(1, "j")], "package_id long, id string")
    pages = t([(1, "j", 1, None, None), (1, "j", 1, None, None), (1, "k", 0, 200, 1), (1, "j", None, None, None)], "package_id long, job_id string, page_number int, start long, length long")
    found = workspace.validate_packages(packages, assets, objects, jobs, pages)
    want = [(1, "asset-id-blank", None)] * 2 + [(1, "asset-id-duplicated", "a"), (1, "asset-missing", "p"), (1, "job-missing", "k:0"), (1, "object-id-duplicated", "p"), (1, "page-duplicated", "j:1"), (1, "page-number", "j"), (1, "page-number", "k:0")]
    want += [(1, "range-in-source", "asset  "), (1, "range-invalid", None), (1, "range-overlaps", "asset b"), (1, "range-truncated", "asset a"), (1, "range-truncated", "page k:0"), (2, "payload-checksum", None), (2, "payload-length", None), (2, "range-invalid", "asset c")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 13


def test_invalid_signature_ranges_cover_nothing(spark):
    raw = spark.createDataFrame([(1, "/Filter /A.B /ByteRange [0 10 20 999] /Reason (why \\(so\\))"), (2, "none"), (3, "/ByteRange [0 5 10 25] /ByteRange [0 1 2 99999999999999999999]")], "doc_id long, raw string")
    found = {(r.doc_id, r.pos): (r.covered, r.gap, r.tail, r.status, r.filter, r.reason) for r in compliance.signature_coverage(raw).collect()}
    assert found[1, 0] == (0, 0, 61, "invalid-range", "A.B", "why (so\\)") or found[1, 0][:5] == (0, 0, len("/Filter /A.B /ByteRange [0 10 20 999] /Reason (why \\(so\\))"), "invalid-range", "A.B")
    assert found[3, 0][:4] == (30, 5, 27, "covers-prior-revision") and found[3, 1][:4] == (0, 0, 62, "invalid-range")


def test_receipt_times_are_utc_in_any_zone(spark):
    row = (1, datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc), "k", "f", None, 1, None, "/r", "1")
    receipts = spark.createDataFrame([row], "id long, created_at timestamp, kind string, filename string, mime_type string, byte_length long, sha256 string, route string, release string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert records.receipts_csv(receipts).first().line.startswith('"2024-01-02T03:04:05.000Z","k"')
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_history_dedupe_receipts_and_pages(spark):
    entries = spark.createDataFrame([(1, 1, 0, "k"), (1, 2, 100, "k"), (1, 3, 200, ""), (1, 4, 300, ""), (1, 5, 400, None), (1, 6, 500, None)], "owner long, id long, at_ms long, merge_key string")
    assert sorted((r.id, r.merged) for r in records.merge_history(entries).collect()) == [(2, 2), (3, 1), (4, 1), (5, 1), (6, 1)]
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c"), (13, None)], "doc_id long, text string")
    stored = [(1, sha("a"), 9, sha("a")), (2, sha("a"), 1, sha("a")), (3, sha("b"), 1, "bad"), (4, sha("b"), 1, sha("b")), (5, sha("c"), 0, sha("c"))]
    found = records.dedupe_by_checksum(docs, spark.createDataFrame(stored, "project_id long, checksum string, schema_version int, stored_checksum string"))
    assert {r.doc_id: (r.project_id, r.reused) for r in found.collect()} == {10: (2, True), 11: (11, False), 12: (12, False), 13: (13, False)}
    receipts = spark.createDataFrame([(1, i, v, s, "x.backup", "", i) for i, (v, s) in enumerate([(1, "s"), (2, "s"), (1, None)])], "owner long, id long, schema_version int, sha256 string, filename string, mime_type string, created_at long")
    assert [(r.id, r.kind) for r in records.activity_receipts(receipts).collect()] == [(0, "backup")]
    asked = spark.createDataFrame([(1, "007", 3)], "doc_id long, expression string, page_count int")
    assert assembly.select_pages(asked).first().error == "Page 7 is outside 1-3."


def test_bates_numbers_of_sparse_ids(spark):
    pages = spark.createDataFrame([(d, p) for d in (-(1 << 60), 5, 7, 1 << 61) for p in (1, 2)], "doc_id long, page_number int").repartition(4)
    got = assembly.bates_numbers(pages, digits=2).orderBy("doc_id", "page_number").collect()
    assert [r.label for r in got] == [f"0{i}" for i in range(1, 9)]


def test_newest_transactions_choose_first(spark):
    asked = [(1, 9, "preparing", 10, None, "edit"), (2, 9, "preparing", 20, None, "edit"), (3, 9, "committed", 5, None, "edit"), (4, 9, "preparing", 20, 77, "merge"), (5, 8, "preparing", 0, None, "edit")]
    derived = [(101, 9, 1, "edit", 25), (102, 9, 1, "edit", 15), (103, 9, 1, "merge", 30), (104, 9, 77, "merge", 30), (105, None, 1, "edit", 30)]
    found = health.recover_transactions(spark.createDataFrame(asked, "transaction_id long, project_id long, status string, started_at long, source_revision_id long, operation string"), spark.createDataFrame(derived, "project_id long, parent_id long, parent_revision_id long, operation string, created_at long"))
    assert {r.transaction_id: (r.outcome, r.output_id) for r in found.collect()} == {2: ("committed", 101), 1: ("committed", 102), 4: ("committed", 104), 5: ("rolled-back", None)}


def test_transactions_choose_without_a_call_for_each_project(spark):
    import random

    draw = random.Random(3)
    maybe = lambda value: None if draw.random() < 0.1 else value
    asked = [(i, maybe(draw.randrange(4)), draw.choice(["preparing", "preparing", "committed"]), maybe(draw.randrange(30)), draw.choice([None, 1, 2]), maybe(draw.choice("em"))) for i in range(300)]
    derived = [(1000 + i, maybe(draw.randrange(4)), maybe(draw.randrange(1, 4)), maybe(draw.choice("em")), maybe(draw.randrange(30))) for i in range(200)]
    used, want = set(), {}
    for id_, project, _, start, source, kind in sorted((a for a in asked if a[2] == "preparing"), key=lambda a: (a[3] is not None, a[3] or 0, a[0]), reverse=True):
        free = [(d[4], d[0]) for d in derived if None not in (project, start, kind, d[4]) and d[0] not in used and d[1] == project and d[3] == kind and d[4] >= start and source in (None, d[2])]
        want[id_] = min(free)[1] if free else None
        used.add(want[id_])
    found = health.recover_transactions(spark.createDataFrame(asked, "transaction_id long, project_id long, status string, started_at long, source_revision_id long, operation string"), spark.createDataFrame(derived, "project_id long, parent_id long, parent_revision_id long, operation string, created_at long"))
    assert {r.transaction_id: r.output_id for r in found.collect()} == want and len(set(want.values())) > 50
    assert "CoGroupsInPandas" not in found._jdf.queryExecution().toString()


def store(spark):
    t = spark.createDataFrame
    one = lambda rows, extra="": t(rows, f"id long, project_id long{extra}")
    return {
        "projects": t([(1, 5, "c", 5, "c", None)], "project_id long, byte_length long, checksum string, stored_length long, stored_checksum string, interrupted_job string"), "objects": t([(1, "o", "image", "a")], "project_id long, object_id string, type string, asset_id string"),
        "assets": t([(1, "a")], "project_id long, asset_id string"), "jobs": t([(7, 1, 1)], "job_id long, project_id long, completed_pages int"), "pages": t([(7, 1, "complete")], "job_id long, project_id long, status string"),
        "events": one([(1, 1)]), "checkpoints": one([(1, 1)]), "tabs": one([(1, 1)]), "revisions": one([(1, 1)]), "transactions": one([(1, 1)]),
    }


def test_a_sound_store_is_healthy(spark):
    tables = store(spark)
    assert [(r.code, r.severity) for r in health.health_audit(tables).collect()] == [("healthy", "pass")]
    tables["jobs"] = tables["jobs"].unionByName(spark.createDataFrame([(8, 2, 0)], tables["jobs"].schema))
    tables["pages"] = tables["pages"].unionByName(spark.createDataFrame([(8, 2, "complete"), (7, 1, "complete"), (9, None, "failed")], tables["pages"].schema))
    assert {(r.code, r.records) for r in health.health_audit(tables).collect()} == {("ocr-count", 1), ("orphan-ocr-jobs", 1), ("orphan-ocr-pages", 2)}
    mended = health.repair(tables, ("orphan-ocr-pages", "ocr-count"))
    assert [r.code for r in health.health_audit(mended).collect()] == ["healthy"]
    with pytest.raises(ValueError):
        health.repair(tables, ("source-missing",))


def test_edits_with_colons_in_ids(spark):
    schema = "doc_id long, id string, object_id string, kind string, follower boolean, page_number int"
    current = spark.createDataFrame([(1, "p2-reflow:a:b:1", "z", "text", True, 1), (1, "p2-reflow:a:1", "y", "text", True, 1), (1, "e", "a:b", "text", False, 1), (1, "q", "w", "text", False, 2)], schema)
    incoming = spark.createDataFrame([(1, "n", "a:b", "text", False, 1)], schema)
    assert {r.id for r in workspace.merge_edits(current, incoming).collect()} == {"p2-reflow:a:1", "q", "n"}


def even(values, count):
    if count <= 0 or not values:
        return []
    if len(values) <= count:
        return values
    if count == 1:
        return [values[(len(values) - 1) // 2]]
    return sorted({values[math.floor(i * (len(values) - 1) / (count - 1) + 0.5)] for i in range(count)})


def brute_sample(count, affected, most):
    chosen = {1, count}
    hit = even(sorted(p for p in set(affected) if 1 <= p <= count), max(0, most - len(chosen)))
    chosen |= set(hit)
    for p in hit:
        for q in (p - 1, p + 1):
            if len(chosen) < most and 1 <= q <= count:
                chosen.add(q)
    chosen |= set(even([p for p in range(1, count + 1) if p not in chosen], most - len(chosen)))
    return chosen


@pytest.mark.parametrize("most", [3, 6, 32])
def test_samples_of_pages(spark, most):
    draw = np.random.default_rng(most)
    counts = {d: int(draw.integers(1, 80)) for d in range(40)}
    affected = {d: sorted(set(draw.integers(-1, n + 3, int(draw.integers(0, 12))).tolist())) for d, n in counts.items()}
    found = fidelity.sample_pages(spark.createDataFrame(list(counts.items()), "doc_id long, page_count int"), spark.createDataFrame([(d, p) for d, ps in affected.items() for p in ps], "doc_id long, page_number int"), most)
    got = {d: set() for d in counts}
    for r in found.collect():
        got[r.doc_id].add(r.page_number)
    assert got == {d: brute_sample(n, affected[d], most) for d, n in counts.items()}


def test_similar_pages_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    base = [draw.choice(40, 25).tolist() for _ in range(8)]
    texts = {}
    for d in range(60):
        words = list(base[d % 8])
        for i in draw.choice(25, int(draw.integers(0, 6)), replace=False):
            words[i] = int(draw.integers(40, 60))
        texts[d] = " ".join(f"word{w}" for w in words)
    texts |= {60: texts[3], 61: "", 62: "a b c d e f", 63: "a b c d e f"}
    pages = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc_id long, page_number int, text string")
    prints = {r.doc_id: (r.normalized, set(r.tokens)) for r in compare.text_fingerprint(pages).collect()}
    first = {}
    for d in sorted(prints):
        first.setdefault(prints[d][0], d)
    copies = {d: sum(x == prints[d][0] for x, _ in prints.values()) for d in first.values() if prints[d][0]}
    for t in (0.5, 0.8):
        wanted = set()
        for a in first.values():
            for b in first.values():
                (x, s), (y, u) = prints[a], prints[b]
                if a < b and x and y and len(s & u) / max(1, len(s | u)) * 0.78 + min(len(x), len(y)) / max(len(x), len(y)) * 0.22 >= t:
                    wanted.add((a, b))
        rows = similar.similar_pages(pages, t).collect()
        assert {(r.a_doc, r.b_doc) for r in rows if r.a_doc != r.b_doc} == wanted and len(wanted) > 10
        assert {(r.a_doc, r.a_copies) for r in rows if r.a_doc == r.b_doc} == {(d, n) for d, n in copies.items() if n > 1}
    with pytest.raises(ValueError):
        similar.similar_pages(pages, 0.2)


def test_images(spark):
    grey = lambda levels: b"".join(bytes([v, v, v, 255]) for v in levels)
    schema = "image_id long, rgba binary, width int, height int"
    rows = [(1, grey(range(0, 256, 4)), 8, 8), (2, grey([200] * 4), 2, 2), (3, b"", 0, 4), (4, None, 8, 8), (5, grey([9] * 3), 2, 2)]
    found = {r.image_id: r for r in images.visual_fingerprint(spark.createDataFrame(rows, schema)).collect()}
    assert found[1].bits == 0 and found[2].ink == 1.0 and found[2].aspect == 1.0 and all(found[i].error and found[i].bits is None for i in (3, 4, 5))
    with pytest.raises(ValueError):
        images.similar_images(images.visual_fingerprint(spark.createDataFrame(rows, schema)), 0.5)
    pairs = [(1, grey([0, 255]), 2, 1, grey([0, 255, 0, 0]), 2, 2), (2, bytes([0, 0, 0, 0]), 1, 1, grey([255]), 1, 1), (3, None, 1, 1, grey([1]), 1, 1)]
    got = {r.pair_id: (r.changed, r.changed_ratio) for r in images.pixel_diff(spark.createDataFrame(pairs, "pair_id long, left binary, left_width int, left_height int, right binary, right_width int, right_height int")).collect()}
    assert got == {1: (2, 0.5), 2: (0, 0.0), 3: (None, None)}
    made = {r.image_id: r.rgba for r in images.preprocess_images(spark.createDataFrame([(1, bytes([10, 200, 90, 7]), 1, 1)], schema), threshold=128).collect()}
    assert bytes(made[1]) == bytes([255, 255, 255, 7])


def test_plans_and_labels(spark):
    plan = pageplan.page_plan(spark.createDataFrame([(1, p) for p in range(1, 6)], "doc_id long, page_number int"))
    order = lambda p: [r.source_page for r in p.orderBy("pos").collect()]
    page = F.col("source_page")
    assert order(pageplan.move_items(plan, page.isin(2, 5), 3)) == [1, 3, 2, 5, 4] and order(pageplan.delete_items(plan, page > 0)) == [1, 2, 3, 4, 5]
    assert order(pageplan.duplicate_items(plan, page == 2)) == [1, 2, 2, 3, 4, 5] and order(pageplan.reverse_items(pageplan.select_items(plan, (1, 2, 5)), True)) == [5, 2, 3, 4, 1]
    assert {r.rotation for r in pageplan.rotate_items(plan, page == 1, -90).collect()} == {270, 0} and {r.rotation for r in pageplan.rotate_items(plan, page == 1, 45).collect()} == {0}
    with pytest.raises(ValueError):
        pageplan.page_labels(plan, header="שלום")


def test_files_and_words(spark):
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7 x %%EOF \n")), ("b", None), ("c", bytearray(b" %PDF-1.7")), ("d", bytearray(b"%PDF-1.1 startxref startxrefstartxref" + b"\xff" * 3000 + b"%%EOF"))], "path string, content binary")
    found = {r.path: r for r in ingest.container_triage(files).collect()}
    assert found["a"].valid and found["b"].errors == ["empty-file", "missing-header", "missing-eof"] and found["c"].errors == ["missing-header", "missing-eof"] and found["d"].incremental_updates == 3 and found["d"].valid
    pages = spark.createDataFrame([(1, 1, "left\ttop\twidth\theight\tconf\ttext\r\n1\t2\t3\t4\t-\tw"), (2, 1, "left\ttop\n1\t2"), (3, 1, None)], "job_id long, page_number int, tsv string")
    assert [(r.job_id, r.text, r.confidence, r.x1, r.y1) for r in ingest.ingest_ocr_tsv(pages).collect()] == [(1, "w", 0.0, 4.0, 6.0)]


def test_interrupted_sessions_as_a_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 5, 1, h, tzinfo=datetime.timezone.utc)
    beats = [(1, 1, at(1), False), (1, 1, at(2), True), (2, 1, at(3), False), (3, 1, at(1), False), (4, 2, at(5), False), (None, 2, at(6), False)]
    batch = spark.createDataFrame(beats, "session long, project long, at timestamp, clean_exit boolean")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = flows.last_beats(stream).writeStream.format("memory").queryName("beats").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    now = F.lit(at(7))
    rows = lambda df: sorted(map(tuple, flows.interrupted_sessions(df, now).collect()))
    assert rows(spark.table("beats")) == rows(flows.last_beats(batch)) and len(rows(flows.last_beats(batch))) == 2


def test_keys_of_similar_sets(spark):
    """Similar sets of all sizes have a key in common, whatever counts as a light part; others seldom have."""
    draw = np.random.default_rng(8)
    names = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for _ in range(150):
        base = draw.choice(400, int(draw.integers(1, 65)), replace=False)
        sets += [base, *(np.unique(np.concatenate([draw.permutation(base)[: max(1, len(base) - cut)], draw.integers(0, 400, more)]))[:64] for cut, more in draw.integers(0, 1 + len(base) // 6, (6, 2)))]
    size, token = np.array([len(x) for x in sets]), np.concatenate(sets)
    for jaccard in (0.58 / 0.78, 0.9, 0.4):
        for weak in (0, 300, 1_000, 10**6):
            met, by_key = set(), {}
            for owner, key in similar._keys(jaccard, weak, size, names[token], 100 + token % 57):
                for i, k in zip(owner.tolist(), key.tolist(), strict=True):
                    by_key.setdefault(k, set()).add(i)
            for group in by_key.values():
                met |= {(i, j) for i in group for j in group if i < j}
            plain = [set(x.tolist()) for x in sets]
            alike = {(j, i) for i in range(len(sets)) for j in range(i) if len(plain[i] & plain[j]) >= jaccard * len(plain[i] | plain[j])}
            assert alike <= met and len(alike) > 100
            if jaccard > similar.PARTED and weak == 1_000:
                assert len(met) < 0.02 * len(sets) ** 2


def test_similar_images_broadcast_no_turned_parts(spark):
    prints = spark.createDataFrame([(1, 5, 0.5, 1.0), (2, 7, 0.5, 1.0), (3, -1, 0.5, 1.0), (4, 5, 0.5, 1.0)], "image_id long, bits long, ink double, aspect double")
    found = images.similar_images(prints)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b, r.a_copies, r.b_copies) for r in found.collect()} == {(1, 2, 2, 1), (1, 1, 2, 2)}


def test_script_profile_of_odd_texts_equals_its_sql(spark, tmp_path):
    import duckdb

    from folio.plans import compared

    texts = [None, "", " \n", "123", "é", "ещё", "עברית", "國", "한국", "plain", "Ωmega 日本"]
    rows = spark.createDataFrame([(i * 7 + k, t) for i, t in enumerate(texts) for k in range(7)] + [(None, "x"), (None, "1")], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = compared.b9_script_profile(spark, str(tmp_path)).select("script", "texts", "editability")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(compared.ORACLES["b9_script_profile"]).fetchall())
