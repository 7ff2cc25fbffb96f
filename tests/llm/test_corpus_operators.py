"""The ten corpus operators against brute force, libraries, and awkward input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from folio.llm import ann, bpe, common, exact, langid, minhash, mixing, near, quality, substring, suffix, toxicity
from folio.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _start long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge and sing".split()


def texts(seed=1, n=60):
    draw = random.Random(seed)
    base = [" ".join(draw.choices(PROSE, k=draw.randint(30, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        words = draw.choice(base).split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(PROSE) + str(draw.randint(0, 9))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t), "x", 7) for i, t in enumerate(texts())]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s0", 0, "y", 1), (102, " \n\t", "fr", None, 3, None, 2)]
    rows += [rows[3], (103, rows[3][1].replace(" ", " \n "), "en", "s1", 5, "z", 3), (None, rows[5][1], "en", "s1", 5, "z", 3), (104, "word " * 30_000, "en", "s2", 9, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), bpe.WordBpe(tokenizer_path())
    odd = ["", "a<|endoftext|>b", "It's WE'LL", "ΣΑΣ İ ß", "x\x1cy\xa0z", "1234 ½", "日本語 한국어", "ab" * 700, "\U0001f600 !!??", "é"]
    for text, (n, ids, decoded) in zip(odd, own.encode(odd), strict=True):
        wanted = lib.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == wanted and n == len(wanted) and decoded == lib.decode(wanted, skip_special_tokens=False)
    rows = bpe.bpe_encode(docs, tokenizer_path(), ["n_tokens", "ids_sha256"]).collect()
    assert len(rows) == docs.count()
    assert {r.ids_sha256 for r in rows if r.doc_id in (100, 101, 102)} == {hashlib.sha256(b"").hexdigest()}
    ids = bpe.bpe_encode(docs.where("doc_id = 1"), tokenizer_path(), ["ids"])
    assert bpe.bpe_decode(ids, tokenizer_path()).first().text == lib.decode(ids.first().ids, skip_special_tokens=False)


def test_tree_and_forest_merge_alike():
    own = bpe.WordBpe(tokenizer_path())
    words = ["".join(random.Random(i).choices("abcdehinorst", k=1 + i % 32)) for i in range(300)]
    assert own.merge_all(words) == [own.merge(w) for w in words]


def test_cuckoo_index_inserts_deletes_and_grows():
    index, held = exact.CuckooIndex(2), {}
    for i in range(2_000):
        digest = hashlib.sha256(str(i % 1500).encode()).hexdigest()
        if index.find(digest) is None:
            index.insert(digest, [i, 1])
            held[digest] = [i, 1]
        if i % 3 == 0:
            assert index.delete(digest) == (held.pop(digest, None) is not None)
    assert dict(index.rows()) == held and index.live == len(held)


def test_exact_dedup(spark, docs):
    by = collections.defaultdict(list)
    for i, t in pairs(docs):
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    rows = exact.exact_dedup(docs).collect()
    assert len(rows) == docs.count() and "lang" in rows[0]
    for r in rows:
        group = by[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        least = min((i for i in group if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(group), r.doc_id == least)
    assert exact.exact_dedup(docs.limit(0)).count() == 0
    index = exact.digest_index(docs.where("doc_id < 10"))
    changed = exact.update_index(index, docs.where("doc_id = 103"), docs.where("doc_id in (0, 1)"))
    gone = {r.text_sha256 for r in exact.digest_index(docs.where("doc_id in (0, 1)")).collect()}
    assert not gone & {r.text_sha256 for r in changed.collect()} and changed.count() >= index.count() - len(gone)


def brute_groups(rows, words, num, den):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        k = min(words, len(w))
        sets[i] |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("words,num", [(3, 85), (5, 80)])
def test_near_dedup(docs, words, num):
    groups, sizes = brute_groups(pairs(docs), words, num, 100)
    rows = minhash.near_dedup(docs, words, num, 100).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_shingles == sizes[r.doc_id] or r.doc_id is None
        assert r.component_id == groups.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    from folio.llm import near

    monkeypatch.setattr(near, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near, "BLOCK", 5)
    monkeypatch.setattr(common, "LEAST_HEAVY", 3)
    rows = list(enumerate(texts(4, 80)))
    wanted, _ = brute_groups(rows, 3, 85, 100)
    got = near.near_groups(spark.createDataFrame(rows, "unit_id long, text string"), 3, 85, 100)
    assert {r.unit_id: r.group_id for r in got.collect()} == wanted


def test_substring_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    near = passage.replace("w7 ", "w7x ")
    rows = [(1, "own line of text\n" + passage), (2, passage + "\nother"), (3, near), (4, "short line\nshort line"), (5, None), (6, ""), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph, r.removed) for r in substring.repeated_paragraphs(docs).collect()}
    assert found == {(1, 1): (1, 1, False), (2, 0): (1, 1, True), (3, 0): (1, 1, True)}
    assert {r.doc_id: r.text for r in substring.substring_dedup(docs).collect()} == {2: "other", 3: ""}


def test_passages_inside_other_text_are_found(spark):
    draw = random.Random(8)
    word = lambda: f"v{draw.randrange(10**6)}"
    shared = [[word() for _ in range(50)] for _ in range(20)]
    rows = [(i * 20 + k, " ".join([*(word() for _ in range(draw.randint(1, 200))), *s[:13]]) + ("\n" if i else " ") + " ".join([*s[13:], *(word() for _ in range(draw.randint(1, 200)))])) for i in range(3) for k, s in enumerate(shared)]
    rows += [(100 + i, " ".join(word() for _ in range(300))) for i in range(20)] + [(200, "of " * 3000), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeated_passages(docs).collect()
    # a place may be chosen by words around the shared ones, so a passage need not be kept in the first document that has it
    assert {r.doc_id for r in found} == set(range(60)) and all(r.keep_doc_id % 20 == r.doc_id % 20 for r in found)
    assert {r.doc_id for r in found if r.removed} == set(range(20, 60))
    left = {r.doc_id: r.text for r in substring.substring_dedup(docs).collect()}
    assert sorted(left) == list(range(20, 60))
    texts = dict(rows)
    assert all(set(left[d].split()) <= set(texts[d].split()) and len(left[d].split()) <= len(texts[d].split()) - 25 for d in left)
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def brute_left(texts, within=False, words=25):
    """The words of every text less all runs of so many words that stand at an earlier place."""
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        w = texts[d].split()
        for p in range(len(w) - words + 1):
            doc, at = first.setdefault(tuple(w[p : p + words]), (d, p))
            if doc != d or (within and p - at >= words):
                gone[d] |= set(range(p, p + words))
    return {d: [x for i, x in enumerate(t.split()) if i not in gone[d]] for d, t in texts.items()}


def shared_texts(seed, most):
    """Texts of random words with pieces of others, over lines; no word is there twice but in such pieces."""
    draw = random.Random(seed)
    pool = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate((25, 26, 40, 50, 80, 200))]
    texts = {}
    for d in range(40):
        words = []
        for k in draw.sample(range(len(pool)), draw.randint(1, 3)):
            cut = draw.choice([0, 0, draw.randrange(20)])
            words += [f"v{draw.randrange(10**9)}" for _ in range(draw.randint(0, 60))] + pool[k][cut : len(pool[k]) - draw.choice([0, draw.randrange(20)])]
            words += pool[k][cut:] * draw.randrange(most)
        words += [f"v{draw.randrange(10**9)}" for _ in range(30)]
        texts[d] = "".join(w + ("\n" if draw.random() < 0.02 else " ") for w in words)
    return texts


def test_shared_runs_go_whole(spark):
    texts = shared_texts(5, 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    wanted = brute_left(texts)
    left = {r.doc_id: r.text.split() for r in substring.substring_dedup(docs, min_words=10**6).collect()}
    assert left == {d: w for d, w in wanted.items() if w != texts[d].split()} and len(left) > 20
    for r in substring.repeated_passages(docs).collect():
        run, kept = (texts[d].split()[p : p + r.n_words] for d, p in ((r.doc_id, r.first_word), (r.keep_doc_id, r.keep_first_word)))
        assert run == kept and len(run) == r.n_words >= 25


def test_runs_repeated_within_a_document_go(spark):
    texts = shared_texts(6, 3) | {50: " ".join(f"own{i}" for i in range(30)) + " " + " ".join(f"own{i}" for i in range(30)) + " end", 51: "a b c d e f g h i j " * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    wanted = brute_left(texts, within=True)
    left = {r.doc_id: r.text.split() for r in substring.substring_dedup(docs, min_words=10**6).collect()}
    assert left == {d: w for d, w in wanted.items() if w != texts[d].split()}
    assert left[50] == [f"own{i}" for i in range(30)] + ["end"] and left[51] == texts[51].split()[:30]


def test_short_lines_that_repeat_go(spark):
    rows = [(1, "one two three four five\nnever said elsewhere at all here"), (2, "own words\nOne two  three four five"), (3, "one two three four\nanother line " + " ".join(f"u{i}" for i in range(16))), (4, " ".join(f"u{i}" for i in range(16)) + " end"), (5, " ".join(f"u{i}" for i in range(16)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph, r.removed) for r in substring.repeated_paragraphs(docs).collect()}
    assert found == {(1, 0): (1, 0, False), (2, 1): (1, 0, True), (3, 1): (3, 1, False), (4, 0): (3, 1, True), (5, 0): (3, 1, True)}


def test_every_passage_holds_a_seed():
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(500)}" if draw.random() < 0.9 else "\n" for _ in range(n)) for n in (0, 5, 24, 25, 26, 40, 50, 51, 80, 300, 3000)] + ["of " * 500, ""]
    w, owner, number, line = substring._words_of(texts)
    first, many, seed, flat = substring._pieces_of(w, owner)
    begins, grams, pieces = np.searchsorted(owner, np.arange(len(texts) + 1)), {}, set()
    for f, n, key, one in zip(first.tolist(), many.tolist(), seed.tolist(), flat.tolist()):
        for p in range(f, f + n):
            assert owner[p] == owner[p + substring.PASSAGE - 1] and one == (len(set(w[p : p + substring.PASSAGE].tolist())) == 1)
            held = {tuple(w[q : q + substring.SEED].tolist()) for q in range(p, p + substring.PASSAGE - substring.SEED + 1)}
            assert grams.setdefault(key, None) in held | {None}
            grams[key] = grams[key] or min(held, key=lambda g: [int(substring._grams(np.array(g, dtype=np.uint64), (substring.SEED,), 0xD1342543DE82EF95)[0][0]) != key, g])
            pieces.add(p)
    for i, text in enumerate(texts):
        words = [(k, x) for k, row in enumerate(text.split("\n")) for x in row.split()]
        assert len(words) == (owner == i).sum() and [k for k, _ in words] == line[owner == i].tolist()
        assert all(begins[i] + p in pieces for p in range(len(words) - substring.PASSAGE + 1))


def test_what_is_kept_stands_in_text_that_stays(spark):
    line = [f"a{i}" for i in range(90)]
    changed = [*line[:40], "other", *line[41:]]
    rows = [(1, " ".join(line)), (2, " ".join(changed)), (3, " ".join([*(f"x{i}" for i in range(30)), *changed[15:65], *(f"y{i}" for i in range(30))]))]
    left = {r.doc_id: r.text.split() for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[2] == [] and "other" in left[3]
    kept = [left.get(d, t.split()) for d, t in rows]
    assert {w for _, t in rows for w in t.split()} == {w for words in kept for w in words}


def test_passages_of_removed_lines_cost_nothing(spark, monkeypatch):
    """What repeats only in lines that are removed already is neither cut into pieces nor compared."""
    rng, made, pieces = random.Random(7), [], substring.pieces
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    gone = spark.createDataFrame([(i + 20, [0]) for i in range(20)], "doc_id long, lines array<int>")
    monkeypatch.setattr(substring, "pieces", lambda held: made.append((out := pieces(held)).count()) or out)
    counts = [(substring.repeated_passages(docs, lines).count(), made.pop()) for lines in (gone, None)]
    assert counts[0] == (0, 0) and counts[1][0] == 40 and counts[1][1] > 40


def test_lines_of_enough_words(spark):
    texts = ["a b c d e", " a\tb  c\x0bd\re ", "a b c d", "a b c d ", "", " ", "\x85a\u00a0b c d e f", "é b\x0cc 𝒅 e", "abcde", "x" * 10**6 + " y", "a " * 10**5]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for least in (0, 1, 2, 5, 64, 65, 10**5):
        rows = df.select("text", substring._has_words(df["text"], least).alias("has")).collect()
        assert [(r.text, r.has) for r in rows] == [(t, len(re.findall(common.WORD, t)) >= least) for t in texts]


def test_substring_dedup_takes_any_id_and_awkward_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    big = 1 << 62
    rows = [(big, "own line of text\n" + passage, "x", 1), (-big, passage + "\nother", "y", 2), (-big, passage + "\nother", "y", 2), (5, "zz " * 40, "z", 3), (5, passage, "z", 3), (None, passage, "n", 4), (6, None, "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_doc_id string, unit_id int")
    found = {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph, r.copies, r.removed) for r in substring.repeated_paragraphs(docs).collect()}
    # of the two texts of document 5 the smaller one counts
    assert found == {(-big, 0): (-big, 0, 3, False), (5, 0): (-big, 0, 3, True), (big, 1): (-big, 0, 3, True)}


def brute_lines(texts, words=5):
    """First (doc, line) of the component of each line that has a near copy."""
    lines = [(d, i, line.split()) for d, t in texts.items() for i, line in enumerate(t.split("\n"))]
    sets = [(d, i, {tuple(w[j : j + words]) for j in range(len(w) - words + 1)}) for d, i, w in lines if len(w) >= words]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (*_, x) in enumerate(sets):
        for b, (*_, y) in enumerate(sets[:a]):
            if 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(a), find(b)), key=lambda i: sets[i][:2])
                root[v] = u
    many = collections.Counter(find(i) for i in range(len(sets)))
    return {s[:2]: sets[find(i)][:2] for i, s in enumerate(sets) if many[find(i)] > 1}


def test_near_lines_equal_brute_force(spark):
    draw = random.Random(11)
    base = [[f"b{draw.randrange(400)}" for _ in range(draw.randint(5, 70))] for _ in range(25)]
    texts = {}
    for d in range(60):
        lines = []
        for _ in range(draw.randint(1, 4)):
            words = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 1, 2, 6])):
                words[draw.randrange(len(words))] = f"c{draw.randrange(9)}"
            lines.append(" ".join(words))
        texts[d] = "\n".join(lines)
    docs = substring.one_text(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph) for r in substring.repeated_lines(docs, 5, 80, 100, 5).collect()}
    wanted = brute_lines(texts)
    assert len(got.items() & wanted.items()) >= 0.99 * len(wanted) and set(got) <= set(wanted)


def test_mixing(docs):
    for block in (1, 16, 64):
        rows = mixing.mix(docs, block=block).collect()
        assert len(rows) == docs.count()
        took = collections.Counter()
        for r in rows:
            took[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size and (r.first_slot is None) == (r.taken == 0)
        for r in rows:
            # the discrepancy of the golden ratio is a few slots
            assert abs(took[r.source] - r.target) <= 4 * block and r.target <= 3 * r.source_size
        assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=block).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_the_points_decide_what_is_taken(docs, monkeypatch):
    taken = lambda: sorted((str(r.doc_id), r.taken, r.first_slot) for r in mixing.mix(docs, block=32).collect())
    golden = taken()
    monkeypatch.setattr(mixing, "GOLDEN", 0.25)
    assert taken() != golden


def test_segments_are_the_maximal_ones():
    draw = np.random.default_rng(3)
    for _ in range(50):
        s = draw.choice([-0.7, 1.1, 2.3, -1.9], 30)
        best = max(s[a:b].sum() for a in range(30) for b in range(a + 1, 31))
        found = toxicity.segments(s)
        assert max((v for *_, v in found), default=best) == pytest.approx(best) or best <= 0
        assert all(v == pytest.approx(s[a:b].sum()) and v > 0 for a, b, v in found)
        assert sum((s[a:b] > 0).sum() for a, b, _ in found) == (s > 0).sum()  # every positive score is in one


def slow_segments(scores):
    """The maximal segments by their definition: best of the whole, then of what is left and right of it."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    n, todo, out = len(scores), [(0, len(scores))], []
    while todo:
        a, b = todo.pop()
        best = max(((sums[j] - sums[i], i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] > 1e-12:
            out.append((best[2], best[3]))
            todo += [(a, best[2]), (best[3], b)]
    return sorted(out) if n else []


def test_segments_by_definition_and_in_linear_time():
    draw = np.random.default_rng(9)
    for n in (1, 2, 5, 12, 25):
        for _ in range(30):
            s = draw.normal(-0.3, 1, n)
            assert sorted((a, b) for a, b, _ in toxicity.segments(s)) == slow_segments(s)
    for shape in (np.where(draw.random(200_000) < 0.05, 1.0, -0.7), np.tile([1.0, -1.5], 100_000), np.tile([1.0, -0.5], 100_000), np.concatenate([np.tile([1.0, -1.1], 50_000), np.tile([1.1, -1.0], 50_000)])):
        steps: list[int] = []
        toxicity.segments(shape, steps)
        assert steps[0] <= 4 * len(shape)


def labelled(spark):
    draw = random.Random(8)
    rows, marks = [], []
    for i in range(240):
        words = draw.choices(PROSE, k=40) if i % 3 else draw.choices(PROSE, k=3) * 12
        bad = i % 4 == 0
        if bad:
            words[10:10] = ["vileword", "nastyword"]
        rows.append((i, " ".join(words)))
        marks.append((i, 1 if i % 3 else 0, int(bad)))
    return spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 160"))
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    held = [i for i in range(160, 240)]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95 and got[900] < 0.7 and got[901] < 0.7
    assert toxicity.predict(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id < 160"))
    got = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in range(160, 240)]) > 0.95 and 0 <= got[900] <= 1
    assert quality.predict(docs, quality.fit(docs.limit(0), labels.limit(0))).where("score between 0 and 1").count() == docs.count()


def test_language_id(spark):
    lines = {"en": "the house of the old man with this and that", "de": "das haus und der mann mit dem kind auf die", "fr": "la maison de le vieux avec les enfants que nous"}
    rows = [(i, lang, " ".join(random.Random(i).choices(line.split(), k=30))) for i, (lang, line) in enumerate(list(lines.items()) * 30)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "de", ""), (902, "fr", "123 !!")], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs.where("doc_id < 60"))).collect()}
    assert all(got[i].lang_pred == lang and not got[i].ambiguous for i, lang, _ in rows)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    for k in (2, 4, 5, 9):
        code = langid.codewords(k)
        assert len({tuple(row) for row in code.tolist()}) == k


def test_previous_factors_equal_brute_force():
    draw = random.Random(4)
    for size in (210, 400, 900):
        raw = bytes(draw.choices(b"ab", weights=[9, 1], k=size)) * 2 + b"a" * 250
        starts = np.array(sorted(draw.sample(range(len(raw) - 199), len(raw) // 3)))
        order, shared = suffix.suffix_order(np.frombuffer(raw, dtype=np.uint8), starts, 200)
        assert order.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i : i + 200], i))
        common = lambda i, j: next((k for k in range(200) if raw[i + k] != raw[j + k]), 200)
        assert shared.tolist() == [0, *(common(i, j) for i, j in zip(order, order[1:]))]
        wanted = [max((common(i, j) for j in starts if j < i), default=0) for i in order]
        assert suffix.previous_factors(order, shared).tolist() == wanted


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot_bytes", [300, 1_000_000])
def test_suffix_dedup(spark, keep, hot_bytes):
    draw = random.Random(3)
    passages = ["".join(draw.choice("abcd ") for _ in range(300)) for _ in range(4)]
    rows = [(i, "".join(draw.choices("abcdefgh ", k=draw.randint(0, 250))) + passages[i % 4][draw.randint(0, 60) :] * draw.choice([0, 1, 2]) + "".join(draw.choices("xyzé", k=draw.randint(0, 150)))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "aaa" * 200), (104, "word " * 3000), (105, "x" + "word " * 100)]
    raw = {i: (t or "").encode() for i, t in rows}
    count, seen = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199)), set()
    got = {r.doc_id: r for r in suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep, hot_bytes=hot_bytes).collect()}
    for k in sorted(raw):
        gone = bytearray(len(raw[k]))
        for i in range(len(raw[k]) - 199):
            window = raw[k][i : i + 200]
            if (count[window] > 1) if keep == "none" else (window in seen):
                gone[i : i + 200] = b"\1" * 200
            seen.add(window)
        assert bytes(got[k].kept) == bytes(b for b, g in zip(raw[k], gone, strict=True) if not g) and got[k].n_removed == sum(gone)


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 16))
    x[700:900] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (3, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 1500, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        best = np.lexsort((np.arange(1500), -cos.round(12)))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in found[q]})
        assert len(found[q]) == 5 and all(s == pytest.approx(cos[v]) for v, s in found[q])
    assert hits >= 0.9 * 5 * 30
    assert [v for v, _ in found[700]] == [5, 701, 702, 703, 704]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_few_comparisons_find_most_neighbours():
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(400, 32)) * 3
    x = centres[draw.integers(0, 400, 20_000)] + draw.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.build(x.copy())
    lists, gaps = index.nearest(x, ann.COPIES)
    member = collections.defaultdict(set)
    for i, c in zip(*np.nonzero(gaps <= gaps[:, :1] * ann.CLOSURE + 1e-12)):
        member[lists[i, c]].add(int(i))
    asked = np.arange(0, len(x), 100)
    found, gaps = index.nearest(x[asked], index.probes)
    hits = compared = 0
    for q, own, gap in zip(asked, found, gaps):
        near = [member[c] for c, g in zip(own, gap) if g <= gap[0] * index.ratio + 1e-12]
        cos = x @ x[q]
        cos[q] = -9
        hits += len(set().union(*near) & set(np.argsort(-cos)[:5].tolist()))
        compared += sum(map(len, near))
    assert hits >= 0.9 * 5 * len(asked) and compared <= 0.3 * len(x) * len(asked)


def test_vectors_of_extreme_size_and_few_candidates(spark):
    rows = [(0, [1e-200] * 4, 9), (1, [1e200, 1e200, 1e200, 1e200], 9), (2, [1.0, 1.0, 1.0, -1.0], 9), (50, [1.0, 1.0, 1.0, 1.0], 9), (7, [1.0], 9), (7, [2.0, 1.0, 1.0, 1.0], 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 6)))
    last = (2, 0.5)
    assert got[50] == [(0, 1.0), (1, 1.0), (7, round(5 / 28**0.5, 6)), last] and got[0] == [(1, 1.0), (50, 1.0), (7, round(5 / 28**0.5, 6)), last]


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert last.where("n_tokens > 0").count() == last.count() > 0
