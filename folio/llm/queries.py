"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact, langid, minhash, mixing, phrases, quality, secrets, substring, suffix, toxicity, trie
from .common import fold, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), ["n_tokens", "ids_sha256", "decoded_sha256"])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _labelled(spark: SparkSession, sf_dir: str, modulus: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold(modulus) != held)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _labelled(spark, sf_dir, 3, 1))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_segments")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, _labelled(spark, sf_dir, 4, 2))
    return quality.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents")).drop("example_doc_id")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_minhash": op6_minhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_nearest": op10_nearest,
    "op11_trie": op11_trie,
    "op12_phrases": op12_phrases,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES = {
    "op2_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from t""",
    # the words of a source are its slots times the block, three rounds at most
    "op4_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                          sha256(coalesce(doc_id::varchar, '')) as k from documents),
        s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, (3 * sum(size))::bigint as lim from d group by source),
        l as (select *, (sum(source_size) over () * 1.0::double - coalesce(sum(lim) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as lev
              from s window w as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
        t as (select source, source_size, least(lim::double, weight * (select arg_min(lev, lim / weight) from l where lim >= lev * weight)) as target from l),
        b as (select sum(source_size)::bigint as total, 16 as block from s),
        n as (select source, floor(target / greatest(1, (select total from b))::double * 70368744177664::double)::bigint as units from t where target > 0),
        c as (select source, case when row_number() over (order by source desc nulls first) = 1 then 1.0::double else least(1.0::double, sum(units) over (order by source nulls last rows unbounded preceding)::double / 70368744177664::double) end as upto from n),
        f as (select source, upto, coalesce(lag(upto) over (order by upto, source nulls last), 0.0::double) as start from c),
        i as (select unnest(range(0, greatest(1, (total + block - 1) // block))) as i from b),
        p as (select ((i % 67108864) * 0.6180339887498949::double + ((i // 67108864) * (67108864 * 0.6180339887498949::double % 1.0::double)) % 1.0::double) % 1.0::double as point from i),
        m as (select source, count(*) as slots from p join f on point >= start and point < upto group by source),
        w as (select t.*, least(coalesce(slots, 0) * (select block from b), 3 * source_size)::bigint as words from t left join m on t.source is not distinct from m.source),
        q as (select d.*, w.source_size, w.target, w.words, coalesce(sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as start
              from d join w on d.source is not distinct from w.source)
        select doc_id, size, source_size, target,
               (size * (words // greatest(source_size, 1)) + greatest(0, least(start + size, words % greatest(source_size, 1)) - start))::bigint as taken
        from q""",
    # crc32 of a short ASCII string, bit by bit; prefixes are lists of turns, and every node is told to all its ancestors
    "op11_trie": r"""
        with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as place
                   from conversations where conv_id is not null),
        l as (select conv_id, list(sha256(length(role) || ':' || role || text) order by place) as t, list(octet_length(encode(text)) order by place) as b from o group by conv_id),
        c as (select conv_id, (list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                     lambda a, x: list_reduce([xor(a, x)] || range(8), lambda v, _: xor(v >> 1, (v & 1) * 3988292384::bigint)))) as raw from l),
        h as (select conv_id, xor(raw, 4294967295::bigint) % 9 as h from c),
        r as (select l.conv_id, coalesce(b.t[:h], []) || l.t[h + 1 :] as t, coalesce(b.b[:h], []) || l.b[h + 1 :] as b
              from l join h using (conv_id) left join l b on b.conv_id = l.conv_id - l.conv_id % 5),
        p as (select conv_id, d, t[:d] as k, len(t) = d as ends, case when d = 0 then 0 else b[d] end as b, len(t) as n, t from (select *, unnest(range(0, len(t) + 1)) as d from r)),
        n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, max(b) as b, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends from p group by k, d),
        x as (select k[: d - 1] as k, count(*) as n_children from n where d > 0 group by 1),
        m as (select n.*, coalesce(n_children, 0) as n_children from n left join x using (k)),
        a as (select k[:e] as k, n_children, (n_convs - 1) * b as saved from (select *, unnest(range(0, d + 1)) as e from m)),
        s as (select k, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from a group by k)
        select m.conv_id, m.d as depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) as ends_sha256
        from m join s using (k) left join m u on m.d > 0 and u.k = m.k[: m.d - 1]""",
    # all runs of one to four words are counted as text
    "op12_phrases": r"""
        with d as (select coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
        p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(pieces) as piece from d)),
        i as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
        t as (select lang, count(*) as n from i group by lang),
        f as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, m, count(*) as f from i, range(1, 5) s(m) where i + m - 1 <= len(w) group by all having count(*) >= 30),
        c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m >= 2),
        k as (select c.*, unnest(range(1, m)) as k from c),
        s as (select k.lang, k.phrase, k.a, k, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f + y.f))::bigint as score from k
              join f x on x.lang = k.lang and x.phrase = array_to_string(w[1 : k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(w[k + 1 : k.m], ' ')),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        o as (select lang, array_to_string(w[lo : lo + z - 1], ' ') as phrase, max(a) as cover from (select *, unnest(range(1, m - z + 2)) as lo from (select *, unnest(range(2, m)) as z from c where m >= 3)) group by 1, 2),
        r as (select b.*, n, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b join t using (lang) left join o using (lang, phrase)
              where cover is null or 100::hugeint * cover < 80::hugeint * a)
        select lang, rank, phrase, a, l, r, n, score from r where rank <= 2000""",
    # what stands between the matches of a rule gives their places
    "op13_secret_scan": r"""
        with k(ord, kind, pattern, least, keep) as (values
                 (1, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 1, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{6,}'),
                 (2, 'access', 'AKIA[A-Z0-9]+', 20, '.*'), (3, 'hex', '[0-9a-f]{24,}', 24, '.*'), (4, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 1, '.*'),
                 (5, 'jwt', 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 1, '.*'), (6, 'forge', 'gh[pousr]_[A-Za-z0-9]+', 40, '.*'),
                 (7, 'chat', 'xox[abeoprs]-[A-Za-z0-9-]+', 15, '.*'), (8, 'cloud', 'AIza[A-Za-z0-9_-]+', 39, '.*')),
        d as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
        m as (select id, ord, kind, least, keep, regexp_split_to_array(text, pattern) as gaps, regexp_extract_all(text, pattern) as hits from d, k where regexp_matches(text, pattern)),
        u as (select id, ord, kind, least, keep, unnest(hits) as hit, unnest(gaps[:len(hits)]) as gap, unnest(range(len(hits))) as i from m),
        p as (select *, sum(length(gap) + length(hit)) over (partition by id, ord order by i) as stop from u),
        f as (select id, ord, (stop - length(hit))::bigint as start, kind || ':' || (stop - length(hit))::bigint || ':' || stop::bigint as span from p where length(hit) >= least and regexp_full_match(hit, keep)),
        g as (select id, count(*) filter (ord = 1) as a, count(*) filter (ord = 2) as k, count(*) filter (ord = 3) as h,
                     string_agg(span, ',' order by start, ord) filter (ord <= 3) as base, string_agg(span, ',' order by start, ord) as spans from f group by id)
        select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (id)""",
}
