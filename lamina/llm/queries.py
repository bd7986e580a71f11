"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.jaccard import link

    return link(_documents(spark, sf_dir), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.mixing import mix

    columns = ["doc_id", "_m_domain as domain", "_m_lang as lang", "_m_source as source", "_m_epoch as epoch", "_m_tokens as n_tokens", "_m_take as take_tokens"]
    return mix(_documents(spark, sf_dir)).selectExpr(*columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.quality import classify

    return classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.substrings import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.warc import warc_round_trip

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.rules import apply_rules

    return apply_rules(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.pii import find

    return find(_documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.media import media_columns

    return media_columns(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_format", "width", "height")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.tokenfile import token_files

    return token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.resampling import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least_words=20, seed=7)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op2_mixing": op2_mixing, "op3_quality_classifier": op3_quality_classifier, "op4_suffix_array_dedup": op4_suffix_array_dedup, "op5_warc": op5_warc, "op6_quality_rules": op6_quality_rules, "op7_best_fit_packing": op7_best_fit_packing, "op8_pii": op8_pii, "op9_license_scan": op9_license_scan, "op10_media_columns": op10_media_columns, "op11_token_files": op11_token_files, "op12_importance_resampling": op12_importance_resampling, "op13_embedding_whitening": op13_embedding_whitening}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
                  else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as gram from w),
        n as (select doc_id, count(*) as n from g group by doc_id),
        o as (select a.doc_id as a, b.doc_id as b, count(*) as both from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
        l as (select o.a, o.b from o join n x on o.a = x.doc_id join n y on o.b = y.doc_id where 100 * o.both >= 90 * (x.n + y.n - o.both)),
        e as (select a, b from l union all select b, a from l),
        r as (select a as doc_id, b as reached from e union select r.doc_id, e.b from r join e on r.reached = e.a)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(r.reached), d.doc_id))::bigint as component_id
        from documents d left join n on d.doc_id = n.doc_id left join r on d.doc_id = r.doc_id group by d.doc_id, n.n""",
    "op2_mixing": r"""
        with d as (select doc_id, 'domain' || cast(ascii(right(source, 1)) % 4 as varchar) as domain, lang, source,
                          len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_tokens from documents),
        t as (select * from d where n_tokens > 0),
        leaf as (select domain, lang, source, sum(n_tokens)::double as tokens, 3 * sum(n_tokens)::double as cap from t group by all),
        l1 as (select domain, sum(cap) as cap, 1.0::double as w, (select sum(tokens) * 0.5 from leaf) as give from leaf group by all),
        s1 as (select *, (give - coalesce(sum(cap) over (order by cap / w, domain rows between unbounded preceding and 1 preceding), 0))
                      / sum(w) over (order by cap / w, domain rows between current row and unbounded following) as rate from l1),
        a1 as (select domain, least(cap, (select max(rate) from s1) * w) as give from s1),
        l2 as (select f.domain, f.lang, sum(f.cap) as cap, (case f.lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end)::double as w,
                      any_value(a1.give) as give from leaf f join a1 on f.domain = a1.domain group by f.domain, f.lang),
        s2 as (select *, (give - coalesce(sum(cap) over (partition by domain order by cap / w, lang rows between unbounded preceding and 1 preceding), 0))
                      / sum(w) over (partition by domain order by cap / w, lang rows between current row and unbounded following) as rate from l2),
        r2 as (select domain, max(rate) as rate from s2 group by domain),
        a2 as (select s2.domain, s2.lang, least(s2.cap, r2.rate * s2.w) as give from s2 left join r2 on s2.domain = r2.domain),
        l3 as (select f.domain, f.lang, f.source, f.tokens, f.cap, 1.0::double as w, a2.give from leaf f join a2 on f.domain = a2.domain and f.lang = a2.lang),
        s3 as (select *, (give - coalesce(sum(cap) over (partition by domain, lang order by cap / w, source rows between unbounded preceding and 1 preceding), 0))
                      / sum(w) over (partition by domain, lang order by cap / w, source rows between current row and unbounded following) as rate from l3),
        r3 as (select domain, lang, max(rate) as rate from s3 group by domain, lang),
        a3 as (select s3.domain, s3.lang, s3.source, s3.tokens,
                      floor(round(least(s3.cap, r3.rate * s3.w), 3)) as budget
               from s3 left join r3 on s3.domain = r3.domain and s3.lang = r3.lang),
        e as (select t.*, x.epoch, x.epoch < floor(a3.budget / a3.tokens) as whole, a3.budget - x.epoch * a3.tokens as quota
              from t join a3 using (domain, lang, source) join (select unnest([0, 1, 2, 3]) as epoch) x on x.epoch * a3.tokens < a3.budget),
        o as (select *, sum(n_tokens) over (partition by domain, lang, source, epoch
                        order by md5('17:' || cast(epoch as varchar) || ':' || cast(doc_id as varchar)), doc_id, n_tokens) - n_tokens as before from e)
        select doc_id, domain, lang, source, epoch::bigint as epoch, n_tokens::bigint as n_tokens,
               (case when whole then n_tokens else least(n_tokens, quota - before) end)::bigint as take_tokens
        from o where whole or before < quota""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
             q as (select page_id, octet_length(encode(body)) as n, sha1(encode(body)) as d from p),
             k as (select d, n, max(page_id) as keeper from q where n >= 1000 group by d, n)
        select q.page_id, q.n as payload_bytes, q.d as payload_digest,
               case when k.keeper is null or k.keeper = q.page_id then 'response' else 'revisit' end as record_type,
               case when k.keeper <> q.page_id then k.keeper end as refers_to
        from q left join k on q.d = k.d and q.n = k.n""",
    # CRC-32 bit by bit for the table of bytes, byte by byte for each distinct feature
    "op12_importance_resampling": r"""
        with m as (select list(list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) order by i) as tab from range(0, 256) r(i)),
        texts as (select 'd' as side, doc_id, text from documents union all select 'b', item_id, text from benchmark),
        w as (select side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
        f as (select side, doc_id, unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) as feature from w),
        g as (select side, doc_id, feature, count(*) as c from f group by all),
        h as (select feature, hex(encode(feature)) as x from (select distinct feature from g)),
        b as (select feature, xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint),
                     lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295)) % 10000 as bucket from h, m),
        p as (select g.side, g.doc_id, b.bucket, sum(g.c) as c from g join b using (feature) group by all),
        n as (select bucket, coalesce(sum(c) filter (side = 'd'), 0) as s, coalesce(sum(c) filter (side = 'b'), 0) as t from p group by bucket),
        z as (select sum(s) as ss, sum(t) as tt from n),
        gain as (select bucket, floor(1000 * ln((t + 1)::double * (ss + 10000)::double / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from n, z),
        d as (select p.doc_id, sum(p.c)::bigint as n_features, sum(p.c * gain.gain)::bigint as total from p join gain using (bucket) where side = 'd' group by p.doc_id),
        e as (select w.doc_id, len(w.ws) as n_words, coalesce(d.n_features, 0)::bigint as n_features,
                     case when d.n_features is null then 0 else (d.total - ((d.total % d.n_features) + d.n_features) % d.n_features) // d.n_features end::bigint as weight
              from w left join d on w.doc_id = d.doc_id where w.side = 'd'),
        v as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from e),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from v where n_words >= 20)
        select v.doc_id, v.n_features, v.weight, v.score, (case when r.place <= 25 * r.n // 100 then r.place end)::bigint as rank from v left join r on v.doc_id = r.doc_id""",
}
