"""The registered queries of the text operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import jaccard, lines, lm, media, mixing, phrases, pieces, pii, quality, repair, rules, simhash, warc


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), piece_model(), ids_too=False)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_quality, op4_sentencepiece, op5_rules, op6_media, op7_lm, op8_simhash, op9_lines, op10_mixing, op11_jaccard, op12_repair, op13_phrases)}

ORACLE_SQL = {
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        q as (select page_id, strlen(html) as n, sha1(html) as d from p),
        g as (select d, max(page_id) as top from q where n >= 1000 group by d having count(*) > 1)
        select page_id, n::bigint as payload_bytes, q.d as payload_digest,
            case when top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type,
            case when top is not null and page_id is distinct from top then top end as refers_to
        from q left join g on q.d = g.d and n >= 1000
    """,
    "op11_jaccard": """
        with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r as (select doc_id, doc_id as node from n union select r.doc_id, e.b from r join e on r.node = e.a),
        m as (select doc_id, min(node) as least from r group by 1)
        select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, documents.doc_id) as component_id from documents left join n using (doc_id) left join m using (doc_id)
    """,
    "op12_repair": """
        with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
        -- CRC-32 of the key, bit by bit.
        h as (select *, xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i]), -1, -1, -1, -1, -1, -1, -1, -1]))::bigint[],
            lambda c, b: case when b >= 0 then xor(c, b) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint), 4294967295) % 20 as kind from o),
        d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
        u as (select *, row_number() over () as one from d),
        r as (select conv_id, turn, role, text, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, one) > 1 as seen,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as t from u window w as (partition by conv_id order by turn nulls first, role, md5(text), one)),
        f as (select conv_id, turn, role, text, i, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '?' end as c,
            case when t = '' then 'blank' when seen then 'duplicate' when right(t, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
            left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as two from r),
        s as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
            count_if(fault = 'truncated') as truncated, count_if(two not in ('su', 'ua', 'au')) as illegal from f group by 1),
        -- Inserts from a state, and the grammar's arcs.
        ins as (select * from (values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) v(g, mid, pre)),
        gr as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(mid, c, g2)),
        arcs as (select g, '' as c, mid as g2, pre || 'D' as label, 2 * length(pre) + 3 as cost, true as any_row from ins
            union all select g, c, g2, pre || 'K', 2 * length(pre), false from ins join gr using (mid)
            union all select g, '', g2, pre || 'R', 2 * length(pre) + 2, false from ins join gr using (mid) where c <> 's'),
        p as (select conv_id, n, 0 as i, 0 as g, 0 as cost, '' as audit from s
            union all
            select conv_id, any_value(n), any_value(i), g, min(x).c, min(x).a from (
                select p.conv_id, p.n, f.i, a.g2 as g, {'c': p.cost + a.cost + (fault = 'truncated' and not any_row)::int, 'a': p.audit || label} as x
                from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1 join arcs a on a.g = p.g and (a.c = '' or a.c = f.c) and (any_row or fault not in ('blank', 'duplicate'))) group by conv_id, g),
        e as (select conv_id, min({'c': cost + 2 * length(pre), 'a': audit || pre}) as x from p join ins using (g) where p.i = n and mid in (0, 3) group by 1),
        -- The audit again, edit by edit.
        y as (select conv_id, x.a as audit, 0 as j, 0 as i, 0 as g, null::varchar as line from e
            union all
            select y.conv_id, audit, j + 1, y.i + (ed <> 'I')::int, case when ed = 'D' then y.g else (select g2 from gr where gr.mid = y.g and gr.c = case when ed = 'K' then f.c when y.g = 2 then 'a' else 'u' end) end,
                case ed when 'D' then null when 'K' then f.role || ':' || f.text else case when y.g = 2 then 'assistant' else 'user' end || ':' || case ed when 'I' then '' else f.text end end
            from (select *, audit[j + 1] as ed from y where j < length(audit)) y left join f on f.conv_id is not distinct from y.conv_id and f.i = y.i + 1),
        z as (select conv_id, sha256(coalesce(string_agg(line, chr(10) order by j), '')) as digest from y group by 1),
        k as (select distinct conv_id from conversations)
        select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
            coalesce(e.x.c, 0)::bigint as cost, coalesce(e.x.a, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
        from k left join s on s.conv_id is not distinct from k.conv_id left join e on e.conv_id is not distinct from k.conv_id left join z on z.conv_id is not distinct from k.conv_id
    """,
    "op13_phrases": """
        with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') as w from d),
        f1 as (select lang, x as p, count(*) as f from (select lang, unnest(w) as x from p) group by all),
        n as (select lang, sum(f)::hugeint as n from f1 group by 1),
        f2 as (select lang, x as p, y as q, count(*) as f from (select lang, unnest(w[1:len(w) - 1]) as x, unnest(w[2:len(w)]) as y from p where len(w) >= 2) group by all having count(*) >= 10),
        f3 as (select lang, x as p, y as q, z as s, count(*) as f from (select lang, unnest(w[1:len(w) - 2]) as x, unnest(w[2:len(w) - 1]) as y, unnest(w[3:len(w)]) as z from p where len(w) >= 3) group by all having count(*) >= 10),
        c as (select f2.lang, f2.p || ' ' || f2.q as phrase, f2.f as a, l.f as l, r.f as r, 1 as k from f2 join f1 l on l.lang = f2.lang and l.p = f2.p join f1 r on r.lang = f2.lang and r.p = f2.q
            where not exists (select 1 from f3 where f3.lang = f2.lang and ((f3.p = f2.p and f3.q = f2.q) or (f3.q = f2.p and f3.s = f2.q)) and 100 * f3.f >= 50 * f2.f)
            union all select f3.lang, f3.p || ' ' || f3.q || ' ' || f3.s, f3.f, l.f, r.f, 1 from f3 join f1 l on l.lang = f3.lang and l.p = f3.p join f2 r on r.lang = f3.lang and r.p = f3.q and r.q = f3.s
            union all select f3.lang, f3.p || ' ' || f3.q || ' ' || f3.s, f3.f, l.f, r.f, 2 from f3 join f2 l on l.lang = f3.lang and l.p = f3.p and l.q = f3.q join f1 r on r.lang = f3.lang and r.p = f3.s),
        v as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from c),
        b as (select * from v qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
        select o.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o join n on n.lang = o.lang where rank <= 2000
    """,
}
