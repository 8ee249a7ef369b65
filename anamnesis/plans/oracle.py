"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions import fixed

MESSAGES = """m as (select 'u' || (conv_id % 5) as user_id, conv_id::varchar as session_id,
    row_number() over (partition by conv_id % 5 order by conv_id, turn) - 1 as seq, role,
    1704067200000 + conv_id * 86400000 + turn * 60000 as ts, text as content from conversations)"""

FACTS = """f as (select 'u' || (o_custkey % 5) as user_id, 's' || o_custkey as session_id,
    row_number() over (partition by o_custkey % 5 order by o_orderkey) - 1 as seq, 'user' as role, epoch_ms(o_orderdate) as ts,
    case when o_orderkey % 4 = 0 and c_mktsegment <> 'MACHINERY' then 'Actually the ' || noun || ' changed to ' || floor(o_totalprice)::bigint || ' today.'
        when o_orderkey % 4 = 1 then 'We never approved the ' || noun || ' proposal.'
        when o_orderkey % 4 = 3 then 'We met Acme Logistics and discussed the ' || noun || ' ' || (o_orderkey % 9 + 2) || ' days ago.'
        else 'The ' || noun || ' invoice arrived with ' || (o_orderkey % 90 + 10) || ' boxes yesterday.' end as content, noun, o_orderkey, c_mktsegment
    from (select *, case c_mktsegment when 'AUTOMOBILE' then 'engine freight quota' when 'BUILDING' then 'cement crane permit' when 'FURNITURE' then 'walnut table catalog'
        when 'HOUSEHOLD' then 'kitchen linen voucher' else 'turbine lathe warranty' end as noun from orders join customer on o_custkey = c_custkey))"""

QUESTIONS = """q as (select item_id as query_id, 'u' || (item_id % 5) as user_id,
    array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as query from benchmark)"""

VECTORS = """v as (select 'u' || (doc_id % 5) as user_id, (doc_id // 20)::varchar as session_id,
    row_number() over (partition by doc_id % 5 order by doc_id) - 1 as seq, text as content, embedding
    from documents join embeddings on doc_id = vec_id)"""


def day(ts: str, form: str = "%d %B %Y") -> str:
    return f"strftime(make_timestamp({ts} * 1000), '{form}')"


def line(x: str = "") -> str:
    return f"'[' || {day(x + 'ts', '%Y-%m-%d')} || '] ' || {x}role || ': ' || {x}content"


def index(units: str, tokens: str = "regexp_extract_all(lower(index_text), '[a-z0-9]+')") -> str:
    """BM25 statistics of units (user_id, seq, index_text)."""
    return f"""t as (select user_id, seq, {tokens} as w from {units}),
    cs as (select user_id, count(*) as n, avg(len(w)) as avgdl from t group by 1),
    p as (select user_id, seq, len(w) as dl, term, count(*) as tf from (select user_id, seq, w, unnest(w) as term from t) group by all),
    r as (select user_id, term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p join cs using (user_id) group by 1, 2),
    i as (select user_id, term, df, case when raw < 0 then 0.25 * avg(raw) over (partition by user_id) else raw end as idf from r)"""


def scores(queries: str = "q", tokens: str = "regexp_extract_all(lower(query), '[a-z0-9]+')") -> str:
    return f"""qt as (select query_id, user_id, term, count(*) as times from (select query_id, user_id, unnest({tokens}) as term from {queries}) group by all),
    b as (select query_id, user_id, seq, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
        from qt join i using (user_id, term) join cs using (user_id) join p using (user_id, term) group by all)"""


INDEX_TEXT = f"mi as (select user_id, session_id, seq, 'Speaker: ' || role || chr(10) || 'Event date: ' || {day('ts')} || chr(10) || content as index_text from m)"
RANKED = """every as (select query_id, q.user_id, session_id, seq from q join mi using (user_id)),
    rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, seq) as rank
        from (select e.*, coalesce(score, 0.0) as score from every e left join b using (query_id, user_id, seq)))"""
FUSED = """d as (select query_id, v.user_id, session_id, seq, list_dot_product(x.embedding::double[], v.embedding::double[]) as sim
        from q join embeddings x on query_id = vec_id join v using (user_id)),
    dr as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, seq) as dense_rank from d),
    lr as (select query_id, seq, row_number() over (partition by query_id order by round(score, 9) desc, seq) as lex_rank from b where score > 0),
    fu as (select dr.*, lex_rank, 1.0::double / (60 + dense_rank) + coalesce(0.5::double / (60 + lex_rank), 0) as score from dr left join lr using (query_id, seq)),
    rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, round(sim, 9) desc, seq) as rank from fu)"""


def picks(units: str) -> str:
    return f"""sl as (select query_id, user_id, session_id, seq + off as seq, case when off = 0 then score else 0.0 end as score, rank * 3 + slot as pick, rank
        from rk, (values (0, 0), (1, -1), (2, 1)) s(slot, off) where rank <= 20),
    pk as (select query_id, user_id, seq, arg_min(score, pick) as score, min(pick) as pick, arg_min(rank, pick) as rank
        from sl join {units} u using (user_id, seq, session_id) group by all)"""


def fill(source: str, k: int) -> str:
    return f"""fl as (select query_id, user_id, seq, arg_min(score, pick) as score, min(pick) as pick
        from (select query_id, user_id, seq, score, pick from {source} union all select query_id, user_id, seq, score, rank + 66 from rk) group by all),
    ps as (select *, row_number() over (partition by query_id order by pick) as pos from fl qualify pos <= {k})"""


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def stem(w: str) -> str:
    return "case " + " ".join(f"when {w} like '%{s}' and length({w}) >= {len(s) + 3} then left({w}, length({w}) - {len(s)}) || '{e}'" for s, e in fixed.SUFFIXES) + f" else {w} end"


def topic(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.TOPIC_STOP)
    kept = f"list_filter(list_transform({words(text, fixed.TOPIC_WORD)}, lambda w: lower(w)), lambda w: not list_contains([{stop}], w))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


def distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


CHAIN = """c as (select user_id, noun, any_value(string_split(noun, ' ')) as words, row_number() over (partition by user_id order by min(seq)) - 1 as chain_id
        from f where o_orderkey % 4 = 0 and c_mktsegment <> 'MACHINERY' group by 1, 2),
    ce as (select f.user_id, chain_id, noun, seq, ts, content, regexp_extract(content, '[0-9]+') as value, row_number() over (partition by f.user_id, noun order by seq) - 1 as pos
        from f join c using (user_id, noun) where o_orderkey % 4 = 0)"""
LATE = """an as (select *, row_number() over (partition by user_id order by seq desc) as back from f
        where o_orderkey % 4 <> 1),
    kept as (select * from an where back <= 2000 and c_mktsegment = 'MACHINERY')"""
BEST = """best as (select n.user_id, n.seq, arg_min({'s': k.content, 't': k.ts}, k.seq) as x
        from f n join kept k using (user_id) where n.o_orderkey % 4 = 1 and n.c_mktsegment = 'MACHINERY' and n.seq <> k.seq group by 1, 2),
    pr as (select f.user_id, f.seq, f.content as side_neg, f.ts as side_neg_ts, coalesce(l.content, x.s) as side_pos, coalesce(l.ts, x.t) as side_pos_ts, case when l.content is null then 'assertive' else 'chain' end as via, noun
        from f left join (select user_id, noun, arg_max(content, pos) as content, arg_max(ts, pos) as ts from ce group by 1, 2) l using (user_id, noun)
        left join best using (user_id, seq) where o_orderkey % 4 = 1)"""
LATE_PAIRS = f"""{LATE},
    {BEST}"""
PAIRS = f"""kept as (select * from f where o_orderkey % 4 <> 1 and c_mktsegment = 'MACHINERY'),
    {BEST}"""
JUDGED = """j as (select doc_id as id, lang as category, quality = 1 as is_correct, case when quality = 1 then 1.0 when toxic = 0 then 0.5 else 0.0 end as llm_judge_score,
    source as conversation, text as answer from labels join documents using (doc_id))"""
STOP = ", ".join(f"'{w}'" for w in fixed.CONTENT_STOP)


def content(text: str) -> str:
    return f"list_filter(list_transform(list_filter({words(text, fixed.CONTENT_WORD)}, lambda w: length(w) > 3), lambda w: lower(w)), lambda w: not list_contains([{STOP}], w))"


RECALL = f"""rr as (select d.lang as category, (quality = 1)::int::double as score, {content('b.text')} as g, {content('d.text')} as c from documents d join labels using (doc_id) join benchmark b on d.doc_id % (select count(*) from benchmark) = item_id),
    re as (select category, score, len(list_filter(g, lambda w: list_contains(c, w))) / len(g) as recall from rr where len(g) > 0)"""

RESOLVED = f"""case when content like '%today%' then ' [Resolved relative dates: today = ' || {day('ts')} || ']'
    when content like '%yesterday%' then ' [Resolved relative dates: yesterday = ' || {day('(ts - 86400000)')} || ']'
    when content like '% ago.' then ' [Resolved relative dates: ' || regexp_extract(content, '[0-9]+ days ago') || ' = ' || strftime(make_timestamp(ts * 1000)::date - regexp_extract(content, '([0-9]+) days', 1)::int, '%d %B %Y') || ']' else '' end"""

ORACLE_SQL = {
    "tokenize_v2": "select doc_id, len(w)::bigint as n, md5(array_to_string(w, ' ')) as digest from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)",
    "tokenize_v1": "select doc_id, len(w)::bigint as n, md5(array_to_string(w, ' ')) as digest from (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents)",
    "seq_assign": f"with {MESSAGES} select * from m",
    "ingest_dedup": """with b as (select 'u' || user_id as user_id, user_id || '-' || (event_id // 3) as request_id, event_id as arrival, event_type as content from events),
        k as (select * from b qualify row_number() over (partition by user_id, request_id order by arrival) = 1)
        select *, row_number() over (partition by user_id order by arrival) - 1 as seq from k""",
    "units_message": f"with {MESSAGES}, {INDEX_TEXT} select user_id, seq, index_text from mi",
    "units_line": f"with {MESSAGES} select user_id, seq, {line()} as content from m",
    "units_chunk": f"""with {MESSAGES}, g as (select user_id, session_id, array_to_string(list_sort(list_distinct(list(role))), '/') as r, min(ts) as ts, string_agg(role || ': ' || content, chr(10) order by seq) as body from m group by 1, 2)
        select user_id, session_id, 'Speakers: ' || r || chr(10) || 'Event date: ' || {day('ts')} || chr(10) || body as index_text, ts from g""",
    "units_session": f"with {MESSAGES} select user_id, session_id, '[' || {day('min(ts)', '%Y-%m-%d')} || ']' || chr(10) || string_agg({line()}, chr(10) order by seq) as content from m group by 1, 2",
    "units_window": f"""with {MESSAGES}, n as (select *, row_number() over (partition by user_id, session_id order by seq) - 1 as k, count(*) over (partition by user_id, session_id) as n from m),
        w as (select *, unnest(range(0, n, 2)) as start from n)
        select user_id, session_id, start::int as start, '[' || {day('min(ts)', '%Y-%m-%d')} || ']' || chr(10) || string_agg({line()}, chr(10) order by seq) as content
        from w where k >= start and k < start + 3 and (start = 0 or start + 1 < n) group by 1, 2, 3""",
    "split_long_words": """with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, w, unnest(range(0, (len(w) + 199) // 200)) as part from w where len(w) > 0)
        select doc_id, part::int as part, md5(array_to_string(list_slice(w, part * 200 + 1, part * 200 + 200), ' ')) as digest from s""",
    "platform_segments": """with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
        z as (select doc_id, k, len(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))::int as w from l),
        s as (select doc_id, k, 0 as chunk, 1 as n, w as words, w from z where k = 1
            union all select z.doc_id, z.k, case when s.n >= 4 or s.words + z.w > 120 then s.chunk + 1 else s.chunk end, case when s.n >= 4 or s.words + z.w > 120 then 1 else s.n + 1 end,
                case when s.n >= 4 or s.words + z.w > 120 then z.w else s.words + z.w end, z.w from s join z on z.doc_id = s.doc_id and z.k = s.k + 1)
        select doc_id, chunk, count(*) as n, sum(w)::bigint as words from s group by 1, 2""",
    "bm25_index_stats": f"with {MESSAGES}, {INDEX_TEXT}, {index('mi')} select user_id, term, df, round(idf, 6) as idf from i",
    "bm25_topk": f"""with {MESSAGES}, {INDEX_TEXT}, {QUESTIONS}, {index('mi')}, {scores()}
        select query_id, seq, row_number() over (partition by query_id order by round(score, 9) desc, seq) as rank, round(score, 6) as score from b where score > 0 qualify rank <= 10""",
    "bm25_legacy_topk": f"""with {MESSAGES}, mi as (select *, content as index_text from m), {QUESTIONS},
        {index('mi', "list_filter(regexp_split_to_array(lower(index_text), '\\s+'), lambda x: x <> '')")}, {scores(tokens="list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')")}, {RANKED}
        select query_id, user_id || '#' || seq as id, rank, round(score, 4) as score from rk where rank <= 20""",
    "dense_topk": f"""with {QUESTIONS}, {VECTORS}, d as (select query_id, seq, list_dot_product(x.embedding::double[], v.embedding::double[]) as sim from q join embeddings x on query_id = vec_id join v using (user_id))
        select query_id, seq, row_number() over (partition by query_id order by round(sim, 9) desc, seq) as dense_rank, round(sim, 6) as sim from d qualify dense_rank <= 10""",
    "hybrid_rrf": f"""with {QUESTIONS}, {VECTORS}, mi as (select user_id, seq, content as index_text from v), {index('mi')}, {scores()}, {FUSED}
        select query_id, seq, dense_rank, lex_rank, rank, round(score, 6) as score from rk where rank <= 20""",
    "neighbor_expand": f"with {MESSAGES}, {INDEX_TEXT}, {QUESTIONS}, {index('mi')}, {scores()}, {RANKED}, {picks('mi')} select query_id, seq, round(score, 6) as score, pick from pk",
    "fill_topk": f"with {MESSAGES}, {INDEX_TEXT}, {QUESTIONS}, {index('mi')}, {scores()}, {RANKED}, {picks('mi')}, {fill('pk', 70)} select query_id, seq, pos, round(score, 6) as score from ps",
    "search_abstain": f"""with {QUESTIONS}, {VECTORS}, mi as (select user_id, seq, content as index_text from v), {index('mi')}, {scores()}, {FUSED}, {picks('v')},
        ec as (select query_id, rank, coalesce(sum(count(*)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from pk group by 1, 2),
        op as (select pk.* from pk join ec using (query_id, rank) where before < 30), {fill('op', 30)}
        select query_id, seq, pos, round(score, 6) as score from ps qualify count(*) over (partition by query_id) <= 10 or score >= 0.004""",
    "relative_dates": f"with {FACTS} select user_id, seq, {RESOLVED} as resolved from f",
    "render_memories": f"with {FACTS} select seq as pos, 'mem-' || seq as id, '[mem-' || seq || ' | user | ' || {day('ts')} || '] ' || content || {RESOLVED} as content, 0.5::double as score, ts from f",
    "entity_expand": f"""with {FACTS} select (100 * substr(user_id, 2)::int)::int as query_id, 'acme logistics' as entity, seq from f where o_orderkey % 4 = 3 qualify row_number() over (partition by user_id order by seq) <= 8""",
    "topic_words": f"with {FACTS} select user_id, seq, array_to_string({distinct(topic('content'))}, ' ') as topic from f",
    "values": f"with {FACTS} select user_id, seq, array_to_string(list_transform({words('content', fixed.VALUE)}, lambda x: trim(x)), '|') as found from f",
    "scan_updates": f"with {FACTS} select user_id, seq, 0 as n, content as sentence, regexp_extract(content, '[0-9]+') || case when content like '%. today%' then '.' else '' end as value from f where o_orderkey % 4 = 0 and c_mktsegment <> 'MACHINERY'",
    "scan_negations": f"with {FACTS} select user_id, seq, 0 as n, content as sentence from f where o_orderkey % 4 = 1",
    "scan_assertives": f"with {FACTS}, k as (select *, row_number() over (partition by user_id order by seq desc) as back from f where o_orderkey % 4 <> 1) select user_id, seq, 0 as n, content as sentence from k where back <= 2000",
    "update_chains": f"with {FACTS}, {CHAIN} select user_id, chain_id::int as chain_id, array_to_string(list_transform(string_split(noun, ' '), lambda w: {stem('w')}), ' ') as topic, pos::int as pos, seq, value from ce",
    "conflict_pairs": f"with {FACTS}, {CHAIN}, {PAIRS} select user_id, seq, side_neg, side_pos, side_pos_ts, via from pr",
    "latest_card": f"""with {FACTS}, {CHAIN}, x as (select user_id, arg_max(seq, seq) as seq, arg_max(ts, seq) as ts, arg_max(content, seq) as content, arg_max(value, seq) as value from ce where noun = 'walnut table catalog' group by 1)
        select (100 * substr(user_id, 2)::int + i)::int as query_id, seq, '[LATEST VALUE RECORD | most recent statement, ' || {day('ts')} || '] ' || content || ' (most up-to-date value: ' || value || ')' as content from x, range(2) r(i)""",
    "conflict_card": f"""with {FACTS}, {CHAIN}, {LATE_PAIRS}, x as (select user_id, arg_min(side_neg, seq) as a, arg_min(side_neg_ts, seq) as a_ts, arg_min(side_pos, seq) as b, arg_min(side_pos_ts, seq) as b_ts from pr where noun = 'walnut table catalog' group by 1)
        select (100 * substr(user_id, 2)::int + 1)::int as query_id, '[CONFLICT RECORD | contradictory statements exist in memory] (a) "' || a || '" [' || {day('a_ts')} || ']; (b) "' || b || '" [' || {day('b_ts')}
            || ']. These two statements contradict each other — a correct answer must acknowledge the contradiction and cite both sides, not pick one.' as content from x""",
    "persona_card": """with l as (select n_regionkey as r, 'u' || n_regionkey as user_id, string_agg('- [HABITS] likes ' || n_name, chr(10) order by n_nationkey) as body from nation group by 1, 2)
        select (100 * r)::int as query_id, '[USER PREFERENCE SUMMARY | stable traits extracted from memory history]' || chr(10) || body as content from l""",
    "evidence_recall": f"with {RECALL} select category, count(*) as n, round(avg(recall), 6) as recall from re group by 1",
    "attribution_quadrants": f"""with {RECALL} select coalesce(category, 'TOTAL') as category, count_if(recall >= 0.2 and score >= 0.999)::bigint as pp, count_if(recall >= 0.2 and score < 0.999)::bigint as pw,
        count_if(recall < 0.2 and score < 0.999)::bigint as aw, count_if(recall < 0.2 and score >= 0.999)::bigint as ap from re group by rollup (category)""",
    "accuracy_grouping_sets": f"""with {JUDGED}, k as (select *, case when regexp_matches(answer, '{fixed.TIME_ANSWER}', 'i') then 'time' else 'plain' end as timed from j)
        select case grouping(category, conversation, timed) when 3 then 'category' when 5 then 'conversation' when 6 then 'timed' else 'total' end as kind, coalesce(category, conversation, timed, 'TOTAL') as name,
            sum(is_correct::int)::bigint as right, count(*) as n, round(sum(is_correct::int) / count(*), 6) as accuracy from k group by grouping sets ((category), (conversation), (timed), ())""",
    "accuracy_rollup": f"with {JUDGED} select coalesce(category, 'TOTAL') as category, sum(is_correct::int)::bigint as right, count(*) as n from j group by rollup (category)",
    "score_by_dimension": f"""with {JUDGED} select case category when 'en' then 'recall' when 'fr' then 'recall' when 'de' then 'time' else '?' end as dimension, count(*) as n, round(100 * avg(llm_judge_score::double), 6) as score,
        case dimension when 'recall' then 64.4::double when 'time' then 41.4::double end as best from j group by 1""",
    "dataset_mean": f"with {JUDGED}, e as (select category, avg(llm_judge_score::double) as s from j group by 1) select count(*) as datasets, round(avg(s), 6) as mean_score from e",
    "variant_delta": f"""with {JUDGED}, e as (select category as dataset, avg(llm_judge_score::double) filter (id % 2 = 0) as a, avg(llm_judge_score::double) filter (id % 2 = 1) as b from j group by 1)
        select dataset, round(a, 6) as baseline, round(b, 6) as variant, round(b - a, 6) as delta from e where a is not null and b is not null""",
    "event_ordering": """with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id order by value, event_id) as b, count(*) over (partition by user_id) as c from events),
        u as (select user_id, c as k, a, b from s),
        z as (select user_id, k, count(*) over (partition by user_id) + 1 as tie, a, b from u), y as (select user_id, k, coalesce(a, tie) as a, coalesce(b, tie) as b from z),
        h as (select user_id, any_value(k)::double as k, count_if(a is not null and b is not null)::double as tp from z group by 1),
        pairs as (select l.user_id, sign(l.a - r.a) as x, sign(l.b - r.b) as w from y l join y r on l.user_id = r.user_id and (l.a, l.b) < (r.a, r.b)),
        t as (select user_id, count_if(x * w > 0)::double as p, count_if(x * w < 0)::double as n, count_if(x = 0 and w <> 0)::double as ta, count_if(w = 0 and x <> 0)::double as tb from pairs group by 1),
        g as (select user_id, tp / k as pr, case when (p + n + ta) * (p + n + tb) > 0 then ((p - n) / sqrt((p + n + ta) * (p + n + tb)) + 1) / 2 else 0.5 end as tau from h left join t using (user_id))
        select user_id, round(pr, 6) as precision, round(pr, 6) as recall, round(pr, 6) as f1, round(coalesce(tau, 0.5), 6) as tau_norm, round(coalesce(tau, 0.5) * pr, 6) as final_score from g""",
    "corpus_profile": f"""with {MESSAGES}, e as (select user_id, count(distinct session_id) as s, count(*) as c, sum(len(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) as w from m group by 1)
        select count(*) as users, round(avg(s), 6) as mean_sessions, min(s) as min_sessions, max(s) as max_sessions, sum(c)::bigint as messages, sum(w)::bigint as words from e""",
    "latency_percentiles": """with s as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events)
        select max(value) filter (k = greatest(0, floor(0.5 * n)::bigint - 1)) as p50, max(value) filter (k = greatest(0, floor(0.9 * n)::bigint - 1)) as p90, max(value) filter (k = greatest(0, floor(0.99 * n)::bigint - 1)) as p99, max(value) as most from s""",
    "resume_antijoin": "select doc_id as id from documents where doc_id not in (select doc_id from labels where toxic <> 1)",
    "id_set_check": """with a as (select distinct doc_id as id from documents), b as (select distinct doc_id + 3 as id from labels)
        select coalesce(a.id, b.id) as id, case when a.id is null then 'a' else 'b' end as missing from a full join b using (id) where a.id is null or b.id is null""",
    "badcase_sample": f"with {JUDGED} select category, id, row_number() over (partition by category order by id)::int as n from j where llm_judge_score < 1 qualify n <= 3",
    "judge_parse": "select doc_id, case doc_id % 5 when 0 then 'CORRECT' when 1 then 'WRONG' end as label from labels",
    "rubric_parse": "select doc_id, case when doc_id % 4 = 0 then 1.0::double end as first, case when doc_id % 4 = 0 then 0.5::double end as second from labels",
    "sanitize": "select n_nationkey, n_name || 'a b c d  e f g ->-> 12,3 ' as clean, n_name || 'a b c d  e f g' as cut from nation",
}
ORACLE_SQL |= {
    "units_per_user": f"with {MESSAGES} select user_id, count(*) as units from m group by 1",
    "entity_stats": f"with {FACTS}, e as (select user_id, word, count(*) as df from (select distinct user_id, seq, unnest(case o_orderkey % 4 when 3 then ['acme logistics'] else [] end) as word from f) group by 1, 2) select user_id, count_if(df >= 2)::bigint as active, count(*) as raw from e group by 1",
    "answer_mix": f"""with {JUDGED} select category, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, round(count_if(regexp_matches(answer, '{fixed.TIME_ANSWER}', 'i')) / count(*), 6) as timed,
        round(count_if(regexp_matches(answer, '[0-9]')) / count(*), 6) as numbered from j group by 1""",
    "evidence_spread": """with e as (select user_id, count(distinct event_type) as s, count(*) as p from events group by 1)
        select count(*) as questions, count_if(s > 1)::bigint as across, round(avg(p), 6) as mean_pieces, max(p) as most_pieces from e""",
    "message_lengths": f"with {MESSAGES}, k as (select length(content) as n, row_number() over (order by length(content)) - 1 as r, count(*) over () as c from m) select round(avg(n), 6) as mean_chars, median(n) as median_chars, max(n) filter (r = floor(c * 0.95)::bigint) as p95 from k",
    "contexts": f"""with {MESSAGES}, {INDEX_TEXT}, {QUESTIONS}, {index('mi')}, {scores()}, x as (select query_id, user_id, seq, row_number() over (partition by query_id order by round(score, 9) desc, seq) as pos from b where score > 0 qualify pos <= 10),
        g as (select query_id, string_agg('[memory mem-' || seq || '] [mem-' || seq || ' | ' || role || ' | ' || {day('ts')} || '] ' || content, chr(10) || chr(10) order by pos) as context from x join m using (user_id, seq) group by 1)
        select query_id, length(context)::int as chars, md5(context) as digest from g""",
}
ORACLE_SQL["stream_ingest"] = ORACLE_SQL["ingest_dedup"]
JOINED = """i as (select page_id as id, 0 as late, 'page' as category, html as gold from pages union all select item_id, 1, 'benchmark', text from benchmark),
    l as (select id, arg_max(category, late) as category, arg_max(gold, late) as gold from i group by 1),
    ji as (select b.doc_id as id, coalesce(category, '?') as category, coalesce(gold, '') as gold, coalesce(d.text, '') as answer, quality, toxic from labels b left join l on l.id = b.doc_id left join documents d on d.doc_id = b.doc_id)"""
ORACLE_SQL |= {
    "judged_with_inputs": f"with {JOINED} select id, category, md5(gold) as gold, md5(answer) as answer from ji",
    "score_report": f"""with {JOINED}, k as (select category, quality, case when regexp_matches(gold, '{fixed.TIME_ANSWER}', 'i') then 'time' else 'plain' end as timed,
            case when regexp_matches(answer, '{fixed.RELATIVE_ANSWER}', 'i') and not regexp_matches(gold, '{fixed.RELATIVE_ANSWER}', 'i') then 'relative' else 'fixed' end as relative from ji)
        select case grouping(category, timed, relative) when 3 then 'category' when 5 then 'timed' when 6 then 'relative' else 'total' end as kind, coalesce(category, timed, relative, 'TOTAL') as name,
            count_if(quality = 1)::bigint as right, count(*) as n from k group by grouping sets ((category), (timed), (relative), ())""",
    "group_totals": f"with {JOINED} select category, count(*) as n, count_if(toxic = 1)::bigint as errors, round(100 * avg(case when toxic = 0 then quality::double else 0 end), 6) as total from ji group by 1",
}
AGO_TEXT = "case when ago >= 60 then ago || 'd (~' || (ago // 30) || 'mo)' when ago >= 14 then ago || 'd (~' || (ago // 7) || 'w)' else ago || 'd' end"
ORACLE_SQL["timeline_card"] = f"""with {FACTS}, a as (select * from (values (0, 'How many days between the walnut table catalog updates?', false), (1, 'How long ago was the cement crane permit invoice?', true)) v(k, query, back)),
    t as (select user_id, seq, ts, content, k, back, max(ts) over (partition by user_id, k) as anchor, {topic('content')} as w, {topic('query')} as asked from f, a where ts <> 0),
    b as (select * from t where list_has_any(w, asked) qualify row_number() over (partition by user_id, k order by seq) <= 30),
    g as (select *, row_number() over o as n, (ts - lag(ts) over o) // 86400000 as gap, (anchor - ts) // 86400000 as ago from b window o as (partition by user_id, k order by ts, seq)),
    c as (select user_id, k, any_value(back) as back, any_value(anchor) as anchor, count(*) as n, string_agg('(' || n || ') [' || {day('ts', '%d %b %Y')} || ']' || case when gap is not null then ' (+' || gap || 'd)' else '' end
        || case when back and ago > 0 then ' [' || {AGO_TEXT} || ' before latest]' else '' end || ' ' || content, chr(10) order by n) as body from g group by 1, 2)
    select (100 * substr(user_id, 2)::int + k)::int as query_id, '[TIMELINE | retrieved memories re-ordered earliest to latest; (1) = first event]' || chr(10) || body
        || case when back then chr(10) || '[ANCHOR | latest activity date in memory: ' || {day('anchor', '%d %b %Y')} || ']' else '' end as content from c where n >= 2"""
WALNUT = "noun = 'walnut table catalog'"
ORACLE_SQL["memory_search"] = f"""with {FACTS}, {CHAIN}, {PAIRS}, a as (select * from (values (0, 'What is the current walnut table catalog?'), (1, 'What is the current walnut table catalog proposal?'), (2, 'When did the walnut table catalog change?')) v(k, query)),
    q as (select (100 * u + k)::int as query_id, 'u' || u as user_id, query from a, range(5) g(u)),
    mi as (select user_id, session_id, seq, 'Speaker: ' || role || chr(10) || 'Event date: ' || {day('ts')} || chr(10) || content as index_text from f), {index('mi')}, {scores()}, {RANKED}, {picks('mi')}, {fill('pk', 30)},
    told as (select 100 * substr(user_id, 2)::int as base, max(seq) as seq, user_id in (select user_id from pr where {WALNUT}) as denied from ce where {WALNUT} group by user_id),
    tl as (select query_id from ps join f using (user_id, seq) join q using (query_id) where query_id % 100 = 2 and list_has_any({topic('content')}, {topic('query')}) group by 1 having count(*) >= 2),
    o as (select query_id, 3 as place, pos, 'mem-' || seq as id, round(score, 6) as score from ps union all select query_id, 2, 0, 'timeline-0', 9.3 from tl
        union all select base, 1, 0, 'upd-' || seq, 9.5 from told union all select base + 1, 1, 0, case when denied then 'conflict-0' else 'upd-' || seq end, case when denied then 9.0 else 9.5 end from told)
    select query_id::int as query_id, nth::int as pos, id, score::double as score from (select *, row_number() over (partition by query_id order by place, pos) as nth from o) where nth <= 30"""
