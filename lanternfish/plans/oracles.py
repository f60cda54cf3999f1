"""SQL for each registered query, in DuckDB's dialect, written from the semantics and not from the plans."""

from __future__ import annotations

from ..functions import text as X
from ..functions.globs import any_regex
from ..operators.stages import CLOSING, OPENING

ALLOW = ["*/*", "**/index*", "en/[0-9]*", "{fr,de}/**", "**/*.md"]
DENY = ["**/*secret*", "**/*token*/**", "**/es/**", "de/1?/*", "**/*ref=y*"]

W = X.WS
NOW = 1_767_225_600_000


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{W}]+|[{W}]+$')}, '', 'g')"


def tok(x: str) -> str:
    return rf"(len(regexp_extract_all({x}, {q(X.LATIN_WORD)})) + len(regexp_extract_all({x}, {q(X.CJK)})) + (length(regexp_replace({x}, {q(X.COUNTED)}, '', 'g')) + len(regexp_extract_all({x}, '[\x{{10000}}-\x{{10FFFF}}]')) + 2) // 3)"


def day(ms: str) -> str:
    return f"strftime(date '1970-01-01' + cast({ms} // 86400000 as integer), '%Y-%m-%d')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{W}]+')}), lambda w: w <> '')"


def cut(x: str, tokens: str, most: int) -> str:
    return f"(case when {tokens} <= {most} then {x} else array_to_string(({words(x)})[1:{most}], ' ') || chr(10) || '[truncated; read source file for full chunk]' end)"


def cite(text: str) -> str:
    return f"'[' || source || ' · ' || date || case when type = 'session' then ' · session log — may be superseded' else '' end || '] ' || {text}"


def shown(name: str, x: str) -> str:
    return f"'{name}=' || round({x}, 6)::varchar"


TIER = "(['memory','page','skill','session'])[doc_id % 4 + 1]"
MTIME = "(1704067200000 + doc_id * 86400000)"
SOURCE = "source || '/' || doc_id || '.md'"


def chunks_from(docs: str) -> str:
    return f"""select substr(sha256({SOURCE} || ':root:0:0'), 1, 16) as id, doc_id, text, {SOURCE} as source, 'root' as section, sha256(text) as hash,
    {MTIME} as mtime, {tok('text')} as token_count, {day(MTIME)} as date, {TIER} as type from {docs}"""


def found_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+')"


CHUNKS = f"chunks as materialized ({chunks_from('documents')})"
ASKED = "asked as (select item_id as query_id, text as query, embedding as vector from benchmark join embeddings on vec_id = item_id)"
NEAR = """near as materialized (select query_id, id, distance, 1 / (1 + distance) as score, row_number() over (partition by query_id order by distance, id) as dense_rank
  from (select query_id, id, round(list_distance(embedding::double[], vector::double[]), 9) as distance
        from asked, embeddings join chunks on doc_id = vec_id))"""
DENSE = "dense as (select * from near where dense_rank <= 5)"
POSTED = f"""posted as materialized (
  select id, col, lower(t.t) as term, t.i - 1 as pos from (
    select id, 'text' as col, {found_tokens('text')} as ts from chunks union all
    select id, 'source', {found_tokens('source')} from chunks union all
    select id, 'section', {found_tokens('section')} from chunks) x, unnest(list_zip(ts, range(1, len(ts) + 1))) as u(z), lateral (select z[1] as t, z[2] as i) t),
stats as (select id, count(*) as n_tokens from posted group by id)"""
TERMS = r"""terms as (select query_id, min(i) - 1 as phrase_no, arg_min(t, i) as term from (
    select query_id, z[1] as t, z[2] as i from (select query_id, regexp_extract_all(query, '[\p{L}\p{N}_]+') as ts from asked) a, unnest(list_zip(ts, range(1, len(ts) + 1))) as u(z))
  group by query_id, lower(t))"""
BM25 = """tf as (select term, id, count(*) as tf from posted group by term, id),
folded as (select query_id, phrase_no, lower(strip_accents(term)) as term from terms),
hits as (select query_id, phrase_no, id, tf from folded join tf using (term)),
dfs as (select query_id, phrase_no, count(*) as df from hits group by all),
corpus as (select count(*) as n, avg(n_tokens) as mean from (select id, coalesce(n_tokens, 0) as n_tokens from chunks left join stats using (id))),
scored as (select query_id, id, round(sum(case when ln((n - df + 0.5::double) / (df + 0.5::double)) <= 0 then 1e-6::double else ln((n - df + 0.5::double) / (df + 0.5::double)) end
    * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n_tokens / mean))), 6) as bm25_score
  from hits join dfs using (query_id, phrase_no) join stats using (id), corpus group by query_id, id),
bm25 as materialized (select query_id, id, bm25_score, bm25_rank from (select scored.*, row_number() over (partition by query_id order by bm25_score desc, mtime desc, id) as bm25_rank
  from scored join chunks using (id)) where bm25_rank <= 10)"""
FUSED = """lists as (
  select query_id, id, 0 as l, dense_rank as rank, score, null::double as bm25_score, dense_rank, null::bigint as bm25_rank from dense union all
  select query_id, id, 1, bm25_rank, null, bm25_score, null, bm25_rank from bm25),
summed as (select query_id, id, sum(1 / (60 + rank)::double) as fused_score, min(l * 1000000 + rank) as seen, max(score) as score, max(bm25_score) as bm25_score,
    max(dense_rank) as dense_rank, max(bm25_rank) as bm25_rank from lists group by query_id, id),
norm as (select s.*, fused_score / (n_lists / 61::double) as normalized_fused from summed s join (select query_id, count(distinct l) as n_lists from lists group by query_id) using (query_id)),
fused as materialized (select norm.*, c.* exclude (id), row_number() over (partition by query_id order by normalized_fused desc, score desc nulls last, bm25_score desc nulls last, mtime desc, seen) as pos
  from norm join chunks c using (id))"""
ALL = [CHUNKS, ASKED, NEAR, DENSE, POSTED, TERMS, BM25, FUSED]


def gate(rows: str, keys: str, threshold: str, weight: str, rank_score: str, stale: str = "false") -> str:
    """CTEs from candidates to ``gated``; rows has pos and the columns of chunks."""
    return f"""judged0 as (select *, case when score < {threshold} then 'belowThreshold'
    when score is null and (bm25_rank is null or bm25_rank > 2) then 'bm25WeakNoDense' when {stale} then 'stale' end as r0 from {rows}),
judged1 as (select *, case when r0 is null and row_number() over (partition by {keys}, hash, r0 is null order by pos) > 1 then 'dup' else r0 end as r1, {rank_score} as rank_score from judged0),
judged2 as (select *, coalesce(rank_score, 0) + {weight}::double / (1 + greatest(0, ({NOW} - mtime) / 86400000.0::double) / 30) - case when type = 'session' then 0.05::double else 0 end as final_score from judged1),
placed as materialized (select *, row_number() over (partition by {keys}, r1 is null order by round(final_score, 9) desc, mtime desc, pos) as place from judged2),
pack as (
  select {keys}, 0::bigint as place, 0::bigint as used, []::bigint[] as kept from (select distinct {keys} from placed)
  union all
  select {', '.join('k.' + k.strip() for k in keys.split(','))}, p.place,
    case when used >= 1500 or (used + least(p.token_count, 350) > 1500 and len(kept) > 0) then used else used + least(p.token_count, 350) end,
    case when used >= 1500 or (used + least(p.token_count, 350) > 1500 and len(kept) > 0) then kept else list_append(kept, p.place) end
  from pack k join placed p on {' and '.join(f'p.{x.strip()} = k.{x.strip()}' for x in keys.split(','))} and p.place = k.place + 1 and p.r1 is null),
packed as (select {keys}, arg_max(kept, place) as kept from pack group by {keys}),
gated as materialized (select placed.*, case when r1 is not null then r1 when not list_contains(kept, place) then 'budget' end as drop_reason,
    case when r1 is null and list_contains(kept, place) then list_position(kept, place) end as rank from placed join packed using ({keys}))"""


LIVE = f"live as (select source as s, mtime + case when doc_id % 7 = 0 then 1000 else 0 end as mtime_ms from chunks where doc_id % 11 <> 0)"


def gated(live: bool) -> list[str]:
    rows = "fused"
    extra = []
    if live:
        extra = [LIVE, "fresh as (select fused.*, coalesce(mtime_ms > mtime, true) as is_stale from fused left join live on s = source)"]
        rows = "fresh"
    return [*ALL, *extra, gate(rows, "query_id", "0.45", "0.05", "normalized_fused", "is_stale" if live else "false")]


LINES = f"""assembled as (select query_id, {q(OPENING)} || chr(10) || string_agg({cite(cut('text', 'token_count', 350))}, chr(10) order by rank) || chr(10) || {q(CLOSING)} as additional_context
  from gated where drop_reason is null group by query_id)"""


def sql(ctes: list[str], select: str) -> str:
    return f"with recursive {', '.join(ctes)} {select}" if ctes else select


MARKDOWN = f"""md as (select conv_id, 'memory/sessions/' || conv_id || '.md' as source, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id),
lines as (select source, z[1] as line, z[2]::bigint as line_no from (select source, string_split(text, chr(10)) as ls from md) x, unnest(list_transform(list_zip(ls, range(len(ls))), lambda p: [p[1], p[2]::varchar])) as u(z)),
flags as (select *, regexp_matches(line, {q(X.HEADING.replace(chr(92) + 'z', '$'))}) as is_heading, regexp_matches(line, {q(X.LIST_ITEM)}) as is_list, regexp_matches(line, {q(X.BOLD_LABEL)}) as is_bold,
  not regexp_matches(line, {q(f'[^{W}]')}) as blank, {trimmed(f"regexp_extract(line, {q(X.HEADING.replace(chr(92) + 'z', '$'))}, 2)")} as heading from lines),
numbered as materialized (select *, sum(is_heading::int) over (partition by source order by line_no rows unbounded preceding) as section_id from flags),
sections as (select *, {tok('text')} as tokens, regexp_replace(regexp_replace(regexp_replace(lower(heading), '[`*_~\\[\\]()]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug0 from (
  select source, section_id, coalesce(max(case when is_heading then heading end), 'root') as heading, {trimmed("string_agg(line, chr(10) order by line_no)")} as text, sum(is_list::int) as lists, sum(is_bold::int) as bolds
  from numbered group by source, section_id) where text <> '')"""

UNITS = [
    MARKDOWN,
    "bounds as (select *, (lag(blank) over w is not null and not blank and (lag(blank) over w or is_heading or is_bold or is_list))::int as b from numbered window w as (partition by source, section_id order by line_no))",
    "unit_lines as (select *, sum(b) over (partition by source, section_id order by line_no rows unbounded preceding) as unit_no from bounds)",
    f"units as materialized (select source, section_id, unit_no, u, row_number() over (partition by source, section_id order by unit_no) - 1 as i from (select source, section_id, unit_no, {trimmed('string_agg(line, chr(10) order by line_no)')} as u from unit_lines group by all) where u <> '')",
]


def token_struct(x: str) -> str:
    return rf"{{'la': len(regexp_extract_all({x}, {q(X.LATIN_WORD)}))::bigint, 'cj': len(regexp_extract_all({x}, {q(X.CJK)}))::bigint, 're': (length(regexp_replace({x}, {q(X.COUNTED)}, '', 'g')) + len(regexp_extract_all({x}, '[\x{{10000}}-\x{{10FFFF}}]')))::bigint}}"


def span(lo: str, hi: str, windows: str, t: str) -> str:
    return f"{{'lo': ({lo})::bigint, 'hi': ({hi})::bigint, 'w': ({windows})::boolean, 't': {t}}}"


def size(t: str) -> str:
    return f"({t}.la + {t}.cj + ({t}.re + 2) // 3)"


def added(a: str, b: str) -> str:
    return f"{{'la': {a}.la + {b}.la, 'cj': {a}.cj + {b}.cj, 're': {a}.re + {b}.re}}"


#: Units joined to chunks of 8 to 90 tokens, one unit a step: what is closed, and the span that is still open.
JOINED = [
    f"windows as materialized (select source, section_id, i, list_transform(range((len(ws) + 59) // 60), lambda k: array_to_string(ws[k * 60 + 1 : k * 60 + 90], ' ')) as cut from (select source, section_id, i, {words('u')} as ws from units))",
    f"sized as materialized (select source, section_id, i, {token_struct('u')} as t, {token_struct('cut[-1]')} as tail from units join windows using (source, section_id, i))",
    f"""steps as (
  select distinct source, section_id, -1::bigint as i, []::struct(lo bigint, hi bigint, w boolean, t struct(la bigint, cj bigint, re bigint))[] as done, null::struct(lo bigint, hi bigint, w boolean, t struct(la bigint, cj bigint, re bigint)) as open from sized
  union all
  select source, section_id, i,
    case when {size('t')} > 90 then list_append(flushed, {span('i', 'i', 'true', 'tail')})
      when joins then case when {size('t')} < 8 and {size('grown.t')} < 8 then done else list_append(done, grown) end
      when {size('t')} < 8 then flushed else list_append(flushed, alone) end,
    case when {size('t')} > 90 or {size('t')} >= 8 then null when joins then case when {size('grown.t')} >= 8 then null else grown end else alone end
  from (select *, open is not null and {size('grown.t')} <= 90 as joins from (
    select z.*, s.done, s.open, case when s.open is null then s.done else list_append(s.done, s.open) end as flushed, {span('z.i', 'z.i', 'false', 'z.t')} as alone,
      case when s.open is null then {span('z.i', 'z.i', 'false', 'z.t')} else {span('s.open.lo', 'z.i', 'false', added('s.open.t', 'z.t'))} end as grown
    from steps s join sized z on z.source = s.source and z.section_id = s.section_id and z.i = s.i + 1)))""",
    f"""ended as (select source, section_id, case when open is null then done
    when {size('open.t')} < 8 and len(done) > 0 and {size(added('done[-1].t', 'open.t'))} <= 90 then list_append(done[:-2], {span('done[-1].lo', 'open.hi', 'done[-1].w', added('done[-1].t', 'open.t'))})
    else list_append(done, open) end as spans from (select * from steps qualify row_number() over (partition by source, section_id order by i desc) = 1))""",
    "listed as (select source, section_id, list(u order by i) as us from units group by all)",
    f"""texts as (select source, section_id, p.lo as lo, case when not p.w then [{trimmed("array_to_string(us[p.lo + 1 : p.hi + 1], chr(10) || chr(10))")}]
    when p.hi > p.lo then list_append(cut[:-2], cut[-1] || chr(10) || chr(10) || array_to_string(us[p.lo + 2 : p.hi + 1], chr(10) || chr(10))) else cut end as parts
  from (select source, section_id, unnest(spans) as p from ended) e join listed using (source, section_id) join windows w using (source, section_id) where w.i = p.lo)""",
    "parts as (select source, section_id, (row_number() over (partition by source, section_id order by lo, k) - 1)::int as part, parts[k] as part_text from texts, unnest(range(1, len(parts) + 1)) as u(k))",
]

VERSIONS = f"""v1 as ({chunks_from('documents')}),
docs2 as (select doc_id, case when doc_id % 10 = 1 then text || ' v2' else text end as text, source from documents where doc_id % 10 <> 0 union all
  select doc_id + 1000000, text, source from documents where doc_id % 10 = 2),
v2 as ({chunks_from('docs2')}),
changes as (select coalesce(v1.id, v2.id) as id, case when v1.id is null then 'inserted' when v2.id is null then 'removed' when v1.hash = v2.hash then 'unchanged' else 'updated' end as change
  from v1 full join v2 on v1.id = v2.id)"""

JUDGED = f"""cases as (select vec_id as case_id, label, embedding as vector from embeddings where vec_id % 50 = 0),
named as (select * replace (doc_id::varchar as source) from chunks),
pools as materialized (select case_id, doc_id, source, hash, mtime, token_count, date, type, round(1 / (1 + distance), 9) as score, null::bigint as bm25_rank from (
  select case_id, vec_id, round(list_distance(embedding::double[], vector::double[]), 9) as distance, row_number() over (partition by case_id order by round(list_distance(embedding::double[], vector::double[]), 9), vec_id) as rn
  from cases, (select e.* from embeddings e join documents on doc_id = vec_id) e) join named on doc_id = vec_id where rn <= 30),
grades as (select case_id, vec_id::varchar as source, vec_id % 3 + 1 as grade from cases join embeddings e using (label) where label < 9),
forbidden as (select distinct case_id, source from pools where source in (select doc_id::varchar from labels where toxic = 1)),
sources as (select case_id, source, row_number() over (partition by case_id order by max(score) desc, source) as rank from pools group by case_id, source),
got as (select case_id, count(*) filter (rank <= 5) as hits, min(rank) as first, sum(case when rank <= 5 then (2 ** grade - 1) / log2(rank + 1) end) as dcg from sources join grades using (case_id, source) group by case_id),
ideal as (select case_id, count(*) as relevant, sum(case when p <= 5 then (2 ** grade - 1) / log2(p + 1) end) as idcg from (select *, row_number() over (partition by case_id order by grade desc, source) as p from grades) group by case_id),
ranking as (select case_id, coalesce(hits, 0) / 5 as precision_at_k, coalesce(hits / relevant, 0) as recall_at_k, coalesce(1 / first, 0) as mrr, coalesce(coalesce(dcg, 0) / idcg, 0) as ndcg_at_k
  from cases left join got using (case_id) left join ideal using (case_id))"""


def injected(keys: str) -> str:
    k = "g." + keys.replace(", ", ", g.")
    return f"""chosen as (select distinct {keys}, source from gated where drop_reason is null),
sel as (select {k.replace('g.', 'c.')}, count(*) as n, count(gr.source) as good, count(f.source) as bad from chosen c left join grades gr on gr.case_id = c.case_id and gr.source = c.source
  left join forbidden f on f.case_id = c.case_id and f.source = c.source group by all),
marks as (select {k}, coalesce(relevant, 0) > 0 as should_hit, case when coalesce(n, 0) > 0 then good / n else 0 end as injected_precision, case when coalesce(relevant, 0) > 0 then coalesce(good, 0) / relevant else 0 end as injected_recall,
    coalesce(good, 0) > 0 as injected_hit, coalesce(relevant, 0) = 0 and coalesce(n, 0) = 0 as quiet, coalesce(bad, 0) as forbid_violations
  from grid_cases g left join ideal using (case_id) left join sel using ({keys})),
results as (select *, case when injected_precision + injected_recall > 0 then 2 * injected_precision * injected_recall / (injected_precision + injected_recall) else 0 end as injected_f1 from marks join ranking using (case_id))"""


def mean(c: str) -> str:
    return f"coalesce(avg(case when should_hit then {c} end), 0)"


MEANS = f"""count(*) as cases, count(*) filter (should_hit) as should_hit_cases, count(*) filter (not should_hit) as expect_empty_cases,
  {mean('precision_at_k')} as mean_precision_at_k, {mean('recall_at_k')} as mean_recall_at_k, {mean('mrr')} as mean_mrr, {mean('ndcg_at_k')} as mean_ndcg_at_k,
  {mean('injected_precision')} as ip, {mean('injected_recall')} as ir, coalesce(avg(case when not should_hit then quiet::int end), 1) as quiet_accuracy,
  coalesce(sum(forbid_violations), 0)::bigint as forbid_violations, count(*) filter (injected_hit) as injected_hits"""
TOP = "top as (select *, row_number() over (partition by case_id order by score desc, source, doc_id) as pos from pools)"
EVAL = [CHUNKS, JUDGED, TOP, gate("(select * from top where pos <= 5)", "case_id", "0.45", "0.05", "score"), "grid_cases as (select case_id from cases)", injected("case_id")]
F1_OF_MEANS = "case when ip + ir > 0 then 2 * ip * ir / (ip + ir) else 0 end"
SWEEP = [
    CHUNKS,
    JUDGED,
    TOP,
    "grid as (select row_number() over (order by t, w, k) - 1 as point, round(t, 6) as threshold, w as recency_weight, k as top_k from (select 0.3::double + i * 0.05::double as t from range(7) r(i)), (values (0.0::double), (0.05::double)) ws(w), (values (3), (5)) ks(k))",
    "at_points as (select top.*, point, threshold, recency_weight from top, grid where pos <= top_k and score >= threshold)",
    gate("at_points", "point, case_id", "-1", "recency_weight", "score"),
    "grid_cases as (select point, case_id from grid, cases)",
    injected("point, case_id"),
    f"sums as (select point, {MEANS} from results group by point)",
]

KIND = "case event_id % 4 when 0 then 'client' when 1 then 'service' end"
LOG = f"""log as (select event_id, {KIND} as kind, ts, sha256(user_id::varchar || '-' || (event_id // 40)::varchar) as query_hash,
  case when event_id % 4 = 0 then (['delivered', 'empty', 'error', 'timeout'])[user_id % 4 + 1] end as outcome, floor(value)::bigint as duration_ms, event_id % 2 = 1 as injected from events)"""

ENVELOPED = """case turn % 5 when 0 then '<current-message>' || chr(10) || text || chr(10) || '</current-message>' when 1 then '[chat 1] ann said: ' || text
  when 2 then text || chr(10) || '---- reply via: node send.js x' when 3 then '<replying-to>old' || chr(10) || 'text</replying-to> ' || text else '  ' || text || ' ' || chr(10) end"""
MESSAGE = f"case when regexp_matches(e, '(?is)<current-message>.*</current-message>') then {trimmed('regexp_extract(e, ' + q('(?is)<current-message>(.*?)</current-message>') + ', 1)')} end"


def replaced(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def redacted(x: str) -> str:
    out = trimmed(replaced(x, f"[{W}]+", "' '"))
    # the same ten patterns without lookaround: \b is ASCII here
    for p in (
        f"-----BEGIN[A-Z ]*-----[A-Za-z0-9+/={W}]+?(?:-----END[A-Z ]*-----|$)",
        r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
        f"(?i)\\bBearer[{W}]+[A-Za-z0-9._~+/=-]{{8,}}",
        r"\bsk-[A-Za-z0-9_-]+\b",
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
        r"(?i)\bxox[a-z]-[A-Za-z0-9-]{8,}",
        r"\bgh[pousr]_[A-Za-z0-9]{16,}\b",
        r"\bgithub_pat_[A-Za-z0-9_]{16,}\b",
        r"\bAIza[0-9A-Za-z_-]{30,}\b",
        f"(?i)\\b[A-Za-z0-9_-]*(?:token|secret|password|passwd|pwd|credential|apikey|api[-_]key|private[-_]?key|authorization)[A-Za-z0-9_-]*[{W}]*[:=][{W}]*[^{W}]+",
    ):
        out = replaced(out, p, "'[redacted]'")
    return f"substr({out}, 1, 200)"


def slug(x: str) -> str:
    inner = replaced(replaced(replaced(f"lower({x})", r"[`*_~\[\]()]"), r"[^\p{L}\p{N}]+", "'-'"), "^-+|-+$")
    return f"case when {inner} = '' then 'root' else {inner} end"


PATH = "(['memory/sessions/', 'memory/users/', 'http/public/pages/', '.claude/skills/', 'notes/'])[page_id % 5 + 1] || case when page_id % 3 = 0 then '2025-03-04-' else '' end || page_id || '.md'"
URL_PATH = "regexp_replace(url, '^https?://[^/]*/?', '')"
TOC_ROWS = f"toc_rows as (select source, lang as section, {MTIME} as mtime, doc_id as ord, {day(MTIME)} as date, {TIER} as type from documents)"
TOC = f"""firsts as (select type, source, section, min(mtime) as at_, min(ord) as ord, max(date) as date, count(*) as n from toc_rows group by all),
toc as (select type, source, max(date) as date, sum(n)::bigint as n_chunks, list(section order by ord) as sections from firsts group by type, source)"""
SIGN_ROW = f"{SOURCE} || ':' || {MTIME} || ':' || strlen(text)"

ORACLE_SQL = {
    "knn_topk": sql([CHUNKS, ASKED, NEAR], "select query_id, id, round(distance, 6) as distance, round(score, 6) as score, dense_rank::int as dense_rank from near where dense_rank <= 10"),
    "threshold_gate": sql([CHUNKS, ASKED, NEAR], "select query_id, id, score >= 0.45 as kept from near where dense_rank <= 10"),
    "bm25_topk": sql([CHUNKS, ASKED, POSTED, TERMS, BM25], "select query_id, id, bm25_score, bm25_rank::int as bm25_rank from bm25"),
    "bm25_phrase": sql(
        [CHUNKS, ASKED, POSTED,
         r"ws as (select query_id, regexp_extract_all(query, '[\p{L}\p{N}]+') as w from asked)",
         "pairs as (select query_id, i - 1 as n, w[i] as a, w[i + 1] as b from ws, unnest(range(1, len(w))) as u(i))",
         "firsts as (select query_id, row_number() over (partition by query_id order by n) - 1 as n, a, b from (select query_id, min(n) as n, arg_min(a, n) as a, arg_min(b, n) as b from pairs group by query_id, lower(a || '_' || b)))",
         rf"toks as (select query_id, n as phrase_no, {found_tokens("a || '_' || b")} as p from firsts)",
         "need as (select query_id, phrase_no, len(p) as m, z[1] as term, z[2]::bigint - 1 as shift from (select *, list_zip(p, range(1, len(p) + 1)) as l from toks) x, unnest(list_transform(l, lambda q: [q[1], q[2]::varchar])) as u(z))",
         "starts as (select query_id, phrase_no, m, id, col, pos - shift as at_, count(*) as hits from need join posted using (term) group by all)"],
        "select query_id, phrase_no::int as phrase_no, id, count(*) as tf from starts where hits = m group by query_id, phrase_no, id",
    ),
    "stored_search": sql([CHUNKS, ASKED, POSTED, TERMS, BM25], "select query_id, id, bm25_score, bm25_rank::int as bm25_rank from bm25"),
    "index_counts": "select count(*) as chunks, count(*) as indexed, (select count(*) from embeddings join documents on doc_id = vec_id) as vectors, count(distinct source || '/' || doc_id) as files, true as has_postings, false as has_nothing, 'yours' as embedder_id, '64' as embedder_dimension, true as unknown_is_null, false as backfilled from documents",
    "reindex_needed": "select 'mine' as embedder_id, 0::bigint as todo, count(*) as kept from documents union all select 'other', count(*), 0 from documents",
    "corpus_walk": sql(
        ["""md as (select conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id)""",
         """files as (select conv_id, 'memory/sessions/' || conv_id || case when conv_id % 5 = 3 then '.MARKDOWN' else '.md' end as source, 0 as root_ord, text from md where conv_id % 5 not in (1, 2) and conv_id % 3 <> 2
    union all select conv_id, 'memory/sessions/' || conv_id || case when conv_id % 5 = 3 then '.MARKDOWN' else '.md' end, 1, text || chr(10) || chr(10) || 'later' from md where conv_id % 5 not in (1, 2) and conv_id % 3 <> 0)"""],
        "select source, max(root_ord) as root_ord, arg_max(strlen(text), root_ord) as size, sha256(arg_max(text, root_ord)) as hash from (select * from files where strlen(text) <= 4000) group by source",
    ),
    "log_round_trip": sql([LOG], "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, case when kind = 'client' then 'client' else 'service' end as kind, query_hash, duration_ms from log order by ts desc, event_id desc limit 20"),
    "transcript_sessions": sql(
        ["""l as (select conv_id, turn, role, role = 'user' and turn <> 2 and trim(text) <> '' as asked, role <> 'user' and turn % 3 = 1 as block from conversations)""",
         "t as (select *, sum(asked::int) over (partition by conv_id order by turn rows unbounded preceding) as turn_id from l)"],
        "select conv_id, count(*) as turns, count(*) filter (injected) as injected_turns from (select conv_id, turn_id, bool_or(block) as injected from t where turn_id > 0 group by all) group by conv_id",
    ),
    "hashed_vectors": sql(
        ["w as (select item_id, md5(unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as h from benchmark)",
         "b as (select item_id, ('0x' || substr(h, 1, 8))::bigint % 16 as i, sum(case when substr(h, 9, 1) >= '8' then 1 else -1 end) as x from w group by all)",
         "n as (select item_id, sqrt(sum(x * x)) as norm from b group by item_id)"],
        "select item_id, i, round((x / norm)::float::double, 5) as x from b join n using (item_id) where x <> 0",
    ),
    "clamped_overrides": "select event_id, least(greatest(floor(value - 20), 1), 25)::bigint as top_k from events",
    "golden_sources": "select doc_id, 'corpus/' || source as source from documents",
    "golden_partition": "select item_id % 4 <> 0 as gates, item_id % 3 > 0 as should_hit, count(*) as cases, sum(length(text))::bigint as chars, 'corpus/b.md' as forbid from benchmark group by all",
    "rrf_fuse": sql(ALL, "select query_id, id, pos::int as pos, dense_rank::int as dense_rank, bm25_rank::int as bm25_rank, round(score, 6) as score, round(bm25_score, 6) as bm25_score, round(fused_score, 6) as fused_score, round(normalized_fused, 6) as normalized_fused from fused"),
    "bm25_only_admission": sql(ALL, "select query_id, id, bm25_rank::int as bm25_rank, bm25_rank <= 2 as admitted from fused where score is null"),
    "free_gates": sql(gated(True), "select query_id, id, pos::int as pos, drop_reason, rank::int as rank, round(rank_score, 6) as rank_score, round(final_score, 6) as final_score from gated"),
    "drop_reasons": sql(gated(True), "select query_id, drop_reason, count(*) as n from gated where drop_reason is not null group by all"),
    "dedup_by_hash": sql([CHUNKS], "select arg_min(source, doc_id) as source, hash from chunks group by hash"),
    "staleness_join": sql([CHUNKS, LIVE], "select id, source, coalesce(mtime_ms > mtime, true) as stale from chunks left join live on s = source"),
    "recency_tier_score": sql([CHUNKS, f"b as (select id, 0.05::double / (1 + greatest(0, ({NOW} - mtime) / 86400000.0::double) / 30) as boost, case when type = 'session' then 0.05::double else 0 end as penalty from chunks)"], "select id, round(boost, 6) as boost, penalty, round(0.75::double + (boost - penalty), 5) as final_score from b"),
    "budget_pack": sql(
        [CHUNKS, "items as materialized (select split_part(source, '/', 1) as src, doc_id // 1000 as part, doc_id, least(token_count, 350) as cost, row_number() over (partition by split_part(source, '/', 1), doc_id // 1000 order by doc_id) as i from chunks)",
         "pack as (select distinct src, part, 0::bigint as i, 0::bigint as used, 0::bigint as n, null::bigint as doc_id from items union all select x.src, x.part, x.i, case when used >= 1500 or (used + cost > 1500 and n > 0) then used else used + cost end, case when used >= 1500 or (used + cost > 1500 and n > 0) then n else n + 1 end, case when used >= 1500 or (used + cost > 1500 and n > 0) then null else x.doc_id end from pack k join items x on x.src = k.src and x.part = k.part and x.i = k.i + 1)"],
        "select src, part, doc_id from pack where doc_id is not null",
    ),
    "truncate_chunk": sql([CHUNKS], f"select id, {cut('text', 'token_count', 100)} as cut from chunks"),
    "assemble_context": sql([*gated(False), LINES], "select query_id, coalesce(additional_context, '') as additional_context from asked left join assembled using (query_id)"),
    "hybrid_retrieve": sql([*gated(True), LINES], "select query_id, coalesce(n, 0) as n_selected, sources, coalesce(additional_context, '') as additional_context from asked left join assembled using (query_id) left join (select query_id, count(*) as n, string_agg(source, ',' order by rank) as sources from gated where drop_reason is null group by query_id) using (query_id)"),
    "rerank_filter": sql(
        [CHUNKS, ASKED, NEAR, DENSE, f"s as (select query_id, id, score, mtime, dense_rank, 1 / (1 + exp(-(8 * len(list_intersect(list_distinct({found_tokens('query')}), list_distinct({found_tokens('substr(text, 1, 768)')}))) / greatest(len(list_distinct({found_tokens('query')})), 1)::double - 2))) as rerank_score from dense join chunks using (id) join asked using (query_id))"],
        "select query_id, id, pos::int as pos, round(rerank_score, 6) as rerank_score from (select *, row_number() over (partition by query_id order by rerank_score desc, score desc, mtime desc, dense_rank) as pos from s where rerank_score >= 0.15) where pos <= 3",
    ),
    "recall_items": sql(gated(False), "select query_id, rank::int as rank, source, section, date, round(score, 6) as cosine, round(bm25_score, 6) as bm25, round(normalized_fused, 6) as fused from gated where drop_reason is null"),
    "recall_text": sql(gated(False), f"select query_id, string_agg(source || ' · ' || date || ' · ' || concat_ws(' ', {shown('cosine', 'score')}, {shown('bm25', 'bm25_score')}, {shown('fused', 'normalized_fused')}) || chr(10) || text, chr(10) || chr(10) order by rank) as rendered from gated where drop_reason is null group by query_id"),
    "hook_payload": sql([*gated(False), LINES], "select query_id, sha256('{\"hookSpecificOutput\":{\"hookEventName\":\"UserPromptSubmit\",\"additionalContext\":' || to_json(additional_context)::varchar || '}}') as payload_sha256 from assembled"),
    "stage_log": sql([*gated(True), LINES], """select 'denseRetrieve' as stage, query_id, count(*) as n from dense group by query_id union all select 'bm25Retrieve', query_id, count(*) from bm25 group by query_id
      union all select 'rrfFuse', query_id, count(*) from fused group by query_id union all select 'freeGates', query_id, count(*) filter (drop_reason is null) from gated group by query_id
      union all select 'assemble', query_id, length(coalesce(additional_context, '')) from asked left join assembled using (query_id)"""),
    "service_records": sql([*gated(False)], f"select query_id, 'service' as kind, sha256(query) as query_hash, {redacted('query')} as query_preview, coalesce(n, 0) > 0 as injected, coalesce(n, 0)::int as n_selected from asked left join (select query_id, count(*) as n from gated where drop_reason is null group by query_id) using (query_id)"),
    "estimate_tokens": f"select doc_id, {tok('text')} as tokens from documents",
    "slugify": f"select doc_id, {slug('text')} as slug from documents",
    "content_hash": "select doc_id, sha256(text) as hash from documents",
    "chunk_id": f"select substr(sha256({SOURCE} || ':root:0:0'), 1, 16) as id, {SOURCE} as source from documents",
    "infer_type_date": f"select page_id, (['session', 'memory', 'page', 'skill', 'doc'])[page_id % 5 + 1] as type, case when page_id % 3 = 0 then '2025-03-04' else {day('(1704067200000 + page_id * 86400000)')} end as date from pages where {PATH} is not null",
    "citation_line": sql([CHUNKS], f"select id, {cite('text')} as line from chunks"),
    "injection_sources": sql([CHUNKS], "select id, source, date || case when type = 'session' then ' · session log — may be superseded' else '' end as date from chunks"),
    "redact_secrets": f"select doc_id, {redacted('text')} as preview from documents",
    "normalize_prompt": sql([f"e as (select conv_id, turn, {trimmed(ENVELOPED)} as e from conversations)"], "select conv_id, turn, coalesce(" + MESSAGE + ", " + trimmed(replaced(trimmed(replaced(trimmed(replaced("e", f"(?is)(?:^|\n)[{W}]*----[{W}]*reply via:[{W}]*node[{W}]+.*$")), "(?is)<replying-to>.*?</replying-to>")), f"(?is)^[{W}]*\\[[^\\]]+\\][{W}]+.*?\\bsaid:[{W}]*")) + ") as prompt from e"),
    "clean_prompt": sql([f"e as (select conv_id, turn, {ENVELOPED} as e from conversations)"], "select conv_id, turn, " + trimmed(replaced(replaced(f"coalesce({MESSAGE}, e)", f"(?is)[{W}]*----[{W}]*(reply|ack) via:.*$"), f"(?i)^[{W}]*\\[[^\\]]+\\][{W}]+[^\n]*?\\bsaid:[{W}]*")) + " as prompt from e"),
    "substantive_filter": sql([f"e as (select conv_id, turn, {trimmed('case when turn % 3 = 0 then role when turn = 4 then ' + q('Heartbeat CHECK ') + ' || text else text end')} as t from conversations)"], f"select conv_id, turn, not regexp_matches(t, '(?i)heartbeat check') and not regexp_matches(t, {q(X.ROUTINE[1])}) and not regexp_matches(t, {q(X.ROUTINE[2])}) and not (length(t) < 12 and len(regexp_extract_all(t, {q(X.LATIN_WORD)})) < 3) as substantive from e"),
    "extract_prompt": "select event_id, case event_id % 3 when 0 then 'ask ' || user_id when 1 then '' else 'plain ' || event_type end as prompt from events",
    "fixture_date": "select conv_id, turn, date, epoch_ms(date::date)::bigint + 43200000 as mtime from (select conv_id, turn, case turn % 3 when 0 then '2025-03-0' || (conv_id % 9 + 1) when 1 then '2024-12-24' else '2026-01-01' end as date from conversations)",
    "glob_policy": f"select page_id, not (regexp_matches(p, {q(any_regex(DENY))}) or regexp_matches('/srv/' || p, {q(any_regex(DENY))})) and (regexp_matches(p, {q(any_regex(ALLOW))}) or regexp_matches('/srv/' || p, {q(any_regex(ALLOW))})) as allowed from (select page_id, {URL_PATH} as p from pages)",
    "section_split": sql([MARKDOWN], "select source, section_id::bigint as section_id, heading, sha256(text) as hash, tokens from sections"),
    "heading_occurrence": sql([MARKDOWN], "select source, section_id::bigint as section_id, slug0 as slug, row_number() over (partition by source, slug0 order by section_id) - 1 as occurrence from sections"),
    "semantic_units": sql([MARKDOWN, "bounds as (select *, (lag(blank) over w is not null and not blank and (lag(blank) over w or is_heading or is_bold or is_list))::int as b from numbered window w as (partition by source, section_id order by line_no))", "units as (select *, sum(b) over (partition by source, section_id order by line_no rows unbounded preceding) as unit_no from bounds)"],
        f"select source, section_id::bigint as section_id, unit_no::bigint as unit_no, sha256(u) as hash from (select source, section_id, unit_no, {trimmed('string_agg(line, chr(10) order by line_no)')} as u from units group by all) where u <> ''"),
    "split_decision": sql([MARKDOWN], "select source, section_id::bigint as section_id, tokens > 90 or (bolds >= 2 and lists >= 3) or (lists >= 3 and tokens > 60) as split from sections"),
    "coalesce_units": sql([*UNITS, *JOINED], "select source, section_id::bigint as section_id, part, part_text from parts"),
    "chunk_documents": sql(
        [*UNITS, *JOINED,
         "named as (select *, case when slug0 = '' then 'root' else slug0 end as slug, tokens > 90 or (bolds >= 2 and lists >= 3) or (lists >= 3 and tokens > 60) as split, row_number() over (partition by source, case when slug0 = '' then 'root' else slug0 end order by section_id) - 1 as occ from sections)",
         "pieces as (select source, heading, slug, occ, 0 as part, text as part_text from named where not split union all select source, heading, slug, occ, part, part_text from named join parts using (source, section_id) where split)",
         f"final as (select *, {trimmed('part_text')} as body, split_part(split_part(source, '/', 3), '.', 1)::bigint as conv_id from pieces)"],
        f"select substr(sha256(source || ':' || slug || ':' || occ || ':' || part), 1, 16) as id, body as text, source, heading as section, sha256(body) as hash, (1704067200000 + conv_id * 86400000) as mtime, {tok('body')}::int as token_count, {day('(1704067200000 + conv_id * 86400000)')} as date, 'session' as type from final where body <> '' and {tok('body')} >= 8",
    ),
    "long_split_windows": f"select doc_id, i::bigint as i, sha256(array_to_string(ws[i * 350 + 1 : i * 350 + 500], ' ')) as hash from (select doc_id, {words('text')} as ws from documents), unnest(range((len(ws) + 349) // 350)) as u(i)",
    "chunk_fingerprint": "select r_regionkey, sha256('{\"chunkerVersion\":1,\"chunking\":{\"targetTokens\":350,\"minTokens\":40,\"maxTokens\":500,\"overlapRatio\":0.15}}') as fingerprint from region",
    "postings": sql([CHUNKS, POSTED], "select term, id, col, count(*) as tf, min(pos)::bigint as first_pos from posted group by term, id, col"),
    "doc_stats": sql([CHUNKS, POSTED], "select id, coalesce(n_tokens, 0) as n_tokens from chunks left join stats using (id)"),
    "fts_query_terms": sql([ASKED, TERMS], "select query_id, count(*) as n_terms, sha256(string_agg('\"' || term || '\"', ' OR ' order by phrase_no)) as expression_sha256 from terms group by query_id"),
    "index_diff": sql([VERSIONS], "select * from changes"),
    "index_merge_counts": sql([VERSIONS], "select count(*) filter (change = 'inserted') as inserted, count(*) filter (change = 'updated') as updated, count(*) filter (change = 'unchanged') as unchanged, count(*) filter (change = 'removed') as removed, count(*) filter (change <> 'removed') as total from changes"),
    "index_merge": sql([VERSIONS], "select id, v2.hash as hash, case when v1.id is null then 2000 else 1000 end::bigint as created_at, 2000::bigint as updated_at from v2 left join v1 using (id)"),
    "embed_needed": sql([VERSIONS], "select id, hash from v2 where not exists (select 1 from v1 where v1.id = v2.id and v1.hash = v2.hash and v1.doc_id % 13 <> 0)"),
    "corpus_signature": f"select sha256(string_agg(h, '' order by b)) as signature from (select substr(md5({SOURCE}), 1, 3) as b, sha256(string_agg({SIGN_ROW}, chr(10) order by {SIGN_ROW})) as h from documents group by 1)",
    "toc": sql([TOC_ROWS, TOC], "select type, source, date, n_chunks, array_to_string(sections, ',') as sections from toc"),
    "toc_tier": sql([TOC_ROWS, TOC], "select type, source, date, n_chunks from toc where type = 'session'"),
    "toc_text": sql([TOC_ROWS, TOC], "select type, source, '- ' || source || ' · ' || date || ' · ' || n_chunks || ' chunks' || array_to_string(list_transform(sections, lambda s: chr(10) || '  - ' || s), '') as line from toc"),
    "ranking_metrics": sql([CHUNKS, JUDGED], "select case_id, round(precision_at_k, 6) as precision_at_k, round(recall_at_k, 6) as recall_at_k, round(mrr, 6) as mrr, round(ndcg_at_k, 6) as ndcg_at_k from ranking"),
    "eval_cases": sql(EVAL, "select case_id, round(precision_at_k, 6) as precision_at_k, round(recall_at_k, 6) as recall_at_k, round(mrr, 6) as mrr, round(ndcg_at_k, 6) as ndcg_at_k, should_hit, round(injected_precision, 6) as injected_precision, round(injected_recall, 6) as injected_recall, round(injected_f1, 6) as injected_f1, injected_hit, quiet, forbid_violations from results"),
    "eval_summary": sql([*EVAL, f"sums as (select {MEANS} from results)"], f"select cases, should_hit_cases, expect_empty_cases, round(mean_precision_at_k, 6) as mean_precision_at_k, round(mean_recall_at_k, 6) as mean_recall_at_k, round(mean_mrr, 6) as mean_mrr, round(mean_ndcg_at_k, 6) as mean_ndcg_at_k, round(ip, 6) as injected_precision, round(ir, 6) as injected_recall, round({F1_OF_MEANS}, 6) as injected_f1, round(quiet_accuracy, 6) as quiet_accuracy, forbid_violations, injected_hits from sums"),
    "baseline_gate": sql([*EVAL, f"sums as (select {MEANS} from results)"], f"""select 'low' as floors, cases, forbid_violations <= 1000000 and mean_ndcg_at_k >= 0.05 and {F1_OF_MEANS} >= 0.001 and quiet_accuracy >= 0 as passes from sums
      union all select 'high', cases, forbid_violations <= 1000000 and mean_ndcg_at_k >= 0.05 and {F1_OF_MEANS} >= 0.999 and quiet_accuracy >= 0 from sums union all select 'none', cases, forbid_violations <= -1 from sums"""),
    "sweep_grid": sql(SWEEP, f"select round(threshold, 6) as threshold, recency_weight, top_k::int as top_k, round(f, 6) as injected_f1, round(ir, 6) as injected_recall, round(quiet_accuracy, 6) as quiet_accuracy, round(mean_ndcg_at_k, 6) as mean_ndcg_at_k, forbid_violations, row_number() over (order by forbid_violations, round(quiet_accuracy, 9) desc, round(f, 9) desc, round(ir, 9) desc, round(mean_ndcg_at_k, 9) desc, point)::int as place from (select *, {F1_OF_MEANS} as f from sums) join grid using (point)"),
    "retrieval_log_summary": sql([LOG], "select count(*) as records, count(*) filter (kind is distinct from 'client') as service, count(*) filter (kind = 'client') as client from log"),
    "service_client_join": sql([LOG], "select s.event_id, s.query_hash, c.outcome as client_outcome, c.duration_ms as client_ms from log s left join (select * from log where kind = 'client') c using (query_hash) where s.kind is distinct from 'client'"),
    "log_lines": sql([LOG], "select event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || case when kind = 'client' then '] CLIENT ' || substr(query_hash, 1, 12) || ' outcome=' || outcome else '] SERVICE ' || substr(query_hash, 1, 12) || ' injected=' || injected::varchar end || ' duration=' || duration_ms || 'ms' as line from log"),
    "turn_injection_asof": sql(["t as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding) as turn_id from conversations)"], "select conv_id as session, turn_id::bigint as turn_id, min(turn) as line_no, max(case when role = 'user' then text end) as prompt, arg_max(text, turn) filter (role = 'assistant') as injection from t where turn_id > 0 group by conv_id, turn_id"),
    "stream_incremental_index": sql([CHUNKS], "select id, hash, mtime from chunks"),
    "stream_debounce_sessions": "select user_id, min(ts) as begins, max(ts) + interval 6 hour as ends, count(*) as n from (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as b from events)) group by user_id, s",
}
