"""DuckDB counterparts of the core queries."""

from __future__ import annotations

from ..functions.extract import LETTER_PATTERNS, TAIL_PATTERNS
from ..functions.reward import LONG_UNITS, SHORT_UNITS, UNMAPPED_UNITS
from ..functions.tags import LEVELS, SOURCES, SOURCE_LEVELS, TOPICS, TOPIC_FIELDS
from .cases import REWARD_CASES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FIRST = "list_filter(messages, lambda m: m.role = 'user')[1].content"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\[a-z]+\b', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _shingles(norm: str) -> str:
    w = f"string_split({norm}, ' ')"
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - 4, 1) + 1), lambda i: array_to_string({w}[i : i + 4], ' ')))"


def _answer(c: str, commas: bool = True) -> str:
    t = rf"replace(replace(replace(replace(regexp_replace(regexp_replace({c}, '\\text\{{([^}}]*)\}}', '\1', 'g'), '\s+', '', 'g'), '$', ''), '\,', ''), '\!', ''), '\;', '')"
    return f"lower({t})" if commas else f"coalesce(replace(lower({t}), ',', ''), '')"


BOXED = r"list_transform(regexp_extract_all(response, '\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1), lambda x: trim(x))"

_CLASSES = f"""
normed as (select doc_id as id, {_norm('text')} as norm from documents where text is not null),
reps as (select norm, min(id) as rep from normed group by 1),
sh as (select rep, unnest({_shingles('norm')}) as s from reps),
size as (select rep, count(*) as n from sh group by 1),
pairs as (
  select a.rep as a, b.rep as b, count(*) as i from sh a join sh b on a.s = b.s and a.rep < b.rep group by 1, 2
), found as (
  select p.a, p.b, i / (x.n + y.n - i) as jaccard from pairs p join size x on x.rep = p.a join size y on y.rep = p.b where i / (x.n + y.n - i) >= 0.4
)"""

_SPLITS = f"""
texts as (
  select 'train' as split, cast(rec_id as varchar) as id, coalesce({FIRST}, '') as text from train_pool
  union all select 'olympiad_v2', cast(rec_id as varchar), coalesce({FIRST}, '') from eval_olympiad_v2
  union all select 'mini', cast(rec_id as varchar), coalesce({FIRST}, '') from eval_mini
  union all select case metadata.corpus_subset when 'eval_full' then 'full' when 'eval_olympiad' then 'olympiad' else 'novel' end, cast(rec_id as varchar), coalesce({FIRST}, '')
    from master_corpus where metadata.corpus_subset in ('eval_full', 'eval_olympiad', 'novel_pool')
  union all select 'choice', 'mc_' || index, coalesce(question, '') from phyx_mc
), normed as (select split, id, {_norm('text')} as norm from texts),
reps as (select split, norm, min(id) as rep from normed group by 1, 2),
sh as (select split, rep, unnest({_shingles('norm')}) as s from reps),
size as (select split, rep, count(*) as n from sh group by 1, 2),
comparisons as (select * from (values ('train_vs_olympiad_v2', 'train', 'olympiad_v2'), ('train_vs_mini', 'train', 'mini'), ('train_vs_full', 'train', 'full'), ('train_vs_olympiad', 'train', 'olympiad'), ('novel_vs_choice', 'novel', 'choice')) v(comparison, sa, sb)),
hits as (
  select c.comparison, sa, sb, a.rep as a, b.rep as b, count(*) as i from comparisons c join sh a on a.split = c.sa join sh b on b.split = c.sb and a.s = b.s group by all
), found as (
  select h.comparison, h.a, h.b, i / (x.n + y.n - i) as jaccard from hits h join size x on x.split = h.sa and x.rep = h.a join size y on y.split = h.sb and y.rep = h.b
  where i / (x.n + y.n - i) >= 0.4
), listed as (
  select distinct n.id from normed n join reps r on n.split = r.split and n.norm = r.norm where n.split = 'train' and r.rep in (select a from found where comparison like 'train%')
)"""


def _topic(c: str) -> str:
    body = " ".join(f"when regexp_matches({c}, {_q('(?i)' + p.replace('spin(?!dle)', 'spin([^d]|d[^l]|dl[^e]|d?l?$)'))}) then {_q(n)}" for n, p in TOPICS)
    return f"case {body} end"


_BUCKET = "case " + " ".join(f"when starts_with(coalesce(source, ''), '{s}') then '{s}'" for s in SOURCES) + " else 'other' end"
_META = "array_to_string(list_concat(coalesce(metadata.tags, []), list_filter([" + ", ".join(f"metadata.{f}" for f in TOPIC_FIELDS) + "], lambda x: x is not null)), ' ')"
_LEVEL = (
    "coalesce(case lower(metadata.difficulty) " + " ".join(f"when '{k}' then '{v}'" for k, v in LEVELS.items())
    + " end, case when metadata.score >= 25 then 'high' when metadata.score >= 10 then 'mid' when metadata.score is not null then 'low' end, case bucket "
    + " ".join(f"when '{k}' then '{v}'" for k, v in SOURCE_LEVELS.items()) + " end, 'mid')"
)
_TAGGED = f"""
t0 as (select *, {_BUCKET} as bucket, {FIRST} as q from master_corpus),
t1 as (select *, coalesce({_topic(_META)}, {_topic("substr(q, 1, 400)")}, 'Mechanics') as concept, {_LEVEL} as level,
  coalesce(len(images) > 0, false) or coalesce(contains(q, '<image>'), false) as multimodal,
  bucket || '::' || coalesce(nullif(source, ''), bucket || '_' || rec_id) as uid from t0),
tagged as (select *, case level when 'low' then 0.0 when 'high' then 2.0 else 1.0 end + case bucket
  when 'physreason' then case when metadata.difficulty = 'difficult' then 4.0 else 2.0 end when 'ugphysics' then 1.5
  when 'physics_se' then least(2.0, coalesce(metadata.score, 0.0) / 50)
  when 'openstax' then case when contains(lower(metadata.book), 'vol 3') or contains(lower(metadata.book), 'vol3') or contains(lower(metadata.book), 'vol 2') then 0.5 else 0.0 end
  else 0.0 end as hardness from t1)"""


def _four_way() -> str:
    return f"""with {_TAGGED},
ranked as (select rec_id, bucket, concept, level, hardness, md5('42:t:' || rec_id) as h from tagged),
capped as (select *, row_number() over (partition by bucket order by hardness desc, h, rec_id) > case bucket when 'physreason' then 25 when 'ugphysics' then 20 when 'openstax' then 7 when 'physics_se' then 10 when 'rl_sft' then 5 else 0 end as over from ranked),
top as (select rec_id from capped order by over, hardness desc, h, rec_id limit 40),
left1 as (select * from ranked where rec_id not in (select rec_id from top)),
strata as (select *, row_number() over (partition by concept, level order by md5('42:a:' || rec_id), rec_id) > 120 // (select count(*) from (select distinct concept, level from left1)) as late from left1),
mini as (select rec_id from strata order by late, case when late then md5('42:b:' || rec_id) else '' end, md5('42:a:' || rec_id), rec_id limit 120),
left2 as (select * from left1 where rec_id not in (select rec_id from mini)),
sizes as (select bucket, count(*) as c from left2 group by 1),
raw as (select bucket, 200 * c / sum(c) over () as r, floor(200 * c / sum(c) over ()) as q from sizes),
quota as (select bucket, q + case when row_number() over (order by r - q desc, bucket desc) <= 200 - sum(q) over () then 1 else 0 end as quota from raw),
wide as (select rec_id from (select l.*, row_number() over (partition by bucket order by md5('42:p:' || rec_id), rec_id) as rn from left2 l) x join quota using (bucket) where rn <= quota),
split as (select rec_id, case when rec_id in (select rec_id from top) then 'eval_hard' when rec_id in (select rec_id from mini) then 'eval_mini' when rec_id in (select rec_id from wide) then 'eval_full' else 'train_pool' end as split from tagged)
"""


_LETTER = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {_q(p)}, 1), '')" for p in LETTER_PATTERNS) + rf", regexp_extract_all(t, '\b([A-D])\b', 1)[-1], 'X')"
_LETTERS = rf"""letters as (select g.*, {_LETTER} as letter from (select *, regexp_replace(string_split(coalesce(response, ''), '</think>')[-1], '^\s+|\s+$', '', 'g') as t from generations) g)"""
_GRADED = f"{_LETTERS}, graded as (select *, letter = substr('ABCD', cast(gen_id % 4 + 1 as int), 1) as correct from letters)"
_TAIL = "list_concat(" + ", ".join(f"regexp_extract_all(t, {_q(p)}, 1)" for p in TAIL_PATTERNS) + ")"
_CAND = r"list_filter(list_transform(" + _TAIL + r", lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and length(x) < 120)"
_ORDERED = f"list_filter({_CAND}, lambda x, i: list_position({_CAND}, x) = i)[1:8]"


def _any(preds: str, gold: str) -> str:
    return f"({_answer(gold, False)} <> '' and coalesce(len(list_filter({preds}, lambda p: contains({_answer('p', False)}, {_answer(gold, False)}))) > 0, false))"


_JUDGED = rf"""answers as (select gen_id, coalesce(list_filter(gold, lambda g: g is not null), []) as golds, coalesce({BOXED}, []) as boxes, right(response, 300) as t from generations),
cand as (select *, list_filter(boxes, lambda p: regexp_replace(p, '\s+', '', 'g') <> '') as b from answers),
ready as (select gen_id, golds, case when len(b) > 0 then b else coalesce({_ORDERED}, []) end as preds from cand),
verdict as (select gen_id,
  len(golds) > 0 and len(preds) > 0 and len(list_filter(golds, lambda g: not {_any('preds', 'g')})) = 0 as strict,
  len(golds) > 0 and len(preds) > 0 and len(list_filter(golds, lambda g: not {_any('preds', 'g')} and length(g) % 2 = 1)) = 0 as liberal,
  case when len(golds) > 0 and len(preds) > 0 then len(list_filter(golds, lambda g: not {_any('preds', 'g')})) else 0 end as judged from ready)"""

_GOLDS = "golds as (select gen_id, response, cast(unnest(range(len(gold))) as int) as n, unnest(gold) as gold from generations)"
_BROKEN = r"replace(replace('Answer:' || gold, '(a)', chr(10) || '(a)'), ' (b)', chr(10) || ' (b):')"
_PARTS = rf"string_split_regex({_BROKEN}, '\n\s*\([a-d]\)\s*[:.]?\s*')"
SOLVE_SQL = "'Solve the physics problem. Show your reasoning step-by-step. Put each final sub-answer in \\boxed{}.' || chr(10) || chr(10) || 'Problem:' || chr(10) || trim(replace(coalesce(question, ''), '<image>', '')) || chr(10)"
BELOW_SQL = SOLVE_SQL.replace("Solve the physics problem. Show your reasoning step-by-step.", "Solve the physics problem below. Show step-by-step reasoning.")
LETTER_SQL = "coalesce(question, '') || chr(10) || 'Please provide your final answer as a single letter (A, B, C, or D).'"
CHOOSE_SQL = "coalesce(question, '') || chr(10) || chr(10) || 'Think briefly, then put your final letter (A/B/C/D) in \\boxed{}.'"

_W_PARTS = r"string_split_regex(w, '\n\s*\([a-d]\)\s*[:.]?\s*')"


def _stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _plain(c: str) -> str:
    """Answer without outer dollar signs and a leading text command."""
    bare = rf"regexp_replace({_stripped(c)}, '^\$+|\$+$', '', 'g')"
    return _stripped(rf"(case when regexp_matches({bare}, '^\\text\{{.+\}}') then regexp_extract({bare}, '^\\text\{{(.+)\}}', 1) else {bare} end)")


def _linear(c: str) -> str:
    t = rf"regexp_replace(regexp_replace({_stripped(c)}, '^\$+|\$+$', '', 'g'), '\\(?:text|mathrm|mbox|mathbf|operatorname)\{{([^}}]*)\}}', '\1', 'g')"
    for _ in range(3):
        t = rf"regexp_replace({t}, '\\[dt]?frac\{{([^{{}}]+)\}}\{{([^{{}}]+)\}}', '(\1)/(\2)', 'g')"
    return rf"trim(regexp_replace(replace(regexp_replace({t}, '\\times|\\cdot', '*', 'g'), '\pi', 'pi'), '\\%|%|\\left|\\right|\\[,;!]| ', '', 'g'))"


_FLOAT = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def _number(line: str) -> str:
    """Value of a linear answer: a literal, a fraction of two literals, a multiple of a power of ten, or what it begins with."""
    frac, power = rf"\(({_FLOAT})\)/\(({_FLOAT})\)", rf"({_FLOAT})\*10\^\{{?([-+]?\d+)\}}?"
    as_double = lambda x: f"try_cast({x} as double)"
    return (
        f"case when regexp_full_match({line}, '{_FLOAT}') then {as_double(line)} "
        f"when regexp_full_match({line}, '{frac}') then {as_double(f"regexp_extract({line}, '{frac}', 1)")} / {as_double(f"regexp_extract({line}, '{frac}', 2)")} "
        f"when regexp_full_match({line}, '{power}') then {as_double(f"regexp_extract({line}, '{power}', 1)")} * pow(10, {as_double(f"regexp_extract({line}, '{power}', 2)")}) "
        rf"else {as_double(rf"nullif(regexp_extract({line}, '^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), '')")} end"
    )


def _labelled(c: str) -> str:
    """Parts of an answer with their labels; null for one of a single part."""

    def marked(mark: str, label: str) -> str:
        values = f"string_split_regex({c}, '{mark}')"
        each = f"list_transform(range(1, len({values})), lambda i: {{'l': regexp_extract_all({c}, '{label}', 1)[i], 'v': rtrim({_stripped(f'{values}[i + 1]')}, ';,')}})"
        return f"list_filter({each}, lambda x: x.v <> '')"

    forms = [marked(r"\s*\([a-z]\)\s*", r"\s*\(([a-z])\)\s*"), marked(r"\b[a-z]\.\s+", r"\b([a-z])\.\s+")]
    forms.append(f"list_filter(list_transform(string_split({c}, ';'), lambda x: {{'l': '', 'v': {_stripped('x')}}}), lambda x: x.v <> '')")
    return "case " + " ".join(f"when len({f}) >= 2 then {f}" for f in forms) + " end"


_UNIT = r"\d+(?:\.\d+)?(?:\s*(?:\\times|\*)\s*10\s*\^?\s*\{?[-+]?\d+\}?)?\s*(" + "|".join(LONG_UNITS + SHORT_UNITS) + r")(?:\s*\^\s*\{?-?\d+\}?)?(?:\s*[/·\\\.]\s*[a-zA-Z]+(?:\s*\^\s*\{?-?\d+\}?)?)*(?:[^A-Za-z]|$)"
# no lookaround here: a digit after a letter begins no number, so it is taken out, and the sign after a unit is part of the match
_UNITS = rf"regexp_extract_all(regexp_replace(response, '([A-Za-z\\])\d', '\1', 'g'), '{_UNIT}', 1)[1:32]"
_SIDE = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d*)?"
_PROPER = lambda n: rf"(regexp_full_match(replace(trim(x[{n}]), '\', ''), '{_SIDE}') and replace(trim(x[{n}]), '\', '') <> 'lambda')"
_FRACS = r"list_transform(regexp_extract_all(response, '\\[dt]?frac\{[^{}]+\}\{[^{}]+\}')[1:16], lambda f: [regexp_extract(f, 'frac\{([^{}]+)\}', 1), regexp_extract(f, '\}\{([^{}]+)\}', 1)])"
_REWARD = rf"""{_GOLDS},
r0 as (select gen_id, n, response, gold, {BOXED}[-1] as boxed from golds where gold is not null),
r1 as (select *, {_plain('gold')} as g, {_plain('boxed')} as p from r0),
r2 as (select *, {_labelled('g')} as gp, {_labelled('p')} as pp from r1),
r3 as (select *, coalesce(gp, [{{'l': '', 'v': g}}]) as gv, case when gp is null then [{{'l': '', 'v': p}}] else pp end as pv from r2),
r4 as (select gen_id, n, unnest(gv).l as gl, unnest(pv).l as pl, {_plain('unnest(gv).v')} as a, {_plain('unnest(pv).v')} as b from r3 where len(gv) = len(pv) and g <> '' and p <> ''),
r5 as (select *, {_linear('a')} as x, {_linear('b')} as y from r4),
r6 as (select *, {_number('x')} as u, {_number('y')} as v from r5),
r7 as (select gen_id, n, bool_and((gl = '' or pl = '' or gl = pl) and coalesce(lower(a) = lower(b) or x = y or abs(v - u) < 1e-6 or (u <> 0 and abs(v - u) / abs(u) < 0.01), false)) as agree from r6 group by 1, 2),
letter as (select gen_id, n, case when upper(boxed) in ('A', 'B', 'C', 'D') then upper(boxed) else coalesce(nullif(regexp_extract(response, '(?:answer|Answer)\s*(?:is|:)\s*\(?([A-D])\)?', 1), ''), nullif(regexp_extract(response, '\(([A-D])\)\s*$', 1), ''), nullif(regexp_extract(response, '\\text\{{([A-D])\}}', 1), '')) end as l from r1),
reward as (select r1.gen_id, r1.n,
  case when g = '' or response is null then 0.0::double when upper(g) in ('A', 'B', 'C', 'D') then case when l = upper(g) then 1.0::double else 0.0::double end when agree then 1.0::double else 0.0::double end as answer,
  case when length(boxed) > 0 then 0.1::double else 0.0::double end as format,
  case when len({_UNITS}) > 0 and len(list_filter({_UNITS}, lambda u: u in ({", ".join(_q(u) for u in UNMAPPED_UNITS)}))) = 0 then 0.15::double else 0.0::double end as units,
  case when len(list_filter({_FRACS}, lambda x: {_PROPER(1)} and {_PROPER(2)})) > 0 then 0.2::double else 0.0::double end as fractions
  from r1 left join r7 using (gen_id, n) left join letter using (gen_id, n))"""

ORACLE = {
    "normalize_text": f"select doc_id, {_norm('text')} as norm from documents",
    "shingle_count": f"select doc_id, cast(len({_shingles(_norm('text'))}) as int) as n from documents where text is not null",
    "near_dup_pairs": f"with {_CLASSES.replace('select doc_id as id', 'select rec_id as id').replace('from documents where text is not null', 'from (select rec_id, ' + FIRST + ' as text from master_corpus) where text is not null')} select a, b, round(jaccard, 6) as jaccard from found",
    "near_dup_members": f"with {_CLASSES}, links as (select rep, count(*) as links from (select a as rep from found union all select b from found) group by 1), "
    "copies as (select norm, count(*) as copies from normed group by 1) select n.id, r.rep as class_id, c.copies, coalesce(l.links, 0) as links from normed n join reps r using (norm) join copies c using (norm) left join links l on l.rep = r.rep",
    "overlap_pairs": f"with {_SPLITS} select comparison, a, b, round(jaccard, 6) as jaccard from found",
    "overlap_counts": f"with {_SPLITS} select comparison, count(*) as pairs from found group by rollup (comparison)",
    "overlap_top": f"with {_SPLITS}, r as (select comparison, a, b, cast(row_number() over (partition by comparison order by jaccard desc, a, b) as int) as rank from found) select * from r where rank <= 50",
    "overlap_previews": f"with {_SPLITS} select f.comparison, f.a, f.b, substr(x.text, 1, 120) as a_text, substr(y.text, 1, 120) as b_text from found f join texts x on x.id = f.a join texts y on y.id = f.b",
    "purge_train": f"with {_SPLITS} select rec_id from train_pool where cast(rec_id as varchar) not in (select id from listed)",
    "purge_by_family": f"with {_SPLITS} select coalesce(metadata._split_tags.source_bucket, '?') as family, count(*) as rows from train_pool where cast(rec_id as varchar) in (select id from listed) group by 1",
    "purge_keys": "select rec_id, coalesce(nullif(source, ''), metadata._split_tags.uid) as key from train_pool",
    "dedup_keep_first": "select doc_id, source from (select *, row_number() over (partition by text order by crawled_at nulls first, doc_id) as rn from documents) where rn = 1",
    "dedup_keep_last": "select id, gen_id, source, first_pos from (select *, row_number() over (partition by id order by gen_id desc) as rn, min(gen_id) over (partition by id) as first_pos from generations) where rn = 1",
    "resume_todo": "select id, question from oe_items where id is null or id not in (select id from generations where response is not null and id is not null)",
    "resume_composite": "select gen_id from generations g where not exists (select 1 from generations h where h.benchmark = 'physreason' and coalesce(h.source, 'None') = coalesce(g.source, 'None') and coalesce(h.topic, '') = coalesce(g.topic, ''))",
    "stratified_sample": "with r as (select doc_id, lang, source, row_number() over (partition by lang, source order by md5('42:a:' || doc_id), doc_id) > 200 // (select count(*) from (select distinct lang, source from documents)) as late from documents) "
    "select doc_id, lang, source from r order by late, case when late then md5('42:b:' || doc_id) else '' end, md5('42:a:' || doc_id), doc_id limit 200",
    "proportional_sample": "with sizes as (select lang, count(*) as c from documents group by 1), raw as (select lang, 300 * c / sum(c) over () as r, floor(300 * c / sum(c) over ()) as q from sizes), "
    "quota as (select lang, q + case when row_number() over (order by r - q desc, lang desc nulls last) <= 300 - sum(q) over () then 1 else 0 end as quota from raw) "
    "select d.doc_id, d.lang from (select *, row_number() over (partition by lang order by md5('42:p:' || doc_id), doc_id) as rn from documents) d join quota q on d.lang is not distinct from q.lang where rn <= quota",
    "capped_topk": "with r as (select doc_id, lang, coalesce(n_chars, 0) as hard, md5('42:t:' || doc_id) as h from documents), c as (select *, row_number() over (partition by lang order by hard desc, h, doc_id) > case lang when 'en' then 120 when 'de' then 40 when 'fr' then 30 else 0 end as over from r) "
    "select doc_id, lang, hard from c order by over, hard desc, h, doc_id limit 250",
    "record_tags": f"with {_TAGGED} select rec_id, bucket, concept, level as difficulty, multimodal, uid, round(hardness, 6) as hardness from tagged",
    "split_tags_block": f"with {_TAGGED} select rec_id, uid, metadata.topic as topic from tagged",
    "four_way_split": _four_way() + "select rec_id, split from split",
    "split_disjoint": _four_way() + "select count(*) as rows, count(distinct rec_id) as uids, (select count(*) from (select rec_id from split group by 1 having count(distinct split) > 1)) as shared from split",
    "union_sources": "select rec_id, source, 'train_pool' as origin, null as _uid from train_pool union all select rec_id, source, 'master_corpus', null from master_corpus union all select rec_id, source, 'eval_mini', _uid from eval_mini",
    "split_stats": f"with {_TAGGED} select '_source_bucket' as kind, bucket as value, count(*) as rows, count_if(multimodal) as multimodal from tagged group by 2 union all select '_concept', concept, count(*), count_if(multimodal) from tagged group by 2 "
    "union all select '_difficulty', level, count(*), count_if(multimodal) from tagged group by 2 union all select 'TOTAL', null, count(*), count_if(multimodal) from tagged",
    "crosstab": f"with {_TAGGED}, s as (select unnest({SOURCES}) as _source_bucket) select s._source_bucket, count_if(level = 'low') as low, count_if(level = 'mid') as mid, count_if(level = 'high') as high from s left join tagged t on t.bucket = s._source_bucket group by 1",
    "boxed_all": f"select gen_id, array_to_string(coalesce({BOXED}, []), '|') as boxes from generations",
    "boxed_last": f"select gen_id, {BOXED}[-1] as boxed from generations",
    "strict_matches": f"select gen_id, coalesce(len(list_filter(gold, lambda g: coalesce(len(list_filter(b, lambda p: {_answer('p')} = {_answer('g')} or ({_answer('g')} <> '' and contains({_answer('p')}, {_answer('g')})))) > 0, false))) > 0, false) as strict, "
    f"coalesce(len(list_filter(gold, lambda g: {_any('b', 'g')})) > 0, false) as strict_any, coalesce(len(gold), 0) > 0 and len(list_filter(gold, lambda g: not {_any('b', 'g')})) = 0 as every from (select *, coalesce({BOXED}, []) as b from generations)",
    "tail_fallback": f"select gen_id, array_to_string({_ORDERED}, '|') as candidates from (select gen_id, right(response, 600) as t from generations)",
    "response_tails": "select gen_id, cast(length(response) as int) as n, right(response, 300) as tail, substr(response, 1, 120) as head from generations",
    "yes_no": r"select gen_id, nullif(regexp_extract(upper(response || case gen_id % 3 when 0 then ' Yes.' when 1 then ' no' else '' end), '\b(YES|NO)\b', 1), '') = 'YES' as verdict from generations",
    "gold_subparts": f"with {_GOLDS} select gen_id, n, array_to_string(case when len({_PARTS}) > 1 then {_PARTS}[2:] else [{_BROKEN}] end, '|') as parts from golds where gold is not null",
    "gold_lists": r"select gen_id, case when gen_id % 2 = 0 then array_to_string(list_transform(gold, lambda x: coalesce(replace(x, '\', '\\'), '-')), '|') else coalesce(gold[1], '-') end as golds from generations where len(gold) > 0",
    "answer_forms": f"with {_GOLDS} select gen_id, n, {_answer('gold')} as plain, {_answer('gold', False)} as no_commas from golds where gold is not null",
    "mcq_letter": f"with {_LETTERS} select gen_id, letter from letters",
    "mcq_accuracy": f"with {_GRADED} select count(*) as total, count_if(correct) as correct, count_if(correct) / count(*) as accuracy from graded",
    "mcq_by_category": f"with {_GRADED} select coalesce(subtopic, topic, 'unknown') as category, count(*) as total, count_if(correct) as correct, count_if(correct) / count(*) as accuracy from graded group by 1",
    "choice_prompts": f"select index, {CHOOSE_SQL} as prompt, {LETTER_SQL} as letter_prompt, case when image is null then 1 else 2 end as parts, cast(octet_length(from_base64(image)) as int) as image_bytes from phyx_mc",
    "open_prompts": f"select id, {SOLVE_SQL} as prompt, {BELOW_SQL} as below from oe_items",
    "numeric_match": "select l_orderkey, l_linenumber, l_linenumber % 4 < 2 as matched from lineitem",
    "reward_format": f"with {_GOLDS} select gen_id, n, case when coalesce(length({BOXED}[-1]), 0) > 0 then 0.1::double else 0.0::double end as format from golds where gold is not null",
    "reward_conservation": "select l_orderkey, l_linenumber, abs(l_quantity + l_linenumber - (l_quantity + 6)) / greatest(abs(l_quantity + 6), abs(l_quantity + l_linenumber), 1e-9) > 0.05 as broken from lineitem",
    "judge_liberal": f"with {_JUDGED} select gen_id, strict, liberal, judged from verdict",
    "judge_counts": f"with {_JUDGED} select count(*) as total, count_if(strict) as strict, count_if(liberal) as liberal, count_if(judged > 0) as asked, (select count_if(len(b) = 0 and len({_ORDERED}) > 0) from cand) as fallback from verdict",
    "numeric_forms": "select l_orderkey, l_linenumber, l_linenumber % 3 < 2 as matched from lineitem",
    "reward_components": f"with {_REWARD} select gen_id, n, answer, format, units, fractions, 0.0::double as conservation from reward",
    "reward_total": f"with {_REWARD} select gen_id, n, answer as binary, round(greatest(-1.0, least(1.0, answer * greatest(0.0, 1 - (gen_id % 3) / 2) + format + units + fractions)), 6) as dense from reward",
    "reward_cases": "select * from (values " + ", ".join(f"({i}::int, {score}.0::double, {'null' if value is None else value}::double)" for i, (_, _, score, value) in enumerate(REWARD_CASES)) + ") v(\"case\", answer, number)",
    "judge_parts": f"""with g as (select gen_id, coalesce(list_filter(coalesce({BOXED}, []), lambda p: regexp_replace(p, '\\s+', '', 'g') <> ''), []) as preds, replace(gold[1], '(b)', chr(10) || '(b)') as w, gold, benchmark from generations),
p as (select gen_id, preds, coalesce(list_filter(case when benchmark = 'physreason' then gold when w is null then [null] when len({_W_PARTS}) > 1 then {_W_PARTS}[2:] else [w] end, lambda x: x is not null), []) as golds from g)
select gen_id, len(golds) > 0 and len(preds) > 0 and len(list_filter(golds, lambda x: length(x) % 2 = 1)) = 0 as liberal, case when len(preds) > 0 then len(golds) else 0 end as judged from p""",
    "judge_whole": f"""with w as (select gen_id, response, array_to_string(list_filter(gold, lambda x: x is not null), '; ') as g, coalesce({BOXED}, []) as b from generations)
select gen_id, coalesce(length(g) > 0, false) and coalesce(len(list_filter(b, lambda p: {_answer('p')} = {_answer('g')} or ({_answer('g')} <> '' and contains({_answer('p')}, {_answer('g')})))) > 0, false) as strict,
  coalesce(length(g) > 0 and length(left(g, 3000)) % 2 = 0 and length(right(coalesce(response, ''), 600)) % 2 = 0, false) as liberal from w""",
    "gold_lookup": "with g as (select id, array_to_string(list_sort(list(distinct answer)), '|') as golds from oe_items where answer is not null group by 1) select gen_id, coalesce(g.golds, '') as golds, case when g.id is null then 'no gold' end as err from generations left join g using (id)",
    "model_retries": "select id, case when length(question) % 3 = 0 then '' else 'YES' end as reply, length(question) % 3 = 0 as failed from (select distinct id, question from oe_items where question is not null)",
    "model_batches": "select id, cast(length(question) as varchar) as reply from oe_items where question is not null",
    "first_rows": "select index, answer from (select distinct index, answer from phyx_mc) order by index nulls first, answer nulls first limit 25",
    "json_malformed": "select place as row_idx, case when event_id % 3 > 0 then cast(event_id as varchar) end as id, case when event_id % 3 > 0 then props end as response, event_id % 3 = 0 as bad from (select *, row_number() over (order by event_id) - 1 as place from events) where event_id % 5 > 0",
    "json_dropped": "select cast(event_id as varchar) as id from events where event_id % 3 > 0",
    "corpus_subsets": "select coalesce(metadata.corpus_subset, '?') as split, source as id, coalesce(messages[1].content, '') as text from master_corpus",
    "held_out": f"select source as id, messages[1].content as text, {_norm('messages[1].content')} as norm from eval_olympiad_v2",
    "optional_items": "select 'phyx_' || (row_number() over (order by index nulls first, question nulls first, answer nulls first) - 1) as id, coalesce(question, '') as text from phyx_mc",
    "tsv_items": "select index, question, cast(length(image) as int) as image_chars, answer, category, coalesce(subfield, '') as subfield from phyx_mc",
    "json_array": "select distinct id, question, answer, subtopic from oe_items",
    "json_object": "select id, array_to_string(list_sort(list(distinct answer)), '|') as golds from oe_items where id is not null and answer is not null group by 1",
    "problem_folders": "select id, '(a) ' || coalesce(min(subtopic), '') || chr(10) || chr(10) || '(b) ' || coalesce(min(question), '') as problem_text, replace(coalesce(min(answer), ''), chr(92), chr(92) || chr(92)) as gold, 'hard' as difficulty, 0::int as images from oe_items where id is not null group by 1",
    "appended_rows": "select gen_id, source from generations",
    "result_document": f"with {_GRADED}, c as (select coalesce(subtopic, topic, 'unknown') as category, count(*) as rows, count_if(correct) as hits from graded group by 1) select (select count(*) from graded) as total, (select count_if(correct) from graded) as correct, cast(row_number() over (order by category) - 1 as int) as place, category, rows, hits from c",
    "split_report": f"""with {_TAGGED}, sources as (select unnest({SOURCES}) as v), concepts as (select unnest({[t for t, _ in TOPICS]}) as v), levels as (select unnest(['low', 'mid', 'high']) as v)
select 'source' as part, v as row, 'count' as column, (select count(*) from tagged where bucket = v) as count from sources
union all select 'concept', v, 'count', (select count(*) from tagged where concept = v) from concepts
union all select 'difficulty', v, 'count', (select count(*) from tagged where level = v) from levels
union all select p, 'TOTAL', 'count', (select count(*) from tagged) from (values ('source'), ('concept'), ('difficulty')) t(p)
union all select 'modality', m, 'count', (select count(*) from tagged where multimodal = (m = 'multimodal')) from (values ('text-only'), ('multimodal')) t(m)
union all select 'source x difficulty', s.v, l.v, (select count(*) from tagged where bucket = s.v and level = l.v) from sources s, levels l""",
}
