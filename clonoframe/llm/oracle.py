"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from clonoframe.llm import (
    chat_windows,
    license_scan,
    mixing,
    near_dedup,
    quality_rules,
    source_divergence,
    substring_graph,
)
from clonoframe.llm.queries import PROBE

WORD = r"[^\x20\x09-\x0D]+"


def _op8() -> str:
    def passes(p: quality_rules.Policy) -> str:
        need, advise = quality_rules.bits(p.required), quality_rules.bits(p.advisory)
        return f"((failed_bits & {need}) = 0 and bit_count(failed_bits & {advise}) <= {p.spare})"

    fails = " | ".join(
        f"(case when {r.fails} then {1 << i} else 0 end)::bigint"
        for i, r in enumerate(quality_rules.RULES)
    )
    default = quality_rules.POLICIES[quality_rules.DEFAULT_POLICY]
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over () as rid,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as w
  from documents
), lines as (
  select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from d
), win as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)
), rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1
), covered as (
  select rid, count(distinct i + k) as n
  from rep, (values (0), (1), (2)) as o(k) group by rid
), m as (
  select doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words
  from d join lines using (rid) left join covered using (rid)
), f as (select *, {fails} as failed_bits from m)
select *, not {passes(quality_rules.BASE)} as base_failed,
       {passes(quality_rules.BASE)} and {passes(default)} as kept
from f"""


def _op1() -> str:
    c = chat_windows

    def escaped(x: str) -> str:
        return rf"regexp_replace({x}, '([<\[])(\\*)({c.TAILS})', '\1\2\\\3', 'g')"

    frame = len(c.TURN) + 1 + len(c.END)
    return rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
), t as (
  select *, row_number() over w - 1 as i,
         len(regexp_extract_all({escaped("text")}, '{c.TOKEN}')) + {c.OVERHEAD} as cost,
         {frame} + length(replace({escaped("role")}, chr(10), '{c.LINE}'))
           + length({escaped("text")}) as chars
  from raw window w as (partition by conv_id order by turn nulls first, role, text)
), p as (
  select *, sum(cost) over (partition by conv_id order by i) as upto,
         first(role = 'system') over (partition by conv_id order by i) as sys,
         first(cost) over (partition by conv_id order by i) as cost0,
         first(chars) over (partition by conv_id order by i) as chars0
  from t
), walk as (
  select conv_id, i, 0::bigint as beg, 0::hugeint as base from p where i = 0
  union all
  select p.conv_id, p.i, case when n.new then p.i else walk.beg end,
         case when n.new then p.upto - p.cost else walk.base end
  from walk join p on p.conv_id = walk.conv_id and p.i = walk.i + 1,
  lateral (select p.upto - walk.base > case when walk.beg = 0 then {c.BUDGET}
      else {c.BUDGET - c.HISTORY} - case when p.sys then p.cost0 else 0 end end as new) as n
), span as (
  select conv_id, beg, sum(chars) as chars
  from walk join p using (conv_id, i) group by conv_id, beg
), repeated as (
  select s.conv_id, s.beg, sum(h.chars) as chars
  from span as s
  join p as l on l.conv_id = s.conv_id and l.i = s.beg - 1
  join p as h on h.conv_id = s.conv_id and h.i < s.beg and h.i >= s.beg - {c.HISTORY_TURNS}
    and h.i >= case when h.sys then 1 else 0 end and l.upto - h.upto + h.cost <= {c.HISTORY}
  group by s.conv_id, s.beg
), size as (
  select span.conv_id, count(*) as n_windows,
         sum(span.chars + coalesce(repeated.chars, 0)
             + case when span.beg > 0 and p.sys then p.chars0 else 0 end)::bigint as formatted_chars
  from span left join repeated using (conv_id, beg) join p on p.conv_id = span.conv_id and p.i = 0
  group by span.conv_id
), said as (
  select conv_id, count(*) as n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '') as loss
  from t group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars, n_windows
from said join size using (conv_id)"""


def _op2() -> str:
    rows = ", ".join(
        f"('{name}', {license_scan.bigrams(body)!r})"
        for name, body in sorted(set(license_scan.TEMPLATES))
    )
    least = license_scan.LEAST
    return rf"""
with d as (
  select doc_id, row_number() over () as rid,
         regexp_replace(lower(coalesce(text, '')), '{license_scan._NOT_WORD}', ' ', 'g') as t
  from documents
), parts as (
  select rid, unnest(list_distinct(list_concat(string_split(t, chr(10)),
    list_transform(string_split_regex(t, '
 ?
[ 
]*'), lambda b: replace(b, chr(10), ' '))))) as u
  from d
), words as (
  select rid, row_number() over () as uid, list_filter(string_split(u, ' '), lambda w: w <> '') as w from parts
), pairs as (
  select rid, uid, i, w[i] || ' ' || w[i + 1] as g
  from (select rid, uid, w, unnest(range(1, len(w))) as i from words)
), bags as (
  select rid, uid, list(g || ' ' || k) as bag
  from (select *, row_number() over (partition by uid, g order by i) - 1 as k from pairs)
  group by rid, uid
), template(license, grams) as (values {rows}
), scored as (
  select rid, uid, license, 2 * len(list_intersect(bag, grams)) / (len(bag) + len(grams)) as dice
  from bags, template
  where len(grams) >= len(bag) * {least / (2 - least)!r} and len(grams) * {least / (2 - least)!r} <= len(bag)
), hits as (
  select rid, uid, arg_max(license, (dice, -rank)) as license, max(dice) as dice
  from (select *, rank() over (partition by uid order by license) as rank from scored where dice >= {least})
  group by rid, uid
), by_doc as (
  select rid, count(*) as n_hits, string_agg(distinct license, ',' order by license) as licenses,
         round(max(dice), 6) as best_dice
  from hits group by rid
)
select doc_id, coalesce(n_hits, 0) as n_hits, coalesce(licenses, '') as licenses, best_dice
from d left join by_doc using (rid)"""


def _op7() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size from sized group by source
), w as (
  select *, [{weights}][((row_number() over (order by source nulls last) - 1)
            % {len(mixing.WEIGHTS)} + 1)::int] as weight from s
), o as (
  select *, sum({mixing.CAP} * source_size) over k as capped, sum(weight) over k as used
  from w window k as (order by {mixing.CAP} * source_size / weight, source nulls last)
), t as (select sum(source_size) as total, sum(weight) as weights from w
), levels as (
  select total as rest, weights from t union all
  select total - capped, weights - used from o, t where weights > used
), level as (select arg_max(struct_pack(r := rest, k := weights), rest / weights) as l from levels
), goal as (
  select source, source_size,
         case when weight::hugeint * l.r > {mixing.CAP}::hugeint * source_size * l.k
              then ({mixing.CAP} * source_size)::double
              else weight::double * l.r::double / l.k::double end as target
  from w, level
), plan as (
  select *, case when source_size > 0 then target / source_size else 0 end as ratio from goal
), d as (
  select doc_id, size, sized.source, source_size, target, floor(ratio)::bigint as whole,
         ratio - floor(ratio) as p, target - floor(ratio) * source_size as missing,
         (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint
          + 0.5::double) / 4503599627370496::double as u
  from sized join plan on sized.source is not distinct from plan.source and true
), r as (
  select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from d
), c as (
  select *, sum(size) over (partition by source order by q / (1 + q) nulls last, doc_id
                            rows unbounded preceding) - size as sofar from r
)
select doc_id, size, source_size, target,
       (size * (whole + case when q is not null and sofar + size / 2 <= missing then 1 else 0 end))::bigint
         as taken
from c"""


def _op9() -> str:
    width, t = near_dedup.WIDTH, near_dedup.THRESHOLD
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '{WORD}') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + {width - 1}], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) as i
        from d where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles as a join shingles as b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sizes as x on x.doc_id = a join sizes as y on y.doc_id = b
  where 100 * c >= {t} * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.other
)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id,
       doc_id = min(other) as kept
from reach left join sizes using (doc_id) group by doc_id"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    return (
        f"xor(4294967295, list_reduce(range(0, 8 * length({text})), lambda c, j: case when"
        f" xor(c, case when j % 8 = 0 then ascii({text}[j // 8 + 1]) else 0 end) % 2 = 1 then"
        f" xor(xor(c, case when j % 8 = 0 then ascii({text}[j // 8 + 1]) else 0 end) // 2, 3988292384)"
        f" else xor(c, case when j % 8 = 0 then ascii({text}[j // 8 + 1]) else 0 end) // 2 end,"
        " 4294967295::bigint))"
    )


def _op11() -> str:
    # grammar states 0 to 3: nothing yet, after system, after user, after assistant. A state's best
    # repair of the rest is one string: its cost in nine digits, then its audit.
    called = (2, 2, 3, 2)

    def plus(edit: str, cost: str, rest: str) -> str:
        return f"lpad(({rest}[1:9]::bigint + {cost})::varchar, 9, '0') || '{edit}' || {rest}[10:]"

    kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    direct, inserted = [], []
    for q in range(4):
        keep = " ".join(f"when '{i}' then {plus('K', 'extra', f'b{to}')}" for i, to in kept[q])
        options = [
            plus("D", "4", f"b{q}"),
            f"case when not gone then {plus('R', '3 + extra', f'b{called[q]}')} end",
            f"case when not gone then case initial {keep} end end",
        ]
        direct.append(f"least({', '.join(options)}) as d{q}")
        inserted.append(plus("I", "3", "{}" + str(called[q])))
    # three rounds of insertions are more than any best repair has in one place
    rounds, old = [], "d"
    for new in ("e", "f", "g"):
        cols = ", ".join(f"least({old}{q}, {inserted[q].replace('{}', old)}) as {new}{q}" for q in range(4))
        rounds.append(f"lateral (select {cols})")
        old = new
    gone = "fault in ('blank', 'duplicate')"
    return rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32("k")} % 20 as kind
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
        from conversations)
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g')
              else text end as text
  from raw, range(2) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)
), t as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n, role[1] as initial,
         lag(role[1]) over w || role[1] not in ('su', 'ua', 'au') as illegal,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as shown
  from damaged window w as (partition by conv_id order by turn nulls first, role, text)
), f as (
  select *, case when not regexp_matches(text, '{WORD}') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when not regexp_matches(shown[-1], '[.!?]') then 'truncated' end as fault
  from t
), g as (
  select *, coalesce({gone}, false) as gone, case when fault = 'truncated' then 3 else 0 end as extra from f
), walk as (
  select conv_id, n + 1 as i, '000000000' as b0, '000000006II' as b1, '000000003I' as b2, '000000000' as b3
  from (select distinct conv_id, n from g)
  union all
  select x.conv_id, x.i, g0, g1, g2, g3
  from (select g.conv_id, g.i, {", ".join(direct)}
        from walk join g on g.conv_id is not distinct from walk.conv_id and g.i = walk.i - 1) as x,
       {", ".join(rounds)}
), best as (
  select conv_id, b0[1:9]::bigint as cost, b0[10:] as audit from walk where i = 1
), letters as (
  select conv_id, audit, j, audit[j] as edit,
         length(replace(audit[1:j], 'I', '')) as i, length(replace(audit[1:j], 'D', '')) as place
  from (select *, unnest(range(1, length(audit) + 1)) as j from best)
), placed as (
  select l.*, g.role, g.text,
         bool_or(l.place = 1 and edit = 'K' and initial = 's') over (partition by l.conv_id) as has_system
  from letters as l left join g on g.conv_id is not distinct from l.conv_id and g.i = l.i and l.edit <> 'I'
  where edit <> 'D'
), out as (
  select conv_id, sha256(string_agg(
    case edit when 'K' then role else case when (place - has_system::int) % 2 = 1 then 'user' else 'assistant' end end
    || ':' || case edit when 'I' then '' else text end, chr(10) order by j)) as repaired_sha256
  from placed group by conv_id
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal
  from g group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank,
       coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
       coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) as o
left join facts on facts.conv_id is not distinct from o.conv_id
left join best on best.conv_id is not distinct from o.conv_id
left join out on out.conv_id is not distinct from o.conv_id"""


def _op12() -> str:
    k = substring_graph.K
    return rf"""
with d as (
  select doc_id, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '{WORD}') as w
  from documents
), windows as (
  select rid, doc_id, i, md5(array_to_string(w[i:i + {k - 1}], ' ')) as g
  from (select rid, doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from d)
), repeats as (
  select rid, i from (select *, min(doc_id) over (partition by g) as first from windows) where first < doc_id
), gone as (
  select distinct rid, i + o as i from repeats, range({k}) as r(o)
), words as (
  select rid, i, w[i] as word from (select rid, w, unnest(range(1, len(w) + 1)) as i from d)
), kept as (
  select rid, count(*) as n, string_agg(word, ' ' order by i) as said
  from words anti join gone using (rid, i) group by rid
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(said, '')) as kept_sha256
from d left join kept using (rid)"""


def _op13() -> str:
    d = source_divergence
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def share(n: str, size: str) -> str:
        return f"1 + {d.SCALE} * ({n} + 1)::hugeint // ({size})"

    return rf"""
with words as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), counts as (
  select rid, lang, source, term, count(*) as n
  from (select rid, lang, source, unnest(w) as term from words) group by all
), kept as (
  select lang, term, sum(n) as n from counts group by lang, term having count(*) >= {d.MIN_DOCS}
), groups as (select distinct lang, source from words), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), found as (
  select lang, source, term, sum(counts.n) as n from counts semi join kept using (lang, term) group by all
), sizes as (select lang, source, sum(n) as total from found group by all), cells as (
  select g.lang, g.source, k.term, coalesce(f.n, 0) as n,
         {share("coalesce(f.n, 0)", "coalesce(s.total, 0) + v")} as p, {share("k.n", "langs.total + v")} as q
  from groups as g join kept as k using (lang) join langs using (lang)
  left join found as f on f.lang = g.lang and f.source = g.source and f.term = k.term
  left join sizes as s on s.lang = g.lang and s.source = g.source
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from cells as a join cells as b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), part as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups as a join groups as b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from cells where n > 0 and p > q
)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from part qualify part = 'pair' or rank <= {d.TOP}"""


QUERIES: dict[str, str] = {
    "op1_chat_formatting": _op1(),
    "op2_license_scan": _op2(),
    "op7_mixing": _op7(),
    "op8_quality_rules": _op8(),
    "op9_minhash_near_dedup": _op9(),
    "op11_structure_repair": _op11(),
    "op12_substring_dedup": _op12(),
    "op13_source_divergence": _op13(),
}
