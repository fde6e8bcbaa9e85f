"""The same queries as plain SQL for an independent engine.

Written from the definitions, not from the DataFrame plans: ranks and cumulative sums are
taken over rows, matrices are dense, pairs are compared by brute force.
"""

from __future__ import annotations

from clonoframe import schema as S
from clonoframe.plans.catalog import FAMILIES, J_LIST, MOTIFS, TESTED, V_LIST

CLONES = """
clones as (
  select concat('S', cast(l_suppkey as varchar)) as sample_id,
         case when s_nationkey % 2 = 0 then 'control' else 'case' end as grp,
         concat('C',
                substr(translate(md5(cast(l_partkey as varchar)), '0123456789abcdef', 'ASSLGQDTEYNRVPKI'),
                       1, cast(4 + l_partkey % 16 as int)),
                case when l_partkey % 23 = 0 then '*'
                     when l_partkey % 2 = 0 then 'F'
                     when l_partkey % 31 = 0 then 'A'
                     else 'W' end) as cdr3_aa,
         concat('TRBV', cast(p_size as varchar)) as v_gene,
         concat('TRBJ', cast(1 + l_partkey % 2 as varchar), '-', cast(1 + l_partkey % 7 as varchar)) as j_gene,
         case when p_size % 3 = 0 then 'TRA' else 'TRB' end as chain,
         cast(l_orderkey as varchar) as pair_id,
         cast(l_quantity as bigint) as cnt,
         cast(l_partkey as bigint) as receptor_key,
         concat('g', cast(s_nationkey % 4 as varchar)) as group4
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""

QC = f"""
qc as (
  select * from clones
  where regexp_matches(cdr3_aa, '^[{S.RESIDUES}]+$') and length(cdr3_aa) between 6 and 30
    and regexp_matches(cdr3_aa, '^C.*[FW]$'))"""

META = "meta as (select distinct sample_id, grp from qc)"


def n_of(seq: str, residues: str) -> str:
    return "(" + " + ".join(f"length({seq}) - length(replace({seq}, '{r}', ''))" for r in residues) + ")"


def total_of(seq: str, weights: dict[str, float], scale: int) -> str:
    terms = [f"{round(w * scale)} * {n_of(seq, r)}" for r, w in weights.items() if w]
    return f"(cast({' + '.join(terms)} as double) / {scale})"


CHARGE = total_of("cdr3_aa", S.CHARGE, 2)
HYDRO_SUM = total_of("cdr3_aa", S.HYDROPATHY, 10)
AROM = f"(cast({n_of('cdr3_aa', S.AROMATIC)} as double) / length(cdr3_aa))"

# properties once per distinct sequence
PROPS = f"""
props as (
  select cdr3_aa, length(cdr3_aa) as len, {CHARGE} as charge,
         {HYDRO_SUM} / nullif({n_of('cdr3_aa', S.RESIDUES)}, 0) as hydro_known,
         {HYDRO_SUM} / length(cdr3_aa) as hydro_all, {AROM} as arom,
         {n_of('cdr3_aa', S.AROMATIC)} as n_arom, {n_of('cdr3_aa', 'KRH')} as n_pos,
         {n_of('cdr3_aa', 'DE')} as n_neg
  from (select distinct cdr3_aa from clones))"""

CLASSES = """
mapped as (
  select t.*, p.len as length, p.charge as net_charge, round(p.hydro_all, 3) as hydrophobicity,
         round(p.arom, 3) as aromatic_frac,
         case when p.len <= 12 then 'Short' when p.len <= 16 then 'Medium' else 'Long' end as length_class,
         case when p.charge <= -1 then 'Negative' when p.charge <= 1 then 'Neutral' else 'Positive' end as charge_class,
         case when round(p.hydro_all, 3) < -0.5 then 'Hydrophilic'
              when round(p.hydro_all, 3) < 0.3 then 'Neutral' else 'Hydrophobic' end as hydro_class,
         case when round(p.arom, 3) < 0.10 then 'Low' when round(p.arom, 3) < 0.20 then 'Medium' else 'High' end as aromatic_class
  from {source} t join props p on t.cdr3_aa = p.cdr3_aa)"""

SHARES = """
shares as (
  select sample_id, cdr3_aa, cnt, cast(cnt as double) as c,
         cast(cnt as double) / sum(cnt) over (partition by sample_id) as p,
         cast(sum(cnt) over (partition by sample_id) as double) as total,
         row_number() over (partition by sample_id order by cnt desc, cdr3_aa, pair_id) as rn,
         row_number() over (partition by sample_id order by cnt, cdr3_aa, pair_id) as up,
         sum(cnt) over (partition by sample_id order by cnt desc, cdr3_aa, pair_id
                        rows between unbounded preceding and current row) as cum
  from {source})"""


def sql(*ctes: str, body: str, doubles: str = "", keys: str = "") -> str:
    """Compose CTEs and round the double columns of the result."""
    if doubles or keys:
        cols = [k for k in keys.split()] + [
            f"(round(cast({c} as double), 6) + 0.0) as {c}" for c in doubles.split()
        ]
        body = f"select {', '.join(cols)} from ({body}) final_rows"
    return f"with recursive {', '.join(ctes)} {body}"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


QUERIES: dict[str, str] = {}

# ---- quality and normalisation ------------------------------------------------------------

QUERIES["qc_filter"] = sql(
    CLONES, QC, body="select sample_id, cdr3_aa, v_gene, j_gene, chain, cnt from qc"
)
_ok = f"""(regexp_matches(cdr3_aa, '^[{S.RESIDUES}]+$') and length(cdr3_aa) between 8 and 16
  and regexp_matches(cdr3_aa, '^C.*[FW]$'))"""
QUERIES["qc_summary"] = sql(CLONES, body=f"""
select cast(sum(case when {_ok} then 1 else 0 end) as bigint) as kept,
       cast(sum(case when {_ok} then 0 else 1 end) as bigint) as removed,
       cast(sum(case when {_ok} then cnt else 0 end) as bigint) as reads_kept from clones""")
QUERIES["freq_normalize"] = sql(
    CLONES, QC, keys="sample_id cdr3_aa pair_id cnt", doubles="freq",
    body="""select sample_id, cdr3_aa, pair_id, cnt,
      cast(cnt as double) / sum(cnt) over (partition by sample_id) as freq from qc""")
QUERIES["reads_per_sample"] = sql(CLONES, QC, body="""
select m.sample_id, m.grp, cast(coalesce(r.reads, 0) as bigint) as reads
from (select distinct sample_id, grp from clones) m
left join (select sample_id, sum(cnt) as reads from qc group by sample_id) r on m.sample_id = r.sample_id""")
QUERIES["chain_counts"] = sql(CLONES, body="select chain, count(*) as n from clones group by chain")
QUERIES["chain_select"] = sql(CLONES, QC, body="""
select sample_id, cast(sum(cnt) as bigint) as reads from qc
where chain = (select chain from qc group by chain order by count(*) desc, chain limit 1)
group by sample_id""")
QUERIES["rarefy"] = sql(
    CLONES, QC,
    """merged as (
  select sample_id, grp, cdr3_aa, v_gene, j_gene, chain, cast(sum(cnt) as bigint) as n,
         concat_ws('|', '0', sample_id, grp, cdr3_aa, v_gene, j_gene, chain) as k
  from qc
  where sample_id in (select sample_id from qc group by sample_id having sum(cnt) >= 1000)
  group by sample_id, grp, cdr3_aa, v_gene, j_gene, chain)""",
    """reads as (
  select sample_id, k, c, ('0x' || substr(md5(k || '|' || c), 1, 13))::bigint as u
  from (select *, unnest(range(n)) as c from merged))""",
    """drawn as (
  select k, count(*) as n from
    (select k, row_number() over (partition by sample_id order by u, k, c) as r from reads)
  where r <= 1000 group by k)""",
    body="""select sample_id, grp, cdr3_aa, v_gene, j_gene, chain, coalesce(drawn.n, 0) as cnt,
      coalesce(drawn.n, 0) / 1000.0::double as freq from merged left join drawn using (k)""")
QUERIES["pseudo_samples"] = sql(
    CLONES, QC,
    """copies as (
  select *, md5(k || '|' || c) as h from (
    select grp, cdr3_aa, v_gene, concat_ws('|', '42', grp, cdr3_aa, v_gene) as k, unnest(range(count(*))) as c
    from qc group by grp, cdr3_aa, v_gene))""",
    f"""drawn as (
  select *, row_number() over (partition by grp, draw order by u, k, c) as r from (
    select *, (('0x' || substr(h, 1, 13))::bigint + draw * ('0x' || substr(h, 14, 13))::bigint) % {1 << 52} as u
    from copies, range(50) as draws(draw)))""",
    body="""select grp || '_' || draw as sample_id, grp, cdr3_aa, v_gene, '?' as j_gene, 'TRB' as chain,
      cast(1 as bigint) as cnt from drawn where r <= 500""")

# ---- scalars ------------------------------------------------------------------------------

QUERIES["gene_normalize"] = sql(CLONES, body="""
select v_gene as gene, cast(sum(cnt) as bigint) as reads from clones group by v_gene""")
QUERIES["seq_properties"] = sql(
    CLONES, PROPS, keys="cdr3_aa seq_len seq_n_aromatic seq_n_positive seq_n_negative",
    doubles="seq_charge seq_charge_per_aa seq_hydro seq_arom seq_net_charge",
    body="""select cdr3_aa, len as seq_len, charge as seq_charge, charge / len as seq_charge_per_aa,
      hydro_all as seq_hydro, arom as seq_arom, n_arom as seq_n_aromatic, n_pos as seq_n_positive,
      n_neg as seq_n_negative, charge as seq_net_charge from props""")
_mass = " + ".join(f"{w} * {n_of('cdr3_aa', r)}" for r, w in S.RESIDUE_WEIGHT.items())
_known = n_of("cdr3_aa", S.RESIDUES)
QUERIES["seq_profile"] = sql(
    CLONES, keys="cdr3_aa length charge",
    doubles="charge_density hydrophobicity aromaticity avg_mw glycine proline cysteine",
    body=f"""select cdr3_aa, length(cdr3_aa) as length, {n_of('cdr3_aa', 'KRH')} - {n_of('cdr3_aa', 'DE')} as charge,
      cast({n_of('cdr3_aa', 'KRH')} - {n_of('cdr3_aa', 'DE')} as double) / length(cdr3_aa) as charge_density,
      cast({n_of('cdr3_aa', 'AVILMFWYC')} as double) / length(cdr3_aa) as hydrophobicity,
      cast({n_of('cdr3_aa', 'FWYH')} as double) / length(cdr3_aa) as aromaticity,
      cast({_mass} + 100 * (length(cdr3_aa) - {_known}) as double) / length(cdr3_aa) as avg_mw,
      cast({n_of('cdr3_aa', 'G')} as double) / length(cdr3_aa) as glycine,
      cast({n_of('cdr3_aa', 'P')} as double) / length(cdr3_aa) as proline,
      cast({n_of('cdr3_aa', 'C')} as double) / length(cdr3_aa) as cysteine
      from (select distinct cdr3_aa from clones)""")
QUERIES["domain_classes"] = sql(CLONES, PROPS, CLASSES.format(source="clones"), body="""
select length_class, charge_class, hydro_class, aromatic_class, count(*) as n
from mapped group by all""")
KMERS = """
kmers{k} as (
  select q.*, substr(q.cdr3_aa, i.i, {k}) as kmer
  from {source} q join (select unnest(range(1, 64)) as i) i on i.i <= length(q.cdr3_aa) - {k} + 1)"""
QUERIES["kmer_counts"] = sql(CLONES, QC, KMERS.format(k=3, source="qc"), body="""
select grp, kmer, count(*) as n from kmers3 group by grp, kmer""")


def has(motif: str, column: str = "cdr3_aa") -> str:
    return f"(case when contains({column}, '{motif}') then 1 else 0 end)"


_hits = " + ".join(has(m) for m in MOTIFS)
_lead = " + ".join(has(m) for m in MOTIFS[:3])
_seen = " + ".join(f"max({has(m)})" for m in MOTIFS)
MOTIF_BODY = f"""
select sample_id, avg(case when {_hits} > 0 then 1.0 else 0.0 end) as ra_motif_hit_rate,
       avg(cast({_hits} as double)) as ra_motif_avg_per_seq, {_seen} as ra_motif_diversity,
       avg(cast({has(MOTIFS[0])} as double)) as ra_motif_top1,
       avg(cast({_lead} as double)) / 3 as ra_motif_top3
from qc group by sample_id"""
QUERIES["motif_hits"] = sql(
    CLONES, QC, body=MOTIF_BODY, keys="sample_id ra_motif_diversity",
    doubles="ra_motif_hit_rate ra_motif_avg_per_seq ra_motif_top1 ra_motif_top3")
WINDOWS = """
parts as (
  select sample_id, substr(cdr3_aa, 2, 3) as head,
         substr(cdr3_aa, cast(floor(length(cdr3_aa) / 2) as int) - 1, 3) as mid,
         case when length(cdr3_aa) >= 7 then substr(cdr3_aa, length(cdr3_aa) - 6, 3) else '' end as tail
  from qc)"""
_mid = " + ".join(has(r, "mid") for r in "ILVFMA")
POSITIONS = f"""
select sample_id, avg(cast({has('S', 'head')} as double)) as nterm_serine,
       avg(cast({has('G', 'head')} as double)) as nterm_glycine,
       avg(cast({has('R', 'head')} as double)) as nterm_arginine,
       avg(cast({has('D', 'head')} as double)) as nterm_aspartate,
       avg(cast({_mid} as double)) as mid_hydrophobic,
       avg(cast({has('E', 'tail')} as double)) as cterm_glutamate
from parts group by sample_id"""
QUERIES["positional_aa"] = sql(
    CLONES, QC, WINDOWS, body=POSITIONS, keys="sample_id",
    doubles="nterm_serine nterm_glycine nterm_arginine nterm_aspartate mid_hydrophobic cterm_glutamate")
CHARGE_MOMENTS = """
residues as (
  select s.cdr3_aa, i.i, case when substr(s.cdr3_aa, i.i, 1) in ('K', 'R') then 1.0::double
              when substr(s.cdr3_aa, i.i, 1) = 'H' then 0.5::double
              when substr(s.cdr3_aa, i.i, 1) in ('D', 'E') then -1.0::double else 0.0::double end as q
  from (select distinct cdr3_aa from qc) s
  join (select unnest(range(1, 64)) as i) i on i.i <= length(s.cdr3_aa)),
moments as (
  select cdr3_aa, case when var_pop(q) > 1e-12 then skewness(q) end as s,
         case when var_pop(q) > 1e-12 then kurtosis(q) end as k
  from residues group by cdr3_aa)"""
QUERIES["charge_moments"] = sql(
    CLONES, QC, CHARGE_MOMENTS, keys="sample_id", doubles="charge_skewness charge_kurtosis",
    body="""select sample_id, avg(s) as charge_skewness, avg(k) as charge_kurtosis
      from qc join moments using (cdr3_aa) group by sample_id""")

# ---- per-sample modules -----------------------------------------------------------------------

SPEC = SHARES.format(source="qc")
DIVERSITY = """
select sample_id, -sum(p * ln(p)) as shannon, 1 - sum(p * p) as simpson,
       1 + sum(p * ln(p)) / ln(count(*)) as clonality,
       -regr_slope(ln(c), ln(rn)) as powerlaw_a,
       2 * sum(up * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*) as gini,
       max(p) as top_clone_frac,
       sum(case when rn <= 5 then p else 0 end) as top5_freq,
       cast(min(case when cum / total >= 0.5 then rn end) as bigint) as d50_index,
       cast(min(case when cum / total >= 0.2 then rn end) as bigint) as d20_index,
       cast(sum(case when p > 0.01 then 1 else 0 end) as bigint) as hec_1pct,
       cast(sum(case when p > 0.05 then 1 else 0 end) as bigint) as hec_5pct,
       sum(case when p > 0.01 then p else 0 end) as hec_sum_freq,
       count(*) * sum(c * (c - 1)) / (max(total) * (max(total) - 1)) as morisita,
       max(c) / max(total) as berger_parker, -sum(p * ln(p)) / ln(count(*)) as pielou_evenness,
       -ln(sum(p * p)) as renyi_q2
from shares group by sample_id"""


def per_sample(name: str, doubles: str, keys: str = "sample_id") -> None:
    QUERIES[name] = sql(CLONES, QC, SPEC, body=DIVERSITY, doubles=doubles, keys=keys)


per_sample("diversity", "shannon simpson clonality")
per_sample("powerlaw", "powerlaw_a")
per_sample("gini", "gini top_clone_frac")
per_sample("d50_d20", "top5_freq", "sample_id d50_index d20_index")
per_sample("hec", "hec_sum_freq", "sample_id hec_1pct hec_5pct")
per_sample("dominance", "morisita berger_parker pielou_evenness renyi_q2")
QUERIES["diversity_given_freq"] = sql(
    CLONES, QC, keys="sample_id hec_1pct",
    doubles="shannon simpson top_clone_frac hec_sum_freq renyi_q2",
    body="""select sample_id, -sum(f * ln(f)) as shannon, 1 - sum(f * f) as simpson,
      max(f) as top_clone_frac, cast(sum(case when f > 0.01 then 1 else 0 end) as bigint) as hec_1pct,
      sum(case when f > 0.01 then f else 0 end) as hec_sum_freq, -ln(sum(f * f)) as renyi_q2
      from (select sample_id, cast(cnt as double) / 40 as f from qc) group by sample_id""")
QUERIES["len_stats"] = sql(
    CLONES, QC, keys="sample_id", doubles="cdr3_len_mean cdr3_len_sd n_insertion_proxy",
    body="""select sample_id, avg(length(cdr3_aa)) as cdr3_len_mean,
      stddev_samp(length(cdr3_aa)) as cdr3_len_sd,
      avg(greatest(0, length(cdr3_aa) - 10)) as n_insertion_proxy from qc group by sample_id""")
SELECTION = """
select sample_id, avg(greatest(0, len - 10)) as n_insertion_proxy,
       avg(charge / len) as cdr3_charge_mean, stddev_samp(charge / len) as cdr3_charge_sd,
       avg(hydro_known) as cdr3_hydro_mean
from qc join props using (cdr3_aa) group by sample_id"""
QUERIES["charge_hydro"] = sql(
    CLONES, QC, PROPS, body=SELECTION, keys="sample_id",
    doubles="n_insertion_proxy cdr3_charge_mean cdr3_charge_sd cdr3_hydro_mean")
USAGE = """
usage as (
  select a.sample_id, v_usage_kl, j_usage_kl from
  (select sample_id, sum(p * ln(p * g)) as v_usage_kl from
     (select sample_id, v_gene, cast(count(*) as double) / sum(count(*)) over (partition by sample_id) as p,
             count(*) over (partition by sample_id) as g from qc group by sample_id, v_gene) group by sample_id) a
  join
  (select sample_id, sum(p * ln(p * g)) as j_usage_kl from
     (select sample_id, j_gene, cast(count(*) as double) / sum(count(*)) over (partition by sample_id) as p,
             count(*) over (partition by sample_id) as g from qc group by sample_id, j_gene) group by sample_id) b
  on a.sample_id = b.sample_id)"""
QUERIES["usage_kl"] = sql(
    CLONES, QC, USAGE, body="select * from usage", keys="sample_id", doubles="v_usage_kl j_usage_kl")


def entropy_cte(name: str, keys: str, mass: str) -> str:
    return f"""{name} as (
  select sample_id, count(*) as n, -sum(p * ln(p)) as h, 1 - sum(p * p) as d, max(p) as top from
    (select sample_id, {keys}, cast({mass} as double) / sum({mass}) over (partition by sample_id) as p
     from qc group by sample_id, {keys}) group by sample_id)"""


VJ_BODY = """
select x.sample_id, x.n as vj_n_unique_pairs, x.h as vj_pair_entropy, x.d as vj_pair_simpson,
       x.top as vj_max_pair_frac, v.h as vj_v_entropy, v.d as vj_v_simpson, j.h as vj_j_entropy,
       j.d as vj_j_simpson, v.n as vj_n_v_genes, j.n as vj_n_j_genes,
       cast(x.n as double) / (v.n * j.n) as vj_pair_ratio
from ep x join ev v on x.sample_id = v.sample_id join ej j on x.sample_id = j.sample_id"""


def vj_ctes(mass: str) -> list[str]:
    return [entropy_cte("ep", "v_gene, j_gene", mass), entropy_cte("ev", "v_gene", mass),
            entropy_cte("ej", "j_gene", mass)]


for _name, _w in (("vj_pairing", "count(*)"), ("vj_weighted", "sum(cnt)")):
    QUERIES[_name] = sql(
        CLONES, QC, *vj_ctes(_w), body=VJ_BODY,
        keys="sample_id vj_n_unique_pairs vj_n_v_genes vj_n_j_genes",
        doubles="vj_pair_entropy vj_pair_simpson vj_max_pair_frac vj_v_entropy vj_v_simpson "
                "vj_j_entropy vj_j_simpson vj_pair_ratio")


def isin(column: str, values: list[str]) -> str:
    return f"(case when {column} in ({quoted(values)}) then 1.0 else 0.0 end)"


GENE_USAGE = f"""
select sample_id, avg({isin('v_gene', V_LIST)}) as ra_v_usage, avg({isin('j_gene', J_LIST)}) as ra_j_usage,
       avg({isin('v_gene', V_LIST)} * {isin('j_gene', J_LIST)}) as ra_pair_usage,
       {', '.join(f"avg({isin('v_gene', [g])}) as {c}" for c, g in S.SINGLE_V_COLUMNS.items())},
       count(distinct concat(v_gene, '_', j_gene)) as n_unique_vj_pairs
from qc group by sample_id"""
QUERIES["gene_usage"] = sql(
    CLONES, QC, body=GENE_USAGE, keys="sample_id n_unique_vj_pairs",
    doubles="ra_v_usage ra_j_usage ra_pair_usage " + " ".join(S.SINGLE_V_COLUMNS))
PUBLIC = """
public as (
  select cdr3_aa, grp, held_by, cast(held_by as double) / n as patient_frac from
    (select cdr3_aa, grp, count(distinct sample_id) as held_by from qc group by cdr3_aa, grp) h
    join (select grp, count(distinct sample_id) as n from qc group by grp having count(distinct sample_id) >= 2) g
    using (grp)
  where cast(held_by as double) / n >= {frac})"""
QUERIES["public_clonotypes"] = sql(
    CLONES, QC, PUBLIC.format(frac=0.2), body="select * from public",
    keys="cdr3_aa grp held_by", doubles="patient_frac")
QUERIES["public_hits"] = sql(
    CLONES, QC, PUBLIC.format(frac=0.3), keys="sample_id", doubles="public_hit_rate",
    body="""select sample_id, avg(case when cdr3_aa in (select cdr3_aa from public) then 1.0 else 0.0 end)
      as public_hit_rate from qc group by sample_id""")
# overlaps by brute force over sample pairs
PAIRS = """
owned as (select distinct sample_id, grp, cdr3_aa from qc),
sizes as (select sample_id, grp, count(*) as n from owned group by sample_id, grp),
pairs as (
  select a.sample_id, b.sample_id as other, a.grp = b.grp as same, count(*) as shared
  from owned a join owned b on a.cdr3_aa = b.cdr3_aa and a.sample_id <> b.sample_id
  group by a.sample_id, b.sample_id, a.grp = b.grp),
olap as (
  select s.sample_id, s.n,
         (select count(*) from sizes) - 1 as others,
         (select count(*) from sizes t where t.grp = s.grp) - 1 as mates,
         coalesce(sum(p.shared), 0) as shared,
         coalesce(sum(case when p.same then p.shared else 0 end), 0) as shared_in
  from sizes s left join pairs p on s.sample_id = p.sample_id group by s.sample_id, s.grp, s.n),
presence as (select cdr3_aa, count(*) as held from owned group by cdr3_aa)"""
COLLAPSE = """
collapse as (
  select v.sample_id, b.base - v.shannon as diversity_collapse from
  (select sample_id, -sum(p * ln(p)) as shannon from shares group by sample_id) v,
  (select avg(shannon) as base from
     (select sample_id, -sum(p * ln(p)) as shannon from shares group by sample_id) x
     join meta using (sample_id) where grp = 'control') b)"""
QUERIES["convergence"] = sql(
    CLONES, QC, META, SPEC, PAIRS, COLLAPSE, keys="sample_id",
    doubles="gini top_clone_frac convergence_idx diversity_collapse",
    body=f"""select d.sample_id, d.gini, d.top_clone_frac,
      cast(o.shared as double) / (o.n * o.others) as convergence_idx, c.diversity_collapse
      from ({DIVERSITY}) d join olap o on d.sample_id = o.sample_id
      join collapse c on d.sample_id = c.sample_id""")
GROUP_CONVERGENCE = """
select o.sample_id, o.n as n_distinct,
       cast(o.shared_in as double) / (o.n * o.mates) as intra_group_convergence,
       cast(o.shared - o.shared_in as double) / (o.n * (o.others - o.mates)) as inter_group_convergence,
       (cast(o.shared_in as double) / (o.n * o.mates))
         / (cast(o.shared - o.shared_in as double) / (o.n * (o.others - o.mates))) as convergence_ratio,
       e.private / cast(o.n as double) as private_clone_ratio, e.high / cast(o.n as double) as high_share_clone_ratio
from olap o join
  (select w.sample_id, sum(case when held = 1 then 1 else 0 end) as private,
          sum(case when held > 0.5 * x.mates then 1 else 0 end) as high
   from owned w join presence using (cdr3_aa) join olap x on w.sample_id = x.sample_id
   group by w.sample_id) e on o.sample_id = e.sample_id"""
QUERIES["group_convergence"] = sql(
    CLONES, QC, PAIRS, body=GROUP_CONVERGENCE, keys="sample_id n_distinct",
    doubles="intra_group_convergence inter_group_convergence convergence_ratio private_clone_ratio "
            "high_share_clone_ratio")
QUERIES["overlap_anchor"] = sql(
    CLONES, QC,
    "top as (select sample_id from qc group by sample_id order by sum(cnt) desc, sample_id limit 1)",
    "owned as (select distinct sample_id, cdr3_aa from qc)",
    keys="sample_id anchor_id shared", doubles="overlap",
    body="""select a.sample_id, b.sample_id as anchor_id, count(*) as shared,
      cast(count(*) as double) / max(n.n) as overlap
      from owned a join owned b on a.cdr3_aa = b.cdr3_aa and b.sample_id = (select sample_id from top)
      join (select sample_id, count(*) as n from owned group by sample_id) n on a.sample_id = n.sample_id
      group by a.sample_id, b.sample_id""")
QUERIES["shm"] = sql(
    CLONES, QC, keys="sample_id", doubles="shm_mean_len shm_diversity",
    body="""select sample_id, avg(length(cdr3_aa)) as shm_mean_len,
      cast(count(distinct cdr3_aa) as double) / count(*) as shm_diversity from qc group by sample_id""")
PAIRING = """
select sample_id, -sum(p * ln(p)) as pairing_diversity, count(*) as pairing_n from
  (select sample_id, pair_id, cast(count(*) as double) / sum(count(*)) over (partition by sample_id) as p
   from qc group by sample_id, pair_id) group by sample_id"""
QUERIES["pairing"] = sql(
    CLONES, QC, body=PAIRING, keys="sample_id pairing_n", doubles="pairing_diversity")
MOMENTS = """
select sample_id, skewness(log10(cnt + 1)) as count_skewness, kurtosis(log10(cnt + 1)) as count_kurtosis
from qc group by sample_id"""
QUERIES["count_moments"] = sql(
    CLONES, QC, body=MOMENTS, keys="sample_id", doubles="count_skewness count_kurtosis")
PHYSCHEM = """
select sample_id, skewness(len) as cdr3_len_skew, kurtosis(len) as cdr3_len_kurt,
       avg(case when len <= 12 then 1.0 else 0.0 end) as short_cdr3_ratio,
       avg(case when len >= 16 then 1.0 else 0.0 end) as long_cdr3_ratio, avg(arom) as aromatic_freq,
       skewness(hydro_known) as hydro_skewness, kurtosis(hydro_known) as hydro_kurtosis
from qc join props using (cdr3_aa) group by sample_id"""
PHYSCHEM_COLUMNS = ("cdr3_len_skew cdr3_len_kurt short_cdr3_ratio long_cdr3_ratio aromatic_freq "
                    "hydro_skewness hydro_kurtosis")
QUERIES["len_hydro_moments"] = sql(
    CLONES, QC, PROPS, body=PHYSCHEM, keys="sample_id", doubles=PHYSCHEM_COLUMNS)
_phys = [f"phys_{p}_{s}" for p in ("len", "charge", "hydro", "arom") for s in ("mean", "std")]
_cols = {"len": "len", "charge": "charge", "hydro": "hydro_all", "arom": "arom"}
_aggs = ", ".join(
    f"sum(cnt * cast({e} as double)) / sum(cnt) as phys_{p}_mean, stddev_pop({e}) as phys_{p}_std"
    for p, e in _cols.items())
_onehot = {f"{p}_{g}".replace("-", "_"): (c, g) for p, c, part in (("vgene", "v_gene", "V"), ("jgene", "j_gene", "J"))
           for g in S.GENE_VOCAB["TRB"][part]}
ONEHOT = "select sample_id, " + ", ".join(
    f"avg({isin(c, [g])}) as {n}" for n, (c, g) in _onehot.items()) + " from qc group by sample_id"
QUERIES["gene_onehot"] = sql(CLONES, QC, keys="sample_id", doubles=" ".join(_onehot), body=ONEHOT)
QUERIES["bench_features"] = sql(
    CLONES, QC, PROPS, SPEC, *vj_ctes("sum(cnt)"), keys="sample_id div_n_clones vj_n_unique_pairs vj_n_v_genes vj_n_j_genes",
    doubles=" ".join(_phys) + " div_simpson div_shannon div_clonality div_d50 div_pielou "
            "conv_top1_freq conv_top5_freq conv_unique_ratio vj_pair_entropy vj_pair_simpson vj_max_pair_frac "
            "vj_v_entropy vj_v_simpson vj_j_entropy vj_j_simpson vj_pair_ratio " + " ".join(_onehot),
    body=f"""select a.*, d.simpson as div_simpson, d.shannon as div_shannon, d.clonality as div_clonality,
      d.d50_index / cast(u.n as double) as div_d50, d.pielou_evenness as div_pielou, u.n as div_n_clones,
      d.top_clone_frac as conv_top1_freq, d.top5_freq as conv_top5_freq, u.uniq / cast(u.n as double) as conv_unique_ratio,
      g.* exclude (sample_id), p.* exclude (sample_id)
      from (select sample_id, {_aggs} from qc join props using (cdr3_aa) group by sample_id) a
      join ({DIVERSITY}) d on a.sample_id = d.sample_id
      join (select sample_id, count(*) as n, count(distinct cdr3_aa) as uniq from qc group by sample_id) u
        on a.sample_id = u.sample_id
      join ({ONEHOT}) g on a.sample_id = g.sample_id join ({VJ_BODY}) p on a.sample_id = p.sample_id""")
_div = "shannon simpson clonality powerlaw_a cdr3_len_mean cdr3_len_sd".split()


def _chain(chain: str) -> str:
    spec = SHARES.format(source=f"(select * from qc where chain = '{chain}')").strip()[len("shares as "):]
    body = DIVERSITY.replace("from shares", f"from {spec}")
    lens = f"""select sample_id, avg(length(cdr3_aa)) as cdr3_len_mean,
      stddev_samp(length(cdr3_aa)) as cdr3_len_sd from qc where chain = '{chain}' group by sample_id"""
    cols = ", ".join(f"{c} as {chain}_{c}" for c in _div)
    return f"select d.sample_id, {cols} from ({body}) d join ({lens}) l on d.sample_id = l.sample_id"


QUERIES["multi_chain"] = sql(
    CLONES, QC, keys="sample_id", doubles=" ".join(f"{c}_{x}" for c in ("TRA", "TRB") for x in _div),
    body="select sample_id, " + ", ".join(f"coalesce({c}_{x}, 0) as {c}_{x}" for c in ("TRA", "TRB") for x in _div)
    + f" from ({_chain('TRA')}) a full outer join ({_chain('TRB')}) b using (sample_id)")
# the first component of the dense sample x 3-mer shares: the samples' products are squared over and over, which
# leaves the leading direction
MOTIF_PC = """
words as (
  select sample_id, kmer, cast(count(*) as double) / sum(count(*)) over (partition by sample_id) as x
  from kmers3 group by sample_id, kmer),
cells as (
  select s.sample_id, k.kmer, coalesce(w.x, 0) as x
  from (select distinct sample_id from words) s cross join (select distinct kmer from words) k
  left join words w on w.sample_id = s.sample_id and w.kmer = k.kmer),
scaled as (
  select sample_id, kmer, case when sd > 1e-12 then (x - m) / sd else 0.0::double end as z
  from cells join (select kmer, avg(x) as m, stddev_samp(x) as sd from cells group by kmer) using (kmer)),
wide as (
  select sample_id, row_number() over (order by sample_id) as i, list(z order by kmer) as v
  from scaled group by sample_id),
powers as (
  select 0 as step, i, list(w / t order by j) as r from (
    select *, nullif(sum(case when i = j then w end) over (), 0) as t
    from (select a.i, b.i as j, list_dot_product(a.v, b.v) as w from wide a, wide b))
  group by i
  union all
  select step + 1, i, list(w / t order by j) from (
    select *, nullif(sum(case when i = j then w end) over (), 0) as t
    from (select a.step, a.i, b.i as j, list_dot_product(a.r, b.r) as w from powers a, powers b where a.step < 24))
  group by step, i),
front as (
  select unnest(r) as u, unnest(range(1, len(r) + 1)) as i
  from (select r from powers where step = 24 order by list_extract(r, i) desc nulls last, i limit 1)),
loading as (
  select kmer, sum(z * u) as l from scaled join wide using (sample_id) join front using (i) group by kmer),
motif as (
  select sample_id, sum(z * l) / (select sqrt(sum(l * l)) from loading)
         * (select sign(l) from loading order by round(abs(l) / (select max(abs(l)) from loading), 9) desc, kmer limit 1) as motif_pc1
  from scaled join loading using (kmer) group by sample_id)"""
_basic = ("motif_pc1 public_hit_rate shannon simpson clonality powerlaw_a cdr3_len_mean cdr3_len_sd n_insertion_proxy cdr3_charge_mean "
          "cdr3_charge_sd cdr3_hydro_mean v_usage_kl j_usage_kl gini top_clone_frac convergence_idx "
          "diversity_collapse shm_mean_len shm_diversity pairing_diversity pairing_n")
BASIC = f"""
select m.sample_id, m.grp, coalesce(q.motif_pc1, 0) as motif_pc1, h.public_hit_rate,
       d.shannon, d.simpson, d.clonality, d.powerlaw_a, l.cdr3_len_mean, l.cdr3_len_sd,
       s.n_insertion_proxy, s.cdr3_charge_mean, s.cdr3_charge_sd, s.cdr3_hydro_mean, u.v_usage_kl, u.j_usage_kl,
       d.gini, d.top_clone_frac, cast(o.shared as double) / (o.n * o.others) as convergence_idx,
       c.diversity_collapse, 0 as shm_mean_len, 0 as shm_diversity, p.pairing_diversity, p.pairing_n
from meta m join ({DIVERSITY}) d on m.sample_id = d.sample_id
join (select sample_id, avg(length(cdr3_aa)) as cdr3_len_mean, stddev_samp(length(cdr3_aa)) as cdr3_len_sd
      from qc group by sample_id) l on m.sample_id = l.sample_id
join ({SELECTION}) s on m.sample_id = s.sample_id join usage u on m.sample_id = u.sample_id
join olap o on m.sample_id = o.sample_id join collapse c on m.sample_id = c.sample_id
join ({PAIRING}) p on m.sample_id = p.sample_id
left join motif q on m.sample_id = q.sample_id
join (select sample_id, avg({isin('cdr3_aa', S.PUBLIC_CDR3)}) as public_hit_rate from qc group by sample_id) h
  on m.sample_id = h.sample_id"""
QUERIES["basic_features"] = sql(
    CLONES, QC, META, PROPS, SPEC, USAGE, PAIRS, COLLAPSE, KMERS.format(k=3, source="qc"), MOTIF_PC, body=BASIC, keys="sample_id grp", doubles=_basic)
_enh = (
    "ra_motif_hit_rate ra_motif_avg_per_seq ra_motif_diversity ra_motif_top1 ra_motif_top3 ra_v_usage ra_j_usage "
    + " ".join(S.SINGLE_V_COLUMNS) + " n_unique_vj_pairs ra_pair_usage vj_n_unique_pairs vj_pair_entropy "
    "vj_pair_simpson vj_max_pair_frac vj_v_entropy vj_v_simpson vj_j_entropy vj_j_simpson vj_n_v_genes "
    "vj_n_j_genes vj_pair_ratio d50_index d20_index hec_1pct hec_5pct hec_sum_freq morisita berger_parker "
    "pielou_evenness renyi_q2 count_skewness count_kurtosis " + PHYSCHEM_COLUMNS + " charge_skewness "
    "charge_kurtosis nterm_serine nterm_glycine nterm_arginine nterm_aspartate mid_hydrophobic "
    "intra_group_convergence inter_group_convergence convergence_ratio private_clone_ratio high_share_clone_ratio")
QUERIES["enhanced_features"] = sql(
    CLONES, QC, META, PROPS, SPEC, PAIRS, *vj_ctes("count(*)"), WINDOWS, CHARGE_MOMENTS,
    keys="sample_id grp", doubles=_enh,
    body=f"""select * from meta join ({MOTIF_BODY}) a using (sample_id) join ({GENE_USAGE}) b using (sample_id)
      join ({VJ_BODY}) c using (sample_id) join ({DIVERSITY}) d using (sample_id)
      join ({MOMENTS}) e using (sample_id) join ({PHYSCHEM}) f using (sample_id)
      join ({POSITIONS}) g using (sample_id) join ({GROUP_CONVERGENCE}) h using (sample_id)
      join (select sample_id, avg(s) as charge_skewness, avg(k) as charge_kurtosis
            from qc join moments using (cdr3_aa) group by sample_id) i using (sample_id)""")

# ---- selection, pools, sharing --------------------------------------------------------------------

RANKED = """row_number() over (partition by sample_id order by cnt desc, cdr3_aa, chain, grp, group4, j_gene,
  pair_id, receptor_key, v_gene) as r"""
QUERIES["top_clones"] = sql(CLONES, QC, body=f"""
select sample_id, cdr3_aa, v_gene, j_gene, cnt from (select *, {RANKED} from qc) where r <= 500""")
QUERIES["joint_chains"] = sql(
    CLONES, QC,
    f"""best as (select * from (select *, {RANKED.replace('partition by sample_id', 'partition by sample_id, chain')}
      from qc) where r <= 500)""",
    body="""select sample_id, chain, count(*) as n, cast(sum(cnt) as bigint) as reads from best
      where sample_id in (select sample_id from best where chain = 'TRA')
        and sample_id in (select sample_id from best where chain = 'TRB') group by sample_id, chain""")
QUERIES["pool_build"] = sql(CLONES, body=f"""
select cdr3_aa as sequence, cast(sum(greatest(cnt, 1)) as bigint) as total_count from clones
where regexp_matches(cdr3_aa, '^[{S.RESIDUES}]+$') and length(cdr3_aa) >= 8 group by cdr3_aa""")
QUERIES["network_edges"] = sql(
    CLONES, "seqs as (select distinct cdr3_aa as seq from clones)",
    body="""select a.seq as left_seq, b.seq as right_seq from seqs a join seqs b
      on a.seq < b.seq and abs(length(a.seq) - length(b.seq)) <= 1 and levenshtein(a.seq, b.seq) = 1""")

NEAR = """near as (
  select * from (select a.seq as left_seq, b.seq as right_seq, levenshtein(a.seq, b.seq) as distance
    from seqs a join seqs b on a.seq < b.seq and abs(length(a.seq) - length(b.seq)) <= 2)
  where distance <= 2)"""
QUERIES["network_pairs"] = sql(
    CLONES, "seqs as (select distinct cdr3_aa as seq from clones)", NEAR,
    body="select left_seq, right_seq, cast(distance as int) as distance from near")
QUERIES["network_nodes"] = sql(
    CLONES, "seqs as (select distinct cdr3_aa as seq from clones)", NEAR,
    "ends as (select left_seq as a, right_seq as b from near union all select right_seq, left_seq from near)",
    """reach as (select seq, seq as other from seqs union
      select reach.seq, ends.b from reach join ends on ends.a = reach.other)""",
    "places as (select seq, min(other) as component from reach group by seq)",
    body="""select p.seq, (select count(*) from ends where ends.a = p.seq) as degree, component,
      count(*) over (partition by component) as component_size from places p""")

# ---- tests -----------------------------------------------------------------------------------

FEATURES = f"""
feats as (
  select m.sample_id, m.grp, d.shannon, d.simpson, d.gini, l.cdr3_len_mean, s.cdr3_charge_mean, s.cdr3_hydro_mean
  from meta m join ({DIVERSITY}) d on m.sample_id = d.sample_id
  join (select sample_id, avg(length(cdr3_aa)) as cdr3_len_mean from qc group by sample_id) l on m.sample_id = l.sample_id
  join ({SELECTION}) s on m.sample_id = s.sample_id),
tall as (
  {' union all '.join(f"select sample_id, grp, '{c}' as feature, round({c}, 9) as value from feats" for c in TESTED)})"""


def rank_stats(source: str, keys: str, inside: str) -> str:
    """U, tie term and sizes by row-level mid-ranks."""
    return f"""
select {keys}, cast(sum(case when {inside} then 1 else 0 end) as bigint) as n_in,
       cast(sum(case when {inside} then 0 else 1 end) as bigint) as n_out,
       sum(case when {inside} then midrank else 0 end)
         - sum(case when {inside} then 1.0 else 0.0 end) * (sum(case when {inside} then 1.0 else 0.0 end) + 1) / 2 as u,
       sum(cast(t as double) * t - 1) as tie_term
from (select *, rank() over (partition by {keys} order by value) + (t - 1) / 2.0 as midrank
      from (select *, count(*) over (partition by {keys}, value) as t from {source}) x) y
group by {keys}"""


Z = """case when n_in * n_out / 12.0 * ((n_in + n_out + 1) - tie_term / ((n_in + n_out) * (n_in + n_out - 1.0))) > 0
  then sign(u - n_in * n_out / 2.0) * greatest(0.0, abs(u - n_in * n_out / 2.0) - 0.5)
     / sqrt(n_in * n_out / 12.0 * ((n_in + n_out + 1) - tie_term / ((n_in + n_out) * (n_in + n_out - 1.0)))) else 0 end"""
# two-sided normal tail by the series of erf, whose terms are all positive
NORMAL_P = """case when abs(z) > 8 then 0.0 when z = 0 then 1.0
  else 1 - list_sum(list_transform(range(0, 300), lambda n:
         exp((2 * n + 1) * ln(abs(z) / sqrt(2.0)) - z * z / 2 - lgamma(n + 1.5)))) end"""


def rank_tests(source: str, keys: str, inside: str, out: str = "tested") -> str:
    """CTEs ending in ``out``: rank_stats with z and p.

    p is the normal one unless both sides have fewer than 50 rows; then every subset of the
    size of the inner side is weighed (fewer than 50 rows occur on the smallest tables only).
    """
    same = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{out}_stats as (select *, {Z} as z from ({rank_stats(source, keys, inside)})),
{out}_small as (
  select {mine}, cast(2 * rank() over (partition by {mine} order by a.value) + t - 1 as bigint) as r2,
         row_number() over (partition by {mine}) as i, hit
  from (select *, {inside} as hit, count(*) over (partition by {keys}, value) as t from {source}) a
  join {out}_stats b on {same} where b.n_in < 50 and b.n_out < 50),
{out}_subset as (
  select distinct {keys}, 0::bigint as i, 0::bigint as k, 0::bigint as s from {out}_small
  union all
  select {mine}, a.i + 1, a.k + o.b, a.s + o.b * b.r2 from {out}_subset a
  join {out}_small b on {same} and b.i = a.i + 1, (values (0), (1)) as o(b)),
{out}_sums as (
  select {keys}, count(*) as n, sum(r2) as total, sum(case when hit then r2 else 0 end) as seen,
         sum(case when hit then 1 else 0 end) as m from {out}_small group by {keys}),
{out}_exact as (
  select {mine}, avg(case when abs(a.s - m * total / n) >= abs(seen - m * total / n) - 1e-6
                          then 1.0 else 0.0 end) as p
  from {out}_subset a join {out}_sums b on {same} where a.i = b.n and a.k = b.m group by {mine}),
{out} as (
  select a.*, coalesce(b.p, {NORMAL_P}) as pval from {out}_stats a left join {out}_exact b on {same})"""


TESTS = "tests as (select t.sample_id, t.feature, t.value, t.grp as own, g.grp as grp from tall t, (select distinct grp from meta) g)"
TEST_MEANS = """
means as (
  select feature, grp, avg(case when own = grp then value end) as mean_in,
         avg(case when own <> grp then value end) as mean_out from tests group by feature, grp)"""
TEST_COLUMNS = "u auc tie_term z pval mean_in mean_out mean_diff"
TEST_BODY = """select feature, grp, n_in, n_out, u, u / (cast(n_in as double) * n_out) as auc,
  tie_term, z, pval, mean_in, mean_out, mean_in - mean_out as mean_diff
  from tested join means using (feature, grp) where n_in >= 2 and n_out >= 2"""
STEP_UP = """
ranked as (select *, count(*) over () * pval
                     / count(*) over (order by pval range between unbounded preceding and current row) as q from {source}),
adjusted as (select *, least(1.0, min(q) over (order by pval desc
                              range between unbounded preceding and current row)) as padj from ranked)"""
QUERIES["statistical_markers"] = sql(
    CLONES, QC, META, PROPS, SPEC, FEATURES, TESTS, rank_tests("tests", "feature, grp", "own = grp"),
    TEST_MEANS, f"kept as ({TEST_BODY})", STEP_UP.format(source="kept"),
    keys="feature grp n_in n_out significant", doubles=TEST_COLUMNS + " padj",
    body="select *, padj < 0.05 as significant from adjusted")
QUERIES["rank_test"] = sql(
    CLONES, QC, META, PROPS, SPEC, FEATURES, TESTS, rank_tests("tests", "feature, grp", "own = grp"),
    TEST_MEANS, keys="feature grp n_in n_out",
    doubles="u auc z pval mean_in mean_out mean_diff", body=TEST_BODY)


def fisher(source: str, a: str, b: str, c: str, d: str, key: str) -> str:
    """CTEs giving (key, p) over every table with the same margins.

    Log masses are running sums of neighbour ratios and are normalised by their total, which
    keeps full precision; log-gamma of large margins loses the seventh digit.
    """
    return f"""
margins as (
  select {key}, cast({a} as bigint) as a, cast({a} + {b} as double) as r1, cast({c} + {d} as double) as r2,
         cast({a} + {c} as double) as c1 from {source}),
supports as (
  select *, unnest(range(cast(greatest(0, c1 - r2) as bigint), cast(least(r1, c1) + 1 as bigint))) as x from margins),
masses as (
  select {key}, a, x, sum(case when x = greatest(0, c1 - r2) then 0.0::double
       else ln((r1 - x + 1) * (c1 - x + 1) / (x * (r2 - c1 + x))) end) over (partition by {key} order by x) as lp
  from supports),
seen as (select {key}, max(case when x = a then lp end) as obs, max(lp) as peak from masses group by {key}),
fisher as (
  select {key}, least(1.0, sum(case when lp <= obs + 1e-7 then exp(lp - peak) else 0 end) / sum(exp(lp - peak))) as pval
  from masses join seen using ({key}) group by {key})"""


def kmer_tests(k: int) -> list[str]:
    return [
        KMERS.format(k=k, source="qc"),
        f"""per as (select kmer, grp, count(*) as n from kmers{k} group by kmer, grp)""",
        """tests as (
  select p.kmer as motif, p.grp, p.n as a, t.n - p.n as b, coalesce(k.n, 0) - p.n as c,
         w.n - t.n - coalesce(k.n, 0) + p.n as d
  from per p join (select grp, sum(n) as n from per group by grp) t on p.grp = t.grp
  join (select kmer, sum(n) as n from per group by kmer) k on p.kmer = k.kmer
  cross join (select sum(n) as n from per) w where p.n >= 3)""",
        fisher("tests", "a", "b", "c", "d", "motif, grp"),
        """scored as (
  select motif, grp, cast(a as bigint) as count_in, cast(c as bigint) as count_out,
         cast(a as double) * d / (cast(b as double) * c + 1e-9) as odds_ratio, pval
  from tests join fisher using (motif, grp)),
ranked as (
  select *, pval * (select count(*) from scored) / rank_up as rawq from
    (select *, count(*) over (order by pval range between unbounded preceding and current row) as rank_up from scored)),
adjusted as (
  select *, least(1.0, min(rawq) over (order by pval desc range between unbounded preceding and current row)) as padj
  from ranked)""",
    ]


QUERIES["fisher_kmers"] = sql(
    CLONES, QC, *kmer_tests(3), keys="motif grp count_in count_out significant", doubles="odds_ratio pval padj",
    body="select *, padj < 0.05 and odds_ratio > 1 as significant from adjusted")
QUERIES["fdr_ranges"] = sql(
    CLONES, QC, *kmer_tests(2), keys="motif grp count_in count_out", doubles="odds_ratio pval padj",
    body="select * from adjusted")
QUERIES["cohens_d"] = sql(
    CLONES, QC, META, PROPS, SPEC, FEATURES, keys="feature", doubles="cohens_d",
    body="""select feature, (avg(x) - avg(y)) / sqrt((var_pop(x) + var_pop(y)) / 2 + 1e-10) as cohens_d from
      (select feature, case when grp = 'case' then value end as x, case when grp <> 'case' then value end as y from tall)
      group by feature""")
_domains = {"length_class": "CDR3 Length", "charge_class": "Net Charge", "hydro_class": "Hydrophobicity",
            "aromatic_class": "Aromatic"}
DOMAIN_COUNTS = f"""
classed as ({' union all '.join(
    f"select grp, '{label}' as domain, {c} as category from mapped" for c, label in _domains.items())}),
dcounts as (
  select domain, category, sum(case when grp = 'case' then 1 else 0 end) as n_case,
         sum(case when grp = 'control' then 1 else 0 end) as n_control from classed group by domain, category),
dtotal as (select sum(case when grp = 'case' then 1 else 0 end) as tc, sum(case when grp = 'control' then 1 else 0 end) as tk
           from mapped),
dtests as (select domain, category, n_case as a, n_control as b, tc - n_case as c, tk - n_control as d from dcounts, dtotal)"""
QUERIES["domain_significance"] = sql(
    CLONES, QC, PROPS, CLASSES.format(source="qc"), DOMAIN_COUNTS,
    fisher("dtests", "a", "b", "c", "d", "domain, category"),
    keys="domain category n_case n_control significant", doubles="odds_ratio ci_low ci_high p_value",
    body="""select domain, category, cast(a as bigint) as n_case, cast(b as bigint) as n_control,
      round(cast(a as double) * d / (cast(b as double) * c), 4) as odds_ratio,
      exp(ln(cast(a as double) * d / (cast(b as double) * c)) - 1.96 * sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)) as ci_low,
      exp(ln(cast(a as double) * d / (cast(b as double) * c)) + 1.96 * sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)) as ci_high,
      pval as p_value,
      case when pval < 0.001 then '***' when pval < 0.01 then '**' when pval < 0.05 then '*' else 'ns' end as significant
      from dtests join fisher using (domain, category)""")
QUERIES["freq_redistribution"] = sql(
    CLONES, QC, PROPS, CLASSES.format(source="qc"), DOMAIN_COUNTS,
    keys="domain category", doubles="case_freq control_freq ratio",
    body="""select domain, category, cast(n_case as double) / tc as case_freq, cast(n_control as double) / tk as control_freq,
      (cast(n_case as double) / tc) / (cast(n_control as double) / tk + 1e-6) as ratio from dcounts, dtotal""")
QUERIES["v_family"] = sql(
    CLONES, QC, keys="v_family", doubles="case_freq control_freq log2_ratio",
    body=f"""select split_part(v_gene, '-', 1) as v_family,
      sum(case when grp = 'case' then 1.0 else 0.0 end) / (select count(*) from qc where grp = 'case') as case_freq,
      sum(case when grp = 'control' then 1.0 else 0.0 end) / (select count(*) from qc where grp = 'control') as control_freq,
      log2((sum(case when grp = 'case' then cast(1 as double) else 0 end) / (select count(*) from qc where grp = 'case'))
        / (sum(case when grp = 'control' then cast(1 as double) else 0 end) / (select count(*) from qc where grp = 'control') + 1e-6))
        as log2_ratio
      from qc where split_part(v_gene, '-', 1) in ({quoted(FAMILIES)}) group by 1""")
QUERIES["motif_by_group"] = sql(
    CLONES, QC, keys="motif n_case n_control", doubles="ratio",
    body=f"""select motif, cast(a as bigint) as n_case, cast(b as bigint) as n_control,
      cast(a as double) / greatest(b, 1) as ratio from (
      {' union all '.join(f"select '{m}' as motif, sum(case when grp = 'case' then {has(m)} else 0 end) as a, "
                          f"sum(case when grp = 'control' then {has(m)} else 0 end) as b from qc" for m in MOTIFS)})""")
QUERIES["expansion"] = sql(
    CLONES, QC, "rows_in as (select 1 as test, grp, cnt as value from qc)",
    rank_tests("rows_in", "test", "grp = 'case'"),
    keys="n_in n_out", doubles="case_mean control_mean u auc tie_term z pval",
    body="""select n_in, n_out, u, u / (cast(n_in as double) * n_out) as auc, tie_term, z, pval,
      (select avg(ln(1 + cnt)) from qc where grp = 'case') as case_mean,
      (select avg(ln(1 + cnt)) from qc where grp = 'control') as control_mean from tested""")
VECTORED = """
vectored as (
  select q.*, e.label, round(cast(e.embedding[1] as double), 9) as axis1, round(cast(e.embedding[2] as double), 9) as axis2
  from qc q join embeddings e on e.vec_id = q.receptor_key % (select count(*) from embeddings))"""
_axes = ["axis1", "axis2"]
_props = ["net_charge", "hydrophobicity", "aromatic_frac", "length"]


def _rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}"


# two-sided t test of a correlation: finite sums over half the degrees of freedom
CORRELATION_P = """
  case when abs(rho) >= 1 then 0.0 when (n - 2) % 2 = 0 then
    1 - abs(rho) * (select sum(exp(lgamma(k + 0.5) - lgamma(k + 1.0) - ln(pi()) / 2 + k * ln(1 - rho * rho)))
                    from range((n - 2) // 2) as t(k))
  else 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce((
    select sum(exp(lgamma(k + 1.0) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2.0) + (k + 0.5) * ln(1 - rho * rho)))
    from range((n - 3) // 2) as t(k)), 0)) end"""
QUERIES["axis_corr"] = sql(
    CLONES, QC, PROPS, VECTORED, CLASSES.format(source="vectored"),
    f"ranks as (select {', '.join(_rank(c) for c in _axes + _props)} from mapped)",
    "pairs as (" + " union all ".join(
        f"select '{a}' as axis, '{p}' as property, count(*) as n, corr(r_{a}, r_{p}) as rho from ranks"
        for a in _axes for p in _props) + ")",
    keys="axis property n", doubles="rho pval",
    body=f"select axis, property, n, rho, {CORRELATION_P} as pval from pairs")
_axis_rows = "axis_rows as (" + " union all ".join(
    f"select '{a}' as axis, grp, {a} as value from vectored" for a in _axes) + ")"
QUERIES["axis_auc"] = sql(
    CLONES, QC, VECTORED, _axis_rows,
    f"stats as ({rank_stats('axis_rows', 'axis', 'grp = ' + repr('case'))})",
    keys="axis conclusion", doubles="auc",
    body="""select axis, u / (cast(n_in as double) * n_out) as auc,
      case when (select max(u / (cast(n_in as double) * n_out)) from stats) < 0.55
           then 'population-level' else 'sequence-level signal' end as conclusion from stats""")
QUERIES["centroid_shift"] = sql(
    CLONES, QC, VECTORED, "axis_rows as (select 'axis2' as axis, grp, axis2 as value from vectored)",
    rank_tests("axis_rows", "axis", "grp = 'case'"),
    """knots as (
  select value, max(rn) - 1 as last_at, min(rn) - 1 as first_at from
    (select value, row_number() over (order by value) as rn from axis_rows where grp = 'case') group by value),
steps as (select *, lead(value) over (order by value) as next_value, lead(first_at) over (order by value) as next_at from knots),
placed as (
  select k.value, case when s.value is null then 0.0
              when k.value = s.value or s.next_value is null then cast(s.last_at as double)
              else s.last_at + (s.next_at - s.last_at) * (k.value - s.value) / (s.next_value - s.value) end
         / ((select count(*) from axis_rows where grp = 'case') - 1) as f
  from (select value from axis_rows where grp = 'control') k asof left join steps s on k.value >= s.value)""",
    keys="axis n_in n_out", doubles="shift overlap u auc tie_term z pval",
    body="""select axis, n_in, n_out, u, u / (cast(n_in as double) * n_out) as auc, tie_term, z, pval,
      abs((select avg(value) from axis_rows where grp = 'case') - (select avg(value) from axis_rows where grp = 'control')) as shift,
      (select avg(least(f, 1 - f)) from placed) as overlap from tested""")
QUERIES["modified_axis"] = sql(
    CLONES, PROPS, keys="name",
    doubles="native_charge modified_charge native_hydro modified_hydro delta_charge delta_hydro",
    body=f"""select cdr3_aa as name, charge as native_charge, charge - nr as modified_charge,
      hydro_all as native_hydro, hydro_all + 5.0 * nr / len as modified_hydro,
      -nr as delta_charge, 5.0 * nr / len as delta_hydro
      from (select *, cast({n_of('cdr3_aa', 'R')} as double) as nr from props)""")
_profile = {
    "length": "length(cdr3_aa)", "charge": f"{n_of('cdr3_aa', 'KRH')} - {n_of('cdr3_aa', 'DE')}",
    "hydrophobicity": f"cast({n_of('cdr3_aa', 'AVILMFWYC')} as double) / length(cdr3_aa)",
    "aromaticity": f"cast({n_of('cdr3_aa', 'FWYH')} as double) / length(cdr3_aa)",
    "glycine": f"cast({n_of('cdr3_aa', 'G')} as double) / length(cdr3_aa)",
    "proline": f"cast({n_of('cdr3_aa', 'P')} as double) / length(cdr3_aa)",
}
QUERIES["property_comparison"] = sql(
    CLONES, QC, "prop_rows as (" + " union all ".join(
        f"select '{n}' as feature, grp, round(cast({e} as double), 9) as value from qc" for n, e in _profile.items()) + ")",
    rank_tests("prop_rows", "feature", "grp = 'case'"),
    keys="feature n_in n_out stars", doubles="u auc z pval",
    body="""select feature, n_in, n_out, u, u / (cast(n_in as double) * n_out) as auc, z, pval,
      case when pval < 0.001 then '***' when pval < 0.01 then '**' when pval < 0.05 then '*'
           else 'ns' end as stars from tested""")

# ---- metrics ---------------------------------------------------------------------------------

SCORED = """
scored as (select case when grp = 'case' then 1 else 0 end as label, cast(cnt as double) as score, group4,
                  concat('g', cast(receptor_key % 4 as varchar)) as called from qc)"""
CURVE = """
points as (
  select {k} as part, score, sum(label) as pos, sum(1 - label) as neg from scored group by {k}, score),
curve as (
  select *, sum(pos) over (partition by part order by score desc) as tp, sum(neg) over (partition by part order by score desc) as fp,
         cast(sum(pos) over (partition by part) as double) as p, cast(sum(neg) over (partition by part) as double) as n from points)"""
QUERIES["roc_curve"] = sql(
    CLONES, QC, SCORED, CURVE.format(k="'all'"), keys="tp fp", doubles="threshold tpr fpr",
    body="select score as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, tp / p as tpr, fp / n as fpr from curve")


def _roc(k: str) -> str:
    return f"""
select part as group4, case when p > 0 and n > 0 then auc_raw else 0.5 end as auc,
       case when p > 0 and n > 0 then best_threshold end as best_threshold, case when p > 0 and n > 0 then j end as youden_j,
       case when p > 0 and n > 0 then sens end as sensitivity, case when p > 0 and n > 0 then spec end as specificity from
  (select a.part, a.p, a.n, a.auc_raw, b.score as best_threshold, b.tp / b.p - b.fp / b.n as j, b.tp / b.p as sens,
          1 - b.fp / b.n as spec from
    (select part, max(p) as p, max(n) as n,
            sum((fp - prev_fp) * (tp + prev_tp) / 2.0) / (max(p) * max(n)) as auc_raw from
       (select *, coalesce(lag(tp) over (partition by part order by score desc), 0) as prev_tp,
               coalesce(lag(fp) over (partition by part order by score desc), 0) as prev_fp from curve{k}) group by part) a
    join (select * from (select *, row_number() over (partition by part
            order by round(case when p > 0 then tp / p else 0 end - case when n > 0 then fp / n else 0 end, 12) desc, score desc) as r
          from curve{k}) where r = 1) b on a.part = b.part)"""


QUERIES["roc_summary"] = sql(
    CLONES, QC, SCORED, CURVE.format(k="group4").replace("points", "points1").replace("curve as", "curve1 as"),
    CURVE.format(k="'all'").replace("points", "points2").replace("curve as", "curve2 as"),
    keys="group4", doubles="auc best_threshold youden_j sensitivity specificity",
    body=f"{_roc('1')} union all {_roc('2')}")
QUERIES["pr_curve"] = sql(
    CLONES, QC, SCORED, CURVE.format(k="'all'"), keys="", doubles="threshold recall precision",
    body='select score as threshold, tp / p as recall, cast(tp as double) / (tp + fp) as precision from curve')
QUERIES["pr_summary"] = sql(
    CLONES, QC, SCORED, CURVE.format(k="'all'"), doubles="average_precision auc_pr",
    body="""select sum((tp - ptp) / p * prec) as average_precision, sum((tp - ptp) / p * (prec + pprec) / 2) as auc_pr from
      (select *, coalesce(lag(tp) over (order by score desc), 0) as ptp, coalesce(lag(prec) over (order by score desc), 1.0) as pprec
       from (select *, cast(tp as double) / (tp + fp) as prec from curve))""")
QUERIES["binary_metrics"] = sql(
    CLONES, QC, SCORED,
    """cells as (
  select group4, sum(case when label = 1 and score >= 25 then 1.0::double else 0 end) as tp,
         sum(case when label = 0 and score >= 25 then 1.0::double else 0 end) as fp,
         sum(case when label = 1 and score < 25 then 1.0::double else 0 end) as fn,
         sum(case when label = 0 and score < 25 then 1.0::double else 0 end) as tn from scored group by group4)""",
    keys="group4 tp fp fn tn", doubles="accuracy precision recall specificity f1 mcc",
    body="""select group4, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
      (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
      coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(tn / nullif(tn + fp, 0), 0) as specificity,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
      coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) as mcc from cells""")
QUERIES["multiclass_metrics"] = sql(
    CLONES, QC, SCORED,
    """per as (
  select c.group4 as class, count(*) filter (where s.group4 = c.group4) as support,
         count(*) filter (where s.called = c.group4) as called,
         count(*) filter (where s.group4 = c.group4 and s.called = c.group4) as hit
  from scored s, (select distinct group4 from scored) c group by c.group4)""",
    keys="class support", doubles="precision recall f1 accuracy macro_f1",
    body="""select class, support, coalesce(cast(hit as double) / nullif(called, 0), 0) as precision,
      cast(hit as double) / support as recall, 2.0 * hit / (support + called) as f1,
      (select cast(sum(hit) as double) / sum(support) from per) as accuracy,
      (select avg(2.0 * hit / (support + called)) from per) as macro_f1 from per""")

# ---- prototypes --------------------------------------------------------------------------------

PANEL = """
dims as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as x from embeddings),
centroids as (select label as prototype, i, avg(cast(x as double)) as c from dims group by label, i),
distances as (
  select d.vec_id, c.prototype, sum((cast(d.x as double) - c.c) * (cast(d.x as double) - c.c)) as d2
  from dims d join centroids c on d.i = c.i group by d.vec_id, c.prototype),
panel as (
  select cast(vec_id as bigint) as vec_id, cast(prototype as bigint) as prototype from
    (select *, row_number() over (partition by vec_id order by d2, prototype) as r from distances) where r = 1)"""
QUERIES["nearest_centroid"] = "with " + PANEL + " select vec_id, prototype from panel"
PROTO = f"""{PANEL},
tagged as (
  select q.*, q.receptor_key % (select count(*) from embeddings) as vec_id, p.prototype from qc q
  join panel p on p.vec_id = q.receptor_key % (select count(*) from embeddings)),
pcounts as (select sample_id, prototype, cast(sum(cnt) as bigint) as cnt from tagged group by sample_id, prototype)"""
QUERIES["sample_prototype_counts"] = sql(CLONES, QC, PROTO, body="select * from pcounts")
QUERIES["l2_normalize"] = sql(
    CLONES, QC, PROTO, keys="sample_id prototype cnt", doubles="l2",
    body="""select *, cnt / sqrt(sum(cast(cnt as double) * cnt) over (partition by sample_id)) as l2 from pcounts""")
QUERIES["freq_rows"] = sql(
    CLONES, QC, PROTO, keys="sample_id prototype cnt", doubles="freq",
    body="select *, cast(cnt as double) / sum(cnt) over (partition by sample_id) as freq from pcounts")
QUERIES["cluster_sizes"] = "with " + PANEL + """
select cast(l.label as bigint) as prototype, count(p.vec_id) as members
from (select distinct label from embeddings) l left join panel p on p.prototype = l.label group by l.label"""
QUERIES["matrix_sparsity"] = sql(
    CLONES, QC, PROTO, keys="nonzero", doubles="sparsity",
    body="""select count(*) as nonzero, 1 - cast(count(*) as double) / ((select count(distinct sample_id) from qc)
      * (select count(distinct label) from embeddings)) as sparsity from pcounts where cnt > 0""")
# dense matrix on purpose
DENSE = """
dense as (
  select m.sample_id, m.grp, l.prototype, coalesce(p.cnt, 0) as value
  from meta m cross join (select distinct cast(label as bigint) as prototype from embeddings) l
  left join pcounts p on p.sample_id = m.sample_id and p.prototype = l.prototype)"""
QUERIES["prototype_markers"] = sql(
    CLONES, QC, META, PROTO, DENSE,
    rank_tests("dense", "prototype", "grp = 'case'"),
    """levels as (
  select prototype, avg(case when grp = 'case' then cast(value as double) end) as case_mean,
         avg(case when grp = 'control' then cast(value as double) end) as control_mean,
         avg(case when value > 0 then 1.0 else 0.0 end) as expressed_frac from dense group by prototype)""",
    "kept as (select tested.* from tested join levels using (prototype) where expressed_frac >= 0.05)",
    STEP_UP.format(source="kept"),
    keys="prototype tested significant direction",
    doubles="log_fc case_mean control_mean expressed_frac auc pval fdr effect_size neg_log10_fdr",
    body="""select *, fdr < 0.05 and abs(auc - 0.5) > 0.1 as significant, -log10(greatest(fdr, 1e-300)) as neg_log10_fdr,
      case when auc > 0.6 and fdr < 0.05 then 'up' when auc < 0.4 and fdr < 0.05 then 'down' else 'ns' end as direction
      from (select prototype, expressed_frac >= 0.05 as tested,
      coalesce(pval, 1.0) as pval, coalesce(padj, 1.0) as fdr,
      log2(case when case_mean = 0 then 1e-6 else case_mean end / case when control_mean = 0 then 1e-6 else control_mean end) as log_fc,
      case_mean, control_mean, expressed_frac,
      case when expressed_frac >= 0.05 then u / (cast(n_in as double) * n_out) else 0 end as auc,
      case when expressed_frac >= 0.05 then abs(u / (cast(n_in as double) * n_out) - 0.5) * 2 else 0 end as effect_size
      from levels left join adjusted using (prototype))""")
QUERIES["prototype_markers_fdr"] = QUERIES["prototype_markers"]
ENRICH = "log2((case_count / (ta + 1.0) + {e}) / (control_count / (tb + 1.0) + {e})) as log2_enrichment"
QUERIES["gene_enrichment"] = sql(
    CLONES, QC, PROTO, keys="gene case_count control_count", doubles="log2_enrichment",
    body=f"""select *, {ENRICH.format(e='1e-6')} from
      (select v_gene as gene, cast(sum(case when prototype < 5 then least(cnt, 10) else 0 end) as bigint) as case_count,
              cast(sum(case when prototype >= 5 then least(cnt, 10) else 0 end) as bigint) as control_count from tagged group by v_gene) g,
      (select sum(case when prototype < 5 then least(cnt, 10) else 0 end) as ta,
              sum(case when prototype >= 5 then least(cnt, 10) else 0 end) as tb from tagged) t""")
QUERIES["kmer_enrichment"] = sql(
    CLONES, QC, PROTO, "pseqs as (select distinct prototype, cdr3_aa from tagged)", KMERS.format(k=2, source="pseqs"),
    keys="motif case_count control_count", doubles="log2_enrichment",
    body=f"""select *, {ENRICH.format(e='1e-8')} from
      (select kmer as motif, cast(sum(case when prototype < 5 then 1 else 0 end) as bigint) as case_count,
              cast(sum(case when prototype >= 5 then 1 else 0 end) as bigint) as control_count from kmers2 group by kmer) g,
      (select sum(case when prototype < 5 then 1 else 0 end) as ta,
              sum(case when prototype >= 5 then 1 else 0 end) as tb from kmers2) t where case_count >= 5""")
QUERIES["prototype_convergence"] = sql(
    CLONES, QC, PROTO, keys="prototype n_seqs n_vj_pairs n_v_genes", doubles="convergence_score",
    body="""select m.prototype, m.n_seqs, coalesce(g.pairs, 0) as n_vj_pairs, coalesce(g.v, 0) as n_v_genes,
      coalesce(g.pairs, 0) / cast(greatest(m.n_seqs, 1) as double) as convergence_score
      from (select prototype, count(*) as n_seqs from panel group by prototype) m
      left join (select prototype, count(distinct concat(v_gene, '|', j_gene)) as pairs, count(distinct v_gene) as v
                 from tagged group by prototype) g on m.prototype = g.prototype""")


def _top(gene: str) -> str:
    return f"""(select prototype, string_agg({gene}, ',' order by r) as top_{gene} from
      (select *, row_number() over (partition by prototype order by c desc, {gene}) as r from
        (select prototype, {gene}, count(*) as c from annotated group by prototype, {gene})) where r <= 3 group by prototype)"""


QUERIES["prototype_annotation"] = sql(
    CLONES, QC, PROTO, "annotated as (select distinct prototype, cdr3_aa, v_gene, j_gene from tagged)",
    keys="prototype n_seqs examples top_v_gene top_j_gene", doubles="mean_length",
    body=f"""select a.prototype, a.n_seqs, a.mean_length, e.examples, v.top_v_gene, j.top_j_gene from
      (select prototype, count(*) as n_seqs, avg(length(cdr3_aa)) as mean_length
       from (select distinct prototype, cdr3_aa from annotated) group by prototype) a
      join (select prototype, string_agg(cdr3_aa, ',' order by cdr3_aa) as examples from
        (select *, row_number() over (partition by prototype order by cdr3_aa) as r
         from (select distinct prototype, cdr3_aa from annotated)) where r <= 5 group by prototype) e using (prototype)
      join {_top('v_gene')} v using (prototype) join {_top('j_gene')} j using (prototype)""")
QUERIES["known_match"] = sql(
    CLONES, QC, PROTO, keys="prototype n_seqs n_matches", doubles="match_rate",
    body="""select prototype, count(*) as n_seqs, cast(sum(hit) as bigint) as n_matches, avg(cast(hit as double)) as match_rate from
      (select prototype, cdr3_aa, case when cdr3_aa in (select cdr3_aa from qc where cnt = 50) then 1 else 0 end as hit
       from (select distinct prototype, cdr3_aa from tagged)) group by prototype""")
DOMINANT = """
dominant as (
  select sample_id, grp, prototype as cluster from
    (select *, row_number() over (partition by sample_id order by cnt desc, prototype) as r from pcounts) join meta using (sample_id)
  where r = 1)"""
QUERIES["cluster_agreement"] = sql(
    CLONES, QC, META, PROTO, DOMINANT, doubles="ari nmi",
    body="""select (sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) as ari,
      (ha + hb - hab) / ((ha + hb) / 2) as nmi from
      (select sum(m * (m - 1) / 2.0) as sij, -sum(m / t * ln(m / t)) as hab from
         (select cast(count(*) as double) as m, (select cast(count(*) as double) from dominant) as t from dominant group by cluster, grp)) x,
      (select sum(m * (m - 1) / 2.0) as sa, -sum(m / t * ln(m / t)) as ha, max(t) as n from
         (select cast(count(*) as double) as m, (select cast(count(*) as double) from dominant) as t from dominant group by cluster)) y,
      (select sum(m * (m - 1) / 2.0) as sb, -sum(m / t * ln(m / t)) as hb from
         (select cast(count(*) as double) as m, (select cast(count(*) as double) from dominant) as t from dominant group by grp)) z""")
QUERIES["cluster_composition"] = sql(
    CLONES, QC, META, PROTO, DOMINANT,
    """ctests as (
  select cluster, count(*) filter (where grp = 'case') as a, count(*) filter (where grp <> 'case') as b,
         (select count(*) from dominant where grp = 'case') - count(*) filter (where grp = 'case') as c,
         (select count(*) from dominant where grp <> 'case') - count(*) filter (where grp <> 'case') as d
  from dominant group by cluster)""",
    fisher("ctests", "a", "b", "c", "d", "cluster"),
    keys="cluster n_samples n_case n_control enriched_in", doubles="case_frac enrichment odds_ratio p_value",
    body="""select cluster, a + b as n_samples, a as n_case, b as n_control, cast(a as double) / (a + b) as case_frac,
      (cast(a as double) / (a + b)) / (cast(a + c as double) / (a + b + c + d) + 1e-6) as enrichment,
      cast(a as double) * d / nullif(cast(b as double) * c, 0) as odds_ratio, pval as p_value,
      case when cast(a as double) / (a + b) > cast(a + c as double) / (a + b + c + d) then 'case-enriched'
           else 'control-enriched' end as enriched_in from ctests join fisher using (cluster)""")
QUERIES["heatmap_z"] = sql(
    CLONES, QC, META, PROPS, SPEC, FEATURES, keys="sample_id grp feature", doubles="z",
    body=" union all ".join(
        f"select sample_id, grp, '{c}' as feature, ({c} - avg({c}) over ()) / stddev_samp({c}) over () as z from feats"
        for c in TESTED))
