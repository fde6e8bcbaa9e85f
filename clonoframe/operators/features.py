"""Per-sample feature modules.

Every module is ``DataFrame -> DataFrame(sample_id, ...)``. Modules that only need row-level
aggregates contribute expressions, and the assembler evaluates all of them in one
aggregation; the count spectrum, the gene table and the sharing table are the three other
grains.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe import schema as S
from clonoframe.functions import sequence as Q
from clonoframe.operators import sharing, spectrum

BASIC_MODULES = {
    "motif": ["motif_pc1", "public_hit_rate"],
    "diversity": ["shannon", "simpson", "clonality", "powerlaw_a", "cdr3_len_mean", "cdr3_len_sd"],
    "selection": ["n_insertion_proxy", "cdr3_charge_mean", "cdr3_charge_sd", "cdr3_hydro_mean",
                  "v_usage_kl", "j_usage_kl"],
    "convergence": ["gini", "top_clone_frac", "convergence_idx", "diversity_collapse"],
    "shm": ["shm_mean_len", "shm_diversity"],
    "pairing": ["pairing_diversity", "pairing_n"],
}
ENHANCED_MODULES = {
    "motif_enrichment": ["ra_motif_hit_rate", "ra_motif_avg_per_seq", "ra_motif_diversity",
                         "ra_motif_top1", "ra_motif_top3"],
    "gene_usage": ["ra_v_usage", "ra_j_usage", *S.SINGLE_V_COLUMNS, "n_unique_vj_pairs",
                   "ra_pair_usage"],
    "vj_pairing": ["vj_n_unique_pairs", "vj_pair_entropy", "vj_pair_simpson", "vj_max_pair_frac",
                   "vj_v_entropy", "vj_v_simpson", "vj_j_entropy", "vj_j_simpson",
                   "vj_n_v_genes", "vj_n_j_genes", "vj_pair_ratio"],
    "expansion": ["d50_index", "d20_index", "hec_1pct", "hec_5pct", "hec_sum_freq", "morisita",
                  "berger_parker", "pielou_evenness", "renyi_q2", "count_skewness",
                  "count_kurtosis"],
    "physicochemical": ["cdr3_len_skew", "cdr3_len_kurt", "short_cdr3_ratio", "long_cdr3_ratio",
                        "aromatic_freq", "charge_skewness", "charge_kurtosis", "hydro_skewness",
                        "hydro_kurtosis", "nterm_serine", "nterm_glycine", "nterm_arginine",
                        "nterm_aspartate", "mid_hydrophobic"],
    "sharing": ["intra_group_convergence", "inter_group_convergence", "convergence_ratio",
                "private_clone_ratio", "high_share_clone_ratio"],
}
MODULES = {**BASIC_MODULES, **ENHANCED_MODULES}
MID_RESIDUES = "ILVFMA"


def fraction(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


# ---- row-grain modules --------------------------------------------------------


class RowModule:
    """Columns derived per clone row, aggregates over them, and a final projection."""

    def __init__(self, derived=None, aggregates=None, final=None):
        self.derived: dict[str, Column] = derived or {}
        self.aggregates: dict[str, Column] = aggregates or {}
        self.final: dict[str, Column] = final or {}


def length_rows() -> RowModule:
    return RowModule(
        {"_len": F.length("cdr3_aa")},
        {"cdr3_len_mean": F.avg("_len"), "cdr3_len_sd": F.stddev_samp("_len")},
    )


def selection_rows() -> RowModule:
    return RowModule(
        {
            "_ins": Q.insertion_proxy("cdr3_aa"),
            "_charge": Q.charge_per_residue("cdr3_aa"),
            "_hydro": Q.hydropathy("cdr3_aa"),
        },
        {
            "n_insertion_proxy": F.avg("_ins"),
            "cdr3_charge_mean": F.avg("_charge"),
            "cdr3_charge_sd": F.stddev_samp("_charge"),
            "cdr3_hydro_mean": F.avg("_hydro"),
        },
    )


def public_rows(public_ref: Sequence[str] | None = None) -> RowModule:
    known = F.col("cdr3_aa").isin(list(public_ref or S.PUBLIC_CDR3))
    return RowModule(aggregates={"public_hit_rate": fraction(known)})


def motif_rows(motifs: Sequence[str] | None = None) -> RowModule:
    motifs = list(motifs or S.MOTIFS)
    derived = {f"_m{i}": F.col("cdr3_aa").contains(m) for i, m in enumerate(motifs)}
    hits = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in derived])
    seen = {f"_seen{i}": F.max(c) for i, c in enumerate(derived)}
    lead = [f"_m{i}" for i in range(min(3, len(motifs)))]
    return RowModule(
        derived,
        {
            "ra_motif_hit_rate": fraction(hits > 0),
            "ra_motif_avg_per_seq": F.avg(hits),
            "ra_motif_top1": fraction(F.col(lead[0])),
            "ra_motif_top3": sum((fraction(F.col(c)) for c in lead), F.lit(0.0)) / len(lead),
            **seen,
        },
        {"ra_motif_diversity": reduce(
            lambda a, b: a + b, [F.col(c).cast("int") for c in seen]
        )},
    )


def gene_rows(
    v_genes: Sequence[str] | None = None, j_genes: Sequence[str] | None = None
) -> RowModule:
    in_v = F.col("v_gene").isin(list(v_genes or S.V_GENES))
    in_j = F.col("j_gene").isin(list(j_genes or S.J_GENES))
    singles = {c: fraction(F.col("v_gene") == g) for c, g in S.SINGLE_V_COLUMNS.items()}
    return RowModule(
        aggregates={
            "ra_v_usage": fraction(in_v),
            "ra_j_usage": fraction(in_j),
            "ra_pair_usage": fraction(in_v & in_j),
            **singles,
        }
    )


def physchem_rows(compat: bool = False) -> RowModule:
    skew, kurt = Q.charge_moments("cdr3_aa")
    head, mid = F.col("_head"), F.col("_mid")
    n = F.col("_rows")
    return RowModule(
        {
            "_len": F.length("cdr3_aa"),
            "_arom": Q.aromatic_fraction("cdr3_aa"),
            "_hydro": Q.hydropathy("cdr3_aa"),
            "_cskew": skew,
            "_ckurt": kurt,
            "_head": Q.n_terminal("cdr3_aa"),
            "_mid": Q.central("cdr3_aa"),
        },
        {
            "_rows": F.count("_len").cast("double"),
            "_len_g1": F.skewness("_len"),
            "_len_g2": F.kurtosis("_len"),
            "short_cdr3_ratio": fraction(F.col("_len") <= 12),
            "long_cdr3_ratio": fraction(F.col("_len") >= 16),
            "aromatic_freq": F.avg("_arom"),
            "charge_skewness": F.avg("_cskew"),
            "charge_kurtosis": F.avg("_ckurt"),
            "_hyd_g1": F.skewness("_hydro"),
            "_hyd_g2": F.kurtosis("_hydro"),
            "nterm_serine": fraction(head.contains("S")),
            "nterm_glycine": fraction(head.contains("G")),
            "nterm_arginine": fraction(head.contains("R")),
            "nterm_aspartate": fraction(head.contains("D")),
            "mid_hydrophobic": F.avg(
                reduce(lambda a, b: a + b,
                       [mid.contains(r).cast("int") for r in MID_RESIDUES]).cast("double")
            ),
        },
        {
            "cdr3_len_skew": Q.adjusted_skew(n, F.col("_len_g1")),
            "cdr3_len_kurt": Q.adjusted_kurtosis(n, F.col("_len_g2"), compat),
            "hydro_skewness": Q.adjusted_skew(n, F.col("_hyd_g1")),
            "hydro_kurtosis": Q.adjusted_kurtosis(n, F.col("_hyd_g2"), compat),
        },
    )


def moment_rows(compat: bool = False) -> RowModule:
    n = F.col("_count_n")
    return RowModule(
        {"_log_count": F.log10(F.col("count") + 1)},
        {
            "_count_n": F.count("_log_count").cast("double"),
            "_count_g1": F.skewness("_log_count"),
            "_count_g2": F.kurtosis("_log_count"),
        },
        {
            "count_skewness": Q.adjusted_skew(n, F.col("_count_g1")),
            "count_kurtosis": Q.adjusted_kurtosis(n, F.col("_count_g2"), compat),
        },
    )


def shm_rows(any_heavy: Column) -> RowModule:
    return RowModule(
        {"_len": F.length("cdr3_aa")},
        {
            "_shm_len": F.avg("_len"),
            "_shm_rows": F.count(F.lit(1)),
            "_any_heavy": F.max(F.lit(any_heavy)),
        },
        {"shm_mean_len": F.when(F.col("_any_heavy"), F.col("_shm_len"))},
    )


def described(sequences: DataFrame) -> DataFrame:
    """A table of sequences with the columns that lengths and selection derive from each.

    Row modules take such a column where clones have it, so that a sequence found in many clones
    is worked out once, before clones are joined to it.
    """
    derived = {**length_rows().derived, **selection_rows().derived}
    return sequences.select("*", *[c.alias(name) for name, c in derived.items()])


def aggregate_rows(clones: DataFrame, modules: Sequence[RowModule], key="sample_id") -> DataFrame:
    """Evaluate several row modules in a single aggregation."""
    derived, aggregates, final = {}, {}, {}
    for module in modules:
        derived.update({name: c for name, c in module.derived.items() if name not in clones.columns})
        aggregates.update(module.aggregates)
        final.update(module.final)
    rows = clones.select("*", *[c.alias(name) for name, c in derived.items()])
    out = rows.groupBy(key).agg(*[c.alias(name) for name, c in aggregates.items()])
    plain = [name for name in aggregates if not name.startswith("_")]
    hidden = [name for name in aggregates if name in ("_shm_rows", "_any_heavy")]
    return out.select(key, *plain, *hidden, *[c.alias(name) for name, c in final.items()])


# ---- gene grain -----------------------------------------------------------------


def gene_table(clones: DataFrame, weight: str | None = None) -> DataFrame:
    """(sample_id, v_gene, j_gene, mass): bounded per sample by the gene vocabularies."""
    if weight is None and "duplicate_count" in clones.columns:
        weight = "duplicate_count"
    mass = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    return clones.groupBy("sample_id", "v_gene", "j_gene").agg(mass.cast("double").alias("mass"))


def gene_statistics(clones: DataFrame, weight: str | None = None) -> DataFrame:
    """Entropy, Simpson and counts of V, J and V-J mass, and the usage divergences.

    One grouping-sets pass over the gene table yields all three marginals.
    """
    table = gene_table(clones, weight)
    sets = table.groupingSets(
        [
            [F.col("sample_id"), F.col("v_gene"), F.col("j_gene")],
            [F.col("sample_id"), F.col("v_gene")],
            [F.col("sample_id"), F.col("j_gene")],
        ],
        "sample_id", "v_gene", "j_gene",
    ).agg(F.sum("mass").alias("mass"), F.grouping_id().alias("level"))
    # grouping_id bits: sample, v, j; a set bit marks a column that was aggregated away
    levels = {"pair": 0, "v": 1, "j": 2}
    mass = F.col("mass")

    def over(level: str, value: Column) -> Column:
        return F.when(F.col("level") == levels[level], value)

    parts = []
    for level in levels:
        parts += [
            F.count(over(level, mass)).cast("double").alias(f"_{level}_n"),
            F.sum(over(level, mass)).alias(f"_{level}_w"),
            F.sum(over(level, F.when(mass > 0, mass * F.ln(mass)).otherwise(0.0))).alias(
                f"_{level}_wlnw"
            ),
            F.sum(over(level, mass * mass)).alias(f"_{level}_ww"),
            F.max(over(level, mass)).alias(f"_{level}_top"),
        ]
    per = sets.groupBy("sample_id").agg(*parts)

    def entropy(level: str) -> Column:
        w = F.col(f"_{level}_w")
        return F.ln(w) - F.try_divide(F.col(f"_{level}_wlnw"), w)

    def simpson(level: str) -> Column:
        w = F.col(f"_{level}_w")
        return 1 - F.try_divide(F.col(f"_{level}_ww"), w * w)

    pairs, n_v, n_j = F.col("_pair_n"), F.col("_v_n"), F.col("_j_n")
    return per.select(
        "sample_id",
        pairs.cast("long").alias("vj_n_unique_pairs"),
        entropy("pair").alias("vj_pair_entropy"),
        simpson("pair").alias("vj_pair_simpson"),
        F.try_divide(F.col("_pair_top"), F.col("_pair_w")).alias("vj_max_pair_frac"),
        entropy("v").alias("vj_v_entropy"),
        simpson("v").alias("vj_v_simpson"),
        entropy("j").alias("vj_j_entropy"),
        simpson("j").alias("vj_j_simpson"),
        n_v.cast("long").alias("vj_n_v_genes"),
        n_j.cast("long").alias("vj_n_j_genes"),
        (pairs / (n_v * n_j)).alias("vj_pair_ratio"),
        (F.ln(n_v) - entropy("v")).alias("v_usage_kl"),
        (F.ln(n_j) - entropy("j")).alias("j_usage_kl"),
        pairs.cast("long").alias("n_unique_vj_pairs"),
    )


def pairing_statistics(clones: DataFrame) -> DataFrame:
    """Entropy and number of pair ids, when both light- and heavy-type chains occur."""
    both = clones.agg(
        (
            F.max(F.col("chain").isin(S.LIGHT_CHAINS)) & F.max(F.col("chain").isin(S.HEAVY_CHAINS))
        )
    ).scalar()
    ids = clones.groupBy("sample_id", "pair_id").agg(F.count(F.lit(1)).cast("double").alias("m"))
    # the flag enters the aggregation once instead of every output column
    m = F.when(F.col("pair_id").isNotNull(), F.col("m"))
    per = ids.groupBy("sample_id").agg(
        F.count(m).alias("_n"), F.sum(m).alias("_w"), F.sum(m * F.ln(m)).alias("_wlnw"),
        F.max(F.lit(both)).alias("_both"),
    )
    both = F.col("_both")
    return per.select(
        "sample_id",
        F.when(both, F.ln("_w") - F.try_divide(F.col("_wlnw"), F.col("_w"))).alias("pairing_diversity"),
        F.when(both, F.col("_n")).alias("pairing_n"),
    )


# ---- assembly ---------------------------------------------------------------------


def compute_features(
    clones: DataFrame,
    meta: DataFrame,
    modules: Sequence[str] = tuple(BASIC_MODULES),
    *,
    healthy_label: str = "healthy",
    public_ref: Sequence[str] | None = None,
    motifs: Sequence[str] | None = None,
    v_genes: Sequence[str] | None = None,
    j_genes: Sequence[str] | None = None,
    k: int = 3,
    compat: bool = False,
    fill: bool = True,
) -> DataFrame:
    """Sample x feature table in ``meta``'s samples; missing and infinite values become 0."""
    unknown = [m for m in modules if m not in MODULES]
    if unknown:
        raise ValueError(f"unknown feature modules: {', '.join(unknown)}")
    wanted = [c for m in modules for c in MODULES[m]]
    chosen = set(modules)
    if "group" not in clones.columns:
        clones = clones.join(meta.select("sample_id", "group"), "sample_id", "left")

    any_heavy = None
    rows: list[RowModule] = []
    if "motif" in chosen:
        rows.append(public_rows(public_ref))
    if "diversity" in chosen:
        rows.append(length_rows())
    if "selection" in chosen:
        rows.append(selection_rows())
    if "shm" in chosen:
        any_heavy = clones.agg(F.max(F.col("v_gene").startswith("IGH"))).scalar()
        rows.append(shm_rows(any_heavy))
    if "motif_enrichment" in chosen:
        rows.append(motif_rows(motifs))
    if "gene_usage" in chosen:
        rows.append(gene_rows(v_genes, j_genes))
    if "expansion" in chosen:
        rows.append(moment_rows(compat))
    if "physicochemical" in chosen:
        rows.append(physchem_rows(compat))

    frames: list[DataFrame] = []
    if rows:
        frames.append(aggregate_rows(clones, rows))
    if chosen & {"diversity", "convergence", "expansion"}:
        counted = spectrum.spectrum_statistics(spectrum.count_spectrum(clones)).drop("n", "reads")
        frames.append(counted)
    if chosen & {"selection", "gene_usage", "vj_pairing"}:
        frames.append(gene_statistics(clones))
    if chosen & {"convergence", "sharing", "shm"}:
        frames.append(sharing.sharing_statistics(clones))
    if "pairing" in chosen:
        if "pair_id" in clones.columns:
            frames.append(pairing_statistics(clones))
        else:
            frames.append(
                clones.select("sample_id").distinct().select(
                    "sample_id",
                    F.lit(None).cast("double").alias("pairing_diversity"),
                    F.lit(None).cast("long").alias("pairing_n"),
                )
            )
    if "motif" in chosen:
        from clonoframe.operators.reduction import kmer_component

        frames.append(kmer_component(clones, k))

    base = meta.select("sample_id", "group")
    for frame in frames:
        base = base.join(frame, "sample_id", "left")
    if "shm" in chosen:
        base = base.withColumn(
            "shm_diversity", F.when(F.col("_any_heavy"), F.col("n_distinct") / F.col("_shm_rows"))
        )
    if "convergence" in chosen:
        base = with_collapse(base, meta.join(counted, "sample_id", "left"), healthy_label)
    out = base.select("sample_id", "group", *wanted)
    return fill_missing(out, wanted) if fill else out


def with_collapse(features: DataFrame, entropies: DataFrame, healthy_label: str) -> DataFrame:
    """Mean Shannon entropy of the healthy samples minus the sample's own.

    The mean is taken over ``entropies`` (group, shannon), which no other module is needed for.
    """
    baseline = entropies.agg(
        F.avg(F.when(F.col("group") == healthy_label, F.col("shannon")))
    ).scalar()
    return features.withColumn("diversity_collapse", baseline - F.col("shannon"))


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and infinite values become 0."""

    def clean(name: str) -> Column:
        c = F.col(name).cast("double")
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, 0.0).otherwise(c).alias(name)

    keep = [F.col(c) for c in df.columns if c not in set(columns)]
    return df.select(*keep, *[clean(c) for c in columns])


def drop_constant(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose standard deviation over the rows is not zero."""
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > 0]


def resolve_columns(name: str, columns: Sequence[str]) -> list[str]:
    """Columns meant by a module name, an exact name (module prefix allowed) or a pattern."""
    import re

    if name in MODULES:
        return [c for c in MODULES[name] if c in columns]
    module, _, plain = name.partition(".")
    for candidate in (name, plain if module in MODULES else name):
        if candidate in columns:
            return [candidate]
    found = [c for c in columns if re.search(name, c)]
    if len(found) == 1:
        return found
    if found:
        raise ValueError(f"'{name}' matches several columns: {', '.join(found)}")
    raise ValueError(f"no column matches '{name}'")


def multi_chain_features(
    clones: DataFrame, chains: Sequence[str], modules: Sequence[str], **options
) -> DataFrame:
    """Features per chain, columns prefixed by the chain, full outer join on the sample."""
    from clonoframe.schema import sample_meta

    merged = None
    for chain in chains:
        part = clones.filter(F.col("chain") == chain)
        meta = sample_meta(part)
        feats = compute_features(part, meta, modules, **options).drop("group")
        feats = feats.withColumnsRenamed(
            {c: f"{chain}_{c}" for c in feats.columns if c != "sample_id"}
        )
        merged = feats if merged is None else merged.join(feats, "sample_id", "full_outer")
    return fill_missing(merged, [c for c in merged.columns if c != "sample_id"])


def public_hit_rate(clones: DataFrame, public: DataFrame) -> DataFrame:
    """Share of a sample's rows whose sequence is in a public list given as a table."""
    listed = public.select("cdr3_aa").distinct().withColumn("_hit", F.lit(1.0))
    return (
        clones.groupBy("sample_id", "cdr3_aa").agg(F.count(F.lit(1)).alias("m"))
        .join(listed, "cdr3_aa", "left")
        .groupBy("sample_id")
        .agg((F.sum(F.coalesce("_hit", F.lit(0.0)) * F.col("m")) / F.sum("m")).alias("public_hit_rate"))
    )
