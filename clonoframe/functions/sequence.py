"""Per-sequence properties as built-in column expressions.

Residues are counted by deleting their letters and comparing lengths, and weighted by one
array lookup per residue; both keep generated code small. Charge is kept in halves and hydropathy in tenths until the last division, so every property is a ratio
of integers and does not depend on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe import schema as S


def col(seq: str | Column) -> Column:
    return F.col(seq) if isinstance(seq, str) else seq


def residue_count(seq: str | Column, residues: str) -> Column:
    seq = col(seq)
    rest = seq
    for residue in residues:
        rest = F.replace(rest, F.lit(residue), F.lit(""))
    return F.length(seq) - F.length(rest)


def weighted_residues(seq: str | Column, weights: dict[str, int]) -> Column:
    """Integer sum of residue weights, by a letter-indexed array; other characters weigh 0."""
    table = F.expr(f"array({', '.join(str(weights.get(chr(65 + i), 0)) for i in range(26))})")
    return F.aggregate(
        F.split(col(seq), ""),
        F.lit(0),
        lambda total, residue: total
        + F.coalesce(F.get(table, F.ascii(residue) - 65), F.lit(0)),
    )


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def net_charge(seq: str | Column) -> Column:
    halves = (
        2 * residue_count(seq, "KR") + residue_count(seq, "H") - 2 * residue_count(seq, "DE")
    )
    return halves.cast("double") / 2


def charge_per_residue(seq: str | Column) -> Column:
    return net_charge(seq) / F.greatest(F.lit(1), F.length(col(seq)))


def hydropathy(seq: str | Column, unknown_as_zero: bool = False) -> Column:
    """Mean hydropathy over the known residues, or over all with unknown ones as zero."""
    tenths = weighted_residues(seq, {r: round(10 * h) for r, h in S.HYDROPATHY.items()})
    known = F.length(F.regexp_replace(col(seq), f"[^{S.RESIDUES}]", ""))
    n = F.length(col(seq)) if unknown_as_zero else known
    return share(tenths, n * 10)


def aromatic_fraction(seq: str | Column) -> Column:
    return share(residue_count(seq, S.AROMATIC), F.length(col(seq)))


def standard_only(seq: str | Column, min_len: int = 1) -> Column:
    return col(seq).rlike(f"^[{S.RESIDUES}]{{{min_len},}}$")


def insertion_proxy(seq: str | Column) -> Column:
    return F.greatest(F.lit(0), F.length(col(seq)) - 10)


def property_columns(seq: str | Column = "cdr3_aa") -> dict[str, Column]:
    """The nine per-sequence classifier features."""
    charge = net_charge(seq)
    return {
        "seq_len": F.length(col(seq)),
        "seq_charge": charge,
        "seq_charge_per_aa": charge_per_residue(seq),
        "seq_hydro": hydropathy(seq, unknown_as_zero=True),
        "seq_arom": aromatic_fraction(seq),
        "seq_n_aromatic": residue_count(seq, S.AROMATIC),
        "seq_n_positive": residue_count(seq, "KRH"),
        "seq_n_negative": residue_count(seq, "DE"),
        "seq_net_charge": charge,
    }


def profile_columns(seq: str | Column = "cdr3_aa") -> dict[str, Column]:
    """The physico-chemical profile used to compare prototype sequence sets."""
    n = F.length(col(seq))
    charge = residue_count(seq, S.PROFILE_POSITIVE) - residue_count(seq, S.PROFILE_NEGATIVE)
    extra = {r: w - S.UNKNOWN_RESIDUE_WEIGHT for r, w in S.RESIDUE_WEIGHT.items()}
    mass = weighted_residues(seq, extra) + S.UNKNOWN_RESIDUE_WEIGHT * n
    return {
        "length": n,
        "charge": charge,
        "charge_density": share(charge, n),
        "hydrophobicity": share(residue_count(seq, S.PROFILE_HYDROPHOBIC), n),
        "aromaticity": share(residue_count(seq, S.PROFILE_AROMATIC), n),
        "avg_mw": share(mass, n),
        "glycine": share(residue_count(seq, "G"), n),
        "proline": share(residue_count(seq, "P"), n),
        "cysteine": share(residue_count(seq, "C"), n),
    }


def map_columns(seq: str | Column = "sequence") -> dict[str, Column]:
    """Length, charge, hydropathy and aromatic share as stored with a sequence map."""
    return {
        "length": F.length(col(seq)),
        "net_charge": net_charge(seq),
        "hydrophobicity": F.round(hydropathy(seq, unknown_as_zero=True), 3),
        "aromatic_frac": F.round(aromatic_fraction(seq), 3),
    }




def domain_classes(
    length: Column, charge: Column, hydro: Column, aromatic: Column
) -> dict[str, Column]:
    """Four three-way classes. Thresholds are fixed values."""
    return {
        "length_class": F.when(length <= 12, "Short").when(length <= 16, "Medium").otherwise("Long"),
        "charge_class": F.when(charge <= -1, "Negative")
        .when(charge <= 1, "Neutral")
        .otherwise("Positive"),
        "hydro_class": F.when(hydro < -0.5, "Hydrophilic")
        .when(hydro < 0.3, "Neutral")
        .otherwise("Hydrophobic"),
        "aromatic_class": F.when(aromatic < 0.10, "Low")
        .when(aromatic < 0.20, "Medium")
        .otherwise("High"),
    }


def kmers(seq: str | Column, k: int) -> Column:
    """Array of all overlapping substrings of length k; empty when the sequence is shorter."""
    seq = col(seq)
    starts = F.sequence(F.lit(1), F.length(seq) - k + 1)
    parts = F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, parts).otherwise(F.array().cast("array<string>"))


def explode_kmers(df: DataFrame, k: int, *keep: str, seq: str = "cdr3_aa", name: str = "kmer"):
    """One row per k-mer occurrence; generated and cut inside code generation."""
    starts = F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("_at")
    long_enough = df.filter(F.length(seq) >= k)
    return long_enough.select(*keep, seq, starts).select(
        *keep, F.substring(F.col(seq), F.col("_at"), F.lit(k)).alias(name)
    )


def motif_hits(seq: str | Column, motifs: list[str]) -> Column:
    """Number of listed motifs that occur in the sequence."""
    total = F.lit(0)
    for motif in motifs:
        total = total + col(seq).contains(motif).cast("int")
    return total


def n_terminal(seq: str | Column, n: int = 3) -> Column:
    return F.substring(col(seq), F.lit(2), F.lit(n))


def c_terminal(seq: str | Column, n: int = 3) -> Column:
    size = F.length(col(seq))
    return F.when(size >= n + 4, F.substring(col(seq), size - n - 3, F.lit(n))).otherwise("")


def central(seq: str | Column, n: int = 3) -> Column:
    size = F.length(col(seq))
    first = F.floor(size / 2).cast("int") - n // 2
    last = first + n - 1
    begin = F.greatest(F.lit(1), first)
    return F.when(size >= n, F.substring(col(seq), begin, last - begin + 1)).otherwise("")


def charge_moments(seq: str | Column) -> tuple[Column, Column]:
    """Bias-adjusted skewness and excess kurtosis of the residue charges of one sequence.

    Charges take four values, so the central moments follow from four counts.
    """
    n = F.length(col(seq)).cast("double")
    counts = [
        (1.0, residue_count(seq, "KR").cast("double")),
        (0.5, residue_count(seq, "H").cast("double")),
        (-1.0, residue_count(seq, "DE").cast("double")),
    ]
    neutral = n - counts[0][1] - counts[1][1] - counts[2][1]
    mean = F.try_divide(net_charge(seq), n)
    values = [*counts, (0.0, neutral)]

    def central_moment(power: int) -> Column:
        total = F.lit(0.0)
        for value, count in values:
            gap, term = F.lit(value) - mean, count
            for _ in range(power):
                term = term * gap
            total = total + term
        return F.try_divide(total, n)

    m2, m3, m4 = central_moment(2), central_moment(3), central_moment(4)
    flat = m2 <= 1e-15
    skew = F.when((n >= 3) & ~flat, adjusted_skew(n, F.try_divide(m3, F.pow(m2, F.lit(1.5)))))
    kurt = F.when((n >= 4) & ~flat, adjusted_kurtosis(n, F.try_divide(m4, m2 * m2) - 3))
    return skew, kurt


def adjusted_skew(n: Column, g1: Column) -> Column:
    return F.when(n >= 3, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1)


def adjusted_kurtosis(n: Column, g2: Column, compat: bool = False) -> Column:
    """Unbiased excess kurtosis; ``compat`` gives the historically coded scaling instead."""
    if compat:
        lead = F.try_divide(n * (n + 1), (n - 1) * (n - 2) * (n - 3))
        value = lead * (g2 + 3) - F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
    else:
        value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, value)


def normalized_gene(gene: str | Column) -> Column:
    """Drop the allele suffix, trim, and shorten a leading ``TCR`` to ``TR``."""
    gene = col(gene)
    base = F.trim(F.split_part(gene, F.lit("*"), F.lit(1)))
    return F.when(gene.isNull() | (gene == "?"), "?").otherwise(
        F.regexp_replace(base, "^TCR", "TR")
    )


def gene_family(gene: str | Column) -> Column:
    return F.split_part(col(gene), F.lit("-"), F.lit(1))
