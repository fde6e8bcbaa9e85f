"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one bit
per failed rule; policies are named, versioned sets of rules, so a changed policy or an
ablation reads the ledger again and never the texts.

Main path: one scan, no shuffle, built-in functions only. Repeated word windows are found
inside the row: word hashes, window hashes with the window's position in the low bits, a
primitive sort, and a look at the neighbours.

Defined cases: null text counts as no words; an empty text fails ``few_words``; repeated rows
give repeated ledger rows; columns of the input with the names of ledger columns are replaced;
an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.shared import SPACES, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; ``fails`` is SQL over the measurements."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """Documents pass if they fail none of ``required`` and at most ``spare`` of ``advisory``."""

    version: str
    required: tuple[str, ...]
    advisory: tuple[str, ...] = ()
    spare: int = 0


#: Rule order fixes the bits: append, never reorder.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("some_symbols", "10 * n_symbols > n_words"),
    Rule("some_duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("some_repeated_windows", "100 * n_repeat_words > 30 * n_words"),
)
BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        BASE,
        Policy(
            "prose-1",
            ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words",
             "long_words"),
            ("some_symbols", "some_duplicate_lines", "some_repeated_windows"),
            spare=1,
        ),
    )
}
DEFAULT_POLICY = "prose-1"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text to its row.

    A window is packed as (hash << bits) | position, bits being just enough for the number of
    words, so one ascending sort of longs brings equal windows together in text order. In very
    long texts few hash bits are left, so the windows found are compared word by word after that.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(body, SPACES, "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    keep = [c for c in docs.columns if c not in MEASURES]
    hashed = docs.select(
        *keep,
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words(F.col(text)).alias("_words"),
    )
    sized = hashed.select(
        *keep, "word_chars", "n_symbols", "_words",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.bin(F.size("_words"))).alias("_bits"),
    )
    plain = [*keep, "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "_bits", "_words"]
    packed = sized.select(
        *plain,
        F.expr(
            "transform(_h, (h, i) -> shiftleft(xxhash64(h, get(_h, i + 1), get(_h, i + 2)), _bits)"
            " | i)"
        ).alias("_w"),
    )
    # the last two entries are no windows: they lack a second or third word
    ordered = packed.select(
        *plain, F.expr("sort_array(slice(_w, 1, greatest(size(_w) - 2, 0)))").alias("_w")
    )
    alike = ordered.select(
        *plain,
        F.expr(
            "sort_array(transform(filter(_w, (x, i) ->"
            " shiftright(x ^ get(_w, i + 1), _bits) = 0 or shiftright(x ^ get(_w, i - 1), _bits) = 0),"
            " x -> struct(array_join(slice(_words, cast(x & (shiftleft(1L, _bits) - 1) as int) + 1, 3), ' ') as w,"
            "  cast(x & (shiftleft(1L, _bits) - 1) as int) as at)))"
        ).alias("_w"),
    )
    repeated = alike.select(
        *plain,
        F.expr(
            "sort_array(transform(filter(_w, (x, i) -> x.w = get(_w, i + 1).w or x.w = get(_w, i - 1).w),"
            " x -> x.at))"
        ).alias("_at"),
    )
    # each repeated window covers three words, less what the one before it covers
    covered = F.expr(
        "aggregate(_at, struct(-3 as last, 0L as n),"
        " (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n)"
    )
    return repeated.withColumn("n_repeat_words", covered).select(*keep, *MEASURES)


def bits(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Mask of the named rules."""
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``failed_bits``, each rule evaluated once.

    A rule whose test is null (it cannot be: measurements are never null) counts as passed.
    """
    if len(rules) > 63:
        raise ValueError("a ledger row holds at most 63 rules")
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        hit = F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0))
        failed = failed.bitwiseOR(hit.cast("long"))
    return measured(docs, text).withColumn("failed_bits", failed)


def passes(policy: Policy, rules: Sequence[Rule] = RULES, without: str | None = None) -> Column:
    """The policy's verdict on ``failed_bits``, optionally with one rule left out."""
    required = bits([n for n in policy.required if n != without], rules)
    advisory = bits([n for n in policy.advisory if n != without], rules)
    failed = F.col("failed_bits")
    return (failed.bitwiseAND(F.lit(required)) == 0) & (
        F.bit_count(failed.bitwiseAND(F.lit(advisory))) <= policy.spare
    )


def verdicts(rows: DataFrame, policies: Mapping[str, Policy] = POLICIES) -> DataFrame:
    """One boolean column ``kept_<version>`` per policy, from the ledger alone."""
    return rows.withColumns(
        {f"kept_{v.replace('-', '_')}": passes(p) for v, p in policies.items()}
    )


def ablation(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, and documents only it rejects.

    The ledger is first counted by failure pattern, which is partial-aggregated before the
    shuffle and leaves at most 2^rules rows; the rules are then compared on patterns.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("docs"))
    sums = []
    for name in (*policy.required, *policy.advisory):
        bit = F.lit(bits([name], rules))
        fails = F.col("failed_bits").bitwiseAND(bit) != 0
        gained = ~passes(policy, rules) & passes(policy, rules, without=name)
        sums.append(
            F.struct(
                F.lit(policy.version).alias("policy"),
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(fails, F.col("docs"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum(F.when(gained, F.col("docs"))), F.lit(0)).alias("only_this"),
            )
        )
    return patterns.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def filtered(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Documents the policy keeps, with their columns as they came.

    The row number, which Spark must not evaluate elsewhere, keeps the filter above the ledger:
    pushed below, it would repeat the measuring expressions once per use.
    """
    held = docs.withColumns({f"_in_{m}": F.col(m) for m in MEASURES if m in docs.columns})
    marked = ledger(held).withColumn("_row", F.monotonically_increasing_id())
    back = [F.col(f"_in_{c}").alias(c) if c in MEASURES else F.col(c) for c in docs.columns]
    return marked.where(passes(POLICIES[policy]) & (F.col("_row") >= 0)).select(*back)
