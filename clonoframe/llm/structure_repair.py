"""Conversation structure repair with a suffix-shared automaton.

Wanted are role initials ``(s?(ua)+)?``. Each turn becomes one symbol: its role initial, with its
first fault (``blank``: no visible character; ``duplicate``: role and text seen earlier in the
conversation; ``truncated``: the last visible character ends no sentence). Edits: Keep (0), Rerole
to user or assistant (3), Delete (4, a must for blank and duplicate turns), Insert an empty turn
of user or assistant (3); a truncated turn not deleted adds 3.

* The symbols of a conversation are its signature; conversations of one signature are repaired
  alike, so only distinct signatures go on.
* Distinct signatures are sorted by their reverse, over ranges. Neighbours then share the longest
  suffixes, and the automaton is built from the end: a node is a distinct suffix, a stack holds
  the nodes of the current signature, and a signature only adds the nodes in front of the suffix
  it shares with its predecessor (a task's first signature adds its whole path). Each node gets,
  once, the cost-to-go and the best first edit for every grammar state. Nodes of equal relative
  costs share one table of edits, so the work per node is a lookup.
* The best audit of a node and state is its best edit followed by the best audit of the node and
  state that edit leads to. Edits of one state have different initials and one target each, so
  among edits of equal cost the least initial gives the ASCII-least audit.

Turns are shuffled by conversation and read in order, so a conversation is never held: one symbol
a turn, and 16 bytes a distinct turn to know duplicates. Its repair is sequential and stays in
one task, however long it is.

Defined cases: a null role or text is one space; a null turn number comes first and does not
count for gaps; turns of equal number are ordered by role, then text; a null conv_id is one
conversation; repeated rows are duplicate turns; an empty role has no initial; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.shared import NO_ID, freed_id, held_id, shuffle_partitions, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads; its role is the one the state calls for.
CALLED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn leads, by its initial and the state before.
KEPT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "x": {},
}
#: At the end a conversation is empty or ends with an assistant; else turns are inserted.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))
MUST_GO = "d"  # symbol of a blank or duplicate turn; a truncated one has its initial in capitals
FAULTS = ("blank", "duplicate", "truncated")


def node(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost-to-go and best edit of each grammar state before a symbol, from those after it."""
    options: list[dict[str, int]] = [{"D": DELETE + after[q]} for q in range(4)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        for q in range(4):
            options[q]["R"] = REROLE + extra + after[CALLED[q]]
        for q, to in KEPT[symbol.lower()].items():
            options[q]["K"] = KEEP + extra + after[to]
    cost = [min(o.values()) for o in options]
    for _ in range(3):  # an insertion leads to another state before the same symbol
        cost = [min(c, INSERT + cost[CALLED[q]]) for q, c in enumerate(cost)]
    for q in range(4):
        options[q]["I"] = INSERT + cost[CALLED[q]]
    best = (min(e for e, c in o.items() if c == cost[q]) for q, o in enumerate(options))
    return tuple(cost), tuple(best)


class Automaton:
    """The nodes of one signature's suffixes, from its end; a next signature reuses the shared ones."""

    def __init__(self) -> None:
        self.signature = ""
        self.tables: dict[tuple, tuple] = {}  # symbol, relative costs -> relative costs, gain, edits
        self.costs: list[tuple[int, ...]] = [END[0]]  # relative to ``base``
        self.base: list[int] = [0]
        self.edits: list[tuple[str, ...]] = [END[1]]

    def push(self, signature: str) -> int:
        """Make the signature current; the number of nodes it adds."""
        backward, held = signature[::-1], self.signature
        shared, most = 0, min(len(backward), len(held))
        while shared < most and backward[shared] == held[shared]:
            shared += 1
        for part in (self.costs, self.base, self.edits):
            del part[shared + 1 :]
        for symbol in backward[shared:]:
            key = (symbol, self.costs[-1])
            found = self.tables.get(key)
            if found is None:
                cost, edits = node(*key)
                least = min(cost)
                found = self.tables[key] = tuple(c - least for c in cost), least, edits
            self.costs.append(found[0])
            self.base.append(self.base[-1] + found[1])
            self.edits.append(found[2])
        self.signature = backward
        return len(backward) - shared

    def best(self) -> tuple[int, str]:
        """Cost and audit of the current signature."""
        state, depth, audit = START, len(self.signature), []
        while True:
            edit = self.edits[depth][state]
            if not edit:
                return self.base[-1] + self.costs[-1][START], "".join(audit)
            audit.append(edit)
            if edit == "K":
                state = KEPT[self.signature[depth - 1].lower()][state]
            elif edit != "D":
                state = CALLED[state]
            depth -= edit != "I"


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = Automaton()
    for batch in batches:
        rows = []
        for signature in batch["signature"]:
            added = automaton.push(signature)
            rows.append((signature, *automaton.best(), added))
        yield pd.DataFrame(rows, columns=["signature", "cost", "audit", "n_nodes"])


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, n_nodes: nodes it added to its task's automaton) of distinct signatures."""
    parts = shuffle_partitions(signatures.sparkSession)
    backward = F.reverse("signature")
    rows = signatures.select("signature").distinct()
    rows = rows.repartitionByRange(parts, backward).sortWithinPartitions(backward)
    return rows.mapInPandas(_solve, "signature string, cost long, audit string, n_nodes long")


def turns_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls; a null id or number is held as a long."""
    return turns.select(
        held_id("conv_id").alias("conv_id"), held_id("turn").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", *order)


STRUCTURE = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " signature string"
)
FLUSH = 4096  # rows a task passes on at once


class _Reading:
    """What is known of the conversation being read."""

    def __init__(self, conv_id: int) -> None:
        self.conv_id, self.symbols, self.seen = conv_id, [], set()
        self.first = self.last = None
        self.n_turns = self.illegal = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.before: str | None = None

    def add(self, turn: int, role: str, text: str) -> None:
        if turn != NO_ID and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.n_turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        shown = text.rstrip(_BLANKS)
        known = hashlib.blake2b(digest_size=16)
        known.update(f"{len(role)}:".encode())
        known.update((role + text).encode("utf-8", "surrogatepass"))
        key = known.digest()
        symbol = initial if initial in ("s", "u", "a") else "x"
        if not shown:
            fault, symbol = "blank", MUST_GO
        elif key in self.seen:
            fault, symbol = "duplicate", MUST_GO
        elif shown[-1] not in ".!?":
            fault, symbol = "truncated", symbol.upper()
        else:
            fault = None
        self.seen.add(key)
        self.symbols.append(symbol)
        if fault:
            self.faults[fault] += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        return self.conv_id, gaps, *self.faults.values(), self.illegal, "".join(self.symbols)


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in columns), strict=True)


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        now: _Reading | None = None
        for conv_id, turn, role, text in _rows(batches, ["conv_id", "turn", "role", "text"]):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now.row()
                now = _Reading(conv_id)
            now.add(turn, role, text)
        if now is not None:
            yield now.row()

    return _framed(rows(), _names(STRUCTURE))


def structures(turns: DataFrame) -> DataFrame:
    """Per conversation its faults, illegal neighbours, gaps and signature; a null id is held."""
    return _in_order(turns_of(turns), "turn", "role", "text").mapInPandas(_read, STRUCTURE)


REPAIRED = "conv_id long, position long, role string, text string, edit string"


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        conv_id, audit, at, state, position = None, "", 0, START, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                state, at = CALLED[state], at + 1
                yield conv_id, position, ROLE[state], "", "I"
                position += 1

        for new_id, is_turn, role, text in _rows(batches, ["conv_id", "is_turn", "role", "text"]):
            if not is_turn:  # the audit comes before the turns of its conversation
                yield from inserted()
                conv_id, audit, at, state, position = new_id, text, 0, START, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = CALLED[state]
                role = ROLE[state]
            else:
                state = KEPT[role[:1]][state]
            yield conv_id, position, role, text, edit
            position += 1
        yield from inserted()

    return _framed(rows(), _names(REPAIRED))


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns after repair, each conversation's rows in order within one task.

    ``audits`` are (conv_id, audit), ids held as in ``structures``.
    """
    texts = turns_of(turns).select("conv_id", F.lit(1).alias("is_turn"), "turn", "role", "text")
    first = audits.select(
        "conv_id", F.lit(0).alias("is_turn"), F.lit(NO_ID).alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"),
    )
    return _in_order(first.unionAll(texts), "is_turn", "turn", "role", "text").mapInPandas(_apply, REPAIRED)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        held, sha = None, hashlib.sha256()
        for conv_id, role, text in _rows(batches, ["conv_id", "role", "text"]):
            if conv_id != held:
                if held is not None:
                    yield held, sha.hexdigest()
                held, sha = conv_id, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if held is not None:
            yield held, sha.hexdigest()

    return _framed(rows(), ["conv_id", "repaired_sha256"])


def digests(repaired_turns: DataFrame) -> DataFrame:
    """(conv_id, sha256 of the role:text lines) of the rows of ``repaired``, as it leaves them."""
    return repaired_turns.mapInPandas(_digest, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation its structure, cost and audit; and the turns after repair.

    Ids are held (``freed``); the first table is staged, as both results read it.
    """
    found = staged(structures(turns))
    plans = staged(solved(found))
    cases = found.join(plans.select("signature", "cost", "audit"), "signature")
    return cases, repaired(turns, cases.select("conv_id", "audit"))


def freed(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", freed_id("conv_id"))


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put in by the crc32 of ``conv_id:turn``, five kinds in one of twenty turns each."""

    def spoken(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    rows = turns.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
