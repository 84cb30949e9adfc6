"""Repair of conversations' structure at the least cost, by an automaton of shared endings.

A conversation is spelt by one letter per turn: who speaks, and whether the turn is sound, cut
short or has to go.  Conversations that end alike share the end of their spelling, so all
spellings form an automaton whose nodes are the distinct endings.  For each node and state of
the role grammar ``(s?(ua)+)?`` it holds the least cost of what is still to do and the first
edit of the ASCII-least way to do it; the edit leads on to another node and state, so that
an audit is read off along the automaton.

Spellings are sorted from their ends: neighbours then share the longest possible ending, and a
node is worked out when the first of them reaches it and left when the last has passed.  A task
holds the nodes of one spelling at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NO_WAY = 1 << 60
#: grammar states: nothing yet, and after a role's initial
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
#: which state the initials s, u and a lead to
FOLLOWS = {EMPTY: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: the role that is expected next, which rerole and insert supply
EXPECTED = {EMPTY: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: letters of spellings: a turn that must go, sound turns by initial, turns cut short by initial
MUST_GO, SOUND, CUT_SHORT = "-", {"s": "s", "u": "u", "a": "a", "": "x"}, {"s": "S", "u": "U", "a": "A", "": "X"}

#: by grammar state: least cost, first edit
Node = tuple[list[int], list[str]]


def last_node() -> Node:
    """Nothing is left to read: sound after an assistant or if nothing was said, else insert."""
    return close([0, NO_WAY, NO_WAY, 0], ["", "", "", ""])


def close(cost: list[int], edit: list[str]) -> Node:
    """Allow insertions before the edits given; of equal costs the ASCII-least edit stands."""
    changed = True
    while changed:
        changed = False
        for state in range(4):
            to = FOLLOWS[state][EXPECTED[state]]
            with_insert = cost[to] + INSERT_COST
            if with_insert < cost[state] or with_insert == cost[state] and INSERT < edit[state]:
                cost[state], edit[state], changed = with_insert, INSERT, True
    return cost, edit


def node_before(letter: str, after: Node) -> Node:
    """The node of an ending that is ``letter`` longer than that of ``after``."""
    costs, edits = [], []
    extra = TRUNCATED_COST if letter.isupper() else 0
    for state in range(4):
        ways = [(after[0][state] + DELETE_COST, DELETE)]
        if letter != MUST_GO:
            kept = FOLLOWS[state].get(letter.lower())
            if kept is not None:
                ways.append((after[0][kept] + extra, KEEP))
            ways.append((after[0][FOLLOWS[state][EXPECTED[state]]] + REROLE_COST + extra, REROLE))
        cost, edit = min(ways)
        costs.append(cost)
        edits.append(edit)
    return close(costs, edits)


def audit_of(spelling: str, nodes: list[Node]) -> tuple[int, str]:
    """Least cost and edits; ``nodes`` by how many turns their endings have."""
    left, state, edits = len(spelling), EMPTY, []
    cost = nodes[left][0][EMPTY]
    while edit := nodes[left][1][state]:
        edits.append(edit)
        if edit == KEEP:
            state = FOLLOWS[state][spelling[len(spelling) - left].lower()]
        elif edit != DELETE:
            state = FOLLOWS[state][EXPECTED[state]]
        left -= edit != INSERT
    return cost, "".join(edits)


AUDITS = pa.schema([("spelling", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def audits(spellings: DataFrame) -> DataFrame:
    """spelling, cost, audit of every distinct ``spelling``."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, before = [last_node()], ""
        for batch in batches:
            rows = []
            for backwards in batch.column(0).to_pylist():
                shared = 0
                for a, b in zip(before, backwards):
                    if a != b:
                        break
                    shared += 1
                del nodes[shared + 1:]
                for letter in backwards[shared:]:
                    nodes.append(node_before(letter, nodes[-1]))
                before = backwards
                spelling = backwards[::-1]
                cost, audit = audit_of(spelling, nodes)
                rows.append({"spelling": spelling, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(rows, AUDITS)

    backwards = spellings.select(F.reverse("spelling").alias("backwards")).distinct()
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(
        walk, "spelling string, cost long, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after damage: conv_id, turn, role, text; nulls of role and text are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text"),
        (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns with their first fault: blank, duplicate, truncated or none; and a ``digest`` of the text.

    A turn's duplicates are told by a window over its conversation, role and text, so that a
    long conversation is spread over its texts.
    """
    before = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    said = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(said == "", "blank").when(F.row_number().over(before) > 1, "duplicate").when(
        ~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    return turns.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.sha2("text", 256).alias("digest"),
                        F.row_number().over(before).alias("nth"))


def in_order(turns: DataFrame, *first: str) -> DataFrame:
    """Conversations one after the other, each in the order of its turns; turns of one number by
    role and text."""
    return turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", *first, F.asc_nulls_first("turn"), "role", "digest", "nth")


def letter_of(fault: Column, initial: Column) -> Column:
    by = lambda names: F.when(initial == "s", names["s"]).when(initial == "u", names["u"]).when(
        initial == "a", names["a"]).otherwise(names[""])
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", by(CUT_SHORT)).otherwise(by(SOUND))


SPELT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                   ("truncated", pa.int64()), ("illegal", pa.int64()), ("spelling", pa.string())])


def spelt(turns: DataFrame) -> DataFrame:
    """Each conversation's counts and spelling, a letter per turn, from its turns in order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, row, letters, last, numbers = None, None, [], None, (None, None, 0)

        def done() -> dict:
            low, high, distinct = numbers
            row["gaps"] = high - low + 1 - distinct if distinct else 0
            row["spelling"] = "".join(letters)
            return row

        for batch in batches:
            rows = []
            for conv_id, turn, initial, fault, letter in zip(*(c.to_pylist() for c in batch.columns)):
                if row is None or conv_id != current:
                    if row is not None:
                        rows.append(done())
                    current, letters, last, numbers = conv_id, [], None, (None, None, 0)
                    row = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                if fault != "none":
                    row[fault] += 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    row["illegal"] += 1
                last = initial
                letters.append(letter)
                low, high, distinct = numbers
                if turn is not None and turn != high:
                    numbers = turn if low is None else low, turn, distinct + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SPELT)
        if row is not None:
            yield pa.RecordBatch.from_pylist([done()], SPELT)

    initial = F.substring("role", 1, 1)
    return in_order(turns.select(
        "conv_id", "turn", "role", "digest", "nth", initial.alias("initial"), "fault",
        letter_of(F.col("fault"), initial).alias("letter"))).select(
            "conv_id", "turn", "initial", "fault", "letter").mapInArrow(
        read, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, spelling string")


def repaired_turns(turns: DataFrame, plans: DataFrame, hashed: bool) -> DataFrame:
    """What the audits make of the turns: conv_id, place, role, text; or ``hashed``, conv_id, repaired_sha256.

    Each conversation's plan (conv_id, audit) comes before its turns in one ordered stream, so
    that neither is repeated and a conversation is never held as a whole.
    """
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, place, made, state, number, digest, current = "", 0, 0, EMPTY, 0, hashlib.sha256(), None

        def say(role: str, text: str) -> dict:
            nonlocal number, made
            if hashed:
                digest.update((("\n" if number else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            number += 1
            return {"conv_id": current, "place": number - 1, "role": role, "text": text}

        def insert() -> Iterator[dict]:
            nonlocal place, state
            while place < len(edits) and edits[place] == INSERT:
                place += 1
                expected = EXPECTED[state]
                state = FOLLOWS[state][expected]
                yield say(NAMES[expected], "")

        def end() -> list[dict]:
            rest = list(insert())
            return [{"conv_id": current, "repaired_sha256": digest.hexdigest()}] if hashed else rest

        for batch in batches:
            rows = []
            for conv_id, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if made:
                        rows += end()
                    edits, place, made, state, number, current, digest = audit, 0, 1, EMPTY, 0, conv_id, hashlib.sha256()
                    continue
                before = list(insert())
                edit, place = edits[place], place + 1
                if edit != DELETE:
                    initial = role[:1] if edit == KEEP else EXPECTED[state]
                    before.append(say(role if edit == KEEP else NAMES[initial], text))
                    state = FOLLOWS[state][initial]
                if not hashed:
                    rows += before
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)
        if made:
            yield pa.RecordBatch.from_pylist(end(), shape)

    fields = [("conv_id", pa.int64())] + ([("repaired_sha256", pa.string())] if hashed else [
        ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    shape = pa.schema(fields)
    stream = turns.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "digest", "nth",
                          F.lit(None).cast("string").alias("audit")).unionByName(plans.select(
                              "conv_id", F.lit(0).alias("part"), "audit"), allowMissingColumns=True)
    return in_order(stream, "part").select("conv_id", "audit", "role", "text").mapInArrow(
        follow, "conv_id long, repaired_sha256 string" if hashed else "conv_id long, place long, role string, text string")


class Repair:
    """Faults, plans and repaired turns of all conversations.

    Turns of one number are taken by role and text.  A conversation without an id is one like
    any other.  Roles count by their initials; others than s, u and a fit nowhere.  A
    conversation's spelling, one letter per turn, and its hash are made by one task; its texts are
    streamed.
    """

    def __init__(self, conversations: DataFrame, turns: DataFrame):
        scratch = Scratch(conversations.sparkSession, "conversations")
        self.ids = conversations.select(F.col("conv_id").cast("long")).distinct()
        self.turns = scratch.write(with_faults(turns), "turns")
        found = scratch.write(spelt(self.turns), "spelt")
        self.plans = scratch.write(found.join(audits(found.select("spelling")), "spelling"), "plans")

    def report(self) -> DataFrame:
        hashes = repaired_turns(self.turns, self.plans, True)
        mine = self.plans.join(hashes.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop(
            "_id", "spelling").withColumnRenamed("conv_id", "_id")
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        nothing = hashlib.sha256(b"").hexdigest()
        return self.ids.join(mine, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
            "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

    def conversations(self) -> DataFrame:
        """conv_id, place, role, text of the repaired conversations."""
        return repaired_turns(self.turns, self.plans, False)


def repair(conversations: DataFrame, damage: bool = False) -> Repair:
    """Plans for ``conversations`` (conv_id, turn, role, text), damaged first if asked for.

    Nulls of role and text are one space, a null turn comes first.  Equal rows are duplicates of
    the first of them.  An empty table gives empty results; other columns are not read.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = damaged(conversations) if damage else conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role"), shown("text"), F.lit(0).alias("copy"))
    return Repair(conversations, turns)
