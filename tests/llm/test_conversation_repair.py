"""Repair plans against a search through all edits, and the whole query against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from quarterdeck.llm.conversation_repair import audits, repair

TURNS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(shown).encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def slow_plan(turns, most_inserts=2):
    """(cost, audit) by trying every string of edits; ``turns`` are (initial, fault)."""
    best = (10 ** 9, "")
    for edits in itertools.product("KRD", repeat=len(turns)):
        for inserts in itertools.product(range(most_inserts + 1), repeat=len(turns) + 1):
            cost, roles, audit, bad = 3 * sum(inserts), "", "", False
            for i in range(len(turns) + 1):
                audit += "I" * inserts[i]
                for _ in range(inserts[i]):
                    roles += "a" if roles.endswith("u") else "u"
                if i == len(turns):
                    break
                initial, fault = turns[i]
                audit += edits[i]
                if edits[i] == "D":
                    cost += 4
                    continue
                bad |= fault in ("blank", "duplicate")
                cost += 3 * (fault == "truncated")
                if edits[i] == "K":
                    roles += initial or "-"
                else:
                    cost, roles = cost + 3, roles + ("a" if roles.endswith("u") else "u")
            if not bad and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best, (cost, audit))
    return best


def slow_report(rows):
    kept = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in kept if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            last = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                          "none" if last in ".!?" else "truncated")
            seen.add((role, text))
        numbers = {r[1] for r in mine} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = slow_plan(list(zip(initials, faults)))
        repaired, at, roles = [], 0, ""
        for edit in audit:
            if edit != "I":
                at += 1
            if edit == "D":
                continue
            role = mine[at - 1][2] if edit == "K" else "assistant" if roles.endswith("u") else "user"
            roles += role[0]
            repaired.append(f"{role}:{'' if edit == 'I' else mine[at - 1][3]}")
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def report(df):
    rows = repair(df, damage=True).report().collect()
    found = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                                "repaired_sha256")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_short_spelling(spark):
    letters = {"-": ("u", "blank"), "s": ("s", "none"), "u": ("u", "none"), "a": ("a", "none"), "x": ("", "none"),
               "S": ("s", "truncated"), "U": ("u", "truncated"), "A": ("a", "truncated"), "X": ("x", "truncated")}
    spellings = ["".join(p) for n in range(4) for p in itertools.product(letters, repeat=n)]
    df = spark.createDataFrame([(s,) for s in spellings], "spelling string")
    got = {r["spelling"]: (r["cost"], r["audit"]) for r in audits(df.unionByName(df)).collect()}
    assert got == {s: slow_plan([letters[c] for c in s]) for s in spellings}


def test_report_equals_brute_force(spark):
    r = np.random.default_rng(3)
    texts = ["Yes.", "No! ", "cut short", "", "  ", "Why?\n", "é.", None, "..."]
    roles = ["user", "assistant", "system", "umpire", "", None, "tool"]
    rows = []
    for conv in range(150):
        for turn in range(int(r.integers(0, 5))):
            rows.append((conv, [None, turn, turn, 2 * turn][int(r.integers(0, 4))], roles[int(r.choice(7, p=[.35, .35, .1, .05, .05, .05, .05]))],
                         texts[int(r.integers(0, len(texts)))]))
    rows += [(None, None, None, None), (None, 1, "user", "Hello."), (None, 2, "assistant", "Hi.")]
    rows += [(900, 0, "user", "Twice."), (900, 0, "user", "Twice."), (901, None, "assistant", "a."), (901, None, "user", "b.")]
    assert report(spark.createDataFrame(rows, TURNS).repartition(5)) == slow_report(rows)


def test_repaired_turns_follow_the_audit(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (1, 2, "user", "More"), (2, 0, "user", "Fine.")]
    fixed = repair(spark.createDataFrame(rows, TURNS))
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in fixed.plans.collect()} == {
        (1, *slow_plan([("a", "none"), ("u", "none"), ("u", "truncated")])), (2, *slow_plan([("u", "none")]))}
    turns = sorted((r["conv_id"], r["place"], r["role"], r["text"]) for r in fixed.conversations().collect())
    roles = {}
    for conv, place, role, text in turns:
        assert place == len(roles.get(conv, ""))
        roles[conv] = roles.get(conv, "") + role[0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())
    assert [t for t in turns if t[0] == 2] == [(2, 0, "user", "Fine."), (2, 1, "assistant", "")]


def test_long_conversation_and_many_alike(spark):
    long = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30_000)]
    alike = [(c, i, ("user", "assistant")[i % 2], "Same." if i else f"Hello {c % 3}.") for c in range(100, 600) for i in range(2)]
    found = report(spark.createDataFrame(long + alike, TURNS).repartition(4))
    assert len(found) == 501 and len(found[7][6]) > 25_000
    small = [r for r in alike if r[0] < 140]
    assert {c: found[c] for c in range(100, 140)} == slow_report(small)


@pytest.mark.parametrize("extra", [False, True])
def test_empty_table_and_clashing_columns(spark, extra):
    schema = TURNS + (", fault string, audit string, part int" if extra else "")
    assert report(spark.createDataFrame([], schema)) == {}
    row = (5, 0, "user", "x" * 2_000_000 + ".") + (("a", "b", 1) if extra else ())
    assert report(spark.createDataFrame([row], schema)) == slow_report([row[:4]])
