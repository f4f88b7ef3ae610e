"""Conversation repair against a plain backward table over all edits, and the damage, order and edge cases."""

import hashlib
import itertools
import random
import zlib

from meterflow.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {"n": "u", "s": "u", "u": "a", "a": "u"}


def plain(marks):
    """Least (cost, audit) from the end backwards: audits of one place compare as whole rests."""
    none = (10**9, "")
    rest = {"n": (0, ""), "a": (0, ""), "s": none, "u": none}

    def inserted(rest):
        for _ in range(4):
            rest = {s: min(rest[s], (rest[FOLLOWS[s]][0] + 3, "I" + rest[FOLLOWS[s]][1])) for s in rest}
        return rest

    rest = inserted(rest)
    for m in reversed(marks):
        now = {}
        for s in rest:
            ways = [(4, "D", s)]
            if m != "x":
                extra = 3 if m.isupper() else 0
                ways.append((3 + extra, "R", FOLLOWS[s]))
                if m.lower() == FOLLOWS[s] or (s, m.lower()) == ("n", "s"):
                    ways.append((extra, "K", m.lower()))
            now[s] = min((c + rest[to][0], e + rest[to][1]) for c, e, to in ways)
        rest = inserted(now)
    return rest["n"]


def test_both_ends_find_the_least_of_all_cheapest_audits():
    for n in range(4):
        for marks in itertools.product("suaoSUAx", repeat=n):
            assert C.cheapest_edits("".join(marks)) == plain("".join(marks)), marks
    pick = random.Random(3)
    for _ in range(400):
        marks = "".join(pick.choice("suaoSUAOxuaua") for _ in range(pick.randint(5, 90)))
        assert C.cheapest_edits(marks) == plain(marks), marks


def expected(rows):
    """Report and repaired turns of one conversation, from its turns in any order."""
    seen, marks, counts, kept = set(), "", [0, 0, 0, 0], []
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    for _, role, text in rows:
        written = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not written else 2 if (role, text) in seen else 0 if written[-1] in ".!?" else 3
        seen.add((role, text))
        counts[fault] += 1
        mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
        marks += "x" if fault in (1, 2) else mark.upper() if fault == 3 else mark
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = plain(marks)
    left, system = iter(rows), 0
    for edit in audit:
        role, text = next(left)[1:] if edit != "I" else ("", "")
        if edit == "K":
            system = system or (not kept and role[:1] == "s")
        if edit in "RI":
            role = "assistant" if (len(kept) - system) % 2 else "user"
        if edit != "D":
            kept.append((edit, role, text))
    return (gaps, *counts[1:], illegal, cost, audit), kept


def conversations():
    pick, rows = random.Random(11), []
    texts = ["Hello there.", "no end", "", " \t\n", "What?\n ", "Done!", None, "ünïcode 漢字.", "x" * 200_000 + "."]
    for conv in range(60):
        for turn in range(pick.randint(1, 9)):
            number = None if pick.random() < 0.1 else turn * pick.choice([1, 1, 2])
            rows.append((conv, number, pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), pick.choice(texts)))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-1, 5, "user", "same."), (-1, 5, "user", "same.")]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(9000)]  # over several batches
    pick.shuffle(rows)
    return rows


def test_report_turns_and_digest(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    by_conv = {}
    for conv, *rest in rows:
        by_conv.setdefault(conv, []).append(rest)
    want = {conv: expected(r) for conv, r in by_conv.items()}
    reports = {r[0]: tuple(r[1:]) for r in C.repair_report(turns).collect()}
    assert reports == {conv: report for conv, (report, _) in want.items()}
    found = {}
    for r in sorted(C.repaired_turns(turns).collect(), key=lambda r: r.place):
        found.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert found == {conv: kept for conv, (_, kept) in want.items() if kept}
    digests = {r.conv_id: r.repaired_sha256 for r in C.repaired_digests(turns).collect()}
    whole = {conv: "\n".join(f"{role}:{text}" for _, role, text in kept) for conv, (_, kept) in want.items()}
    assert digests == {conv: hashlib.sha256(text.encode()).hexdigest() for conv, text in whole.items()}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    found = {}
    for conv, turn, role, text, there in C.damaged(spark.createDataFrame(rows, TURNS)).collect():
        found.setdefault((conv, turn), []).append((role, text, there))
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        made = ("user" if code == 4 else role, "" if code == 1 else "One Two" if code == 2 and text != " " else text, code != 0)
        assert found[conv, turn] == [made] * (2 if code == 3 else 1)


def test_lost_and_empty(spark):
    from pyspark.sql import functions as F

    turns = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", True), (2, 1, "assistant", "b.", True)], TURNS + ", there boolean")
    found = {r.conv_id: tuple(r)[1:] for r in C.repaired_digests(turns, there=F.col("there")).collect()}
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert C.repaired_digests(turns.limit(0)).count() == 0 and C.repaired_turns(turns.limit(0)).count() == 0


def test_other_names_and_columns_in_the_way(spark):
    turns = spark.createDataFrame([("a", 0, "user", "x.", 1, 2, 3)], "thread string, n int, who string, said string, conv int, digest int, kind int")
    args = ("thread", "n", "who", "said")
    assert [tuple(r) for r in C.repaired_turns(turns, *args).orderBy("place").collect()] == [("a", 0, "K", "user", "x."), ("a", 1, "I", "assistant", "")]
    assert C.repair_report(turns, *args).first().thread == "a"
