"""Conversation repair against every sequence of edits on short conversations, and against a plain program on whole tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vitrina.llm import turn_repair as tr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def legal(initials):
    rest = initials[1:] if initials[:1] == ["s"] else initials
    return not initials or (len(rest) > 0 and rest == ["u", "a"] * (len(rest) // 2))


def every_repair(initials, faults, room=3):
    """(cost, audit) of every sequence of edits with at most `room` insertions that ends legal."""
    def go(k, sofar, cost, audit, left):
        if k == len(initials) and legal(sofar):
            yield cost, audit
        if left:
            for new in "ua":
                yield from go(k, [*sofar, new], cost + 3, audit + "I", left - 1)
        if k < len(initials):
            yield from go(k + 1, sofar, cost + 4, audit + "D", left)
            if faults[k] in (tr.NORMAL, tr.TRUNCATED):
                more = 3 if faults[k] == tr.TRUNCATED else 0
                yield from go(k + 1, [*sofar, initials[k]], cost + more, audit + "K", left)
                for new in "ua":
                    yield from go(k + 1, [*sofar, new], cost + 3 + more, audit + "R", left)

    return min(go(0, [], 0, "", room))


def test_equal_to_every_sequence_of_edits():
    rng = random.Random(3)
    for _ in range(250):
        n = rng.randint(0, 4)
        initials, faults = [rng.choice("suax") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        roles = [{"s": "system", "u": "user", "a": "assistant", "x": "tool"}[i] for i in initials]
        steps = [tr.message_step(i, f) for i, f in zip(initials, faults)]
        last, cost = tr.last_state(steps)
        got = tr.rebuild(roles, ["t"] * n, faults, tr.NOTHING, last, True)
        assert (cost, got["audit"]) == (got["cost"], got["audit"]) == every_repair(initials, faults)
        assert legal([r[:1] for r in got["roles"]])


def least_strings(initials, faults):
    """(cost, audit) with whole strings carried along, for long conversations."""
    best = {0: (0, "")}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                put(table, tr.follower(state), (cost + 3, audit + "I"))
        return table

    for initial, fault in zip(initials, faults):
        new = {}
        for state, (cost, audit) in inserted(best).items():
            put(new, state, (cost + 4, audit + "D"))
            if fault in (tr.NORMAL, tr.TRUNCATED):
                more = cost + (3 if fault == tr.TRUNCATED else 0)
                put(new, tr.follower(state), (more + 3, audit + "R"))
                if initial == "s" and state == 0:
                    put(new, 1, (more, audit + "K"))
                if initial == ("a" if state == 2 else "u"):
                    put(new, tr.follower(state), (more, audit + "K"))
        best = new
    return min(value for state, value in inserted(best).items() if state in (0, 3))


def test_long_conversations_and_blocks_of_them():
    rng = random.Random(4)
    for n in (1, 2, 3, 17, 64, 300):
        for _ in range(12):
            initials, faults = [rng.choice("sua") for _ in range(n)], [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
            steps = [tr.message_step(i, f) for i, f in zip(initials, faults)]
            last, cost = tr.last_state(steps)
            want = least_strings(initials, faults)
            got = tr.rebuild(initials, ["t"] * n, faults, tr.NOTHING, last, True)
            assert (cost, got["audit"]) == want
            cuts = sorted({0, n, *[rng.randint(0, n) for _ in range(3)]})
            blocks = [tr.summary(steps[a:b]) for a, b in zip(cuts, cuts[1:])]
            end, total = tr.last_state(blocks)
            states = tr.crossings(blocks, tr.NOTHING, end)
            pieces = [tr.rebuild(initials[a:b], ["t"] * (b - a), faults[a:b], p, q, b == n) for a, b, p, q in zip(cuts, cuts[1:], states, states[1:])]
            assert (total, "".join(p["audit"] for p in pieces)) == want and sum(p["cost"] for p in pieces) == cost


def plain_damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv_id, turn, role, text)] * (2 if kind == 3 else 1)


def plain_repair(rows, damaged):
    """What the query returns, from sorted lists and whole strings."""
    groups = defaultdict(list)
    for row in damaged:
        groups[row[0]].append(row[1:])
    out = {}
    for conv_id in {row[0] for row in rows}:
        messages = sorted(groups.get(conv_id, []), key=lambda m: (m[0] is not None, m[0] or 0))
        roles, texts, faults, seen = [m[1] for m in messages], [m[2] for m in messages], [], set()
        for _, role, text in messages:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(tr.BLANK if not bare else tr.DUPLICATE if (role, text) in seen else tr.NORMAL if bare[-1] in ".!?" else tr.TRUNCATED)
            seen.add((role, text))
        initials = [r[:1] for r in roles]
        cost, audit = least_strings(initials, faults)
        state, at, said = 0, 0, []
        for letter in audit:
            new = {2: "user", 3: "assistant"}[tr.follower(state)]
            if letter == "I":
                said.append(f"{new}:")
            elif letter != "D":
                said.append(f"{roles[at] if letter == 'K' else new}:{texts[at]}")
            if letter != "I":
                at += 1
            if letter != "D":
                state = 1 if said[-1][0] == "s" else 2 if said[-1][0] == "u" else 3
        turns = {m[0] for m in messages if m[0] is not None}
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(tr.BLANK), faults.count(tr.DUPLICATE), faults.count(tr.TRUNCATED),
            sum(pair not in LEGAL for pair in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def collected(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_equals_a_plain_program(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert collected(tr.repair_damaged(table)) == plain_repair(rows, plain_damage(rows))


def talk(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv_id, size in sizes.items():
        for turn in range(size):
            rows.append((conv_id, turn * rng.choice([1, 1, 1, 2]) if turn % 50 == 49 else turn * 2, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                         rng.choice(["yes.", "no!", "", " \n", f"point {turn}.", f"cut {turn}", "why? "])))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("rows_per_block", [3, 1024])
def test_hot_and_cut_conversations(spark, rows_per_block):
    rows = talk(5, {1: 700, 2: 9, 3: 1, None: 40, 4: 130, **{k: 5 for k in range(10, 60)}})
    rows += [(70, None, "user", "Hello."), (71, None, None, None), (71, 5, "assistant", "x" * 300_000 + "."), (72, 0, "user", "a" * 200_000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = collected(tr.digests(tr.repair(frame, rows_per_block, chars_per_block=100_000)))
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == plain_repair(rows, spaced)


def test_ties_repeated_rows_and_conversations_without_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hello."), (2, None, "user", "b."), (2, None, "assistant", "a.")]
    got = collected(tr.digests(tr.repair(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))))
    assert got[1] == plain_repair(rows, sorted(rows, key=lambda r: (r[0], r[2], r[3])))[1]  # ties by role, then text
    assert got[2][6] == "IKKI"  # assistant before user
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "Hi.", "", 0)], SCHEMA)
    assert collected(tr.repair_damaged(frame)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.repair_damaged(empty).collect() == [] and tr.repair(empty).collect() == []
