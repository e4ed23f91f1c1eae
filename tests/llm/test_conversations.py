"""Repair of conversations against all cheapest edits, found by a plain backward table with whole strings."""

import hashlib
import random
import re
import zlib

from vectormart.llm import conversations
from vectormart.llm.conversations import cheapest


def plain_cheapest(initials, faults):
    """(cost, least audit) from a table of (cost, rest of the audit) for every row and every string state, row by row from the end."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(faults)
    table = {(n, ""): (0, ""), (n, "a"): (0, "")}
    for i in range(n, -1, -1):
        options = {s: [table[(i, s)]] if (i, s) in table else [] for s in after}
        if i < n:
            for s in after:
                extra = faults[i] == "t"
                moves = [("D", s, 3)]
                if faults[i] not in "bd":
                    moves += [("K", r, extra) if initials[i] == r else ("R", r, 2 + extra) for r in after[s] if r in "ua" or initials[i] == r]
                options[s] += [(c + table[(i + 1, to)][0], e + table[(i + 1, to)][1]) for e, to, c in moves if (i + 1, to) in table]
        best = {s: min(o) for s, o in options.items() if o}
        for _ in range(6):  # insertions stay in the row; a few turns settle them
            for s in after:
                for r in after[s]:
                    if r in "ua" and r in best:
                        best[s] = min(best.get(s, (1e9, "")), (2 + best[r][0], "I" + best[r][1]))
        table.update({(i, s): b for s, b in best.items()})
    return table[(0, "")]


def test_cheapest_equals_plain_table():
    rng = random.Random(3)
    cases = [([], ""), (["s"], " "), (["x"], " "), ([""], "t"), (["s", "s", "u"], "   "), (["u"] * 60, " " * 60), (["s"] * 9, "t" * 9)]
    for _ in range(4000):
        n = rng.randint(0, 14)
        cases.append(([rng.choice("suuuaaax") for _ in range(n)], "".join(rng.choice("   bdt") for _ in range(n))))
    for initials, faults in cases:
        assert cheapest(initials, faults) == plain_cheapest(initials, faults), (initials, faults)


def test_audit_repairs():
    rng = random.Random(4)
    for _ in range(500):
        roles = [rng.choice(["system", "user", "assistant", "user", "tool", " "]) for _ in range(rng.randint(0, 12))]
        rows = [(r, rng.choice(["", "Yes.", "cut", "Done!", "More?"])) for r in roles]
        _, audit = cheapest([r[:1] for r in roles], conversations.faults_of(rows))
        fixed = conversations.repaired(rows, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))


def plain_rows(table):
    by = {}
    for conv, turn, role, text in table:
        name = " " if turn is None else turn
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{name}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = by.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks = set(), ""
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            marks += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else " "
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        cost, audit = plain_cheapest(initials, marks)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        state, lines, rest = "", [], iter(rows)
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(rest)[1:]
            if edit == "D":
                continue
            role = role if edit == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            state = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_digests(spark):
    rng = random.Random(6)
    table = []
    for conv in [*range(300), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "Tool"])
            text = rng.choice([None, "", " \t", "Yes.", "Well, go on! ", "cut off", f"Line {turn}.\nnext é", "same?"])
            table.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    table += [(400, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(3000)] + table[:40]
    frame = spark.createDataFrame([(*r, "x", 2) for r in table], "conv_id long, turn long, role string, text string, rows string, gaps int").repartition(4)
    assert rows(conversations.repair_digests(frame)) == plain_rows(table)
    assert rows(conversations.repair_digests(frame.limit(0))) == []


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert rows(conversations.repair_digests(frame)) == plain_rows([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
