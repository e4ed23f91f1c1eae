"""Repair of conversation structure: the cheapest edits, found by Dijkstra's search from both ends.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``.  Its rows and the states of that pattern
span a lattice: from (rows read, state) one may keep the next row (cost 0), give it the other role
(R, 2), delete it (D, 3) or insert a row without text (I, 2); a cut-off row that is not deleted costs 1 more, and blank or
repeated rows must be deleted.  One heap walks forward from the beginning, one backward from the ends.
Both stop once no path through unsettled nodes can be as cheap as the best one found; then every path of
that cost crosses from a node settled forward to one settled backward, all crossings of that cost are finished, and of all
audits (the initials of the edits) the least in ASCII order is taken.
"""

import heapq

import pyarrow as pa
from pyspark.sql import functions as F

KEEP, ROLE, DELETE, INSERT = "K", "R", "D", "I"
ROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# State: initial of the last role; a beginning, or a system row, is followed by a user.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
BLANK, REPEATED, CUT = "b", "d", "t"


def forward(node, initials, faults):
    """(next node, cost, edit) of every edit at a node."""
    i, state = node
    for role, then in AFTER[state].items():
        if role in ROLES:
            yield (i, then), INSERT_COST, INSERT
    if i == len(faults):
        return
    yield (i + 1, state), DELETE_COST, DELETE
    if faults[i] in (BLANK, REPEATED):
        return
    cut = CUT_COST * (faults[i] == CUT)
    for role, then in AFTER[state].items():
        if initials[i] == role:
            yield (i + 1, then), cut, KEEP
        elif role in ROLES:
            yield (i + 1, then), cut + ROLE_COST, ROLE


def backward(node, initials, faults):
    """(node before, cost, edit) of every edit that leads to a node."""
    i, state = node
    before = [s for s in AFTER if state in AFTER[s].values()]
    if state in (USER, ASSISTANT):
        for s in before:
            yield (i, s), INSERT_COST, INSERT
    if not i:
        return
    yield (i - 1, state), DELETE_COST, DELETE
    if faults[i - 1] in (BLANK, REPEATED):
        return
    cut = CUT_COST * (faults[i - 1] == CUT)
    role = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}.get(state)
    for s in before:
        if initials[i - 1] == role:
            yield (i - 1, s), cut, KEEP
        elif role in ROLES:
            yield (i - 1, s), cut + ROLE_COST, ROLE


def cheapest(initials, faults):
    """(cost, audit) of the cheapest edits of one conversation; of equally cheap ones the least audit.

    ``initials`` has a role initial and ``faults`` a mark (or a space) for every row.
    """
    ends = [(len(faults), s) for s in FINAL]
    sides = [({(0, START): 0}, set(), [(0, (0, START))], forward), (dict.fromkeys(ends, 0), set(), [(0, e) for e in ends], backward)]
    best = float("inf")
    while sides[0][2] and sides[1][2] and sides[0][2][0][0] + sides[1][2][0][0] <= best:
        side = 0 if sides[0][2][0][0] <= sides[1][2][0][0] else 1
        known, settled, heap, edits = sides[side]
        cost, node = heapq.heappop(heap)
        if node in settled:
            continue
        settled.add(node)
        if node in sides[1 - side][0]:
            best = min(best, cost + sides[1 - side][0][node])
        for other, more, _ in edits(node, initials, faults):
            if cost + more < known.get(other, float("inf")):
                known[other] = cost + more
                heapq.heappush(heap, (cost + more, other))
    (ahead, settled, _, _), (behind, settled_back, _, _) = sides
    settled_back.update(ends)

    # Crossings of the best cost, and from them back all nodes settled forward that lead to one at that cost.
    good = {node for node in settled if node in settled_back and ahead[node] + behind[node] == best or any(
        then in settled_back and ahead[node] + more + behind[then] == best for then, more, _ in forward(node, initials, faults))}
    stack = list(good)
    while stack:
        node = stack.pop()
        for before, more, _ in backward(node, initials, faults):
            if before in settled and before not in good and ahead[before] + more == ahead[node]:
                good.add(before)
                stack.append(before)

    # Edits of one node differ in their initial, so the least audit takes the least edit that stays at the best cost.
    audit, node, spent = [], (0, START), 0
    while spent < best or node not in ends:
        node, spent, edit = min(
            ((then, spent + more, edit) for then, more, edit in forward(node, initials, faults)
             if then in settled_back and spent + more + behind[then] == best or then in good and spent + more == ahead[then]),
            key=lambda option: option[2])
        audit.append(edit)
    return best, "".join(audit)


def faults_of(rows):
    """A mark for the first fault of every (role, text) row: blank, repeated, cut off, or a space."""
    seen, marks = set(), []
    for row in rows:
        text = row[1].strip(" \t\n\x0b\x0c\r")
        marks.append(BLANK if not text else REPEATED if row in seen else " " if text[-1] in ".!?" else CUT)
        seen.add(row)
    return "".join(marks)


def repaired(rows, audit):
    """The (role, text) rows that the edits of an audit make of a conversation."""
    state, rest, out = START, iter(rows), []
    for edit in audit:
        role, text = (None, "") if edit == INSERT else next(rest)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = AFTER[state][role[0]]
        else:
            initial, state = next((r, then) for r, then in AFTER[state].items() if r in ROLES)
            role = ROLES[initial]
        out.append((role, text))
    return out


RIGHT_PAIRS = ("su", "ua", "au")
OUT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired array<struct<role:string,text:string>>")


def repairs(turns, conv="conv_id", turn="turn", role="role", text="text", present=None):
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (its new rows).

    Rows stand by turn, null turns first, then by role and text; a null role or text counts as one space, null ids
    are one conversation.  ``present`` may be a condition; rows that do not meet it only keep their conversation
    in the result, with zeros, an empty audit and no rows if nothing else is left.  An empty table gives no rows; columns that
    are not named are not read.  A conversation is one document: its rows meet in one task, however long they are, as
    the repaired conversation is one value; work and memory are proportional to its rows.
    """
    kind = turns.schema[conv].dataType.simpleString()
    said = F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    met = F.sort_array(F.collect_list(said if present is None else F.when(present, said)))
    whole = turns.groupBy(F.col(f"`{conv}`").alias("conv")).agg(met.alias("rows"))
    numbers = F.filter("rows.turn", lambda t: t.isNotNull())
    gaps = F.when(F.size(numbers) > 0, F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))).otherwise(F.lit(0))
    out_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            results = []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                rows = list(zip(roles, texts))
                marks = faults_of(rows)
                initials = [r[:1] for r in roles]
                cost, audit = cheapest(initials, marks)
                illegal = sum(a + b not in RIGHT_PAIRS for a, b in zip(initials, initials[1:]))
                results.append((marks.count(BLANK), marks.count(REPEATED), marks.count(CUT), illegal, cost, audit,
                                [{"role": r, "text": t} for r, t in repaired(rows, audit)]))
            columns = list(zip(*results)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string(), out_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("gaps"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])

    listed = whole.select("conv", gaps.cast("long").alias("gaps"), F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    return listed.mapInArrow(run, f"conv {kind}, {OUT}").withColumnRenamed("conv", conv)


def damaged(turns):
    """Rows of ``conversations`` with one fault by the checksum of ``conv_id:turn`` (a null is one space), and whether they are left."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("fault") != 0).alias("present"), F.explode(times).alias("copy")).drop("copy")


def repair_digests(turns):
    """One row per conversation after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = repairs(damaged(turns), present=F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
