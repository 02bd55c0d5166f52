import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from gaugeworks.llm import conversations as C

SF = "/root/testdata/sf0.01"
SHAPE = re.compile(r"(s?(ua)+)?")


def brute_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def brute_repair(rows, costs):
    """Cheapest edits by a search over (cost, audit) in order; states are whole role strings' ends."""
    faults = brute_faults(rows)
    queue, done = [(0, "", 0, "")], {}
    while queue:
        cost, audit, i, made = heapq.heappop(queue)
        # Only the last initial and whether a system row leads decide what may follow.
        state = (i, made[-1:], made[:1] == "s")
        if state in done:
            continue
        done[state] = True
        if i == len(rows) and SHAPE.fullmatch(made):
            return cost, audit, made
        for initial in "ua":
            heapq.heappush(queue, (cost + costs.insert, audit + "I", i, made + initial))
        if i < len(rows):
            heapq.heappush(queue, (cost + costs.delete, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = costs.truncated * (faults[i] == "truncated")
                role = rows[i][1][:1]
                if role and role in "sua":
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, made + role))
                for initial in "ua":
                    heapq.heappush(queue, (cost + extra + costs.rerole, audit + "R", i + 1, made + initial))
        queue = [q for q in queue if re.fullmatch(r"s?(ua)*u?", q[3])]
        heapq.heapify(queue)
    raise AssertionError


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def applied(rows, audit, made):
    lines, i, m = [], 0, 0
    for letter in audit:
        role = {"s": "system", "u": "user", "a": "assistant"}[made[m]] if letter != "D" else None
        if letter == "K":
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif letter == "R":
            lines.append(f"{role}:{rows[i][2]}")
        elif letter == "I":
            lines.append(f"{role}:")
        i += letter != "I"
        m += letter != "D"
    return "\n".join(lines)


def brute_result(rows, costs):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = brute_faults(rows)
    cost, audit, made = brute_repair(rows, costs)
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256(applied(rows, audit, made).encode()).hexdigest(),
    )


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(3, 9, 1, 2), C.Costs(4, 3, 1, 1), C.Costs(0, 1, 1, 0)])
def test_least_weight_matches_search(costs):
    """Also with costs that make inserts worthwhile, and cut into runs at every place."""
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(0, 9)
        rows = [
            (i, rng.choice(["system", "user", "assistant", "tool", "", "aide"]), rng.choice(["", "yes.", "no", f"a{i}!", f"b{i}"]))
            for i in range(n)
        ]
        pairs = [(r[1][:1], f) for r, f in zip(rows, brute_faults(rows), strict=True)]
        cost, audit, _ = brute_repair(rows, costs)
        cuts = sorted(rng.sample(range(n + 1), min(n, rng.randrange(0, 4))))
        reached, width = [0, None, None, None], 0
        for a, b in zip([0, *cuts], [*cuts, n]):
            run, run_width = C.run_weights(pairs[a:b], costs)
            reached, width = C.join_runs(reached, width, run, run_width), width + run_width
        weight, width = C.close(reached, width, costs)
        assert (weight >> 3 * width, C.audit_of(weight, width)) == (cost, audit)


def test_free_inserts_are_refused():
    with pytest.raises(ValueError):
        C.Costs(insert=0)


def check_query(spark, rows, folder):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return spark, str(folder)


def compare(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = defaultdict(list)
    for conv, *row in brute_damage(rows):
        groups[conv].append(tuple(row))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {conv: brute_result(groups[conv], C.Costs()) if conv in groups else empty for conv, *_ in rows}
    got = C.op12_conversation_repair(spark, sf_dir).collect()
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_query_matches_brute_force(spark):
    compare(spark, SF)


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    """Null ids, turns, roles, texts; ties and repeats; cells of two rows cut conversations."""
    monkeypatch.setattr(C, "CELL_BITS", 1)
    rng = random.Random(11)
    rows = [
        (rng.choice([None, 1, 2, 3, 3, 3, 9]), rng.choice([None, 0, 1, 2, 5, 8, 2**40]),
         rng.choice([None, "system", "user", "user", "assistant", "assistant", "tool", "", "üser"]),
         rng.choice([None, "", " \n", "Hi.", "Yes!", "cut", "Hi.  \n", "Wh?y", "é."]))
        for _ in range(250)
    ]
    rows += [(4, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(40)]
    rows += [(5, 0, "user", "same.")] * 30 + [(6, None, "system", "x" * 300_000 + ".")]
    rows += [(i, None, None, None) for i in range(100, 130)]
    check_query(spark, rows, tmp_path)
    compare(spark, str(tmp_path))


def test_rows_are_repaired(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"),
        (1, 3, "user", "Why?"), (1, 4, "assistant", "Because"), (1, 5, "assistant", "So it is."),
    ]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "c long, turn long, role string, text string, at double, edit string")
    repair = C.repair_conversations(df, conv="c")
    got = [(r["edit"], r["role"], r["text"]) for r in repair.rows.orderBy("conv", "at", "place").collect()]
    assert got == [
        ("R", "user", "Be brief."), ("K", "assistant", "Hello."), ("K", "user", "Why?"), ("D", "user", "Why?"),
        ("D", "assistant", "Because"), ("K", "assistant", "So it is."),
    ]
    assert repair.conversations.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def test_inserts_are_placed(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U.")], "conv_id long, turn long, role string, text string")
    rows = C.repair_conversations(df, costs=C.Costs(9, 9, 1, 0)).rows.orderBy("at", "place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in rows] == [
        ("K", "system", "S."), ("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "U."), ("I", "assistant", ""),
    ]


def test_empty_table(spark, tmp_path):
    check_query(spark, [], tmp_path)
    assert C.op12_conversation_repair(spark, str(tmp_path)).count() == 0
