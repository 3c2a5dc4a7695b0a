"""Conversation repair against every sequence of edits on short conversations, and against a plain dynamic program on long ones."""

import hashlib
import random
import re
import zlib
from itertools import product

from copperline.llm import conversation_repair as repair, registry

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(kind)
    return out


def by_all_edits(rows):
    """Least (cost, audit) with its text, over all edits of each row and up to two inserts in each gap."""
    options = []
    for (role, text), fault in zip(rows, faults(rows)):
        mine = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            mine += [(extra, "K", [(role, text)]), (1 + extra, "R", [("user", text)]), (1 + extra, "R", [("assistant", text)])]
        options.append(mine)
    inserts = [[(5 * n, "I" * n, [(r, "") for r in roles]) for roles in product(("user", "assistant"), repeat=n)] for n in range(3)]
    gap = [x for n in inserts for x in n]
    best = None
    for chosen in product(*(x for o in options for x in (gap, o)), gap):
        kept = [t for c in chosen for t in c[2]]
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in kept)):
            found = (sum(c[0] for c in chosen), "".join(c[1] for c in chosen), "\n".join(f"{r}:{t}" for r, t in kept))
            best = found if best is None or found < best else best
    return best


def by_strings(rows):
    """The same with whole audits kept per state."""
    free = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "p"), "p": ("user", "u")}
    shift = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}

    def insert(states):
        for _ in range(3):
            for at, (cost, audit, out) in list(states.items()):
                role, to = free[at]
                new = (cost + 5, audit + "I", [*out, f"{role}:"])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        after = {}

        def put(to, new):
            if to not in after or new[:2] < after[to][:2]:
                after[to] = new

        for at, (cost, audit, out) in insert(states).items():
            put(at, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if (at, role[:1]) in shift:
                put(shift[at, role[:1]], (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
            put(free[at][1], (cost + 1 + extra, audit + "R", [*out, f"{free[at][0]}:{text}"]))
        states = after
    ends = insert(states)
    cost, audit, out = min((ends[s] for s in ("", "p") if s in ends), key=lambda e: e[:2])
    return cost, audit, "\n".join(out)


def repaired(spark, conversations, **kwargs):
    rows = [(conv, turn, role, text) for conv, turns in conversations.items() for turn, role, text in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = repair.repair(df, **kwargs)
    reports = {r["conv_id"]: r for r in done.reports.collect()}
    texts = {}
    for r in done.rows.orderBy("conv_id", "piece", "place", "at").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    hashes = {r["conv_id"]: r["sha256"] for r in repair.digests(done.rows).collect()}
    for conv, lines in texts.items():
        assert hashes[conv] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return reports, {c: "\n".join(texts.get(c, [])) for c in reports}


def test_short_conversations_by_all_edits(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", " "]
    texts = ["a.", "b!", "cut", "", " \n", "c? \t"]
    made = {i: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 4))] for i in range(150)}
    reports, out = repaired(spark, made)
    for i, turns in made.items():
        rows = [(role, text) for _, role, text in turns]
        assert (reports[i]["cost"], reports[i]["audit"], out[i]) == by_all_edits(rows), rows
        assert (reports[i]["cost"], reports[i]["audit"], out[i]) == by_strings(rows), rows


def test_long_conversations_are_cut_in_pieces(spark):
    rng = random.Random(6)
    made = {}
    for i, n in enumerate([1, 40, 700, 1500]):
        # null and repeated turns, equal rows, gaps in the numbers
        made[i] = [(rng.choice([None, rng.randrange(n), rng.randrange(10 ** 12, 10 ** 12 + 3)]), rng.choice(["user", "assistant", "user", "system"]),
                    rng.choice(["x.", "y", "", *[f"{k}!" for k in range(n)]])) for _ in range(n)]
    made[9] = [(3, "user", "same.")] * 2000 + [(4, "assistant", "one.")]
    reports, out = repaired(spark, made)
    for i, turns in made.items():
        ordered = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        rows = [(role, text) for _, role, text in ordered]
        cost, audit, text = by_strings(rows)
        r = reports[i]
        assert (r["cost"], r["audit"], out[i]) == (cost, audit, text)
        numbers = [t[0] for t in turns if t[0] is not None]
        kinds = faults(rows)
        initials = [role[:1] for role, _ in rows]
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [kinds.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert r["n_rows"] == len(rows)


def test_nulls_empty_tables_and_other_columns(spark):
    schema = "conv_id string, turn long, role string, text string, piece string, `a.b` int"
    rows = [(None, None, None, None, "mine", 1), (None, 2, "user", "a.", "mine", 1), ("", 1, "user", "b.", None, 2), ("", 2, "assistant", "c." * 40_000, None, 2)]
    df = spark.createDataFrame(rows, schema)
    done = repair.repair(df)
    reports = {r["conv_id"]: r for r in done.reports.collect()}
    assert set(reports) == {None, ""}
    # a null text is blank; a null role is a space, which no grammar knows
    assert (reports[None]["audit"], reports[None]["blank"], reports[None]["illegal"], reports[None]["gaps"]) == ("DD", 1, 1, 0)
    assert (reports[""]["audit"], reports[""]["cost"]) == ("KK", 0)
    hashes = {r["conv_id"]: r["sha256"] for r in repair.digests(done.rows).collect()}
    assert hashes == {"": hashlib.sha256(("user:b.\nassistant:" + "c." * 40_000).encode()).hexdigest()}
    empty = repair.repair(df.limit(0))
    assert empty.reports.count() == 0 and empty.rows.count() == 0 and repair.digests(empty.rows).count() == 0


def test_pieces_do_not_change_results(spark):
    rng = random.Random(7)
    made = {0: [(t, rng.choice(["user", "assistant", "tool"]), rng.choice(["x.", "y", f"{t}!"])) for t in range(90)]}
    whole = repaired(spark, made)
    rows = [(role, text) for _, role, text in made[0]]
    assert (whole[0][0]["cost"], whole[0][0]["audit"], whole[1][0]) == by_strings(rows)
    # the parse from each top, cut anywhere and strung together, is the parse of the whole
    symbols = [(role[:1], fault, 1) for (role, _), fault in zip(rows, faults(rows))]
    for cut in (1, 7, 45, 89):
        first, second = repair.parse(symbols[:cut], repair.EMPTY), [repair.parse(symbols[cut:], top) for top in range(4)]
        audits = {s: [c for c in x[2]] for s, x in enumerate(first) if x}
        for to in range(4):
            joined = [(first[mid][0] + second[mid][to][0], "".join(repair.STEPS[ord(c) - 48].audit for c in [*audits[mid], *second[mid][to][2]]))
                      for mid in range(4) if first[mid] and second[mid][to]]
            direct = repair.parse(symbols, repair.EMPTY)[to]
            if direct is None:
                assert joined == []
                continue
            assert min(joined) == (direct[0], "".join(repair.STEPS[ord(c) - 48].audit for c in direct[2]))


def test_damage_covers_its_cases(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = registry.damaged(df).groupBy("conv_id", "turn", "role", "text").count().collect()
    by_place = {(r["conv_id"], r["turn"]): r for r in out}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = by_place.get((c, t))
        if kind == 0:
            assert row is None
            continue
        expected_text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 and text else text
        assert (row["role"], row["text"], row["count"]) == ("user" if kind == 4 else role, expected_text, 2 if kind == 3 else 1)
