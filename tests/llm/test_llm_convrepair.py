"""Conversation repair: the agenda against all edit sequences, stretches against whole conversations, the operator by hand."""

import hashlib
import itertools
import random
import re
import zlib

import pytest


def all_repairs(rows):
    """Cheapest (cost, audit, lines) over all edits of rows (role, text, fault), by trying each sequence."""
    best = None

    def go(i, cost, audit, roles, lines, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r in roles)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, lines, 0)
            if fault not in "bd":
                more = fault == "t"
                go(i + 1, cost + more, audit + "K", roles + [role], lines + [f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", roles + [r], lines + [f"{r}:{text}"], 0)
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", roles + [r], lines + [f"{r}:"], inserts + 1)

    go(0, 0, "", [], [], 0)
    return best


def fault_of(rows):
    """(role, text) in order -> the same with the fault of each."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        f = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "o"
        seen.add((role, text))
        out.append((role, text, f))
    return out


def kinds_of(rows):
    letter = lambda r, f: "d" if f in "bd" else (r[:1] if r[:1] in ("s", "u", "a") else "x")
    return "".join(letter(r, f).upper() if f == "t" else letter(r, f) for r, _, f in rows)


def test_agenda_against_all_edits():
    from pressroom.llm.convrepair import whole

    for n in range(5):
        for kinds in itertools.product("dsuaxSA" if n > 3 else "dsuaxSUAX", repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}[k.lower()], "", "d" if k == "d" else "t" if k.isupper() else "o")
                    for k in kinds]
            if n < 4 or zlib.crc32("".join(kinds).encode()) % 23 == 0:
                assert whole("".join(kinds)) == all_repairs(rows)[:2], kinds


@pytest.mark.parametrize("seed", range(4))
def test_stretches_equal_whole(seed, monkeypatch):
    from pressroom.llm import convrepair as C

    rng = random.Random(seed)
    for _ in range(150):
        kinds = "".join(rng.choices("dsuaxSUAX" if seed else "ua", k=rng.randint(0, 40)))
        want = min(v for q, v in C.agenda([C.EDITS[c] for c in kinds], {0: (0, "")}, C.INSERTS).items() if q in C.GOALS)
        monkeypatch.setattr(C, "CHUNK", rng.choice([1, 3, 7]))
        C._KEPT.clear()
        assert C.whole(kinds) == want
        cuts = sorted(rng.choices(range(len(kinds) + 1), k=rng.randint(0, 4)))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
        tables = [[{"q": q, "r": r, "cost": c, "audit": a} for q in range(4) for r, (c, a) in C.table(p, q).items()] for p in parts]
        assert C.join_tables(tables) == want
    monkeypatch.undo()
    C._KEPT.clear()


def test_long_conversation_is_deduced_in_chunks():
    from pressroom.llm.convrepair import whole

    assert whole("ua" * 100_000) == (0, "K" * 200_000)
    cost, audit = whole("s" + "uad" * 30_000 + "uu")
    assert cost == 3 * 30_000 + 2 and audit.startswith("KKKDKKD")       # the last user becomes the answer


def test_repair_by_hand(spark):
    from pressroom.llm.convrepair import clean, digests, repaired, summary

    talk = {
        1: [("user", "Hi."), ("assistant", "Yes.")],
        2: [("assistant", "So."), ("assistant", "And?")],
        3: [("system", "Be kind."), ("user", "Cut of"), ("user", "  "), ("assistant", "Fine!"), ("assistant", "Fine!")],
        4: [(None, "Who"), ("tool", "Result."), ("", ""), (None, None)],
        5: [("system", "Only.")],
        None: [("user", "No id."), ("assistant", "None.")],
        7: [("user", f"Line {i}." if i % 5 else "Same.") if i % 3 else ("assistant", f"Answer {i // 9}") for i in range(7)],
    }
    rows = [(c, None if c == 4 and t < 2 else t, r, x) for c, rs in talk.items() for t, (r, x) in enumerate(rs)]
    rows += [(8, 3, "user", "Twice."), (8, 3, "user", "Twice."), (8, 9, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as head", "'x' as conv", "2 as kind").repartition(5)
    ready = clean(df)
    heads = summary(ready, ready)
    got = {r.conv: r for r in digests(ready, heads).collect()}
    lines = {}
    for r in repaired(ready, heads).orderBy("conv", "place").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert set(got) == {1, 2, 3, 4, 5, 7, 8, None}
    talk[8] = [("user", "Twice."), ("user", "Twice."), ("assistant", "Ok.")]
    talk[4] = sorted([(r or " ", x or " ") if x != "" else (r, x) for r, x in talk[4][:2]]) + [("", ""), (" ", " ")]
    for c, rs in talk.items():
        full = fault_of(rs)
        cost, audit, want = all_repairs(full)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit), c
        assert lines.get(c, []) == want
        assert r.sha256 == hashlib.sha256("\n".join(want).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f == k for *_, f in full) for k in "bdt")
        initials = [x[:1] for x, *_ in full]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert [got[c].gaps for c in (1, 2, 5, None, 8, 4)] == [0, 0, 0, 0, 9 - 3 + 1 - 2, 0]
    empty = clean(df.limit(0))
    assert digests(empty, summary(empty, empty)).count() == 0


def test_conversation_over_many_ranges(spark):
    """One conversation with most rows crosses the borders of ranges; its repair equals that of one stretch."""
    from pressroom.llm.convrepair import clean, digests, summary, whole

    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No!", "cut", " ", f"Say {t}."])) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"T{t}.") for c in range(2, 400) for t in range(2)]
    df = clean(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    got = {r.conv: r for r in digests(df, summary(df, df)).collect()}
    full = fault_of([r[2:] for r in rows[:3000]])
    cost, audit = whole(kinds_of(full))
    assert (got[1].cost, got[1].audit) == (cost, audit)
    initials = [r[0] for r, *_ in full]
    assert got[1].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert all(got[c].cost == 0 and got[c].audit == "KK" for c in range(2, 400))


def test_damage(spark):
    from pressroom.llm.convrepair import clean, damaged, q_op12_conversation_repair

    rows = [(c, t, "assistant", f"Well! {c}?") for c in range(40) for t in range(6)] + [(None, 1, None, None), (3, None, "user", "A.")]
    df = clean(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(map(str, map(tuple, damaged(df).collect())))
    want = []
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        want += [str((c, t, "user" if code == 4 else r, x))] * (0 if code == 0 else 2 if code == 3 else 1)
    assert got == sorted(want)
    out = q_op12_conversation_repair(spark, "/root/testdata/sf0.001")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
