"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from fathomline.llm import registry, repair


def damage(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        new = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [] if kind == 0 else [new, new] if kind == 3 else [new]
    return out


def best(faults, roles):
    """Least cost, then least labels, with the output roles, by search from the end."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "", ())] if i == len(roles) and state in ("", "a") else []
        if inserts < 2:
            for full in ("user", "assistant"):
                if full[0] in after[state]:
                    c, s, r = go(i, full[0], inserts + 1)
                    found.append((c + 5, "I" + s, ((full, None), *r)))
        if i < len(roles):
            c, s, r = go(i + 1, state, 0)
            found.append((c + 2, "D" + s, r))
            if faults[i] in ("", "t"):
                extra = 5 * (faults[i] == "t")
                if roles[i][:1] and roles[i][:1] in after[state]:
                    c, s, r = go(i + 1, roles[i][:1], 0)
                    found.append((c + extra, "K" + s, ((roles[i], i), *r)))
                for full in ("user", "assistant"):
                    if full[0] in after[state]:
                        c, s, r = go(i + 1, full[0], 0)
                        found.append((c + 1 + extra, "R" + s, ((full, i), *r)))
        return min(found, key=lambda f: f[:2], default=(1 << 40, "", ()))

    return go(0, "", 0)


def expected(rows):
    own = damage(rows)
    seen, faults = set(), []
    for _, role, text in own:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = {t for t, _, _ in own if t is not None}
    roles = [r for _, r, _ in own]
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    cost, audit, out = best(tuple(faults), tuple(roles))
    text = "\n".join(f"{r}:{'' if i is None else own[i][2]}" for r, i in out)
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def check(df, got):
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    order = lambda r: (r[1] is not None, r[1] or 0)
    want = {i: expected(sorted(rows, key=order)) for i, rows in by.items()}
    rows = got.collect()
    assert len(rows) == len(want) and {r.conv_id: tuple(r)[1:] for r in rows} == want


def test_distances_and_walks():
    rng = random.Random(2)
    for _ in range(400):
        roles = [rng.choice(["system", "user", "assistant", "tool", ""]) for _ in range(rng.randint(1, 9))]
        faults = [rng.choice(["", "", "t", "b", "d"]) for _ in roles]
        codes = bytes(4 * ["", "b", "d", "t"].index(f) + "sua".find(r[:1] or "?") + 1 for f, r in zip(faults, roles, strict=True))
        far = repair.distances(codes, repair.LEFT)
        assert (far[0], repair.walk(codes, far, 0, True)[0]) == best(tuple(faults), tuple(roles))[:2]


@pytest.mark.parametrize("rows,size", [(repair.SEGMENT_ROWS, repair.SEGMENT_BYTES), (3, 1 << 20), (50, 60)])
def test_conversations(spark, data, rows, size):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    check(df, registry.op13_repair(spark, data) if rows > 50 else repair.report(df, rows, size))


def odd(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, 5, None]), i, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", "Ok!\n ", "", " \t", None, "?", "same text."])) for i in range(160)]
    rows += [(7, None, "user", "only row without turn."), (8, 5, "user", "long " * 200_000 + "end."), (8, 6, "assistant", "x."), (9, 0, "user", "a")]
    rows += [(10, t, "user" if t % 2 else "assistant", "The same message again.") for t in range(300)]  # one conversation with most rows, all alike
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, code long, far string").repartition(3)


def test_odd_conversations(spark):
    df = odd(spark)
    check(df, repair.report(df))
    check(df, repair.report(df, 7, 1000))
    assert repair.report(df.where("false")).count() == 0
    dropped = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:2]
    none = spark.createDataFrame([(i, 0, "user", "gone.") for i in dropped], "conv_id long, turn long, role string, text string")
    assert {tuple(r)[1:] for r in repair.report(none).collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    steps = repair.edits(df, 7, 1000).where("conv_id = 10").orderBy("part", "seq", "step").collect()
    audit = repair.report(df).where("conv_id = 10").first().audit
    assert "".join(r.edit for r in steps) == audit and all((r.edit == "D") == (r.role is None) for r in steps)


def test_ties_of_turns_keep_copies_together(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"4:{t}".encode()) % 20 == 3)
    df = spark.createDataFrame([(4, turn, "user", "b?"), (4, turn, "assistant", "a."), (4, turn, "assistant", "a.")], "conv_id long, turn long, role string, text string")
    r = repair.report(df).first()
    assert (r.gaps, r.duplicate, r.illegal) == (0, 4, 4) and r.audit.count("D") + r.audit.count("K") + r.audit.count("R") == 6
