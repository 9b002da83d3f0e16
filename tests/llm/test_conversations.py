import hashlib
import random
import re
from itertools import product

import pytest

from isoframe.llm.conversations import Repair, repair_conversations

SHAPE = re.compile(r"(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Every sequence of edits with up to two Inserts before each row and at the end."""
    best = None
    steps = [["", "u", "a", "ua", "au"]]
    kinds = []
    for (role, text), fault in zip(rows, faults_of(rows)):
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", more, role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant")]
        kinds.append(own)
    for choice in product(*[x for own in kinds for x in (steps[0], own)], steps[0]):
        cost, audit, lines = 0, "", []
        for i, x in enumerate(choice):
            if isinstance(x, str):
                cost, audit = cost + 3 * len(x), audit + "I" * len(x)
                lines += [({"u": "user", "a": "assistant"}[c], "") for c in x]
            else:
                cost, audit = cost + x[1], audit + x[0]
                lines += [(x[2], rows[i // 2][1])] if x[2] is not None else []
        if SHAPE.fullmatch("".join(role[:1] or "-" for role, _ in lines)):
            found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
            best = min(best, found) if best else found
    return best


ROLES = ["system", "user", "assistant", "tool", "", " "]
TEXTS = ["Yes.", "No", " ", "Well!\n", "é?", "cut "]


@pytest.fixture
def turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, copies string").coalesce(3)

    return make


def test_equals_brute_force(turns):
    draw = random.Random(5)
    cases = {k: [(draw.choice(ROLES[:4] if k % 3 else ROLES), draw.choice(TEXTS)) for _ in range(k % 4)] for k in range(100)}
    rows = [(k, t, *row) for k, case in cases.items() for t, row in enumerate(case)]
    found = {r["conv_id"]: r for r in repair_conversations(turns(rows)).collect()}
    for k, case in cases.items():
        if not case:
            assert k not in found
            continue
        cost, audit, text = brute(case)
        kinds = faults_of(case)
        r = found[k]
        assert (r["cost"], r["audit"]) == (cost, audit), case
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [kinds.count(f) for f in ("blank", "duplicate", "truncated")]
        pairs = [(a[0][:1] or "-") + (b[0][:1] or "-") for a, b in zip(case, case[1:])]
        assert (r["gaps"], r["illegal"]) == (0, sum(p not in ("su", "ua", "au") for p in pairs))


def test_nulls_ties_copies_and_gaps(turns):
    rows = [
        (1, 7, "assistant", "B."), (1, 3, "user", "A."), (1, 9, "user", "A."), (1, 9, "user", "A."),  # 4, 5, 6, 8 are missing
        (2, None, "user", "A."), (2, None, "user", None), (2, 0, "user", "A."), (2, 1, None, "C."),
        (None, 1, "user", "A."), (None, 2, "assistant", "B."),
        (3, 5, "assistant", "B."), (3, 5, "user", "A."),  # one turn: by role
    ]
    found = {r["conv_id"]: r for r in repair_conversations(turns(rows)).collect()}
    one, two, none, three = (found[k] for k in (1, 2, None, 3))
    assert (one["gaps"], one["duplicate"], one["illegal"], one["audit"], one["cost"]) == (4, 2, 1, "KKDD", 8)
    assert (two["gaps"], two["blank"], two["duplicate"], two["illegal"]) == (0, 1, 1, 3)
    assert (none["audit"], none["cost"]) == ("KK", 0)
    assert none["repaired_sha256"] == hashlib.sha256(b"user:A.\nassistant:B.").hexdigest()
    assert (three["illegal"], three["cost"], three["audit"]) == (0, *brute([("assistant", "B."), ("user", "A.")])[:2])


def test_no_rows(spark, turns):
    from pyspark.sql import functions as F

    assert repair_conversations(turns([])).collect() == []
    r = repair_conversations(turns([(4, 1, "user", "x")]), F.lit(0)).first()
    assert tuple(r) == (4, 0, 0, 0, 0, 0, 0, "", NOTHING)


def test_long_conversation_and_long_text(turns):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(20_000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    rows[10_001] = (1, 10_001, "user", "Wrong role.")
    found = {r["conv_id"]: r for r in repair_conversations(turns(rows)).collect()}
    assert found[1]["cost"] == 3 and found[1]["audit"] == "K" * 10_001 + "R" + "K" * 9_998
    assert found[2]["audit"] == "KK"


def test_open_rows_stay_few():
    draw, repair, longest, letters = random.Random(3), Repair(), 0, 0
    for i in range(5_000):
        repair.row(draw.choice("suat"), draw.choice([None, None, "blank", "truncated"]))
        longest = max(longest, repair._fields)
        if i % 32 == 31:
            letters += len(repair.settled())
    assert longest < 500 and letters + len(repair.end()) - 1 == 5_000
