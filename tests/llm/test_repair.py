"""Conversation repair against plain enumeration, its long form against its short one, and odd rows."""

import random
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from fieldstream.llm import repair

ROWS = "conv_id long, turn long, role string, text string, copies int"
LEGAL = {""} | {s + "ua" * n for s in ("", "s") for n in range(1, 9)}


def plain(rows):
    """Least (cost, audit) by trying all edits of all rows with insertions everywhere."""
    found = []
    options = []
    seen = set()
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        blank, twice = not shown, (role, text) in seen
        seen.add((role, text))
        more = 0 if blank or twice or shown[-1] in ".!?" else 3
        own = [("D", "", 4)]
        if not (blank or twice):
            own += [("K", role[:1], more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append(own)
    for edits in product(*options):
        for gaps in product(("", "I", "II"), repeat=len(rows) + 1):
            for roles in product("ua", repeat=sum(map(len, gaps))):
                it = iter(roles)
                made = "".join(next(it) for _ in gaps[0])
                audit, cost = gaps[0], 3 * len(roles) + sum(e[2] for e in edits)
                for (kind, initial, _), gap in zip(edits, gaps[1:], strict=True):
                    made += initial + "".join(next(it) for _ in gap)
                    audit += kind + gap
                if made in LEGAL and not any(k == "K" and i not in ("s", "u", "a") for k, i, _ in edits):
                    found.append((cost, audit))
    return min(found)


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", " "]
    return [(t, rng.choice(roles[:3] if rng.random() < 0.9 else roles), rng.choice(["Yes.", "No!", "cut", "", " \n", f"new {t}.", f"open {t}"])) for t in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_least_repair_of_short_conversations(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = random_rows(rng, rng.randint(0, 3))
        _, cost, audit, _ = repair.repair([(t, r.encode(), x.encode()) for t, r, x in rows])
        assert (cost, audit) == plain(rows)


def every_split(symbols):
    """Cells of all spans by all splits."""
    n = len(symbols)
    chart = {(i, i + 1): repair._ROW_CELLS[s] for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = {}
            for k in range(i + 1, i + size):
                for at, found in repair.join(chart[i, k], chart[k, i + size]).items():
                    cell[at] = min(found, cell.get(at, found))
            chart[i, i + size] = cell
    return chart[0, n]


def test_one_split_gives_what_all_splits_give():
    rng = random.Random(5)
    for _ in range(60):
        symbols = [rng.choice("suua?") + rng.choice("--bdt") for _ in range(rng.randint(1, 12))]
        assert repair.parsed(symbols) == every_split(symbols)


def made(audit, rows):
    out = []
    fixed = repair.Repaired(audit, out.append)
    for _, role, text in rows:
        fixed.row(role, text)
    fixed.end()
    return b"".join(out)


def test_repaired_text():
    rows = [(0, b"system", b"Be brief."), (1, b"assistant", b"Hi."), (2, b"user", b"What"), (3, b"assistant", b"")]
    facts, cost, audit, digest = repair.repair(rows)
    assert (cost, audit) == (11, "KIKDD") and facts.counts() == (0, 1, 0, 1, 1)
    assert made(audit, rows) == b"system:Be brief.\nuser:\nassistant:Hi."
    assert digest == sha256(made(audit, rows)).hexdigest()
    assert made("KKRI", [(0, b"system", b"a."), (1, b"unit", b"b."), (2, b"tool", b"c.")]) == b"system:a.\nunit:b.\nassistant:c.\nuser:"


def table(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumns({c: F.col(c).cast("binary") for c in ("role", "text")})


@pytest.mark.parametrize("partitions", [3, 7])
def test_long_conversations_give_what_short_ones_give(spark, monkeypatch, partitions):
    rng = random.Random(partitions)
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 8)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = []
    for conv, n in ((1, 150), (2, 3), (None, 61), (3, 9), (5, 30)):
        for t, role, text in random_rows(rng, n):
            rows.append((conv, rng.choice([t, t, None]), role, text, rng.choice([1, 1, 1, 0, 2])))
    rows += [(1, 40, "user", "the same.", 1)] * 40 + [(7, 0, "user", "gone.", 0)] * 30 + [(8, 0, "user", "gone.", 0)]
    df = table(spark, rows).repartition(partitions)
    want = sorted(map(str, repair.repaired(df).collect()))
    assert sorted(map(str, repair.repaired(df, long_rows=20).collect())) == want and len(want) == 7


def test_damage_and_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, None, "user", None, 2), (1, 2, None, "x" * 200_000, 3), (2, 0, "user", "é?", 4), (2, 0, "user", "é?", 4), (3, 1, "Üser", "Fine.", 5)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    found = {r["conv_id"]: r for r in repair.repaired(repair.damaged(odd, modulus=1 << 32)).collect()}
    assert set(found) == {None, 1, 2, 3} and found[None]["blank"] == 1 and found[None]["gaps"] == 0
    assert found[1]["blank"] == found[1]["truncated"] == 1 and found[2]["duplicate"] == 1 and found[2]["audit"] == "KDI"
    assert found[3]["audit"] == "IR" and found[3]["cost"] == 6 or found[3]["audit"] == "D" and found[3]["cost"] == 4
    assert repair.repaired(repair.damaged(odd.limit(0))).count() == 0
    bad = odd.limit(1).select(F.lit(9).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.expr("cast(x'ff2e' AS string)").alias("text"))
    assert repair.repaired(repair.damaged(bad, modulus=1 << 32)).first()["audit"] == "KI"


def test_all_rows_dropped(spark):
    row = repair.repaired(table(spark, [(4, 1, "user", "x.", 0)])).first()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", sha256().hexdigest())
