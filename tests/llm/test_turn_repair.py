"""Conversation repair against enumeration of all edits, its SQL, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tests.compare import connect, differences
from wayfold.llm.turn_repair import repair, repaired
from wayfold.llm.turn_repair_sql import repair_sql

SCHEMA = "conv_id long, turn long, role string, text string, kind string, place string, known string"


def brute_damage(rows):
    """Plain version: conversation -> turns (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        talk = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        talk += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for talk in out.values():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute_faults(talk):
    seen, out = set(), []
    for _, role, text in talk:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(talk):
    """The least of all edits that cost no more than deleting everything, tried one after another."""
    faults, best = brute_faults(talk), (3 * len(talk), "D" * len(talk), "")

    def go(k, cost, audit, lines):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(talk) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] if x[:1] != ":" else "-" for x in lines)):
            best = min(best, (cost, audit, "\n".join(lines)))
        for r in ("user", "assistant"):
            go(k, cost + 2, audit + "I", [*lines, f"{r}:"])
        if k < len(talk):
            (_, role, text), late = talk[k], faults[k] == "truncated"
            go(k + 1, cost + 3, audit + "D", lines)
            if faults[k] not in ("blank", "duplicate"):
                go(k + 1, cost + late, audit + "K", [*lines, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(k + 1, cost + 2 + late, audit + "R", [*lines, f"{r}:{text}"])

    go(0, 0, "", [])
    return best


def brute_rows(rows, edits=True):
    out = []
    for conv, talk in brute_damage(rows).items():
        faults, numbers = brute_faults(talk), {t for t, _, _ in talk if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit, text = brute_repair(talk) if edits else (None, None, None)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", None) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def talks(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 4)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "no", "?!", "", " \t\n\x0b", None, "Again!", "Again!", "漢字。", "end. \n"])))
    return rows


def test_equals_all_edits(spark):
    rows = talks(120, 1)
    rows += [(None, None, None, None), (None, 4, "user", "Hi."), (-7, 0, "user", "a\nb: c?"), (2**62, 2**61, "assistant", "Large.")]
    assert found(repair(frame(spark, rows))) == brute_rows(rows)


def test_faults_and_gaps_of_longer_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "Again!", f"turn {t}."])) for c in range(20) for t in range(40)]
    rows += rows[:60]  # repeated rows are duplicates
    got = [r[:6] for r in found(repair(frame(spark, rows)))]
    assert got == [r[:6] for r in brute_rows(rows, edits=False)]


def test_equals_sql(spark, sf_dir):
    assert differences(repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")), connect(sf_dir), repair_sql()) == ""


def test_query_equals_enumeration_on_table(spark, sf_dir, table):
    """Whole table: faults everywhere, edits of conversations that are short enough to enumerate."""
    from wayfold.llm import queries

    rows = [tuple(r) for r in table("conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: r for r in found(queries.op11_turn_repair(spark, sf_dir))}
    assert [r[:6] for r in sorted(got.values(), key=repr)] == [r[:6] for r in brute_rows(rows, edits=False)]
    short = {c for c, t in brute_damage(rows).items() if len(t) <= 3}
    want = brute_rows([r for r in rows if r[0] in short])
    assert want and [got[r[0]] for r in want] == want


def test_repeated_rows_long_texts_and_a_long_conversation(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Short."), *[(2, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]]
    plain = frame(spark, rows).selectExpr("conv_id", "turn", "role", "text", "0 AS place")
    got = {r.conv_id: r for r in repaired(plain).collect()}
    assert (got[1].cost, got[1].audit, got[1].text) == (0, "KK", f"user:{long}\nassistant:Short.")
    assert (got[2].cost, got[2].audit) == (0, "K" * 3000)


@pytest.mark.parametrize("drop", [False, True])
def test_empty(spark, drop):
    rows = [] if not drop else [(c, t, "user", "x.") for c in range(200) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = found(repair(frame(spark, rows)))
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in sorted({r[0] for r in rows}, key=lambda c: repr((c,)))]
