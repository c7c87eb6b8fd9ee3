"""Conversation repair against brute force: every cheapest edit by dynamic programming over (row, state) with whole audits."""

import hashlib
import random
import re
import zlib

import pytest

from strata.llm import conversations

ACCEPTED = re.compile(r"(s?(ua)+)?")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def best(rows, insert=5):
    """(faults, (cost, audit, repaired lines)), by the definition: the automaton's state is the last role initial."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {q: (0, "", ()) if q in ("", "a") else (1e9, "", ()) for q in NEXT}
    for k in range(len(rows), -1, -1):
        now = dict(after) if k == len(rows) else {}
        if k < len(rows):
            (_, role, text), fault = rows[k], faults[k]
            for q in NEXT:
                options = [(2, "D", q, None)]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    if role[:1] and (role[:1] == NEXT[q] or (q == "" and role[:1] == "s")):
                        options.append((more, "K", role[:1], f"{role}:{text}"))
                    options.append((1 + more, "R", NEXT[q], f"{ROLE[NEXT[q]]}:{text}"))
                now[q] = min(((c + after[to][0], letter + after[to][1], ((line,) if line is not None else ()) + after[to][2]) for c, letter, to, line in options), key=lambda x: x[:2])
        for _ in range(4):  # insertions, several in a row as well
            for q in NEXT:
                to = now[NEXT[q]]
                now[q] = min(now[q], (insert + to[0], "I" + to[1], (f"{ROLE[NEXT[q]]}:", *to[2])), key=lambda x: x[:2])
        after = now
    return faults, after[""]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damaged([r for r in rows if r[0] == conv]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, (cost, audit, lines) = best(own)
        turns = {r[0] for r in own if r[0] is not None}
        roles = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
        assert ACCEPTED.fullmatch("".join(line[:1] for line in lines))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "It ends", "and so on. \n", "", " \t", "é世?", "Yes.", None, "x" * 500 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.6 else f"turn {turn} of {conv}."))
    for turn in range(400):  # one long conversation, in stretches of a single role
        rows.append((900, turn, ("user", "assistant")[turn // 7 % 2] if turn % 50 > 20 else ("user", "assistant")[turn % 2], f"row {turn % 90}" + rng.choice([".", "?", ""])))
    rows += [(901, 3, "user", "same.")] * 40 + [(901, 4, "assistant", "other.")] * 3
    rows += [(902, None, "user", "all null."), (902, None, "assistant", "really.")]
    rows += [(None, 1, "user", "no conversation id."), (None, 2, "assistant", "none.")]
    rows += [(903, 0, "system", "only a system row.")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("clash"), "part": F.lit(1), "_conv": F.lit(0)}).repartition(6)


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair_equals_brute_force(spark, talks):
    want = expected(talks)
    assert results(conversations.repair(frame(spark, talks))) == want
    assert any("D" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_chunked_repair_converges_to_the_same(spark, talks):
    passes = []
    assert results(conversations.repair(frame(spark, talks), chunk_rows=3, passes=passes)) == expected(talks)
    assert passes[-1] == 0 and len(passes) > 1 and passes[0] > 20  # speculation failed somewhere and was mended


def test_cheap_insertions_are_traced(monkeypatch):
    """At a cost of 5 a deletion always beats an insertion; at 1 they take part, also at the ends of chunks."""
    rng = random.Random(6)
    monkeypatch.setattr(conversations, "INSERT", 1)
    conversations.before.cache_clear()
    try:
        inserted = 0
        for _ in range(300):
            rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", f"{t}.", "cut", " "])) for t in range(rng.randrange(1, 9))]
            faults, (cost, audit, lines) = best(rows, insert=1)
            chain = [(role[:1], {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (_, role, _), f in zip(rows, faults, strict=True)]
            roles, texts, at = [r[1] for r in rows], [r[2] for r in rows], rng.randrange(len(rows))
            after, low = conversations.sweep(chain[at:], conversations.settled(conversations.FINAL))
            before, less = conversations.sweep(chain[:at], after[0])
            first, state = conversations.trace(chain[:at], before, less, conversations.START, False)
            second, _ = conversations.trace(chain[at:], after, low, state, True)
            assert (before[0][0] + sum(less) + sum(low), first + second) == (cost, audit)
            got = [*conversations.repaired(roles[:at], texts[:at], first, conversations.START), *conversations.repaired(roles[at:], texts[at:], second, state)]
            assert tuple(got) == lines
            inserted += "I" in audit
        assert inserted > 100
    finally:
        conversations.before.cache_clear()


def test_no_rows_and_rows_all_dropped(spark):
    drop = next(t for t in range(10_000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, drop, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert results(conversations.repair(df)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(df.where("false")).count() == 0


def test_rows_taken_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Hello.")]
    got = results(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damage=False))
    assert got[1][4:7] == (1, 2, "KDKK")
