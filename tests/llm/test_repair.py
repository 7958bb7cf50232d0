import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from recollect.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        old = (role, hashlib.md5(text.encode()).digest())
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            out[conv] += []
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn is not None, turn or 0, *old, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: [((t if k else None), r, x) for k, t, _, _, r, x in sorted(v)] for c, v in out.items()}


def brute(rows):
    """All edit sequences by a search over (row, state) that keeps the least (cost, audit) of the rest."""
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(SPACE)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}  # state -> (cost, audit, lines)
    for i in range(len(rows), -1, -1):
        now = {}
        for s in step:
            options = [(0, "", ())] if i == len(rows) and s in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                cost, audit, lines = best[s]
                options.append((cost + 2, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    if role[:1] in step[s]:
                        cost, audit, lines = best[step[s][role[:1]]]
                        options.append((cost + more, "K" + audit, ((role, text), *lines)))
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if to in step[s]:
                            cost, audit, lines = best[to]
                            options.append((cost + 1 + more, "R" + audit, ((name, text), *lines)))
            now[s] = min(options) if options else (1 << 40, "", ())
        for _ in range(4):
            for s in step:
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in step[s]:
                        cost, audit, lines = now[to]
                        now[s] = min(now[s], (cost + 5, "I" + audit, ((name, ""), *lines)))
        best = now
    cost, audit, lines = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def compare(got, rows):
    want = {c: brute(v) for c, v in damaged(rows).items()}
    have = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}
    assert len(got) == len(have)
    for c in want:
        assert have[c] == want[c], (c, have[c], want[c])
    assert have.keys() == want.keys()


def made(rng, conversations, longest):
    rows = []
    for c in conversations:
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            row = (c, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "ubu"]), rng.choice(["Yes.", "no", " \t\n", "", None, "Why?", "end. ", "a.\x0b", "ü!", "x" * 50]) if rng.random() < 0.4 else f"text {rng.randint(0, 10 ** 6)}" + rng.choice([".", "", "!\n"]))
            rows += [row] * rng.choice([1, 1, 1, 1, 3])
    return rows


def test_short_conversations_against_brute_force(spark):
    rows = made(random.Random(1), [None, *range(400)], 14)
    random.Random(2).shuffle(rows)
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pos string, block int")
    compare(repair.repair(extra).collect(), rows)


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    rows = made(random.Random(3), range(6), 60) + [(1, t, "user", "same") for t in range(100, 160)] + [(2, 7, "assistant", "copy.")] * 40
    compare(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), rows)


def test_no_rows_and_dropped_rows(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    [r] = repair.repair(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, 0, "", empty)


@pytest.mark.parametrize("roles,audit", [("ua", "KK"), ("sua", "KKK"), ("uu", "KR"), ("aa", "RK"), ("u", "D"), ("s", "D"), ("uau", None), ("usa", "KDK"), ("suaau", None)])
def test_clean_texts_by_roles(spark, roles, audit):
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(1, t, names[r], f"text {t}.") for t, r in enumerate(roles)]
    [r] = repair.repair(spark.createDataFrame(rows, SCHEMA), damaged=False).collect()
    want = brute([(t, r, x) for _, t, r, x in rows])
    assert (r["cost"], r["audit"], r["repaired_sha256"]) == want[-3:]
    if audit:
        assert r["audit"] == audit


def test_query_over_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op13_conversation_repair(spark, sf).collect(), rows)
