"""Structure repair against a plain search over all edit lists, and small fixed cases."""

import hashlib
import heapq
import random
import zlib

import pytest

from worktrail.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        if case == 4:
            role = "user"
        if case:
            out += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def least(rows):
    """(cost, audit, repaired): the shortest, then least path, by a queue of whole paths."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        made = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 5, audit + "I", i, made[0], (*out, made + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, made[0], (*out, f"{made}:{text}")))
            if (state, role[:1]) in NEXT:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))


def plain(rows, ids):
    by = {i: [] for i in ids}
    for row in rows:
        by[row[0]].append(row)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        for _, _, role, text in own:
            bare = text.rstrip(WHITE)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = least(marked)
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], bad, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def invented(n, longest, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Sys", "ua"])
            text = rng.choice(["Yes.", "No", f"Number {turn}!", f"So {conv}? \n", "", " \t", "é.", "x" * 50_000])
            rows.append((conv, turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, role, text))
    seen = {}
    for r in rows:  # ties stand by role and a hash: leave none whose order counts
        seen[r[:2]] = r
    return list(seen.values())


@pytest.mark.parametrize("window", [4096, 8], ids=["one segment", "many segments"])
def test_equal_to_plain(spark, monkeypatch, window):
    rows = invented(150, 14, 1) + [(None, i, "user" if i % 2 else "system", f"{i}.") for i in range(40)]
    rows += [(900, 1, None, None), (901, None, None, "a."), (902, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as at", "'x' as fault", "2 as letter", "3 as row")
    if window != repair.WINDOW:  # workers read the module anew, so the size goes along
        from pyspark import cloudpickle
        monkeypatch.setattr(repair, "WINDOW", window)
        cloudpickle.register_pickle_by_value(repair)
    try:
        got = told(repair.digest(df.repartition(5)))
    finally:
        if window == 8:
            cloudpickle.unregister_pickle_by_value(repair)
    assert got == plain(harmed(rows), {r[0] for r in rows})


def rows_of(roles, text="t."):
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    return [(1, i, names[c], f"{text}{i}.") for i, c in enumerate(roles)]


@pytest.mark.parametrize("roles,cost,audit", [
    ("sua", 0, "KKK"), ("suaua", 0, "KKKKK"), ("s", 2, "D"), ("u", 2, "D"), ("uu", 1, "KR"),
    ("au", 2, "RR"), ("uaa", 2, "DRK"), ("uat", 2, "DRR"), ("us", 1, "KR")])
def test_small_cases(spark, roles, cost, audit):
    got = told(repair.repaired(spark.createDataFrame(rows_of(roles), TURNS)))
    want = plain(rows_of(roles), {1})
    assert got == want
    assert got[0][6] == cost
    if roles not in ("uaa", "uat"):
        assert got[0][7] == audit


def test_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", ""])) for i in range(9000)]
    assert told(repair.repaired(spark.createDataFrame(rows, TURNS))) == plain(rows, {1})


def test_nothing_left_and_empty(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "a.")], TURNS)
    assert told(repair.digest(df)) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert told(repair.digest(spark.createDataFrame([], TURNS))) == []
