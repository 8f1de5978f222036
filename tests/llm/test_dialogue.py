"""Conversation repair against a search over all edits, whole and in stretches."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from siltstone.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, edge int, seg string"
COLUMNS = [c.split()[0] for c in dialogue.DIGEST.split(", ")]
DONE, OPEN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"(s?(ua)*u?)?\Z")


def cheapest(rows, faults):
    """(cost, audit, lines): a search by cost, then audit, over every edit."""
    heap, met = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and DONE.match(initials):
            return cost, audit, out
        if (i, initials[-1:]) in met:
            continue
        met.add((i, initials[-1:]))
        steps = [(2, "I", i, "u", "user:"), (2, "I", i, "a", "assistant:")]
        if i < len(rows):
            _, role, text = rows[i]
            more = int(faults[i] == 3)
            steps.append((3, "D", i + 1, "", None))
            if faults[i] not in (1, 2):
                steps += [(2 + more, "R", i + 1, "u", f"user:{text}"), (2 + more, "R", i + 1, "a", f"assistant:{text}")]
                steps += [(more, "K", i + 1, role[0], f"{role}:{text}")] if role else []
        for c, letter, j, initial, line in steps:
            if OPEN.match(initials + initial):
                heapq.heappush(heap, (cost + c, audit + letter, j, initials + initial, out if line is None else (*out, line)))


def plainly(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        convs[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, met = [], set()
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in met else 3 if body[-1] not in ".!?" else 0)
            met.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "sir", "User"]
    texts = ["Hi.", "ok", "What?", "", " \t\x0b", None, "well!", "long text. ", "x  ", "yes.", "é?", "b\u0085"]
    out = [(rng.choice([1, 2, 3, None, 99]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    return out + [(7, None, "user", "same.")] * 30 + [(k, t, ["user", "assistant"][t % 2], f"fine {t}.") for k in range(200, 230) for t in range(4)] + [(300, 1, "user", "word " * 60_000)]


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in some_rows()], SCHEMA).repartition(5)


def told(df):
    got = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


def test_repair_against_search(spark, convs):
    assert told(dialogue.repair(dialogue.damaged(convs))) == plainly(some_rows())


def test_stretches_against_search(spark, convs):
    """Adaptive execution off, so that 16 partitions cut nearly every conversation."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    kept = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        damaged = dialogue.damaged(convs)
        rows = dialogue.long_repair(damaged, True)
        assert told(rows) == plainly(some_rows())
        for r in rows.collect():
            assert hashlib.sha256("\n".join(f"{m['role']}:{m['text']}" for m in r["messages"]).encode()).hexdigest() == r["repaired_sha256"]
        assert told(dialogue.repair(damaged, True)) == plainly(some_rows())
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


def test_any_cut_gives_the_same_letters():
    rng = random.Random(9)
    for _ in range(200):
        kinds = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 9))]
        behind = tuple(dialogue._closed(dialogue.END))
        whole, _, cost = dialogue.letters(kinds, dialogue.START, behind, True, frozenset([0]))
        k = rng.randint(1, len(kinds))
        parts = [kinds[:k], kinds[k:]] if k < len(kinds) else [kinds]
        ms = [dialogue.transfer(p) for p in parts]
        ahead, back = [dialogue.np.array([dialogue.START])], [dialogue.np.array(behind)]
        for m in ms:
            ahead.append(dialogue._times(ahead[-1], m))
        for m in reversed(ms):
            back.append(dialogue.np.minimum((m + back[-1][None, :]).min(axis=1), dialogue.FAR))
        back.reverse()
        out, at = "", frozenset([0])
        for j, part in enumerate(parts):
            more, at, c = dialogue.letters(part, tuple(map(int, ahead[j][0])), tuple(map(int, back[j + 1])), j == len(parts) - 1, at)
            out += more
            assert c == cost
        assert out == whole


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair(dialogue.damaged(empty)).collect() == []


def test_query_against_search(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op13_conversation_repair(spark, at)) == plainly(rows)
