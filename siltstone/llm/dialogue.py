"""Conversation structure repair: the cheapest edits that make a conversation s?(ua)+ or nothing.

Each row may be kept, given another role, or deleted, and empty rows may be put in anywhere. A position and
what came last (nothing, s, u, a) make a node, an edit an arc with a cost. Forward and backward minimum
costs tell which arcs lie on a cheapest path; among these the least letter is taken step by step, from all
nodes at once that the letters so far can have led to. States count four, so that a stretch of rows is a
4 x 4 matrix of least costs, and a conversation of any length is mended in stretches that lie in different
tasks: their matrices give the costs at every border.

Defined results. The order of a conversation's rows is turn (nulls first), then role, then the text's hash,
then the hash's equals in any order, which makes no difference. A null role or text is one space; so is a
null conv_id or turn in the number that damage depends on, but null conv_ids are one conversation and null
turns stay null. A row's initial is its role's first character; an empty role has none and can't be kept.
Repeated rows are duplicates like any other. A conversation of which damage leaves nothing has zeros, an
empty audit and the hash of the empty string; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, staged

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
FAR = 1 << 60
#: States: nothing yet, after s, after u, after a. What a row put in, or given another role, leads to from each.
NEXT = (2, 2, 3, 2)
#: Where a kept row leads to, by its initial and the state before it.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {2: "user", 3: "assistant"}
#: Least costs of putting in rows, from state to state.
FILLED = np.array([[0, FAR, 2, 4], [FAR, 0, 2, 4], [FAR, FAR, 0, 2], [FAR, FAR, 2, 0]])
START = (0, FAR, FAR, FAR)
END = (0, FAR, FAR, 0)
FAULTS = ("", "blank", "duplicate", "truncated")

#: The columns that a conversation's digest has.
DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "array<struct<role: string, text: string>>"


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-cost product of two matrices."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


@lru_cache(maxsize=4096)
def _arcs(initial: str, fault: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of what can be done with a row."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault not in (1, 2):
        more = CUT_SHORT if fault == 3 else 0
        out += [("K", q, to, KEEP + more) for q, to in KEPT.get(initial, {}).items()]
        out += [("R", q, NEXT[q], REROLE + more) for q in range(4)]
    return tuple(out)


@lru_cache(maxsize=4096)
def _matrix(initial: str, fault: int) -> np.ndarray:
    """Least costs over a row and what is put in before it."""
    m = np.full((4, 4), FAR)
    for _, a, b, cost in _arcs(initial, fault):
        m[a, b] = min(m[a, b], cost)
    return _times(FILLED, m)


def _based(v) -> tuple[int, tuple[int, ...]]:
    low = int(min(v))
    return (0, tuple(v)) if low >= FAR else (low, tuple(int(x) - low if x < FAR else FAR for x in v))


@lru_cache(maxsize=65536)
def _onward(v: tuple[int, ...], kind: tuple[str, int]) -> tuple[int, tuple[int, ...]]:
    m = _matrix(*kind)
    return _based([min(min(v[q] + int(m[q, r]) for q in range(4)), FAR) for r in range(4)])


@lru_cache(maxsize=65536)
def _back(v: tuple[int, ...], kind: tuple[str, int]) -> tuple[int, tuple[int, ...]]:
    m = _matrix(*kind)
    return _based([min(min(int(m[q, r]) + v[r] for r in range(4)), FAR) for q in range(4)])


def _closed(v) -> list[int]:
    """Backward costs, where rows may still be put in before."""
    return [min(min(int(FILLED[q, r]) + v[r] for r in range(4)), FAR) for q in range(4)]


def transfer(kinds: list[tuple[str, int]]) -> np.ndarray:
    """Least costs from each state before a stretch of rows (initial, fault) to each state after it."""
    m = np.full((4, 4), FAR)
    for q in range(4):
        total, v = 0, tuple(0 if r == q else FAR for r in range(4))
        for kind in kinds:
            more, v = _onward(v, kind)
            total += more
        m[q] = [total + x if x < FAR else FAR for x in v]
    return m


def letters(kinds: list[tuple[str, int]], ahead: tuple[int, ...], behind: tuple[int, ...], last: bool, starts: frozenset[int]) -> tuple[str, frozenset[int], int]:
    """The least letters over a stretch of rows, the states that they can have led to, and the conversation's cost.

    ahead: least costs from the conversation's start to each state before the stretch; behind: those
    from each state after it to the end, rows put in there counted. starts: the states that the letters
    before may have led to. In the last stretch, rows may be put in after the last row too.
    """
    n = len(kinds)
    forward, backward = [(0, tuple(ahead))], [(0, tuple(behind))]
    for kind in kinds:
        base, v = forward[-1]
        more, v = _onward(v, kind)
        forward.append((base + more, v))
    for kind in reversed(kinds):
        base, v = backward[-1]
        more, v = _back(v, kind)
        backward.append((base + more, v))
    backward.reverse()

    def spent(k: int, q: int) -> int:
        """Least cost of reaching state q at position k, rows put in there counted."""
        base, v = forward[k]
        low = min(v[p] + int(FILLED[p, q]) for p in range(4))
        return base + low if low < FAR else FAR

    def left(k: int, q: int) -> int:
        base, v = backward[k]
        return base + v[q] if v[q] < FAR else FAR

    best = min(forward[0][1][q] + left(0, q) for q in range(4))
    out, k, at = [], 0, starts
    while True:
        if k == n and (not last or any(END[q] == 0 for q in at)):
            return "".join(out), at, best
        steps: dict[str, set[int]] = {}
        for q in at:
            before = spent(k, q)
            if before + INSERT + left(k, NEXT[q]) == best:
                steps.setdefault("I", set()).add(NEXT[q])
            if k < n:
                for letter, a, b, cost in _arcs(*kinds[k]):
                    if a == q and before + cost + left(k + 1, b) == best:
                        steps.setdefault(letter, set()).add(b)
        letter = min(steps)
        out.append(letter)
        at, k = frozenset(steps[letter]), k + (letter != "I")


def applied(audit: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """(role, text) of each row of the repaired stretch."""
    out, each = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(each)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[role[0]][state]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out.append((role, text))
    return out


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage, with every original conv_id: one that keeps no row has a row without role."""
    texted = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(texted("conv_id"), F.lit(":"), texted("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(texted("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(texted("text"), "[.!?]", "")).otherwise(texted("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # A dropped row stays as a mark of its conversation, without role and text.
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind != 0, role).alias("role"), F.when(kind != 0, text).alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows of damaged() in order, dealt by ranges, so that a conversation of any size lies in neighbouring partitions.

    Rows alike in all that counts are told apart by their place, that a crowd of them be dealt out too.
    """
    hashed = rows.withColumn("_hash", F.md5("text")).withColumn("_place", F.monotonically_increasing_id())
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("_hash"), F.asc("_place")]
    return hashed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_place")


def fault_columns(role: str = "role", text: str = "text") -> dict:
    """blank and truncated of a row, whether or not another fault comes first."""
    shown = F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    return {"_blank": shown == "", "_cut": ~F.substring(shown, -1, 1).isin(".", "!", "?")}


def _fault(blank: bool, seen: bool, cut: bool) -> int:
    return 1 if blank else 2 if seen else 3 if cut else 0


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Part:
    """The rows of one conversation, or of a stretch of it, in order."""

    def __init__(self):
        self.kinds: list[tuple[str, int]] = []
        self.rows: list[tuple[str, str]] = []
        self.turns: list[int | None] = []
        self.seen: set[bytes] = set()

    def add(self, turn, role: str, text: str, blank: bool, cut: bool) -> None:
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        self.kinds.append((role[:1], _fault(blank, mark in self.seen, cut)))
        self.seen.add(mark)
        self.rows.append((role, text))
        self.turns.append(turn)

    def digest(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        count = [sum(f == k for _, f in self.kinds) for k in (1, 2, 3)]
        illegal = sum(not _legal(a, b) for (a, _), (b, _) in zip(self.kinds, self.kinds[1:]))
        audit, _, cost = letters(self.kinds, START, tuple(_closed(END)), True, frozenset([0]))
        kept = applied(audit, self.rows)
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        return gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), kept


def _whole(key: pa.DataType, messages: bool):
    """For each stretch of a conversation in a partition its digest, as if it were whole, and whether the partition's edge cuts it."""
    types = [key, pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = ["conv_id", "edge", *[c.split()[0] for c in DIGEST.split(", ")], "messages"]
    if not messages:
        types, names = types[:-1], names[:-1]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] if c != "messages" else [{"role": a, "text": b} for a, b in r[i]] for r in rows], t) for i, (c, t) in enumerate(zip(names, types))], names=names)

    def run(batches):
        now, part, first, out = object(), None, True, []
        for batch in batches:
            for conv, turn, role, text, blank, cut in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "_blank", "_cut"))):
                if part is None or conv != now:
                    if part is not None:
                        out.append((now, first, *part.digest()))
                        first = False
                    now, part = conv, _Part()
                if role is not None:
                    part.add(turn, role, text, blank, cut)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if part is not None:
            out.append((now, True, *part.digest()))
        yield batch_of(out)

    return run


def repair(df: DataFrame, messages: bool = False) -> DataFrame:
    """conv_id with the columns of DIGEST for every conversation of rows (conv_id, turn, role, text), as damaged() gives them.

    A row without role only names its conversation. With `messages`, the repaired rows come along as an
    array of (role, text). A conversation that lies within one partition is mended there. Those that a
    border of partitions cuts, at most one for each border, are mended in stretches (see long_repair()).
    """
    key = df.schema["conv_id"]
    ready = ordered(df).withColumns(fault_columns())
    schema = T.StructType([key, T.StructField("edge", T.BooleanType()), *T.StructType.fromDDL(DIGEST + (f", messages {MESSAGES}" if messages else "")).fields])
    found = staged(mapped(ready.drop("_hash"), _whole(to_arrow_type(key.dataType), messages), schema), "dialogue-parts")
    # As many rows at most as there are borders of partitions.
    cut = staged(found.filter("edge").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv_id"), "dialogue-cut")
    if cut.isEmpty():
        return found.drop("edge")
    wanted = F.broadcast(cut.withColumnRenamed("conv_id", "_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = found.join(wanted, same, "left_anti").drop("edge")
    return whole.unionByName(long_repair(df.join(wanted, same, "left_semi"), messages))


def long_repair(df: DataFrame, messages: bool = False) -> DataFrame:
    """repair() of conversations of any size, by stretches: no task holds more than one stretch, a line for each, or a conversation's audit.

    1. Rows are written in order with their stretch (the partition) and place in it.
    2. What role and text a conversation has seen earlier is told by the first place of each.
    3. Each stretch gives its matrix, counts and ends; a line for each stretch gives the costs at its borders.
    4. Each stretch gives its letters for every state in which it may begin; the chain of states chooses.
    5. The repaired lines of a conversation pass through its hash in order, a batch at a time: SHA-256 can't be cut up.
    """
    key = df.schema["conv_id"]
    rows = ordered(df).withColumns(fault_columns()).withColumn("seg", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    rows = staged(rows, "dialogue-rows")
    real = rows.filter(F.col("role").isNotNull()).withColumn("_mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = real.groupBy("conv_id", "_mark").agg(F.min("pos").alias("_first"))
    at = real.select("conv_id", "_mark", "seg", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "_blank", "_cut").alias("r")
    joined = at.join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r._mark") == F.col("f._mark")))
    fault = F.when(F.col("_blank"), 1).when(F.col("pos") > F.col("_first"), 2).when(F.col("_cut"), 3).otherwise(0)
    kinds = staged(joined.select("r.conv_id", "seg", "pos", "turn", "initial", fault.alias("fault")), "dialogue-kinds")

    summary = T.StructType([key, *T.StructType.fromDDL("seg int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, low_turns long, first_turn long, last_turn long, matrix array<long>").fields])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        what = list(zip(pdf["initial"], pdf["fault"]))
        known = pdf["turn"].dropna().astype("int64")
        illegal = sum(not _legal(a, b) for (a, _), (b, _) in zip(what, what[1:]))
        turn = (None,) * 5 if known.empty else (known.min(), known.max(), known.nunique(), known.iloc[0], known.iloc[-1])
        row = (pdf["conv_id"].iloc[0], pdf["seg"].iloc[0], len(what), *[int((pdf["fault"] == k).sum()) for k in (1, 2, 3)], illegal, what[0][0], what[-1][0], *turn, transfer(what).ravel().tolist())
        return pd.DataFrame([row], columns=[f.name for f in summary.fields]).astype({c: "Int64" for c in ("low", "high", "low_turns", "first_turn", "last_turn")})

    parts = staged(kinds.groupBy("conv_id", "seg").applyInPandas(summed, summary), "dialogue-stretches")

    border = T.StructType([key, *T.StructType.fromDDL("seg int, ahead array<long>, behind array<long>, is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long").fields])

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        ms = [np.array(m, np.int64).reshape(4, 4) for m in pdf["matrix"]]
        ahead, behind = [np.array([START])], [np.array(_closed(END))]
        for m in ms:
            ahead.append(_times(ahead[-1], m))
        for m in reversed(ms):
            behind.append(np.minimum((m + behind[-1][None, :]).min(axis=1), FAR))
        behind.reverse()
        known = pdf.dropna(subset=["low"])
        gaps = 0
        if len(known):
            turns = int(known["low_turns"].sum()) - sum(int(a == b) for a, b in zip(known["last_turn"].iloc[:-1], known["first_turn"].iloc[1:]))
            gaps = int(known["high"].max()) - int(known["low"].min()) + 1 - turns
        between = sum(not _legal(a, b) for a, b in zip(pdf["last"].iloc[:-1], pdf["first"].iloc[1:]))
        total = {"gaps": gaps, **{c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": int(pdf["illegal"].sum()) + between, "cost": int(behind[0][0])}
        n = len(pdf)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "seg": pdf["seg"], "ahead": [a.ravel().tolist() for a in ahead[:n]], "behind": [b.tolist() for b in behind[1:]], "is_last": [k == n - 1 for k in range(n)], **total})

    at_borders = staged(parts.groupBy("conv_id").applyInPandas(borders, border), "dialogue-borders")

    choice = T.StructType([key, *T.StructType.fromDDL("seg int, state int, after int, letters string").fields])

    def chosen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, b = left.sort_values("pos"), right.iloc[0]
        what = list(zip(left["initial"], left["fault"]))
        ahead, behind = tuple(map(int, b["ahead"])), tuple(map(int, b["behind"]))
        through = transfer(what)
        ways = [min(ahead[q] + int(through[q, r]) + behind[r] for r in range(4)) for q in range(4)]
        tight = [q for q in range(4) if ahead[q] < FAR and ways[q] == int(b["cost"])]
        out = []
        for q in tight:
            audit, ends, _ = letters(what, ahead, behind, bool(b["is_last"]), frozenset([q]))
            out.append((right["conv_id"].iloc[0], b["seg"], q, min(ends), audit))  # a letter leads from one state to one state
        return pd.DataFrame(out, columns=[f.name for f in choice.fields])

    ways = staged(kinds.groupBy("conv_id", "seg").cogroup(at_borders.groupBy("conv_id", "seg")).applyInPandas(chosen, choice), "dialogue-ways")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        for _, own in pdf.sort_values("seg").groupby("seg", sort=True):
            way = next(w for w in own.itertuples(index=False) if w.state == at)
            out.append(tuple(way))
            at = int(way.after)
        return pd.DataFrame(out, columns=list(pdf.columns))

    path = staged(ways.groupBy("conv_id").applyInPandas(chain, choice), "dialogue-path")

    said = T.StructType([key, *T.StructType.fromDDL("seg int, part int, role string, text string").fields])

    def spoken(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame([], columns=[f.name for f in said.fields], dtype=object)
        left, way = left.sort_values("pos"), right.iloc[0]
        out = applied(way["letters"], list(zip(left["role"], left["text"])), int(way["state"]))
        return pd.DataFrame({"conv_id": [right["conv_id"].iloc[0]] * len(out), "seg": way["seg"], "part": range(len(out)), "role": [x for x, _ in out], "text": [x for _, x in out]}).astype({"role": object, "text": object})

    told = rows.filter(F.col("role").isNotNull()).select("conv_id", "seg", "pos", "role", "text").groupBy("conv_id", "seg").cogroup(path.groupBy("conv_id", "seg")).applyInPandas(spoken, said)
    by = [F.asc_nulls_first("conv_id"), F.asc("seg"), F.asc("part")]
    streams = mapped(told.repartition("conv_id").sortWithinPartitions(*by), _hashed(to_arrow_type(key.dataType)), T.StructType([key, T.StructField("repaired_sha256", T.StringType())]))

    audits = path.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    totals = at_borders.filter("is_last").drop("seg", "ahead", "behind", "is_last")
    none = df.select("conv_id").distinct().alias("n")
    out = none.join(totals.alias("t"), F.col("n.conv_id").eqNullSafe(F.col("t.conv_id")), "left").join(audits.alias("a"), F.col("n.conv_id").eqNullSafe(F.col("a.conv_id")), "left")
    out = out.join(streams.alias("h"), F.col("n.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    if messages:
        every = told.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
        out = out.join(every.alias("m"), F.col("n.conv_id").eqNullSafe(F.col("m.conv_id")), "left")
    also = [F.coalesce("m.messages", F.array().cast(MESSAGES)).alias("messages")] if messages else []
    zero = [F.coalesce(f"t.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("n.conv_id", *zero, F.coalesce("a.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), *also)


def _hashed(key: pa.DataType):
    """The hash of each conversation's lines, that come in order."""

    def run(batches):
        now, total, out = object(), None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                said = f"{role}:{text}"
                if total is None or conv != now:
                    if total is not None:
                        out.append((now, total.hexdigest()))
                    now, total = conv, hashlib.sha256(said.encode())
                else:
                    total.update(f"\n{said}".encode())
        if total is not None:
            out.append((now, total.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], key), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])

    return run
