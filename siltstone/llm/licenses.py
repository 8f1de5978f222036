"""License scans: an exact set-similarity join of text blocks with license templates.

Every line and every paragraph (lines between blank ones) is a block, a set of words; so is a
template. A block matches where it holds at least `threshold` of the template's words. Words are
ordered by how many documents hold them, over the whole corpus, rarest first: a match must hold one
of the template's first |T| - need + 1 words (prefix filter), have at least `need` words (length
filter), and at each common word leave room for the rest (positional filter). What the join finds is
then held against the block's text: that share of the template's words must stand there in order,
within no more than |T| / threshold words, so that scattered words and a notice with further terms
("nc") are no match; and a template whose words another one of the same place holds too, and more, goes.

Defined results: null is the empty text, with no words, places or labels and score 0; ties in
document frequency are broken by the word; repeated rows each get their own result; an empty table
gives no rows; columns of df named like the results are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, texts, widened

# The phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wordings that license notices commonly use.
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-nc-nd-4.0": "licensed under cc by nc nd 4 0",
    "cc-by-nc-sa-4.0": "licensed under cc by nc sa 4 0",
    "cc-by-nd-4.0": "licensed under cc by nd 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.9

_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    """Runs of digits, lower-cased letters and bytes from 0x80."""
    return text.translate(_WORDS).split()


def places(found: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    line = b" %b " % b" ".join(found)
    out = []
    for phrase, label in phrases.items():
        needle = b" %b " % phrase.encode()
        at, last, words_before = line.find(needle), 0, 0
        while at >= 0:
            words_before += line.count(b" ", last, at)  # what stands before `last` has been counted
            last = at
            out.append((words_before, label))
            at = line.find(needle, at + 1)
    return out


def blocks(text: bytes) -> list[bytes]:
    """Lines, and paragraphs of several lines."""
    lines = text.split(b"\n")
    out = list(lines)
    run: list[bytes] = []
    for line in [*lines, b""]:
        if line.strip():
            run.append(line)
        else:
            if len(run) > 1:
                out.append(b" ".join(run))
            run = []
    return out


def in_order(block: list[bytes], template: list[bytes], threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, share) of the windows of |template| / threshold words of the block that hold at least that share of the template in order."""
    width, need = int(len(template) / threshold + 1e-9), max(1, math.ceil(threshold * len(template) - 1e-9))
    mask: dict[bytes, int] = {}
    for k, w in enumerate(template):
        mask[w] = mask.get(w, 0) | 1 << k
    hits = [0]
    for w in block:
        hits.append(hits[-1] + (w in mask))
    full, out = (1 << len(template)) - 1, []
    for a, w in enumerate(block):
        z = min(len(block), a + width)
        if w not in mask or hits[z] - hits[a] < need:
            continue
        row, end, most = full, a, 0  # longest common subsequence, a bit for each word of the template
        for b in range(a, z):
            both = row & mask.get(block[b], 0)
            row = ((row + both) | (row - both)) & full
            n = len(template) - row.bit_count()
            if n > most:
                most, end = n, b + 1
        if most >= need:
            out.append((a, end, most / len(template)))
    return out


class Join:
    """The templates, indexed by their prefixes under a global order of words."""

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.frequency, self.threshold = frequency, threshold
        self.index: dict[bytes, list[tuple[str, int]]] = {}
        self.sorted: dict[str, list[bytes]] = {}
        self.wording = {name: wording.encode().split() for name, wording in templates.items()}
        self.need: dict[str, int] = {}
        for name, wording in templates.items():
            t = sorted(set(wording.encode().split()), key=self.rank)
            self.sorted[name] = t
            self.need[name] = max(1, math.ceil(threshold * len(t) - 1e-9))
            for k, w in enumerate(t[: len(t) - self.need[name] + 1]):
                self.index.setdefault(w, []).append((name, k))
        self.prefixes = set(self.index)

    def rank(self, word: bytes) -> tuple[int, bytes]:
        return self.frequency.get(word, 0), word

    def match(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(template, containment) of every template that the block holds."""
        have = set(block)
        if self.prefixes.isdisjoint(have):
            return []
        out = []
        ranks = sorted(self.rank(w) for w in have)
        place = {w: k for k, (_, w) in enumerate(ranks)}
        seen: set[str] = set()
        for w in sorted(self.prefixes & have, key=self.rank):
            for name, k in self.index[w]:
                if name in seen or len(have) < self.need[name]:
                    continue
                t = self.sorted[name]
                before = sum(x in have for x in t[:k])
                if before + 1 + min(len(t) - k - 1, len(have) - place[w] - 1) < self.need[name]:
                    continue
                seen.add(name)
                common = sum(x in have for x in t)
                if common >= self.need[name]:
                    out.append((name, common / len(t)))
        return out

    def verified(self, block: list[bytes]) -> list[tuple[str, float]]:
        """The matches of the block whose words stand in order, without what lies within a match of more words; the share is that in order."""
        at = {name: in_order(block, self.wording[name], self.threshold) for name, _ in self.match(block)}
        out = []
        for name, places_ in at.items():
            mine = set(self.wording[name])
            larger = [p for other, ps in at.items() if mine < set(self.wording[other]) for p in ps]
            own = [s for a, z, s in places_ if not any(x < z and a < y for x, y, _ in larger)]
            if own:
                out.append((name, max(own)))
        return out

    def scan(self, text: bytes, found: list[bytes] | None = None) -> list[tuple[str, float]]:
        if self.prefixes.isdisjoint(words(text) if found is None else found):
            return []
        best: dict[str, float] = {}
        for block in blocks(text):
            for name, share in self.verified(words(block)):
                best[name] = max(best.get(name, 0.0), share)
        return sorted(best.items())


def frequencies(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """How many documents hold each word of the templates: as many rows as these have words."""
    vocabulary = {w for t in templates.values() for w in t.encode().split()}

    def count(batches):
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for x in texts(batch, text):
                for w in vocabulary.intersection(words(x)):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total]), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    each = mapped(df.select(text), count, "word string, n long")
    return {r["word"].encode(): r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """df's columns but the text, with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    join = df.sparkSession.sparkContext.broadcast(Join(frequencies(df, text, templates), templates, threshold))
    new = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in new.split(", ")]
    rest = [c for c in df.columns if c != text and c not in names]

    def run(batches):
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = []
            for x in texts(batch, text):
                found = words(x)
                base = places(found)
                own = join.value.scan(x, found)
                at = [p for p, _ in base]
                mine = sorted({label for _, label in base})
                score = max([share for _, share in own] + [1.0] * bool(base), default=0.0)
                out.append((len(found), len(base), min(at, default=None), max(at, default=None), ",".join(mine), ",".join(sorted({*mine, *(n for n, _ in own)})), score))
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, *[pa.array([r[i] for r in out], t) for i, t in enumerate(types)]], names=[*rest, *names])

    return mapped(df.select(*rest, text), run, widened(df, rest, new))


