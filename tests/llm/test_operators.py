"""Operators over small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, licenses, lm, media, mixing, neardup, pages, simhash, toxicity
from siltstone.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, count string"
LONG = "the quick brown fox " * 4000
BASE = " ".join(f"word{k}" for k in range(120))


def rows():
    return [
        (0, BASE, "en", "s0", 1, 7, "x"), (1, BASE, "en", "s0", 1, 7, "x"), (2, BASE.replace("word50", "other"), "en", "s1", 1, 7, "x"),
        (3, None, None, None, None, None, None), (4, "", "en", "s1", 0, 1, "y"), (5, LONG, "en", None, 1, 1, None), (6, "ein wort und noch ein wort", "de", "s0", 1, 1, "z"),
        (6, "ein wort und noch ein wort", "de", "s0", 1, 1, "z"), (None, "no id here but some text", "en", "s2", 1, 1, "z"), (9, "123 456 !!", "en", "s2", 1, 1, "z"),
        (10, "All rights reserved. Licensed under CC BY 4.0\nyou idiot", "en", "s1", 1, 1, ""),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k == 10)) for k in range(11)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def words(t):
    return (t or "").encode().split()


def test_mixing(docs, empty):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * total, set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert 0 <= r["copies"] <= 2
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.edits(docs).collect()
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, r in enumerate(data):
        t, n = r[1] or "", data[(k + 1) % len(data)][1] or ""
        cut = len(t) // 4
        want[r[0], len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[0] == prints[1] and prints[3] == prints[4] == "0" * 16
    far = bin(int(prints[0], 16) ^ int(prints[2], 16)).count("1")
    assert far < 16 and all(0 <= r["near_edited"] <= 1 for r in got)
    assert simhash.edits(empty).count() == 0


def test_fingerprints_by_hand(docs):
    def h(seed, *parts):
        for x in parts:
            seed = xxhash.xxh64(x, seed=seed).intdigest()
        return seed

    def fingerprint(text):
        found = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        sums, whole = [0] * 64, 0
        for k, w in enumerate(found):
            pair = [w, *found[k + 1 : k + 2]]
            weight = min(3, sum(map(len, pair)) // 6) + 1
            term = h(42, *[x.encode() for x in pair]) & ~3 & (1 << 64) - 1 | weight - 1
            bits = h(42, term.to_bytes(8, "little"))
            whole += weight
            for i in range(64):
                sums[i] += weight * (bits >> i & 1)
        # Bit k of the fingerprint: sums come in two lanes, of the lower and the upper half.
        return f"{sum(1 << i for i in range(64) if 2 * sums[i] > whole):016x}"

    got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.edits(docs).collect())
    assert got == Counter((r[0], fingerprint(r[1])) for r in rows())


def test_order_of_documents_in_many_buckets(spark):
    data = [(k * 7 % 1000, f"t{k}") for k in range(500)] + [(None, "n"), (5, "a"), (5, "b"), (5, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    line = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(line, [*line[1:], line[0]]))
    for each in (4, 1, 100_000):
        out = simhash.in_order(df, "doc_id", each)
        assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()) == want
    assert simhash.in_order(df, "doc_id", 4).select("bucket").distinct().count() > 60


def test_simhash_search_is_complete(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    near_ = []
    for k, x in enumerate(base):
        y = x & (2**64 - 1)
        for bit in rng.choice(64, k % 6, replace=False):
            y ^= 1 << int(bit)
        near_.append(y - 2**64 if y >= 2**63 else y)
    q = spark.createDataFrame([(x,) for x in base], "fp long")
    r = spark.createDataFrame([(x,) for x in base + near_ + near_], "fp long")
    every = set(base + near_)
    want = {(a, b) for a in base for b in every if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = [(x["query"], x["fp"]) for x in simhash.near(q, r, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates(spark, docs, empty):
    got = neardup.classes(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["class_id"], r["class_size"]))
    assert by[0] == by[1] == by[2] == {(0, 3)} and by[3] == by[4] == {(3, 2)} and by[6] == {(6, 2)} and by[None] == {(None, 1)}
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["0", "10", "3", "5", "6", "9", "None"]
    assert neardup.classes(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(80, 300)))]
        for _ in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.01, 0.03]))):
                t[int(rng.integers(0, len(t)))] = f"n{rng.integers(0, 9999)}"
            texts.append(t + (passage if g % 2 else []))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)
            if neardup.distance(texts[i], texts[j], most) <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {k: find(k) for k in range(len(texts))}


def test_edited_pairs_are_found(spark):
    # Pairs with scattered word substitutions, all within the operator's similarity.
    rng = np.random.default_rng(21)
    texts, percents = [], [3, 6, 10, 13, 16]
    for k in range(150):
        a = [f"w{x}" for x in rng.integers(0, 20_000, int(rng.integers(60, 250)))]
        b = list(a)
        for at in rng.choice(len(a), int(len(a) * percents[k % 5] / 100), replace=False):
            b[at] = f"n{rng.integers(0, 10**9)}"
        texts += [a, b]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    for k, percent in enumerate(percents):
        pairs = [i for i in range(0, 300, 2) if i // 2 % 5 == k]
        assert sum(got[i] == got[i + 1] for i in pairs) >= 0.9 * len(pairs), percent
    assert all(got[i] == i for i in range(0, 300, 2))


def test_crowds_that_share_a_passage_keep_their_links(spark):
    # Many texts share a passage and are otherwise unlike, but for pairs of copies; they are dealt anew without it.
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for _ in range(200):
        t = [f"w{x}" for x in rng.integers(0, 10**6, 60)] + passage
        texts.append(t)
        if len(texts) % 5 == 0:
            u = list(t)
            u[int(rng.integers(0, 60))] = "changed"
            texts.append(u)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    want, first = {}, {}
    for k, t in enumerate(texts):
        want[k] = first.setdefault(tuple(t[:20] if "changed" not in t[:20] else texts[k - 1][:20]), k)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == want


def test_what_few_texts_of_a_crowd_hold_stays_in_its_task(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(12))
    sent = []

    def noted(df, run, schema):
        out = mapped(df, run, schema)
        if schema == "kmer long, n long":
            sent.append(out)
        return out

    mapped = neardup.mapped
    monkeypatch.setattr(neardup, "mapped", noted)
    for n in (100, 400):
        lines = [f"{passage} " + " ".join(f"t{i}w{k}" for k in range(40)) for i in range(n)] + [f"only{k} here" for k in range(neardup.CROWD)] + ["", "short"] * neardup.CROWD
        df = spark.createDataFrame([(b"%d" % k, x) for k, x in enumerate(lines)], "node binary, text string").repartition(4)
        known = np.sort(neardup.kmers(passage.encode())[:2])
        held = Counter(x for line in lines for x in set(neardup.kmers(line.encode()).tolist()) | set(neardup.uncovered(line.encode(), known).tolist()))
        want = {x for x, times in held.items() if times > neardup.CROWD} | set(known.tolist())
        assert set(neardup._common(df, known).tolist()) == want and len(want) > 10
        assert sent[-1].count() < 20 * n  # a text of a crowd has 80 k-mers and words of its own


def test_components_in_one_task_and_in_rounds_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(b"%03d" % a, b"%03d" % b) for a, b in rng.integers(0, 300, (260, 2)).tolist()]
    df = spark.createDataFrame(edges, "a binary, b binary")
    few = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(df).collect()}
    monkeypatch.setattr(neardup, "FEW_LINKS", 0)
    assert {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(df).collect()} == few


def test_drifting_chains_stay_whole(spark, monkeypatch):
    # Every text in one bucket, so that those that leave with a leader are the links to those that stay.
    monkeypatch.setattr(neardup, "sketches", lambda line, common=None: np.array([7], np.uint64))
    texts = []
    for chain in range(6):
        t = [f"c{chain}w{k}" for k in range(100)]
        for step in range(8):
            texts.append(list(t))
            t[12 * step : 12 * step + 12] = [f"c{chain}s{step}n{k}" for k in range(12)]
    near = [[neardup.distance(a, b, 20) <= 20 for b in texts] for a in texts]
    assert all(near[i][j] == (i // 8 == j // 8 and abs(i - j) <= 1) for i in range(48) for j in range(48))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {k: k // 8 * 8 for k in range(48)}


def test_a_page_at_two_addresses_keeps_its_text(spark):
    menu = "<div>home news sport culture travel money weather jobs</div>"
    body = ["<div>" + " ".join(f"p{k}w{x}" for x in range(30)) + "</div>" for k in range(3)]
    rows = [(0, "http://h/a", menu + body[0]), (1, "http://h/b", menu + body[0]), (1, "http://h/b", menu + body[0]), (2, "http://h/c", menu + body[1]), (3, "http://h/d", menu + body[2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in pages.extract(df).collect())
    assert got == sorted((k, " ".join(f"p{max(0, k - 1)}w{x}" for x in range(30))) for k, *_ in rows)


def test_furniture_of_a_large_host_goes_whatever_shards_it_is_in(spark):
    n = 2 * pages.SHARD_PAGES + 50
    rare = "<div>one two three four five six seven eight</div>"
    rows = [(k, f"http://h/{k}", (rare if k % 100 == 7 else "") + "<div>" + " ".join(f"p{k}w{x}" for x in range(20)) + "</div>") for k in range(n)]
    for at in range(0, 16):  # pairs of pages that alone share a line, most of them in different shards
        for k in (20 + at, 220 + at):
            rows[k] = (k, rows[k][1], f"<div>{' '.join(f'm{at}x{j}' for j in range(8))}</div>" + rows[k][2])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got == {k: " ".join(f"p{k}w{x}" for x in range(20)) for k in range(n)}


SITE = "follow us on all our channels for news of the day"


def site_pages(n, host="h"):
    """Marked pages of a host whose footers hold SITE, and the text of each: every third also holds SITE in its article, unnamed."""
    rows, want = [], {}
    for k in range(n):
        own = " ".join(f"p{k}w{x}" for x in range(20))
        told = f"what stands in adverts is told in articles too {k % 4}"
        inside = f"<div>{SITE}</div>" if k % 3 == 0 else ""
        rows.append((k, f"http://{host}/{k}", f'<article><p>{own}</p>{inside}<p>{told}</p><p>they say {SITE} and go</p></article><div class="ad">what stands in adverts is told in articles too {k % 5}</div><footer>about us. {SITE}</footer>'))
        want[k] = f"{own}\n\n{told}\n\nthey say {SITE} and go"
    return rows, want


@pytest.mark.parametrize("copies", [1, 2])
def test_site_furniture_goes_from_marked_articles(spark, copies):
    rows, want = site_pages(9)
    two = [(100 + k, f"http://two/{k}", html_) for k, _, html_ in rows[:2]]  # two pages don't tell what is furniture
    df = spark.createDataFrame((rows + two) * copies, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["text"]) for r in pages.extract(df).collect())
    want |= {100: want[0].replace("\n\n", f"\n\n{SITE}\n\n", 1), 101: want[1]}
    assert got == Counter({(k, x): copies for k, x in want.items()})


def test_site_furniture_goes_whatever_shards_it_is_in(spark, monkeypatch):
    rows, want = site_pages(90)
    small, kept = site_pages(2, "small")
    rows += [(1000 + k, url, html_) for k, url, html_ in small]
    want |= {1000: kept[0].replace("\n\n", f"\n\n{SITE}\n\n", 1), 1001: kept[1]}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for name, value in (("SHARD_PAGES", 10), ("SHARD_CHARS", 3_000)):
        with monkeypatch.context() as m:
            m.setattr(pages, name, value)
            assert {r["page_id"]: r["text"] for r in pages.extract(df).collect()} == one == want


def test_furniture_of_under_half_of_a_host_stays_in_articles(spark):
    line = "this sentence is furniture of a part of the host"
    for shown, goes in ((4, False), (5, False), (6, True)):  # of ten pages
        rows = [(k, f"http://h/{k}", f"<article><p>p{k} is told</p><p>{line}</p></article>" + (f"<footer>{line}</footer>" if k < shown else "")) for k in range(10)]
        got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: f"p{k} is told" + ("" if goes else f"\n\n{line}") for k in range(10)}


def test_clashing_columns_of_pages(spark):
    rows = [(1, "http://h/a", "<article><p>one</p></article>", "a", "b", "c", True, 5), (2, "http://h/b", "<div>two</div>", "d", "e", "f", False, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _own string, c0 string, _whole boolean, _n long")
    got = sorted(tuple(r) for r in pages.extract(df).collect())
    assert got == [(1, "http://h/a", "a", "b", "c", True, 5, "one", 3), (2, "http://h/b", "d", "e", "f", False, 6, "two", 3)]


def test_clashing_columns_of_near_duplicates(spark):
    rows = [(1, BASE, "a", "b", 1, "c", "x"), (2, BASE, "d", "e", 2, "f", "y"), (3, "quite another text than that one", "g", "h", 3, "i", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string, _k string, _times int, _hash string, c0 string")
    assert sorted(tuple(r) for r in neardup.deduplicate(df).collect()) == [rows[0], rows[2]]


def test_components(spark):
    edges = [(b"a", b"b"), (b"b", b"c"), (b"d", b"e"), (b"z", b"c"), (b"q", b"q")] + [(b"%03d" % k, b"%03d" % (k + 1)) for k in range(40)]
    df = spark.createDataFrame(edges, "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(df).collect()}
    assert got[b"c"] == got[b"z"] == b"a" and got[b"e"] == b"d" and got[b"040"] == b"000"


def test_bpe(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    library, file = Tokenizer.from_file(tokenizer_file()), tokenizer_file()
    for often in (1, 10**9):
        monkeypatch.setattr(bpe, "OFTEN", often)
        got = bpe.decode(bpe.encode(docs, file), file).collect()
        assert len(got) == len(rows())
        want = Counter()
        for r in rows():
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            want[r[0], np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode(empty, file).count() == 0


def test_bpe_decoding_of_any_ids(spark):
    file = tokenizer_file()
    data = [(0, np.array([320, 49407, 999_999, 5], "<u4").tobytes(), "clash"), (1, b"", None), (2, None, None)]
    df = spark.createDataFrame(data, "doc_id long, ids binary, decoded string")
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(file).decode([320, 49407, 5], skip_special_tokens=False)
    out = bpe.decode(df, file)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {0: want, 1: "", 2: ""}
    assert {r["id"] for r in bpe.distinct_ids(df).collect()} == {320, 49407, 999_999, 5}
    assert bpe.decode(df.limit(0), file).count() == 0


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_lm(docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "STEPS", 60)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = lm.score(docs, fold).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    lines = [(r[0], [*((r[1] or "").encode().lower().split()), None]) for r in rows()]
    c = Counter()
    for i, line in lines:
        if not held(i):
            c.update(line)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in lines)
    assert sorted((str(r["doc_id"]), not r["_train"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    if frequent == 3:
        assert lm.score(empty, F.lit(True)).count() == 0
        assert all(r["base_score"] == 0 for r in lm.score(docs, F.lit(False)).collect())


def test_lm_score_token_by_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 40)
    rng = np.random.default_rng(4)
    names = [f"{chr(97 + k % 26)}{k}w{k % 7}" for k in range(3000)]
    lines = [[names[x] for x in np.minimum(2999, rng.zipf(1.3, int(rng.integers(0, 120))))] for _ in range(150)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") % 3 != 0).collect()}
    train = [t for k, t in enumerate(lines) if k % 3]
    count = Counter(w.encode() for t in train for w in t)
    ranked = sorted(count, key=lambda w: (-count[w], w))
    own = {w: k for k, w in enumerate(ranked[: lm.OWN])}
    member = {w: k for k, w in enumerate(ranked[lm.OWN : lm.OWN + lm.MEMBERS])}
    assert len(ranked) > lm.OWN + 50

    def kind(w):
        return own[w] if w in own else lm.suffix_class(w)

    def tokens(t):
        """(class before the last, class before, class, context, output or None) of each token."""
        seen, before = [lm.START, lm.START], lm.CONTEXTS - 1
        for w in [*(x.encode() for x in t), None]:
            c = lm.END if w is None else kind(w)
            out = None if c < lm.OWN or w is None else member[w] if w in member else lm.MEMBERS + c - lm.OWN
            yield w, seen[-2], seen[-1], c, before, out
            seen.append(c)
            before = c if c < lm.OWN else lm.OWN + member[w] if w in member else lm.OWN + lm.MEMBERS + c - lm.OWN

    tri, pair = Counter(), Counter()
    for t in train:
        for _, a, b, c, before, out in tokens(t):
            tri[(a * lm.CLASSES + b) * lm.CLASSES + c] += 1
            if out is not None:
                pair[before * lm.OUTPUTS + out] += 1
    of = np.concatenate((np.arange(lm.MEMBERS) % lm.SUFFIXES, np.arange(lm.SUFFIXES)))
    for w, k in member.items():
        of[k] = lm.suffix_class(w) - lm.OWN
    sort = lambda c: (np.array(sorted(c)), np.array([c[k] for k in sorted(c)], float))
    first, second = lm.log_probabilities(lm.train(*sort(tri))), lm.log_within(lm.train_within(*sort(pair), of), of)
    assert np.allclose((10.0**first).sum(1), 1, atol=1e-3)
    assert all(np.allclose((10.0 ** second[:, of == c]).sum(1), 1, atol=1e-3) for c in range(lm.SUFFIXES))
    tokens_, types = Counter(), Counter()
    for w, n in count.items():
        if w not in member:
            tokens_[kind(w)] += n
            types[kind(w)] += 1
    for k, t in enumerate(lines):
        want = 0.0
        for w, a, b, c, before, out in tokens(t):
            want += first[a * lm.CLASSES + b, c]
            if out is not None:
                want += second[before, out]
            if w is None:
                want += math.log10((len(train) + 1) / (len(train) + 2))
            elif w not in member:
                want += math.log10((count[w] + 1) / (tokens_[c] + types[c] + 1))
        assert math.isclose(got[k], want, rel_tol=1e-4, abs_tol=1e-3), k


def test_toxicity(docs, empty, labels):
    model = toxicity.fit(docs, labels, F.lit(True))
    out = toxicity.score(docs.withColumn("toxic_score", F.lit("clash")), model)
    got = out.collect()
    assert len(got) == len(rows()) and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels, F.lit(True))).count() == 0


def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[10]["base_labels"] == "cc-by,reserved" and got[10]["labels"] == "all-rights-reserved,cc-by,cc-by-4.0,reserved"
    assert (got[10]["first_word"], got[10]["last_word"], got[10]["n_base"]) == (0, 5, 2)
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["score"] == 0
    assert licenses.scan(empty).count() == 0


def test_license_query_by_hand(docs):
    import re

    def of(text):
        found = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
        own = set()
        for block in [*(text or "").split("\n"), *re.split(r"\n\s*\n", text or "")]:
            have = set(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", block.lower()))
            line = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", block.lower())
            held = {n for n, t in licenses.TEMPLATES.items() if len(have & set(t.split())) >= math.ceil(licenses.THRESHOLD * len(set(t.split())) - 1e-9)}
            own |= {n for n in held if f" {licenses.TEMPLATES[n]} " in f" {' '.join(line)} "}  # all notices of rows() are literal
        places = [k for k, _ in at]
        base = {label for _, label in at}
        return len(found), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))

    got = Counter(tuple(r)[:7] for r in licenses.scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect())
    assert got == Counter((r[0], *of(r[1])) for r in rows())


def test_main_text_of_unmarked_pages_by_hand(spark):
    rng = np.random.default_rng(12)
    menus = [" ".join(f"m{h}x{k}" for k in range(8)) for h in range(3)]
    data, want = [], Counter()
    for k in range(60):
        h = k % 3
        own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(6, 30)))) for _ in range(2)]
        data.append((k, f"http://www.h{h}.example/{k}", f"<ul><li>{menus[h]}</li></ul><div>{own[0]}</div><p>{own[1]}", "old"))
        want[k, "\n\n".join(own), len("\n\n".join(own))] += 1
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    # Brute force: the host's windows that several pages hold are covered.
    held = {}
    for k, url, html_, _ in data:
        for block in html_.replace("<", "\n<").replace(">", ">\n").split("\n"):
            t = block.split()
            for j in range(len(t) - pages.LONG + 1):
                held.setdefault((url.split("/")[2], tuple(t[j : j + pages.LONG])), set()).add(k)
    assert all(len(v) == 1 or w[0].startswith("m") for (_, w), v in held.items())
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df).collect()) == want


@pytest.mark.parametrize("markup,article", [
    ('<p>one <a href="x>two</a> three</p>', ["one two three"]), ('<p>a <span class="notice">note</span> b</p><p>c</p>', ["a b", "c"]),
    ('<p>a <span class="notice">note</p><p>c</p>', ["a", "c"]), ("<p>x<div class=ad>q</div>y</p>", ["x", "y"]), ("<p title=\"a > b\" data-x='<b>'>k &amp; l</p>", ["k & l"]),
])
def test_odd_markup(markup, article):
    assert pages.read(f"<article>{markup}</article>")[0] == article


def test_pages(spark):
    menu = "<div>home news sport weather contact imprint privacy</div>"
    data = [(k, f"http://h.example/{k}", f"{menu}<p>story number {k} is told</p>", "x") for k in range(4)]
    data += [(7, None, None, "x"), (8, "http://[bad", "", "x"), (9, "http://h.example/9", f"<article><p>kept {menu}</p></article>", None), (0, "http://h.example/0", data[0][2], "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df).collect())
    want = [(k, f"story number {k} is told", 22) for k in (0, 0, 1, 2, 3)] + [(7, "", 0), (8, "", 0), (9, "kept\n\nhome news sport weather contact imprint privacy", 52)]
    fixed = [(a, b, len(b)) for a, b, _ in want]
    assert got == fixed
    assert pages.extract(df.limit(0)).count() == 0


def test_language(docs, empty):
    filters = langid.fit(docs.unionByName(docs).unionByName(docs))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, filters).collect()}
    assert got[3] == got[4] == got[9] == "und" and got[6] == "de" and got[0] == "en"
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_media(docs, empty):
    stored = media.with_media(docs.select("doc_id", "text", "rank"))
    got = media.digest(stored).collect()
    want = Counter()
    for r in rows():
        x = (r[1] or "").encode()
        p = media.padded(x)
        want[r[0], len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    clips = media.clips(stored).filter("doc_id = 5").orderBy("clip").collect()
    assert clips[0]["start_s"] == 0 and clips[-1]["first_frame"] + clips[-1]["n_frames"] == -(-len(LONG) // 4096)
    assert media.digest(media.with_media(empty.select("doc_id", "text"))).count() == 0


@pytest.mark.parametrize("n", [40, 320])
def test_crowds_keep_links_whose_edits_stand_outside_the_shared_passage(spark, n):
    """Pairs that share a quarter, half or three quarters of their words with a whole crowd, all edits in the rest: 0.9 are found."""
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for share in (25, 50, 75):
        for similar in (0.85, 0.91):
            passage = [f"g{share}{similar}p{k}" for k in range(share)]
            for i in range(n - 10):
                tail = [f"w{x}" for x in rng.integers(0, 10**6, 100 - share)]
                rows.append(tail + passage)
                if i < 10:
                    for k in rng.choice(100 - share, round(100 * (1 - similar)), replace=False):
                        tail[k] = f"e{rng.integers(0, 10**6)}"
                    pairs.append((len(rows) - 1, len(rows)))
                    rows.append(tail + passage)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
    assert len(set(got.values())) == len(rows) - sum(got[a] == got[b] for a, b in pairs)  # nothing else is linked


def test_words_outside_of_common_kmers():
    line = b"a b c d e f g h"
    x = neardup.kmers(line)
    h = neardup.word_hashes(line)
    assert (neardup.uncovered(line, np.sort(x[:1])) == h[5:]).all()
    assert (neardup.uncovered(line, np.sort(np.concatenate((x[1:2], h[7:])))) == h[[0, 6]]).all()
    assert (neardup.uncovered(line, np.empty(0, np.uint64)) == h).all() and not len(neardup.uncovered(b"", np.sort(x)))


def test_a_crowd_of_nothing_but_common_passages_keeps_its_links(spark, monkeypatch):
    # Eight passages, each in one of two wordings: every k-mer is common, and two texts are similar where one passage differs at most.
    monkeypatch.setattr(neardup, "CROWD", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "sketches", lambda line, common=None: np.array([7], np.uint64))
    codes = sorted(np.random.default_rng(4).choice(256, 60, replace=False).tolist())
    texts = [" ".join(f"p{k}v{code >> k & 1}w{x}" for k in range(8) for x in range(6)) for code in codes]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 1 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert 1 < len(set(root)) < 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == dict(enumerate(root))


def test_pairs_of_a_crowd_of_any_length_meet_in_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(12)
    texts = []
    for n in (1, 2, 5, 9, 10, 11, 25, 60, 61, 130, 200):
        for _ in range(4):
            t = [f"w{x}" for x in rng.integers(0, 300, n)]
            texts += [t, t[: max(1, round(0.85 * n))], [f"n{k}" if k % 7 == 0 else w for k, w in enumerate(t)]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    nodes = df.select(F.col("doc_id").cast("string").cast("binary").alias("node"), F.col("doc_id").cast("string").alias("_k"), F.xxhash64("text").alias("_h"))
    all_ = neardup._Texts(df.withColumns({"_k": F.col("doc_id").cast("string"), "_h": F.xxhash64("text")}), nodes, 0.8)
    neardup._settled(nodes.select("node"), all_)
    tested = {(int(bytes(r["a"])), int(bytes(r["b"]))) for r in all_.tested.collect()}
    tested |= {(b, a) for a, b in tested}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            assert (i, j) in tested or neardup.distance(a, b, most) > most
    assert len(tested) < len(texts) ** 2 / 4
