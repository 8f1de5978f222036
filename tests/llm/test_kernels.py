"""Plain Python parts against brute force."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe, langid, licenses, lm, media, neardup, pages, toxicity


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24), st.integers(0, 14))
def test_banded_alignment(a, b, most):
    assert neardup.distance(a, b, most) == min(edit(a, b), most + 1)


def test_sketches_of_odd_texts():
    assert len(neardup.sketches(b"")) == 0
    for line in (b"one", b"a b c d", b"a b c d e", b"x " * 3000 + b"y"):
        assert len(neardup.sketches(neardup.normal(line))) == 2 * neardup.SKETCHES
    assert (neardup.sketches(b"a b c d e f") == neardup.sketches(b"a b c d e f")).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_media_round_trip(data):
    p = media.padded(data)
    assert len(p) % 64 == 0 and p
    found = media.probe(media.write_avi(p))
    assert found["payload"] == p
    assert found["shots"][0][0] == 0 and found["shots"][-1][1] == len(found["histograms"])


def test_common_kmers_are_left_to_the_second_family():
    line = b"a b c d e f g h i j"
    common = np.sort(neardup.kmers(line)[:3])
    first = neardup.sketches(line, common)[: neardup.SKETCHES]
    assert (first != neardup.sketches(line)[: neardup.SKETCHES]).any()
    assert len(neardup.sketches(line, np.sort(neardup.kmers(line)))) == neardup.SKETCHES


def test_media_general_decoder_agrees_and_damage_is_seen():
    jpeg = media.encode_frame(bytes(range(64)) * 3)
    info, fast = media.coefficients(jpeg)
    _, at = media._markers(jpeg)
    assert (media._decode_any(info, jpeg[at:], len(fast)) == fast).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")
    avi = media.write_avi(b"a" * 64)
    with pytest.raises(ValueError):
        media.read_avi(avi.replace(b"idx1", b"JUNK"))


def test_samples_are_the_inverse_cosine_transform():
    info, v = media.coefficients(media.encode_frame(bytes(range(128, 192))))
    block = np.zeros((8, 8))
    block.ravel()[media.ZIGZAG] = v[0]
    c = [np.sqrt(1 / 8)] + [0.5] * 7
    want = [[sum(c[u] * c[w] * block[u, w] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for u in range(8) for w in range(8)) for x in range(8)] for y in range(8)]
    assert abs(media.samples(info, v)[0].reshape(8, 8).astype(int) - np.clip(np.rint(np.array(want) + 128), 0, 255)).max() <= 1


def test_shots_at_a_jump():
    h = np.array([[10, 0]] * 6 + [[0, 10]] * 5)
    assert media.shots(h) == [(0, 6), (6, 11)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_array_coverage(streams, long):
    arrays = [np.array(s, np.uint64) for s in streams]
    got = pages.repeated(arrays, list(range(len(streams))), long)
    for k, s in enumerate(streams):
        want = [False] * len(s)
        for i in range(len(s) - long + 1):
            if any(s[i : i + long] == t[j : j + long] for m, t in enumerate(streams) if m != k for j in range(len(t) - long + 1)):
                want[i : i + long] = [True] * long
        assert got[k].tolist() == want


def test_pages():
    page = "<html><head><title>t</title><script>if(a<b)x</script></head><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one<br>two\n three<p><b>four</b><div class='comments'><p>nice!</p></div><aside>x</aside><form>f</form></article><footer>foot</footer>"
    article, other, out = pages.read(page)
    assert article == ["A & B", "one two three", "four"] and other == []
    assert pages.read("") == ([], [], []) and pages.read("<p>a<p")[1] == ["a"]
    assert pages.read("<div hidden><p>no</p></div><p>a < b &am</p>")[1] == ["a < b &am"]


def test_pages_by_class():
    page = '<div class="layout has-sidebar"><article class="post shared"><p>body</p><article class="comment"><p>me too</p></article><div id="cookie-notice">x</div></article><div class="sidebar">y</div></div>'
    assert pages.read(page) == (["body"], [], ["me too", "x", "y"])


@pytest.mark.parametrize("markup", [
    '<h2 id="search">Search for meaning</h2>', '<h2 class="share">Share of votes</h2>', '<section class="related-work">Related work</section>', '<section id="navigation">Navigation</section>',
    '<div class="form-of-life">A form of life</div>', '<blockquote class="share-quote">A quote</blockquote>', '<p class="copyright">Copyright law</p>', '<li id="comments">Comments on the text</li>',
])
def test_what_an_article_tells_about_stays(markup):
    assert pages.read(f"<article><p>one</p>{markup}<p>two</p></article>")[0] == ["one", re.sub("<[^>]*>", "", markup), "two"]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "adBox", "comments", "comment-list", "post-comments", "related-posts", "share-buttons", "newsletter-signup", "social-media-links", "x y sidebar", "div-gpt-ad-7", "notice", "cookieNotice"])
def test_furniture_within_an_article_goes(name):
    assert pages.read(f'<article><p>one</p><div class="{name}"><p>me</p></div><p>two</p></article>') == (["one", "two"], [], ["me"])


def test_end_tags_that_close_nothing_cost_nothing():
    n = 40_000  # a walk through the open elements for each would take minutes
    start = time.process_time()
    assert pages.read("<b>x</i>" * n)[1] == ["x" * n]
    assert time.process_time() - start < 10


def test_unique_runs():
    shared = "this very menu is on each page of ours"
    got = pages.unique_runs([(0, [shared, "only here"], []), (1, [shared + " tail words"], []), (2, [], [])])
    assert got == {0: ["only here"], 1: ["tail words"], 2: []}


def test_license_places_against_brute_force():
    text = "CC BY, cc  by. All rights\nreserved; general public license é all rights reserved".encode()
    found = licenses.words(text)
    want = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(found)) if b" ".join(found[k : k + len(phrase.split())]) == phrase.encode())
    assert sorted(licenses.places(found)) == want and len(want) == 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("license the under version apache licensed 2 0 x y cc by 4 rights all reserved".split()), max_size=16))
def test_license_join_is_exact(block):
    join = licenses.Join({w.encode(): k % 5 for k, w in enumerate("the license under 2 0 by".split())})
    words = [w.encode() for w in block]
    want = sorted(n for n, t in licenses.TEMPLATES.items() if len(set(words) & set(t.encode().split())) >= join.need[n])
    assert sorted(n for n, _ in join.match(words)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("licensed under cc by nc 4 0 all rights reserved x".split()), max_size=14), st.sampled_from([0.7, 0.9, 1.0]))
def test_order_against_brute_force(block, threshold):
    words = [w.encode() for w in block]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    for wording in licenses.TEMPLATES.values():
        t = wording.encode().split()
        width = int(len(t) / threshold + 1e-9)
        best = max((common(words[k : k + width], t) for k in range(len(words))), default=0)
        got = max((s for *_, s in licenses.in_order(words, t, threshold)), default=0)
        assert got == (best / len(t) if best / len(t) >= threshold - 1e-9 else 0)


@pytest.mark.parametrize("text,want", [
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("Licensed under CC BY 4.0", ["cc-by-4.0"]), ("licensed under CC BY-NC-ND 4.0", ["cc-by-nc-nd-4.0"]), ("Licensed under CC BY-SA 4.0", ["cc-by-sa-4.0"]),
    ("Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", ["cc-by-4.0", "cc-by-nc-4.0"]), ("all people have rights and some seats are reserved", []), ("0 by 4 cars cc under the roof licensed", []),
    ("All rights reserved.", ["all-rights-reserved"]), ("Released under the MIT License.", ["mit-notice"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]), ("This work is licensed under the\nGNU General Public License, v. version 3.", ["gpl-3.0"]),
])
def test_license_labels(text, want):
    assert [n for n, _ in licenses.Join({}).scan(text.encode())] == want


def test_a_template_within_a_larger_one_goes():
    join = licenses.Join({}, {"short": "a b c d", "long": "x a b c d y"}, 0.8)
    assert join.verified(b"x a b c d y".split()) == [("long", 1.0)]
    assert join.verified(b"x a b c d y q q a b c d".split()) == [("short", 1.0), ("long", 1.0)]


def test_filters_return_every_language_that_learned_a_gram():
    f = langid.Filters([("a", 5), ("b", 5), ("b", 9)])
    assert f.languages(np.array([5, 9, 77])).tolist()[:2] == [3, 2]
    assert langid.Filters([]).predict([b"abc"]) == [("und", 0.0, 0.0)]
    assert f.predict([b"", b"12 !", "é".encode()])[0][0] == "und" and f.predict([b"12 !"])[0][0] == "und" and f.predict([b"zzz"])[0] == ("a", 0.0, 0.0)


def test_label_model_finds_the_bad_voter():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    flip = lambda p: np.where(rng.random(2000) < p, ~y, y)
    votes = np.column_stack([np.where(flip(p), 1, -1) for p in (0.05, 0.1, 0.45)])
    q, info = toxicity.label_model(votes, (votes.sum(1) > 0).astype(float))
    assert ((q > 0.5) == y).mean() > 0.9
    hit = info["accuracy"][1, :, 2]
    assert hit[0] > hit[2]


def test_toxicity_of_one_class():
    assert toxicity.train([], [], []).score(b"x") == pytest.approx(0, abs=1e-9)
    assert toxicity.train([(1, [False] * 6, np.empty(0, np.uint32))], [], []).score(b"x") == pytest.approx(1, abs=1e-9)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 4000), rng.integers(0, 4, 4000)
    cells = (a * lm.CLASSES + b) * lm.CLASSES + (b + 1) % 4
    u, n = np.unique(cells, return_counts=True)
    table = lm.log_probabilities(lm.train(u, n.astype(float), steps=300))
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)
    assert (n * table.ravel()[u]).sum() / n.sum() > np.log10(0.6)
    even = lm.log_probabilities(lm.train(np.empty(0, np.int64), np.empty(0)))
    assert np.allclose((10.0 ** even.astype(float)).sum(1), 1, atol=1e-4)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    return bpe.Splitter(file), Tokenizer.from_file(file)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_the_library_does(tokenizer, text):
    split, library = tokenizer
    assert [i for w in split.words(text) for i in split.ids(w)] == library.encode(text, add_special_tokens=False).ids


def test_words_of_special_texts(tokenizer):
    split, library = tokenizer
    for text in ("a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "I'M don't 'S's", "Σίσυφος ΟΔΟΣ İ", "x\x85y\xa0z\x1c", "½²१२Ⅷ", "é Å ﬁ"):
        assert [i for w in split.words(text) for i in split.ids(w)] == library.encode(text, add_special_tokens=False).ids
    assert hashlib.sha256(b"").hexdigest()


def test_sketches_propose_scattered_edits_down_to_the_threshold():
    # Of pairs with so many words in a hundred replaced, scattered over the text, all within the operator's similarity.
    rng = np.random.default_rng(11)
    for percent in (3, 6, 10, 13, 16, 20):
        hit = total = 0
        for _ in range(150):
            a = [b"w%d" % x for x in rng.integers(0, 30_000, int(rng.integers(60, 250)))]
            b = list(a)
            for k in rng.choice(len(a), int(len(a) * percent / 100), replace=False):
                b[k] = b"n%d" % rng.integers(0, 10**9)
            x, y = b" ".join(a), b" ".join(b)
            assert neardup.similar(x, y)
            assert apart(neardup.signature(x), neardup.signature(y)) <= neardup.allowed(np.array(len(a)))
            hit += len(np.intersect1d(neardup.sketches(x), neardup.sketches(y))) > 0
            total += 1
        assert hit >= 0.9 * total, (percent, hit, total)


def test_signatures_tell_most_other_texts_apart():
    rng = np.random.default_rng(3)
    for n in (40, 200, 1000):
        found = [neardup.signature(b" ".join(b"w%d" % x for x in rng.integers(0, 30_000, n))) for _ in range(40)]
        passed = [apart(x, y) <= neardup.allowed(np.array(n)) for k, x in enumerate(found) for y in found[:k]]
        assert np.mean(passed) < (0.5 if n == 40 else 0.01)
    assert not neardup.signature(b"").any()


def apart(a, b):
    return sum(bin(int(x) & (1 << 64) - 1).count("1") for x in a ^ b)


def test_places_of_many_phrases():
    found = (b"x cc by y " * 20_000).split() + [b"cc", b"by"]
    at = [k for k, _ in licenses.places(found)]
    assert at == [4 * k + 1 for k in range(20_000)] + [80_000]


def test_more_languages_than_a_mask_holds():
    rng = np.random.default_rng(2)
    grams = {f"l{k:03d}": rng.choice(155**3, 400, replace=False) for k in range(150)}
    filters = langid.Filters([(name, int(g)) for name, codes in grams.items() for g in codes])
    assert len(filters.masks) == 3 and (filters.false < 1e-6).all()
    for k, (name, codes) in enumerate(grams.items()):
        assert (filters.languages(codes, k // 64) >> np.uint64(k % 64) & np.uint64(1)).all(), name


def test_shares_of_languages_by_sets():
    lines = {"aa": [b"abc abd abe " * 9, b"abc abd"], "bb": [b"xyz xyw abc " * 9], "cc": [b"mno mnp " * 9]}

    def gram(x):  # of the words with a space between them and at both ends
        t = b" " + b" ".join(x.split()) + b" "
        return [t[i : i + 3] for i in range(len(t) - 2) if x.split()]

    sets = {name: {g for x in items for g in gram(x)} for name, items in lines.items()}
    code = lambda g: int(langid._CLASS[g[0]] * langid.CLASSES + langid._CLASS[g[1]]) * langid.CLASSES + int(langid._CLASS[g[2]])
    filters = langid.Filters([(name, code(g)) for name, s in sets.items() for g in s])
    texts = [b"abc xyz", b"MNO mnp abd", b"qqq", b"12 3"]
    for x, shares, (lang, score, _) in zip(texts, filters.shares(texts), filters.predict(texts)):
        found = gram(bytes(x.lower()).translate(langid._CLEAN))
        want = [sum(g in sets[name] for g in found) / max(1, len(found)) for name in sorted(sets)]
        assert np.allclose(shares, want, atol=1e-4)
        assert lang == ("und" if not langid.has_letter(x) else "aa" if max(want) == 0 else sorted(sets)[int(np.argmax(want))])
        assert abs(score - (max(want) / sum(want) if sum(want) else 0)) < 1e-3


def test_label_model_learns_accuracies_from_agreement_alone():
    rng = np.random.default_rng(6)
    y = rng.random(6000) < 0.15
    reach, false = rng.uniform(0.3, 0.8, 12), rng.uniform(0.001, 0.03, 12)
    votes = np.where(y[:, None], rng.random((6000, 12)) < reach, rng.random((6000, 12)) < false).astype(int)
    votes = np.column_stack([votes, votes[:, :1], -(votes.sum(1) == 0).astype(int)])  # a voter twice, and one for silence
    q, found = toxicity.label_model(votes, toxicity.first_guess(votes, 0.15), balance=0.15)
    assert np.mean((q >= 0.5) == y) > 0.98
    assert np.allclose(found["accuracy"][1, 1:12, 2], reach[1:], atol=0.06) and np.allclose(found["accuracy"][0, 1:12, 2], false[1:], atol=0.02)
    assert found["correlation"][0, 12] > 0.9 and abs(found["weight"][0] - 0.5) < 0.1 and found["weight"][1] == 1


def test_label_model_by_hand():
    # One round of the formulas, in plain loops, from the same start.
    votes = np.array([[1, 1, 0], [1, 0, 0], [0, 0, 0], [0, 0, -1], [0, 0, -1]])
    start = toxicity.first_guess(votes, 0.4)
    assert np.allclose(start, [0.9, 0.9, 0.04, 0.04, 0.04])
    q, found = toxicity.label_model(votes, start, rounds=1, balance=0.4)
    for i in range(5):
        score = np.log(0.4 / 0.6)
        for j in range(3):
            p = []
            for side in (lambda x: x, lambda x: 1 - x):
                n = {v: sum(side(start[r]) for r in range(5) if votes[r, j] == v) + 0.1 for v in (-1, 0, 1)}
                p.append(n[votes[i, j]] / sum(n.values()))
            score += found["weight"][j] * np.log(p[0] / p[1])
        assert abs(q[i] - 1 / (1 + np.exp(-score))) < 1e-9
