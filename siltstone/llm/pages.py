"""Main text of web pages: block structure, and a suffix array of each host for what repeats.

A page is read into blocks; elements that are never article (menus, footers, adverts, forms,
scripts, comments and so on, by element, role and class) are furniture. The token streams of all of a
host's pages are concatenated, and a suffix array finds substrings of at least LONG tokens that distinct
pages share. Of a page that marks no article, covered runs are removed and unique runs stay. Of a marked
article, a covered run is furniture or a sentence that other pages hold too, which an exact check tells:
a block goes if all of it is covered by runs that stand as furniture on most of the host's pages.

Defined results: null and empty pages, and pages without article text, give the empty text; broken
and unclosed markup is read to the end; repeated rows each give a row; an empty table gives none;
columns of df named `text` or `n_chars` are replaced; other columns keep their values, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mixed, numbered, staged, values, widened, word_hashes

# Elements of HTML by what they do here.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas select xmp noembed noframes title".split())
LEFT_OUT = frozenset("nav footer aside form button dialog menu head audio video map fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Class, id and role words of what is not article.
WORDS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar comment comments respond reply replies disqus social share sharing related recommended recommendations widget search pagination pager copyright skip alert complementary contentinfo dialog form tracking".split()
)
# Words that name a part of the layout around an article, whatever else stands beside them.
LAYOUT_WORDS = frozenset("main content article container wrapper wrap layout page has with without no".split())
# What an article element can be besides an article.
ARTICLE_OUT = frozenset("ad ads advert comment comments promo related reply replies sponsored".split())
HEADER_WORDS = frozenset(("header", "banner", "masthead"))
# Words that within an article also name what it says or tells about; elements whose id tells their content.
TOPIC_WORDS = frozenset("alert copyright form navigation notices overlay reply respond search share sharing skip tracking".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PASSAGES = frozenset("blockquote code dd dt em figcaption figure li p pre strong table td th".split())
# Words that only say what kind of box a name is for.
BOX_WORDS = frozenset("area article articles bar body bottom box block button buttons card cards container content count div entry google gpt group holder icon icons inline inner item items left link links list lists media mid module native outer panel post posts reader right row section site slot sticky stories story text thread title toggle top unit user wrap wrapper zone".split())
#: A repeated substring counts from so many tokens.
LONG = 6
#: Pages of a host whose streams stand in one array.
SHARD_PAGES = 400
#: Characters of a host's pages that stand in one array.
SHARD_CHARS = 8_000_000
#: Furniture of so many pages of a host, and of more than half, is furniture of the site.
SITE_PAGES = 3
#: What a token stream or a window is of: a page that marks no article, a marked article, furniture, what else is evidence; or a page is counted.
TEXT, ARTICLE, FURNITURE, EVIDENCE, PAGE = range(5)

#: A comment; a tag, whose quoted values end before a space, a slash or its end; a tag of any other form, to its first ">"; a declaration; an unclosed tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|<(?=[/a-zA-Z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _left_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()):
        return True
    if in_article and name != "article":
        return name not in HEADINGS and any(_furniture(name, k, x) for k in ("class", "id", "role") for x in attributes.get(k, "").split())
    named = set()
    for k in ("class", "id", "role"):
        named |= _name_words(attributes.get(k, ""))
    if name == "article":
        return bool(named & ARTICLE_OUT)
    return bool(named & WORDS_OUT) and not named & LAYOUT_WORDS


def _name_words(name: str) -> set[str]:
    return set(_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}


def _furniture(element: str, kind: str, name: str) -> bool:
    """Whether a class, id or role of an element in an article names furniture and nothing else.

    An id made of topic words can stand for a part of the text. Passages (paragraphs, quotations, list
    items) are content by their element: their ids say nothing, nor do topic words in their classes.
    """
    found = _name_words(name)
    parts = found & (WORDS_OUT - HEADER_WORDS)
    if kind == "id" and element in PASSAGES:
        return False
    if kind == "id" or kind == "class" and element in PASSAGES:
        parts = parts - TOPIC_WORDS
    return bool(parts) and found <= WORDS_OUT | BOX_WORDS


def read(page: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks of marked articles, other blocks that may be text, and blocks that are left out."""
    article: list[str] = []
    other: list[str] = []
    out: list[str] = []
    count: Counter = Counter()  # open elements of each name
    open_: list[tuple[str, bool, bool, list[str] | None]] = []  # element, whether it starts what is left out, whether an article, the line of text that it interrupts
    state = [0, 0]  # left out, in an article
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                (out if state[0] else article if state[1] else other).append(text)

    def close(k: int) -> None:
        while len(open_) > k:
            name, left, art, line = open_[-1]
            if name in BLOCK or line is not None:
                flush()
            open_.pop()
            count[name] -= 1
            state[0] -= left
            state[1] -= art
            if line is not None:
                pieces.extend(line)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            pieces.append(html.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        ends, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
        if ends:
            if not count[name]:  # nothing to close, and nothing to look through
                continue
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name not in BLOCK and open_[k][2]:
                        flush()
                    close(k)
                    break
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            at = stop.end()
            continue
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK and open_ and open_[-1][0] == "p":
            close(len(open_) - 1)
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and open_ and open_[-1][0] == name:
            close(len(open_) - 1)
        attributes = _attributes(rest)
        left = _left_out(name, attributes, state[1] > 0)
        marked = name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
        line = None
        if marked and name not in BLOCK:
            flush()
        elif left and name not in BLOCK:  # it interrupts a line, which goes on after it
            line = pieces[:]
            pieces.clear()
        open_.append((name, left, marked, line))
        count[name] += 1
        state[0] += left
        state[1] += marked
    close(0)
    flush()
    return article, other, out


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def suffix_array(tokens: np.ndarray, most: int | None = None) -> np.ndarray:
    """Starts of all suffixes, sorted by their first `most` tokens (all of them by default), by doubling ranks."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < min(n, most or n):
        follow = np.full(n, -1, np.int64)
        follow[: n - step] = rank[step:]
        key = rank * (n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def repeated(streams: list[np.ndarray], owners: list[int], long: int = LONG, kinds: list[int] | None = None, pages: int | None = None) -> list[np.ndarray]:
    """For each stream, which tokens lie in a substring of at least `long` tokens that a stream of another owner holds too.

    kinds: what each stream is; all are TEXT by default. ARTICLE streams are evidence against none; their tokens
    count where such a substring is site furniture: of FURNITURE streams of most of the `pages` owners there are.
    """
    if not streams:
        return []
    names, ids = np.unique(np.concatenate(streams) if any(map(len, streams)) else np.empty(0, np.uint64), return_inverse=True)
    sizes = [len(s) for s in streams]
    ends = np.cumsum(np.array(sizes) + 1)
    starts = ends - np.array(sizes) - 1
    line, own = np.empty(int(ends[-1]), np.int64), np.empty(int(ends[-1]), np.int64)
    kind = np.repeat(np.array(kinds if kinds is not None else [TEXT] * len(streams)), np.array(sizes) + 1)
    at = 0
    for k, (a, size) in enumerate(zip(starts, sizes)):
        line[a : a + size] = ids[at : at + size]
        line[a + size] = len(names) + k  # a mark that occurs once
        own[a : a + size + 1] = owners[k]
        at += size
    order = suffix_array(line, long)
    n = len(line)
    padded = np.concatenate((line, -1 - np.arange(long)))
    same = np.ones(max(0, n - 1), bool)
    for k in range(long):
        t = padded[order + k]
        same &= t[1:] == t[:-1]
    group = np.empty(n, np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~same)))
    groups, proof = int(group.max()) + 1, kind != ARTICLE
    first, last = np.full(groups, np.iinfo(np.int64).max), np.full(groups, -1)
    np.minimum.at(first, group[proof], own[proof])
    np.maximum.at(last, group[proof], own[proof])
    hit = proof & (first < last)[group]
    if pages is not None:
        out = kind == FURNITURE
        held = np.bincount(np.unique(group[out] * (own.max() + 1) + own[out]) // (own.max() + 1), minlength=groups)  # pages of each
        hit |= ~proof & of_site(held, pages)[group]
    at = np.flatnonzero(hit)
    change = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(n, at + long), minlength=n + 1)
    covered = np.cumsum(change[:n]) > 0
    return [covered[a : a + size] for a, size in zip(starts, sizes)]


def of_site(held, pages):
    """Whether what `held` pages of a host's `pages` hold as furniture is furniture of the site. Numbers, arrays or columns."""
    return (held >= SITE_PAGES) & (2 * held > pages)


def windows(block: bytes, long: int = LONG) -> np.ndarray:
    """A hash of each run of `long` tokens of the block, in order."""
    return runs_of(word_hashes(block), long)


def runs_of(h: np.ndarray, long: int = LONG) -> np.ndarray:
    """A hash of each run of `long` of the tokens' hashes, in order."""
    n = max(0, len(h) - long + 1)
    x = np.zeros(n, np.uint64)
    for j in range(long):
        x = (x + h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(x).view(np.int64)


def unique_runs(pages: list[tuple], long: int = LONG, elsewhere: dict | None = None, marked: frozenset | set = frozenset(), site: np.ndarray | None = None) -> dict[int, list[str]]:
    """pages: (number, its blocks, further blocks as evidence, and blocks of furniture if any). The blocks of each, without what other pages repeat.

    elsewhere: for a number, windows() that pages outside this group repeat.
    marked: numbers of the pages whose blocks are a marked article. Of these a block goes if site furniture covers all of it.
    site: windows() of the site's furniture if the host has pages outside this group, else None.

    Pages of the same blocks, such as repeated rows or a page at two addresses, are one page here.
    """
    streams, owners, kinds, blocks, where = [], [], [], [], []
    first: dict = {}
    for number, own, more, *out in pages:
        out = out[0] if out else []
        owner = first.setdefault((number in marked, tuple(own), tuple(more), tuple(out)), number)
        every = [x.encode() for x in (*own, *more, *out)]
        hashes, at = word_hashes(b" ".join(every)), 0
        for k, block in enumerate(every):
            size = len(block.split())
            if k < len(own):
                where.append((number, block, len(streams) if size >= long else None))
            if size >= long:  # no shorter one holds a run
                streams.append(hashes[at : at + size])
                owners.append(owner)
                kinds.append((ARTICLE if number in marked else TEXT) if k < len(own) else TEXT if k < len(own) + len(more) else FURNITURE)
            at += size
    left: dict[int, list[str]] = {number: [] for number, *_ in pages}
    found = repeated(streams, owners, long, kinds, len(first) if site is None else None)
    for number, block, k in where:
        covered = found[k] if k is not None else np.zeros(len(block.split()), bool)
        far = site if number in marked else (elsewhere or {}).get(number)
        if k is not None and far is not None and len(far):
            covered = covered.copy()
            for at in np.flatnonzero(np.isin(runs_of(streams[k], long), far)):
                covered[at : at + long] = True
        if number in marked:
            if not covered.all():
                left[number].append(block.decode())
        elif kept := b" ".join(w for w, c in zip(block.split(), covered) if not c).decode():
            left[number].append(kept)
    return left


def extract(df: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """df's columns but the page, with text and n_chars.

    All pages meet by host, and a page's text is what its host's suffix array leaves. A host's pages are
    dealt to shards of about SHARD_PAGES, by a hash of the address and the blocks, so that no host fills one task.
    """
    df, new, _ = numbered(df)
    rest = [n for c, n in new.items() if c not in (page, "text", "n_chars")]
    back = [F.col(n).alias(c) for c, n in new.items() if n in rest]
    page, url = new[page], new[url]

    def parse(batches, light=False):
        for batch in batches:
            done = []
            for address, x in zip(values(batch, url), values(batch, page)):
                article, other, out = read(x or "")
                own, more = (article, other) if article else (other, [])
                name = "\x1e".join("\x1f".join(blocks) for blocks in (["article"] if article else [], own, more, out))  # neither stands in a block
                owner = int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)
                done.append((bool(article), host(address), owner, [] if light and article else own, more, out))
            kinds = [pa.bool_(), pa.string(), pa.int64(), *[pa.list_(pa.string())] * 3]
            kept = [url] if light else rest
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *[pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)]], names=[*kept, "_marked", "_host", "_owner", "_own", "_more", "_out"])

    def addresses(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host(x) for x in values(batch, url)], pa.string()), batch.column(1)], names=["_h", "_c"])

    # Hosts with more pages, or longer ones, get more shards; only hosts of several shards are broadcast, at most one for SHARD_PAGES pages or SHARD_CHARS characters.
    sizes = staged(mapped(df.select(url, F.coalesce(F.length(page), F.lit(0)).cast("long").alias("_c")), addresses, "_h string, _c long").groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_c")), "sizes")
    hosts = sizes.select("_h", F.ceil(F.greatest(F.col("_n") / SHARD_PAGES, F.col("_c") / SHARD_CHARS)).cast("int").alias("_shards")).filter("_shards > 1")
    found = "_marked boolean, _host string, _owner long, _own array<string>, _more array<string>, _out array<string>"
    shard = F.pmod(F.xxhash64(url, "_owner"), F.coalesce("_shards", F.lit(1))).cast("long")

    def dealt(parsed, how):
        return parsed.join(F.broadcast(hosts), F.col("_host") == F.col("_h"), how).drop("_h").withColumn("_shard", shard)

    parsed = dealt(mapped(df.select(*rest, page), parse, widened(df, rest, found)), "left").withColumn("_far", F.lit(None).cast("array<long>"))
    if not hosts.isEmpty():  # pages are read twice, since a copy of their blocks would take as much disk as the pages
        light = dealt(mapped(df.select(url, page), lambda batches: parse(batches, True), widened(df, [url], found)), "inner")
        parsed = parsed.unionByName(_exchanged(light, hosts), allowMissingColumns=True)

    def clean(rows):
        page_ = [x is not None for x in rows.column("_marked").to_pylist()]
        names = ("_marked", "_owner", "_own", "_more", "_out", "_far")
        told = list(zip(*[rows.column(c).to_pylist() for c in names]))
        several = pc.max(rows.column("_shards")).as_py() is not None
        far = {r[1]: np.asarray(r[5], np.int64) for r in told if r[5] is not None}
        told = [r for r in told if r[0] is not None]
        elsewhere = {k: far[r[1]] for k, r in enumerate(told) if r[1] in far}
        marked = {k for k, r in enumerate(told) if r[0]}
        found = unique_runs([(k, *r[2:5]) for k, r in enumerate(told)], LONG, elsewhere, marked, far.get(None, np.empty(0, np.int64)) if several else None)
        kept = rows.select(rest).filter(pa.array(page_, pa.bool_()))
        return kept.append_column("text", pa.array(["\n\n".join(found[k]) for k in range(len(told))], pa.string()))

    # A task for each SHARD_CHARS characters, if that is more than the session has.
    tasks = (sizes.agg(F.sum("_c")).first()[0] or 0) // SHARD_CHARS
    several = [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    done = parsed.repartition(*several, "_host", "_shard").groupBy("_host", "_shard").applyInArrow(clean, widened(df, rest, "text string"))
    return done.select(*back, "text", F.length("text").cast("long").alias("n_chars"))


def _exchanged(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """What shards of a host tell each other, so that a repeat counts wherever on the host it is: rows of _host, _shard, _owner, _shards and _far.

    _far: windows() of an unmarked page's blocks that another page of the host holds; without an owner, those of the
    site's furniture. Most pages hold each of these, so that they are few: at most twice a page's average.
    """

    def hashes(blocks):
        long = [windows(x.encode()) for x in blocks if x.count(" ") >= LONG - 1]
        return np.unique(np.concatenate(long)) if long else np.empty(0, np.int64)

    def emit(batches):
        def flush():
            count = [len(w) for _, w, _ in held]
            rows_ = pa.array(np.repeat([r for r, _, _ in held], count).astype(np.int64))
            columns = [batch.column(batch.schema.get_field_index(c)).take(rows_) for c in ("_host", "_shard", "_owner")]
            kinds = np.repeat(np.array([k for _, _, k in held], np.int32), count)
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([w for _, w, _ in held])), pa.array(kinds)], names=["_host", "_shard", "_owner", "_w", "_kind"])

        for batch in batches:
            held, size = [], 0
            for k, (marked, own, more, out) in enumerate(zip(*[values(batch, c) for c in ("_marked", "_own", "_more", "_out")])):
                for kind, w in ((PAGE, np.zeros(1, np.int64)), (TEXT, hashes([] if marked else own)), (EVIDENCE, hashes(more)), (FURNITURE, hashes(out))):
                    held.append((k, w, kind))
                    size += len(w)
                if size >= 100_000:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    held = mapped(parsed.select("_host", "_shard", "_owner", "_marked", "_own", "_more", "_out"), emit, "_host string, _shard long, _owner long, _w long, _kind int")
    held = staged(held, "held")  # read four times
    several = held.filter(F.col("_kind") != PAGE).groupBy("_host", "_w").agg(F.min("_owner").alias("a"), F.max("_owner").alias("z")).filter("a < z").select("_host", "_w")
    far = held.filter(F.col("_kind") == TEXT).join(several, ["_host", "_w"]).groupBy("_host", "_shard", "_owner").agg(F.collect_set("_w").alias("_far"))
    pages = held.filter(F.col("_kind") == PAGE).select("_host", "_owner").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    site = held.filter(F.col("_kind") == FURNITURE).select("_host", "_w", "_owner").distinct().groupBy("_host", "_w").agg(F.count(F.lit(1)).alias("_held"))
    site = site.join(pages, "_host").filter(of_site(F.col("_held"), F.col("_n"))).groupBy("_host").agg(F.collect_set("_w").alias("_far"))
    site = site.join(hosts, F.col("_host") == F.col("_h")).select("_host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - F.lit(1).cast("long"))).alias("_shard"), F.lit(None).cast("long").alias("_owner"), "_far")
    return far.unionByName(site).withColumn("_shards", F.lit(None).cast("int"))
