"""Near duplicates by order MinHash, verified by banded alignment.

Texts are lower-cased words. A k-mer is five words, labelled with how often it has occurred before.
Each sketch hashes the labelled k-mers with a seed of its own, takes the several smallest and keeps
them in text order, so that equal sketches speak for a small edit distance, not just for common
content. Texts that share a sketch, a bucket, are candidates. A signature of the words of both tells
most of those apart that can't be similar; a banded alignment of their words finds whether their edit
similarity, 1 - distance / longer length, is 0.8 or more.

Equal texts are one node throughout. In the buckets of a few early sketches the texts are aligned with
one of them, the leader, which joins a large group of copies in one pass. Then the texts
outside of a bucket's largest class meet another of its members, and where few pairs a text are left,
all pairs of different classes are tested. Buckets with
more are crowds that share a passage rather than a text. Their texts are dealt anew: k-mers and words
that more than CROWD of these texts hold are left out, and sketches are drawn from all their other
k-mers and from the words outside of common k-mers, until no crowd is left, or its texts share nothing
of that kind. What that leaves apart is settled exactly: all pairs of a crowd's texts whose lengths,
signatures and word counts allow it are tested, block by block. So no text
leaves unseen, and pairs are not made within a large class. Classes are the connected components of
what matched.

Defined results: null is the empty text; texts without words are equal to one another; a class's id
is its smallest key, null only where all its keys are; repeated rows are in the same class; an empty
table gives no rows; columns of df besides key and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, mixed, numbered, staged, texts, widened, word_hashes

K = 5
#: Sketches of a text in each of two draws, and k-mers in a sketch. At edit similarity 0.8, by scattered
#: one-word edits, a fifth of the k-mers agree, and both draws together propose 0.95 of such pairs.
SKETCHES = 40
PICKED = 2
#: Sketches whose leaders are met before those of the others.
EARLY = 10
#: A bucket with more pairs of different classes than this for each of so many texts is a crowd; k-mers and words in more texts of a crowd than this are common.
CROWD = 64
#: Up to so many k-mers of crowds are left out at a time, the most frequent first.
COMMON_KMERS = 1_000_000
SIMILAR = 0.8
#: Bits of the signature of a text's words, and standard deviations by which two may disagree by chance.
BITS, CHANCE = 128, 4.0
#: Up to so many keys (of 16 bytes) a list of texts that takes part is broadcast; a longer one is joined.
BROADCAST_ROWS = 500_000
#: A task knows so many of the texts it has met, so as to sketch their copies once.
KNOWN = 100_000
#: Texts of a crowd that meet as many others at a time, and the bins in which their words are counted.
BLOCK, BINS = 2048, 1024
#: Up to so many links (of 32 bytes) the components are found in one task; more are in rounds over all tasks.
FEW_LINKS = 200_000

_POWERS = np.cumprod(np.full(K, 0xD6E8FEB86659FD93, np.uint64))
_NEXT = np.cumprod(np.full(PICKED, 0xA0761D6478BD642F, np.uint64))


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


_last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))


def hashes(line: bytes) -> np.ndarray:
    """word_hashes() of a line, kept for the next call with the same one."""
    global _last
    if _last[0] is not line:
        _last = (line, word_hashes(line))
    return _last[1]


def kmers(line: bytes) -> np.ndarray:
    """Hashes of the k-mers, in order. A text of fewer words than K is one k-mer."""
    h = hashes(line)
    if not len(h):
        return h
    if len(h) < K:
        h = np.concatenate((h, np.zeros(K - len(h), np.uint64)))
    n = len(h) - K + 1
    x = np.zeros(n, np.uint64)
    for j in range(K):
        x += h[j : j + n] * _POWERS[j]
    return mixed(x)


def labelled(x: np.ndarray) -> np.ndarray:
    """k-mers made distinct by how often each has occurred before."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    times = np.empty(n, np.uint64)
    times[order] = np.arange(n) - np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
    return mixed(x + times * np.uint64(0x94D049BB133111EB))


def _seeds(salt: int) -> np.ndarray:
    return mixed((np.arange(1, SKETCHES + 1, dtype=np.uint64) + np.uint64(SKETCHES * salt)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def picked(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SKETCHES hashes, each of the PICKED smallest of the labelled k-mers in text order; none if there are none.

    The k-mers are well mixed, so that their products with an odd seed are hashes enough.
    """
    if not len(x):
        return x
    seeds = _seeds(salt)
    take = min(PICKED, len(x))
    at = np.empty((SKETCHES, take), np.int64)
    step = max(1, (1 << 16) // len(x))
    for a in range(0, SKETCHES, step):
        v = x[None, :] * seeds[a : a + step, None]
        rows = np.arange(len(v))
        for k in range(take):
            at[a : a + step, k] = v.argmin(axis=1)
            v[rows, at[a : a + step, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at.sort(axis=1)
    return mixed((x[at] * _NEXT[None, :take]).sum(axis=1, dtype=np.uint64) ^ seeds)


def uncommon(line: bytes, common: np.ndarray | None) -> np.ndarray:
    """The labelled k-mers of a line but those in `common`, which is sorted and has no labels."""
    x = kmers(line)
    marked = labelled(x) if len(x) else x
    if common is None or not len(common) or not len(x):
        return marked
    return marked[common[np.minimum(np.searchsorted(common, x), len(common) - 1)] != x]


def uncovered(line: bytes, common: np.ndarray) -> np.ndarray:
    """The hashes of the words that no k-mer in `common` covers, in order, and that aren't in it themselves."""
    h, x = hashes(line), kmers(line)
    if not len(common) or not len(h):
        return h
    at = np.flatnonzero(_among(x, common))
    covered = np.zeros(len(h) + K, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + K, -1)
    left = h[np.cumsum(covered)[: len(h)] == 0]
    return left[~_among(left, common)]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def marked(found: np.ndarray) -> np.ndarray:
    """Sketches whose lowest bit says whether they are among the EARLY ones."""
    return np.concatenate((found[:EARLY] | np.uint64(1), found[EARLY:] & ~np.uint64(1)))


def sketches(line: bytes, common: np.ndarray | None = None) -> np.ndarray:
    """Two draws of sketches; common: sorted k-mers that the first leaves out."""
    whole = uncommon(line, None)
    own = whole if common is None else uncommon(line, common)
    return marked(np.concatenate((picked(own), picked(whole, 1))))


def signature(line: bytes) -> np.ndarray:
    """Two numbers of 64 bits: a bit for each of BITS bins, of the smallest labelled word hash that falls into it; 0 where none does."""
    out = np.zeros(BITS, np.uint8)
    x = hashes(line)
    if len(x):
        x = np.sort(labelled(x))[::-1]
        out[(x & np.uint64(BITS - 1)).astype(np.int64)] = (x >> np.uint64(8)).astype(np.uint8) & 1  # the last to be written is the smallest
    return np.packbits(out).view(np.int64)


def allowed(n, threshold: float = SIMILAR, sqrt=np.sqrt, least=np.minimum):
    """In how many bits the signatures of texts of edit similarity `threshold`, the longer of n words, may differ.

    d edits of n words leave n - d of n + d words in common at least. Bins that either text fills hold
    the same smallest word as often; half of the others agree by chance.
    """
    filled = least(BITS + n * 0, n * 1.25 + 1)
    differ = (1 - threshold / (2 - threshold)) / 2
    return differ * filled + CHANCE * (differ * (1 - differ)) ** 0.5 * sqrt(filled)


def distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences, or most + 1 if it is above `most`.

    Common ends are cut off. The rest is aligned in a band that holds every path of up to `band`
    edits; the band doubles until the distance fits into it. A column of the band is one number whose
    bits say where neighbouring cells differ by one.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lo, top = 0, len(b)
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not b:
        return len(a) if len(a) <= most else most + 1
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    band = max(8, len(a) - len(b))
    while True:
        band = min(band, most)
        d = _banded(len(a), b, where, min(band, len(a) - 1)) if len(a) > 1 else int(a[0] not in b) + len(b) - 1
        if d <= band or band >= len(a) - 1:
            return min(d, most + 1)
        if band >= most:
            return most + 1
        band *= 2


def _banded(n: int, b: list, where: dict, band: int) -> int:
    """Edit distance of a (n items, at the places `where` says) and b if it is at most `band`, else any number above `band`.

    After item j of b the band holds rows j - band to j + band of the table, a bit each. `up` and
    `down` say which cells are one more, or one less, than the cell above; as the band moves down a
    row with each item, the cell at its lower edge follows its diagonal until the last row is
    reached, and the last row from there.
    """
    width = 2 * band + 1
    full, edge = (1 << width) - 1, 1 << width - 1
    up, down, value = full ^ ((1 << band) - 1), 0, band
    for j, w in enumerate(b):
        places, shift = where.get(w, 0), j - band
        match = (places >> shift if shift >= 0 else places << -shift) & full
        level = ((((match & up) + up) ^ up) | match | down) & full  # equal to the cell on the diagonal
        more = down | full & ~(level | up)  # one more than the cell to the left
        less = level & up
        if j < n - band:
            value += not level & edge
        else:
            row = 1 << n - 1 - shift
            value += bool(more & row) - bool(less & row)
        moved = level >> 1
        up, down = less | full & ~(moved | more), moved & more
    return value


def similar(a: bytes, b: bytes, threshold: float = SIMILAR) -> bool:
    """Whether the edit similarity of two texts' words reaches the threshold."""
    x, y = a.split(), b.split()
    longer = max(len(x), len(y))
    most = int((1 - threshold) * longer + 1e-9)
    if longer - min(len(x), len(y)) > most:
        return False
    common = sum((Counter(x) & Counter(y)).values())
    if longer - common > most:  # each edit changes one word at most
        return False
    return distance(x, y, most) <= most


def _joined(batches):
    """(node, root) of the links in the batches, by union and find."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(texts(batch, "a"), texts(batch, "b")):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the links (a, b) but the roots: the smallest node that each is connected with.

    Up to FEW_LINKS links are joined in one task; more by large-star and small-star steps in turn, each
    written down, until the links no longer change.
    """
    now = staged(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    if now.count() <= FEW_LINKS:
        return mapped(now.coalesce(1), _joined, "node binary, root binary")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = None
    while (at := state(now)) != last:
        last = at
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written down, so that the join deals out both sides itself and the rows of a large star can be split.
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = staged(down, "stars")
        least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.filter(F.col("a") != F.col("b")).distinct(), "links")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


class _Texts:
    """The table's texts, the row that owns each node, and what has been tested so far."""

    def __init__(self, docs: DataFrame, owners: DataFrame, threshold: float):
        self.docs, self.owners, self.threshold = docs, owners, threshold
        self.tested: DataFrame | None = None
        self.roots: DataFrame | None = None

    def lines(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes, a row for each."""
        n = nodes.count()
        owned = nodes.join(self.owners, "node").select("node", "_k", "_h")
        found = staged(self.docs.select("_k", "_h", "text").join(F.broadcast(owned) if n <= BROADCAST_ROWS else owned, ["_k", "_h"]).select("node", "text"), "lines")
        return found if found.count() == n else staged(found.dropDuplicates(["node"]), "lines")  # rows are repeated

    def placed(self, texts_: DataFrame) -> DataFrame:
        """texts_ (node, ...) with the root of each, itself where it is in no class."""
        if self.roots is None:
            return texts_.withColumn("root", F.col("node"))
        return texts_.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def members(self, held: DataFrame, early: bool = False) -> DataFrame:
        """(bucket, node, n, s0, s1, root) of held; early: only of the early sketches."""
        buckets = F.filter("buckets", lambda x: x.bitwiseAND(F.lit(1)) == 1) if early else F.col("buckets")
        return self.placed(held).select("node", "n", "s0", "s1", "root", F.explode(buckets).alias("bucket"))

    def plausible(self, x: str, y: str):
        """Whether two structs of n, s0 and s1 can belong to similar texts."""
        longer = F.greatest(f"{x}.n", f"{y}.n")
        apart = F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))) + F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1")))
        as_long = F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= (1 - self.threshold) * longer + 1e-9
        return as_long & (apart <= allowed(longer, self.threshold, F.sqrt, F.least))

    def test(self, pairs: DataFrame) -> None:
        """Aligns the pairs (a, b) that haven't been tested, and joins the classes of those that are similar."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if not pairs.limit(1).count():
            return
        nodes = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
        lines = self.lines(nodes)
        # Few pairs go to where the texts are; each pair then takes one of its texts to the other.
        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        both = few.join(lines.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(lines.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        threshold = self.threshold

        def align(batches):
            for batch in batches:
                good = [similar(normal(x), normal(y), threshold) for x, y in zip(texts(batch, "ta"), texts(batch, "tb"))]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        found = mapped(both.select("a", "b", "ta", "tb"), align, "a binary, b binary")
        if self.roots is not None:
            found = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        self.roots = staged(components(found), "roots")


def _shared(found: DataFrame) -> DataFrame:
    """(node, n, s0, s1, buckets): the sketches of each text that others have too. found, written down: node, n, s0, s1, sketch."""
    spread = found.select("node", F.explode("sketch").alias("bucket")).repartition("bucket").dropDuplicates(["bucket", "node"])
    counted = spread.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("c > 1")
    each = found.groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "s0", "s1")])
    return staged(counted.groupBy("node").agg(F.collect_list("bucket").alias("buckets")).join(each, "node"), "held")


def _full(lines: DataFrame, items: Callable) -> np.ndarray:
    """Bits of the bins into which more than CROWD texts of the lines (node, text) put a k-mer or word, as many bins as these have items or so; a common one lies in such a bin.

    A task counts up to CROWD + 1 in a byte and sends its bins by pieces of 2**16, which are added up piece by piece.
    """
    size = lines.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = 1 << min(24, max(16, (size // 4).bit_length()))

    def count(batches):
        held = np.zeros(bins, np.uint8)
        for batch in batches:
            for x in texts(batch):
                at = np.unique(_bin(items(normal(x)), bins))
                held[at] = np.minimum(held[at], CROWD) + 1
        pieces = held.reshape(-1, 1 << 16)
        for k in np.flatnonzero(pieces.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pieces[k].tobytes()], pa.binary())], names=["piece", "held"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.int64)
        for x in t["held"]:
            total += np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"piece": t["piece"][:1], "full": pa.array([np.packbits(total > CROWD).tobytes()], pa.binary())})

    found = mapped(lines.select("text"), count, "piece int, held binary").groupBy("piece").applyInArrow(add, "piece int, full binary").collect()  # 2**24 bits at most
    out = np.zeros((bins >> 16, 1 << 13), np.uint8)
    for r in found:
        out[r["piece"]] = np.frombuffer(r["full"], np.uint8)
    return out.ravel()


def _bin(x: np.ndarray, bins: int) -> np.ndarray:
    return (x & np.uint64(bins - 1)).astype(np.int64)


def _common(lines: DataFrame, known: np.ndarray) -> np.ndarray:
    """Up to COMMON_KMERS k-mers and words outside of known k-mers, besides the known ones, that more than CROWD of the lines (node, text) hold.

    They are counted in bins first, and only those in full bins one by one: what few texts hold doesn't leave its task.
    """
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def items(x: bytes) -> np.ndarray:
        found = np.unique(np.concatenate((kmers(x), uncovered(x, shared.value))))
        return found[~_among(found, shared.value)]

    full = lines.sparkSession.sparkContext.broadcast(_full(lines, items))

    def count(batches):
        bits = full.value
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                found = np.concatenate([items(normal(x)) for x in texts(batch.slice(a, 100))])
                at = _bin(found, 8 * len(bits))
                ids, n = np.unique(found[bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    counts = mapped(lines.select("text"), count, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD)
    found = counts.orderBy(F.desc("n"), "kmer").limit(COMMON_KMERS).select("kmer").toArrow()  # COMMON_KMERS rows
    return np.sort(np.concatenate((known, found["kmer"].to_numpy().astype(np.int64).view(np.uint64))))


def _dealt_anew(lines: DataFrame, common: np.ndarray, level: int) -> DataFrame:
    """(node, n, s0, s1, sketch) of the lines (node, text): a draw from the k-mers that aren't common, and two from the words outside of common ones.

    Where most of a text is a passage that a crowd shares, all edits may stand in the rest, and close
    together; words, k-mers of length one, survive there more often than longer ones.
    """
    shared = lines.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("node"))
            words = [normal(x) for x in texts(batch)]
            found = []
            for x in words:
                left = uncovered(x, shared.value)
                rest = labelled(left) if len(left) else left
                found.append(marked(np.concatenate((picked(uncommon(x, shared.value), 3 * level), picked(rest, 3 * level + 1), picked(rest, 3 * level + 2)))))
            yield sketched([ids], ["node"], words, found)

    return mapped(lines.select("node", "text"), run, f"node binary, {SKETCHED}")


SKETCHED = "n int, s0 long, s1 long, sketch array<long>"


def sketched(columns: list, names: list[str], lines: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of the columns, and of each line its words, its signature and the sketches found."""
    bits = np.array([signature(x) for x in lines], np.int64).reshape(-1, 2)
    more = [pa.array([x.count(b" ") + 1 for x in lines], pa.int32()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "n", "s0", "s1", "sketch"])


def _led(members: DataFrame, all_: _Texts) -> None:
    """Aligns the texts of each bucket with its leader, the smallest node, unless they are in its class."""
    text_ = F.struct("node", "root", "n", "s0", "s1")
    met = members.select(text_.alias("y"), F.min(text_).over(Window.partitionBy("bucket")).alias("x"))
    all_.test(met.filter((F.col("x.root") != F.col("y.root")) & all_.plausible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def _several(members: DataFrame) -> DataFrame:
    """members of the buckets that hold several classes, with the largest of these (most), how many texts are in others, and whether there is a crowd of them."""
    bucket = Window.partitionBy("bucket")
    counted = members.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("bucket", "root"))).withColumn("m", F.max(F.struct("c", "root")).over(bucket))
    counted = counted.withColumn("others", F.count(F.lit(1)).over(bucket) - F.col("m.c")).filter("others > 0")
    size = F.col("others") + F.col("m.c")
    # Up to CROWD pairs a text are made in a bucket; in a large one, CROWD / 8.
    crowd = (F.col("others") * size > CROWD * CROWD) & (F.col("others") > CROWD // 8)
    return staged(counted.withColumns({"most": F.col("m.root"), "crowd": crowd}).drop("c", "m"), "several")


def _led_anew(several: DataFrame, all_: _Texts) -> None:
    """Aligns the texts outside of each bucket's largest class with one member of it, another one in each bucket."""
    text_ = [F.col(c) for c in ("node", "root", "n", "s0", "s1")]
    member = F.min(F.when(F.col("root") == F.col("most"), F.struct(F.xxhash64("bucket", "node").alias("h"), *text_))).over(Window.partitionBy("bucket"))
    met = several.select("most", F.struct(*text_).alias("y"), member.alias("x"))
    met = met.filter((F.col("y.root") != F.col("most")) & all_.plausible("x", "y"))
    all_.test(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _between(several: DataFrame, all_: _Texts) -> None:
    """Aligns the pairs of different classes in each bucket. Members of a bucket's largest class meet only its other members."""
    text_ = F.struct("node", "root", "n", "s0", "s1")
    x = several.filter("root != most").select("bucket", text_.alias("x"))
    y = several.select("bucket", "most", text_.alias("y"))
    both = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("most")) | (F.col("x.node") < F.col("y.node"))) & all_.plausible("x", "y"))
    all_.test(both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def word_counts(line: bytes) -> np.ndarray:
    """How many of the line's words fall into each of BINS bins, up to 255. An edit changes two of these numbers by one at most."""
    return np.minimum(np.bincount((hashes(line) >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8)


def near_pairs(x: tuple, y: tuple | None, threshold: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of x and y, or within x without y, of different classes whose lengths, signatures and word counts allow similarity.

    x and y: lengths, signatures (two columns), word counts and classes of some texts.
    """
    (n, bits, counts, root), (m, bits_, counts_, root_) = x, x if y is None else y
    at: list[np.ndarray] = []
    step = max(1, (1 << 19) // max(1, len(m)))
    for a in range(0, len(n), step):
        own = slice(a, a + step)
        longer = np.maximum(n[own, None], m[None, :])
        apart = np.bitwise_count(bits[own, None, 0] ^ bits_[None, :, 0]) + np.bitwise_count(bits[own, None, 1] ^ bits_[None, :, 1])
        most = (1 - threshold) * longer + 1e-9
        good = (np.abs(n[own, None] - m[None, :]) <= most) & (apart <= allowed(longer, threshold)) & (root[own, None] != root_[None, :])
        if y is None:
            good &= np.arange(a, min(a + step, len(n)))[:, None] < np.arange(len(m))[None, :]
        i, j = np.nonzero(good)
        for b in range(0, len(i), 1 << 12):
            k, o = i[b : b + (1 << 12)], j[b : b + (1 << 12)]
            own_, their = counts[a + k], counts_[o]
            differ = (np.maximum(own_, their) - np.minimum(own_, their)).sum(axis=1, dtype=np.int32)
            kept = differ + np.abs(n[a + k] - m[o]) <= 2 * most[k, o]  # else more words differ than edits are allowed
            at.append(np.stack((a + k[kept], o[kept])))
    found = np.concatenate(at, axis=1) if at else np.empty((2, 0), np.int64)
    return found[0], found[1]


def _settled(nodes: DataFrame, all_: _Texts) -> None:
    """Tests all pairs of the nodes (node) that are in different classes and can be similar.

    Similar texts have neighbouring classes of length. Each of these is dealt to blocks of about BLOCK
    texts; a block meets those of its own class and of the next one, each pair of blocks in a group of its own.
    """
    threshold = all_.threshold

    def told(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                lines = [normal(x) for x in texts(part)]
                bits = np.array([signature(x) for x in lines], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("node")), pa.array([x.count(b" ") + 1 for x in lines], pa.int32()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([word_counts(x).tobytes() for x in lines], pa.binary())],
                    names=["node", "n", "s0", "s1", "counts"],
                )

    rows = mapped(all_.lines(nodes).select("node", "text"), told, "node binary, n int, s0 long, s1 long, counts binary")
    rows = staged(all_.placed(rows).withColumn("g", F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")), "crowd")
    sizes = {r["g"]: -(-r["count"] // BLOCK) for r in rows.groupBy("g").count().collect()}  # a row for each class of length
    parts = lambda by: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for g, k in sizes.items() for v in (g, k)]), F.col("g") + by), F.lit(0))
    every = lambda by, f: F.transform(F.filter(F.sequence(F.lit(-1), parts(by) - 1), lambda q: q >= 0), f)
    met = lambda g, p, h, q: F.struct(g.alias("g"), p.alias("p"), h.alias("h"), q.alias("q"))
    g, p = F.col("g"), F.col("block")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), parts(0)).cast("int"))
    groups = F.concat(every(0, lambda q: met(g, F.least(p, q), g, F.greatest(p, q))), every(1, lambda q: met(g, p, g + 1, q)), every(-1, lambda q: met(g - 1, q, g, p)))
    rows = rows.select("node", "n", "s0", "s1", "counts", "root", g.alias("own_g"), p.alias("own_p"), F.explode(groups).alias("m")).select("*", "m.*").drop("m")

    def pairs(t: pa.Table) -> pa.Table:
        same = (t["own_g"].to_numpy() == t["g"].to_numpy()) & (t["own_p"].to_numpy() == t["p"].to_numpy())
        _, root = np.unique(np.array(t["root"].to_pylist(), dtype=object), return_inverse=True)
        bits = np.stack((t["s0"].to_numpy(), t["s1"].to_numpy()), axis=1).view(np.uint64)
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8).reshape(-1, BINS)
        n, nodes_ = t["n"].to_numpy().astype(np.int64), t["node"].combine_chunks()
        side = lambda at: (n[at], bits[at], counts[at], root[at])
        x, y = np.flatnonzero(same), np.flatnonzero(~same)
        alone = t["g"][0] == t["h"][0] and t["p"][0] == t["q"][0]
        i, j = near_pairs(side(x), None if alone else side(y), threshold)
        a, b = nodes_.take(pa.array(x[i])), nodes_.take(pa.array((x if alone else y)[j]))
        return pa.table({"a": a, "b": b})

    found = staged(rows.groupBy("g", "p", "h", "q").applyInArrow(pairs, "a binary, b binary"), "near")
    all_.test(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """For each row of df: key, _h (a hash of its text), class_id, class_size (rows) and kept, true for one key and text of each class."""
    docs = df.select(F.col(key).alias(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"))

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                lines = [normal(x) for x in texts(part)]
                ids = [hashlib.blake2b(x, digest_size=16).digest() for x in lines]
                found = []
                for x, node in zip(lines, ids):
                    found.append(np.empty(0, np.uint64) if node in met else sketches(x))
                    met.add(node)
                if len(met) > KNOWN:
                    met.clear()
                yield sketched([*part.select([key, "_k", "_h"]).columns, pa.array(ids, pa.binary())], [key, "_k", "_h", "node"], lines, found)

    rows = staged(mapped(docs, run, widened(docs, [key, "_k", "_h"], f"node binary, {SKETCHED}")), "sketches")
    owners = staged(rows.groupBy("node").agg(F.min(F.struct("_k", "_h")).alias("o")).select("node", "o._k", "o._h"), "owners")
    all_ = _Texts(docs, owners, threshold)
    held, common, level = _shared(rows), np.empty(0, np.uint64), 0
    crowd = None
    while held.limit(1).count():
        _led(all_.members(held, early=True), all_)
        several = _several(all_.members(held))
        _led_anew(several, all_)
        several = _several(all_.placed(several.drop("root", "most", "others", "crowd")))
        _between(several.filter(~F.col("crowd")), all_)
        nodes = staged(several.filter("crowd").select("node").distinct(), "nodes")
        if not nodes.limit(1).count():
            break
        crowd = nodes if crowd is None else crowd  # texts of later crowds are among these
        lines = all_.lines(nodes)
        known, common, level = len(common), _common(lines, common), level + 1
        if len(common) == known:  # nothing tells them apart
            break
        held = _shared(staged(_dealt_anew(lines, common, level), "sketches"))
    if crowd is not None:
        _settled(crowd, all_)
    placed = all_.placed(rows.select(key, "_k", "_h", "node"))
    first = F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("_h").alias("h"))).alias("first")
    each = staged(placed.groupBy("root").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"), first), "classes")
    out = staged(placed, "placed").join(each, "root")  # both sides are dealt by this join alone, so that the rows of a large class can be split
    kept = F.col(key).eqNullSafe(F.col("first.k")) & (F.col("_h") == F.col("first.h"))
    return out.select(key, "_h", "class_id", "class_size", kept.alias("kept"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """df's rows without near duplicates: of each class the row with the smallest key stays (of equal keys, one).

    Other columns come back as they are, whatever their names.
    """
    rows, new, back = numbered(df)
    key, text = new[key], new[text]
    keep = classes(rows, key, text, threshold).filter("kept").groupBy(F.col(key).alias("_k"), "_h").agg(F.count(F.lit(1)).alias("_times"))
    keep = staged(keep, "kept")
    rows = rows.withColumn("_hash", F.xxhash64(text))
    both = rows.join(keep, rows[key].eqNullSafe(keep["_k"]) & (rows["_hash"] == keep["_h"]))
    once, more = both.filter("_times = 1"), both.filter("_times > 1").dropDuplicates([key, "_hash"])
    return once.unionByName(more).select(*back)
