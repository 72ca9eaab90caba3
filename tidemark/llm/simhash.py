"""SimHash near-duplicates: a binary trie joined with itself, then connected components.

Fingerprints: XXH64 (seed 42) of all 3-word shingles, repeats included; a bit is set if it is set in over half of
them. Two documents are linked at `budget` (2) or fewer differing bits.

The trie self-join runs in parallel below its upper levels. Two fingerprints that differ in at most 2 bits agree in
at least 2 of their 4 blocks of 16 bits, so with each of the 6 pairs of blocks moved to the front, linked
fingerprints share the first 32 levels of one of 6 tries. What shares them is one trie node; a task starts from the
pair (node, node), goes down level by level on all its node pairs together, adds up differing bits and drops a pair
as soon as it has more than the budget. Only distinct fingerprints take part, so copies cost nothing; a node with
very many fingerprints is split into chunks, joined chunk by chunk in different tasks. A task reports a spanning
forest of the links that it found, not the links.

Components are found by passing the least label along forest edges, with the labels written to the shared folder
each round.

Null or empty texts have fingerprint zero and are linked like any other. Repeated rows get equal results. Rows with a
null doc_id take part; `component_id` is the least non-null doc_id of the component, null if there is none.

With a `similarity` (the pipeline's stage: 0.8 on five words, a budget of 3 bits), documents are linked if the Jaccard
similarity of their sets of shingles is that or more; `fp` is then a hash of the set, and texts without words are linked.
The same steps find candidates: SimHash fingerprints of the sets and the trie joined with itself, with fronts of two of
budget + 2 blocks, whose pairs are verified on the whole sets. These links make the first components. Pairs that differ in
more bits, or that a forest of unverified pairs left out, are then found by an exact rest; no Hamming budget finds all such
pairs. It compares only documents of different components, by a prefix filter, which loses none: with one order of all
shingles, two such sets share one of the first n - ceil(similarity * n) + 1 of each.
Any order is right; shingles that several prefixes by hash share come late in it, so that few documents meet.
Of the documents that meet, shingles that no other of them holds are counted: two sets share no more than what either
has left, which rules out most documents of a large group of loosely alike ones before any pair is made. Of those that
stay, each is compared with a center first, the document with the largest part of shared shingles, to which all that
can be near to any tend to be near; what that has joined is not compared with itself again, all other pairs
are, if masks of their shared shingles leave room for a link. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, load, materialise

SHINGLE = 3
BUDGET = 2
#: Bits for candidates that are verified. More find more links before the exact rest, but with shorter fronts, at which unlike
#: fingerprints meet in number of the square of the input: fronts of 25 bits at 3, 18 at 5.
NEAR_BUDGET = 3
#: Distinct fingerprints below one trie node that one task joins; a larger node is split.
NODE_ROWS = 2048
#: Node pairs that are held at once while going down.
FRONTIER = 500_000
#: Bits that mark shingles as shared or sets as candidates; too few cost time, not links.
MARKS = 1 << 26
NEAR = 1e-9
#: Words of the masks; too few cost time, not links.
MASK_WORDS = 16


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included; a shorter text is one shingle, a text without words none."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []  # bytes: only A-Z, only 0x20 and 0x09-0x0D
    n = len(words) - size + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(start[:n].tolist(), end[size - 1 :].tolist())], np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return voted(shingles(text, size))


def voted(h: np.ndarray) -> int:
    """The fingerprint of these hashes."""
    n = len(h)
    if n <= 1:
        return int(h[0]) if n else 0
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        votes += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return df.select("doc_id", df[text]).mapInArrow(run, T.StructType([df.schema["doc_id"], T.StructField("fp", T.LongType())]))


def blocks(budget: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Shift and width of budget + 2 blocks of 64 bits, highest first, and the pairs of them that can be a front: what
    differs in no more bits than the budget agrees in two blocks."""
    m = budget + 2
    ends = [64 * i // m for i in range(m + 1)]
    return [(64 - y, y - x) for x, y in zip(ends, ends[1:])], [(a, b) for a in range(m) for b in range(a + 1, m)]


def with_front(fp: np.ndarray, pair: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """The fingerprints with two of their blocks moved to the front; pair: index into the pairs of blocks()."""
    out = np.empty_like(fp)
    cut, pairs = blocks(budget)
    for i, (a, b) in enumerate(pairs):
        on = pair == i
        moved = np.zeros(np.count_nonzero(on), np.uint64)
        for shift, width in [cut[a], cut[b], *(x for k, x in enumerate(cut) if k not in (a, b))]:
            moved = (moved << np.uint64(width)) | ((fp[on] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        out[on] = moved
    return out


def trie_join(keys: np.ndarray, node: np.ndarray, budget: int = BUDGET, depth: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of keys that share a node and differ in at most `budget` bits.

    keys: distinct within a node, sorted by (node, key). A trie node is a range of them; `depth` is the level at which
    the nodes stand. Node pairs are split on the next bit, both ranges at once.
    """
    edge = np.flatnonzero(np.diff(node)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        level, a0, a1, b0, b1, bits = stack.pop()
        if not len(a0):
            continue
        if level == 64:
            apart = a0 != b0
            yield a0[apart], b0[apart]
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[half:] for x in (a0, a1, b0, b1, bits))), (level, *(x[:half] for x in (a0, a1, b0, b1, bits)))]
            continue
        shift = np.uint64(63 - level)
        ones = np.concatenate([[0], np.cumsum((keys >> shift) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # in a node's range the zeros come first
        twin = a0 == b0  # a node with itself: its two children meet once
        parts = [(a0, am, b0, bm, bits, True), (am, a1, bm, b1, bits, True), (a0, am, bm, b1, bits + 1, True), (am, a1, b0, bm, bits + 1, ~twin)]
        made = [np.concatenate(x) for x in zip(*[[y[k] for y in (p0, p1, q0, q1, e)] for p0, p1, q0, q1, e, on in parts for k in [(p1 > p0) & (q1 > q0) & (e <= budget) & on]])]
        p0, p1, q0, q1, e = made
        useful = (p0 != q0) | (p1 - p0 > 1)  # a single fingerprint has no partner in itself
        stack.append((level + 1, *(x[useful] for x in (p0, p1, q0, q1, e))))


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.up[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def join_all(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs that joined what was apart. Most pairs of a large group are dropped unseen."""
        made = []
        for k in range(0, len(x), 65_536):
            a, b = x[k : k + 65_536], y[k : k + 65_536]
            while len(a):
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = np.array([self.root(n) for n in names.tolist()], np.int64)[at]
                apart = label[: len(a)] != label[len(a) :]
                a, b = a[apart], b[apart]
                made += [(p, q) for p, q in zip(a[:1000].tolist(), b[:1000].tolist()) if self.join(p, q)]
                a, b = a[1000:], b[1000:]
        return made


def links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS, real: bool = False) -> DataFrame:
    """Edges (a, b) of a forest whose trees span, node by node, what links at `budget` or fewer bits join; if `real`, each
    edge is such a link itself."""
    if budget > 6:
        raise ValueError("the fronts are too short for more than 6 bits")
    cut, pairs = blocks(budget)
    depth = min(cut[a][1] + cut[b][1] for a, b in pairs)
    block = lambda i: F.shiftrightunsigned("fp", cut[i][0]).bitwiseAND((1 << cut[i][1]) - 1)
    nodes = distinct.select("fp", F.posexplode(F.array(*[F.shiftleft(block(a), cut[b][1]).bitwiseOR(block(b)) for a, b in pairs])).alias("pair", "front"))
    sizes = nodes.groupBy("pair", "front").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / node_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), "m").cast("int")
    nodes = (
        nodes.join(sizes, ["pair", "front"]).withColumn("m", chunks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("pair", "front", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, made = Forest(), []

        def join(rows: list[np.ndarray]) -> None:
            pair, front, c1, c2, fp = rows
            keys = with_front(fp.view(np.uint64), pair, budget)
            order = np.lexsort((keys, c2, c1, front, pair))
            keys, names = keys[order], fp[order]
            whole = np.stack([x[order] for x in (pair, front, c1, c2)])
            node = np.concatenate([[0], np.cumsum((np.diff(whole, axis=1) != 0).any(axis=0))])
            for i, j in trie_join(keys, node, budget, depth):
                if real:
                    made.extend(forest.join_all(names[i], names[j]))
                    continue
                for x, y in zip(names[i].tolist(), names[j].tolist()):
                    forest.join(x, y)

        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(k).to_numpy().astype(np.int64) for k in range(5)]
            if held:
                rows = [np.concatenate([old, new]) for old, new in zip(held.pop(), rows)]
            # the last node may go on in the next batch
            change = np.flatnonzero((np.diff(np.stack(rows[:4]), axis=1) != 0).any(axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                join([x[:cut] for x in rows])
            held.append([x[cut:] for x in rows])
        if held and len(held[0][0]):
            join(held[0])
        edges = made if real else [(x, forest.root(x)) for x in forest.up]
        for i in range(0, len(edges), 50_000):
            a, b = zip(*edges[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["pair", "front", "c1", "c2"]
    return nodes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node with an edge can reach.

    Each round points every node at the least label among its neighbours and itself, then at that label's label, so
    chains shorten by halves; edges between nodes of one label are dropped.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while edges.take(1):
        # hook: every node goes to its least neighbour if that is less; then compress to the roots
        parent = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        parent = materialise(parent, "hook")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parent = materialise(parent.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "compress")
            moved = parent.where("moved").limit(1).count()
            parent = parent.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            new = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = labels.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(parent)
        labels = materialise(labels, "labels")
        root = parent.select(F.col("node").alias("k"), "root")
        a = edges.join(root, edges["a"] == root["k"], "left").select(F.coalesce("root", "a").alias("a"), "b")
        edges = a.join(root, a["b"] == root["k"], "left").select("a", F.coalesce("root", "b").alias("b"))
        edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def set_of(text: str | None, size: int) -> tuple[int, int, np.ndarray]:
    """A signed hash of the text's set of shingles (0 if it is empty), the set's signed fingerprint, and the set in order."""
    import xxhash

    grams = np.unique(shingles(text, size))
    key, sim = xxhash.xxh64_intdigest(grams.tobytes(), 42) if len(grams) else 0, voted(grams)
    return key - (key >> 63 << 64), sim - (sim >> 63 << 64), grams.view(np.int64)


def shingle_sets(df: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the hash of the set), sim (its fingerprint) and grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                fp, sim, grams = zip(*[set_of(x.as_py(), size) for x in part.column(1)])
                ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
                columns = [part.column(0), pa.array(fp, pa.int64()), pa.array(sim, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sim", "grams"])

    own = [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]
    return df.select("doc_id", df[text]).mapInArrow(run, T.StructType([df.schema["doc_id"], *own]))


def near_pairs(sims: DataFrame, budget: int) -> DataFrame:
    """Pairs (a, b) of sets (fp, sim) that the trie join finds at `budget` or fewer bits: enough to connect all such sets."""
    named = materialise(sims.select("fp", "sim").distinct(), "sims")
    first = materialise(named.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")  # of sets with one fingerprint
    edges = links(first.select(F.col("sim").alias("fp")), budget, real=True)
    end = lambda c: first.select(F.col("sim").alias(c), F.col("first").alias(f"{c}_first"))
    between = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    equal = named.join(first, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return materialise(between.unionByName(equal), "near_pairs")


def marks(df: DataFrame, name: str) -> np.ndarray:
    """Bits, packed, that are set where a number of the column falls; other numbers may fall there too."""
    place = F.col(name).bitwiseAND(MARKS - 1)
    parts = df.groupBy(F.shiftright(place, 15).alias("k")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros((MARKS >> 15, 4096), np.uint8)
    for part in parts:
        out[part["k"]] = np.frombuffer(part["bits"], np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = numbers & (MARKS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def prefixes(sets: DataFrame, similarity: float, late: np.ndarray | None = None) -> DataFrame:
    """fp, n (the set's size) and gram: the first shingles of each set by hash, those marked in `late` after all others."""
    sent = sets.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                fp, flat = part.column(0).to_numpy(), part.column(1).flatten().to_numpy()
                n = part.column(1).value_lengths().to_numpy().astype(np.int64)
                set_ = np.repeat(np.arange(len(n)), n)
                if sent.value is not None:
                    flat = flat[np.lexsort((marked(sent.value, flat), set_))]  # stable: by hash within both
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                on = at < (n - np.ceil(similarity * n - NEAR).astype(np.int64) + 1)[set_]
                columns = [pa.array(fp[set_[on]], pa.int64()), pa.array(n[set_[on]], pa.int32()), pa.array(flat[on], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "gram"])

    return sets.select("fp", "grams").mapInArrow(run, "fp long, n int, gram long")


def only_marked(sets: DataFrame, bits: np.ndarray) -> DataFrame:
    sent = sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(sent.value, batch.column(0).to_numpy())))

    return sets.select("fp", "grams").mapInArrow(run, "fp long, grams array<long>")


def shared_parts(own: DataFrame, similarity: float) -> DataFrame:
    """fp, s (the number of the set's shingles that another of the sets holds), where that is enough for any link, and a
    mask of `MASK_WORDS` words of 64 bits, in which each of these shingles sets a bit."""
    each = own.select("fp", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    slot = F.pmod(F.xxhash64("gram"), F.lit(64 * MASK_WORDS)).cast("int")
    bit = F.expr("shiftleft(1L, slot % 64)")
    masks = [F.bit_or(F.when(F.floor(F.col("slot") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MASK_WORDS)]
    parts = each.join(shared, "gram", "left_semi").withColumn("slot", slot).groupBy("fp", "n").agg(F.count("*").cast("int").alias("s"), *masks)
    return parts.where(F.col("s") >= similarity * F.col("n") - NEAR).drop("n")


def most_shared(x: str, y: str) -> Column:
    """An upper bound of what two sets share: a bit that only one mask has is a shingle that the other set lacks."""
    apart = lambda a, b: sum((F.bit_count(F.col(f"{a}.m{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.m{i}")))) for i in range(MASK_WORDS)), F.lit(0))
    return F.least(F.col(f"{x}.s") - apart(x, y), F.col(f"{y}.s") - apart(y, x))


def similar_links(sets: DataFrame, similarity: float, near: DataFrame) -> DataFrame:
    """Edges (a, b) between set hashes that join all sets of this Jaccard similarity or more, and no others.

    near: candidates (a, b) of the trie join, which are verified first; the prefix filter is for what they leave apart.
    What is written for `sets` is deleted on the way.
    """
    group = Window.partitionBy("gram")
    least = similarity / (1 + similarity)  # of both sizes' sum, what two sets share at least

    def met(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"lo": F.min("fp").over(group), "hi": F.max("fp").over(group)}).where("lo <> hi").drop("lo", "hi")

    late = marks(prefixes(sets, similarity).groupBy("gram").count().where("count > 1"), "gram")
    rows = materialise(met(prefixes(sets, similarity, late)).dropDuplicates(["gram", "fp"]), "shared")
    own = only_marked(sets, marks(rows, "fp"))
    own = materialise(own.join(rows.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "grams"), "sets")
    discard(sets)
    # twice: what the sets that are gone held alone with another does not count any more
    for _ in range(2):
        parts = materialise(shared_parts(own, similarity), "parts")
        old, own = own, materialise(own.join(parts.select("fp"), "fp", "left_semi"), "sets")
        discard(old)
    old, rows = rows, materialise(met(rows.join(parts.select("fp", "s"), "fp")), "shared")
    discard(old)

    def fits(m: Column, s: Column, n: Column, z: Column) -> Column:
        """Sizes m and n and shared parts s and z leave room for a link."""
        return (F.least(m, n) >= similarity * F.greatest(m, n) - NEAR) & (F.least(s, z) >= least * (m + n) - NEAR)

    def verified(p: tuple[Column, Column], q: tuple[Column, Column], pairs: DataFrame) -> DataFrame:
        """Links among the pairs that met, once for each shared shingle; p and q: hash and size of each set.

        What two sets share outside both prefixes lies behind the prefix that ends first, so few common ones rule a pair out.
        """
        pairs = pairs.select(F.least(p[0], q[0]).alias("a"), F.greatest(p[0], q[0]).alias("b"), (p[1] + q[1]).alias("sum"), F.greatest(p[1], q[1]).alias("more"))
        pairs = pairs.groupBy("a", "b", "sum", "more").count()
        return alike(pairs.where(F.col("count") + F.ceil(similarity * F.col("more") - NEAR) - 1 >= least * F.col("sum") - NEAR).select("a", "b"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Links among the pairs. A set that is gone from `own` has none."""
        pairs = pairs.join(own.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return materialise(pairs.where(both >= similarity * (F.size("x") + F.size("y") - both) - NEAR).select("a", "b"), "links")

    def labelled() -> DataFrame:
        return materialise(rows.join(components(edges), rows["fp"] == F.col("node"), "left").select("gram", "fp", "n", "s", F.coalesce("root", "fp").alias("label")), "named")

    edges = alike(near)
    named = labelled()
    for best in (F.struct(-F.col("s") / F.col("n"), F.xxhash64("fp")), F.xxhash64(F.lit(1), "fp")):
        center = named.groupBy("gram").agg(F.min_by(F.struct("fp", "n", "s", "label"), best).alias("c"))
        pairs = named.join(center, "gram").where((F.col("label") != F.col("c.label")) & fits(F.col("n"), F.col("s"), F.col("c.n"), F.col("c.s")))
        found = verified((F.col("fp"), F.col("n")), (F.col("c.fp"), F.col("c.n")), pairs)
        edges = edges.unionByName(found)
        named = labelled()
    most = named.groupBy("gram").agg(F.mode("label").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram", "most")
    named = materialise(named.join(most, "gram").join(parts.drop("s"), "fp"), "apart")
    x, y = named.where("label <> most").alias("x"), named.alias("y")
    other = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.most")) | (F.col("x.fp") < F.col("y.fp")))
    room = fits(F.col("x.n"), F.col("x.s"), F.col("y.n"), F.col("y.s")) & (most_shared("x", "y") >= least * (F.col("x.n") + F.col("y.n")) - NEAR)
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & other & room)
    return edges.unionByName(verified((F.col("x.fp"), F.col("x.n")), (F.col("y.fp"), F.col("y.n")), pairs))


def near_duplicates(df: DataFrame, text: str = "text", budget: int = BUDGET, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id, root (a fingerprint that names the component): one row for each row of df.

    Links are those of `budget` bits, or with `similarity` those of the Jaccard similarity, of which the trie join finds the
    ones within `budget` bits; `size`: words of its shingles.
    """
    if similarity is None:
        fps = materialise(fingerprints(df, text), "fingerprints")
    else:
        sets = materialise(shingle_sets(df, text, size), "shingles")
        fps = materialise(sets.select("doc_id", "fp", "sim"), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), budget) if similarity is None else similar_links(sets, similarity, near_pairs(fps, budget)))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(named.join(least, "root").select("fp", "root", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(df: DataFrame, text: str = "text", budget: int = BUDGET, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """df with one row of each component: the one with its least doc_id (of rows that repeat it, one).

    Of a component without any doc_id, one of the rows with its least fingerprint stays. Names that start with `_sh_`
    are reserved.
    """
    found = materialise(near_duplicates(df.select("doc_id", text), text, budget, size, similarity), "near")
    first = found.where(F.col("doc_id") == F.col("component_id"))
    # a doc_id that several texts share is settled by doc_id and fingerprint; these rows are fingerprinted again
    shared = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id"), "shared")
    kept = first.join(shared, "doc_id", "left_anti").select("doc_id").distinct()
    out = df.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*df.columns)
    if not shared.isEmpty():
        own = with_fingerprint(df.join(shared, "doc_id", "left_semi").select(*df.columns), text, size, similarity)
        pairs = first.select("doc_id", F.col("fp").alias("_sh_fp")).distinct()
        out = out.unionByName(own.join(pairs, ["doc_id", "_sh_fp"], "left_semi").dropDuplicates(["doc_id"]).select(*df.columns))
    unnamed = found.where(F.col("component_id").isNull()).groupBy("root").agg(F.min("fp").alias("_sh_fp")).select("_sh_fp")
    if not unnamed.isEmpty():
        own = with_fingerprint(df.where(F.col("doc_id").isNull()), text, size, similarity)
        out = out.unionByName(own.join(unnamed, "_sh_fp", "left_semi").dropDuplicates(["_sh_fp"]).select(*df.columns))
    return out


def with_fingerprint(df: DataFrame, text: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """df with its fingerprint, or with `similarity` the hash of its set of shingles, as column _sh_fp."""
    columns = df.columns
    of = (lambda x: fingerprint(x)) if similarity is None else (lambda x: set_of(x, size)[0] % 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([of(x.as_py()) for x in batch.column(columns.index(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*columns, "_sh_fp"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("_sh_fp", T.LongType())]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
