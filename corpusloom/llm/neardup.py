"""Near-duplicate groups by MinHash with tensored banding.

A document is the set of its distinct word shingles (64-bit hashes; A-Z lower-cased). Documents of
equal sets form a class at once, and only one of a class goes on. Two small collections of ``m``
sub-sketches of ``ROWS`` minhashes each are computed; the table keys are all m * m combinations of
one sub-sketch from either collection. So 2 * m * ROWS minhashes serve m * m tables of 2 * ROWS
minhashes each, about the square root of what separate tables would need. ``m`` follows from the
threshold: a link at the threshold is missed by all tables with a probability of ``MISS`` at most.

A key is formed only where both of its sub-sketches occur more than once. No bucket is expanded to
all its pairs: each is linked as a star to its smallest member, the pairs are confirmed on full
shingle sets, and confirmed links join components. Within one component further pairs can't change
the result. The members of buckets that still hold several components are settled exactly: sets
that similar share a shingle among the first few of either in one order, rarest first, so members
meet by these few shingles, in blocks of ``BLOCK``. A pair is looked at under its first common one
only; components, sizes, places in the order and the minhashes rule out nearly all, and what is
left is confirmed on full sets.

Components come from rounds of large-star and small-star steps, cut by Parquet tables in the shared
folder. Nulls and texts without words have no shingles and are linked with nothing. Rows that
repeat an id stay together; a null id takes part by its text, and is kept only where no document of
its group has an id. Other columns are ignored; ``deduplicated`` keeps them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim, written

ROWS, MISS = 3, 3e-5
BLOCK = 1024
#: Pairs whose minhashes agree in a share this far below the threshold (5 standard deviations) are not read in full.
_SIGMAS = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands(threshold: float) -> int:
    """Sub-sketches per collection."""
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - threshold**ROWS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(x)


class Sketcher:
    def __init__(self, m: int, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.m, size = m, 2 * m * ROWS
        self.mult = rng.integers(0, 1 << 63, size, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, size, np.uint64)[:, None]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Minhashes, 32 bits each."""
        low = np.full(len(self.mult), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            v = ((x[None, at : at + 512] ^ self.add) * self.mult) >> np.uint64(32)
            low = np.minimum(low, v.min(1).astype(np.uint32))
        return low

    def sub(self, low: np.ndarray) -> np.ndarray:
        """The 2 * m sub-sketches as 64-bit hashes; the first m are of the first collection."""
        part = low.reshape(2 * self.m, ROWS).astype(np.uint64)
        x = np.arange(2 * self.m, dtype=np.uint64)
        for k in range(ROWS):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
        return x.view(np.int64)


def _sketches(docs: DataFrame, n: int, m: int) -> DataFrame:
    """doc_id, fp (128 bits of the set), n_shingles, sig, subs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(m)
        for batch in batches:
            fps, sizes, sigs, subs = [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py(), n)
                low = sketch(x)
                fps.append(xxhash.xxh3_128_digest(x.tobytes()))
                sizes.append(len(x))
                sigs.append(low.tobytes())
                subs.append(sketch.sub(low))
            offsets = np.arange(len(subs) + 1, dtype=np.int32) * (2 * m)
            flat = pa.array(np.concatenate(subs) if subs else np.empty(0, np.int64))
            yield pa.record_batch(
                [batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["doc_id", "fp", "n_shingles", "sig", "subs"],
            )
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp binary, n_shingles long, sig binary, subs array<long>")


def _memberships(classes: DataFrame, m: int) -> DataFrame:
    """key, node: every table key of two sub-sketches that both occur more than once, with two members or more."""
    each = classes.select("node", F.posexplode("subs").alias("c", "h"))
    again = each.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = each.join(again, ["c", "h"]).groupBy("node").agg(F.collect_list(F.struct("c", "h")).alias("s"))
    first, second = F.filter("s", lambda x: x["c"] < m), F.filter("s", lambda x: x["c"] >= m)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["c"], b["c"], a["h"], b["h"]))))
    rows = written(own.select("node", F.explode(pairs).alias("key")), "dup-keys")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(many, "key")


class _Verifier:
    """Confirms pairs of nodes on full sets, which are computed once for all nodes that share a bucket."""

    def __init__(self, docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, threshold_pct: int) -> None:
        self.classes, self.pct = classes, threshold_pct

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shingles(t.as_py(), n).tobytes() for t in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["node", "set"])

        # a shuffle join at any size: the nodes grow with the corpus
        own = nodes.select(F.col("node").alias("doc_id")).hint("merge")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id", "left_semi")
        have = texts.mapInArrow(sets, "node long, set binary")
        # ids may repeat with other texts: the class's own set has its size
        sized = have.join(classes.select("node", "n_shingles"), "node").where(F.length("set") == 8 * F.col("n_shingles"))
        # written: joins with it are of plain tables, so that Spark can split a hub of very many pairs
        self.sets = written(sized.groupBy("node").agg(F.first("set").alias("set")), "dup-sets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs a < b that sizes and minhashes allow."""
        meta = self.classes.select("node", "n_shingles", "sig")
        a = meta.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
        b = meta.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
        sized = pairs.distinct().join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= self.pct * F.greatest("na", "nb"))
        pct = self.pct

        def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                    keep = (x == y).mean(1) >= least_agreement(pct, x.shape[1])
                    yield batch.select([0, 1]).filter(pa.array(keep))

        return sized.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs with 100 * intersection >= pct * union, written."""
        pct, have = self.pct, self.sets
        both = pairs.join(have.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for p, q in zip(batch.column(2), batch.column(3)):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= pct * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "dup-links")


def least_agreement(pct: int, hashes: int) -> float:
    t = pct / 100
    return t - _SIGMAS * math.sqrt(t * (1 - t) / hashes)


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of the links (a, b): comp is the smallest node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "dup-edges")
    last = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        last = state
        # large star: what is larger than a node goes to the smallest around the node
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is not larger than a node, and the node, go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct(), "dup-edges")


def _prefixes(sets: DataFrame, rest: DataFrame, pct: int) -> DataFrame:
    """node, comp, n, pre: the shingles that two rest nodes at least have, among the first n - ceil(n * pct / 100) + 1 of a node's.

    The order is by frequency among the rest, then by hash; shingles of one node alone come first
    and are counted only. pre has (shingle, place in the order).
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            sizes = [len(x) for x in found]
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.record_batch([pa.array(node), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["node", "shingle"])

    own = sets.join(rest.select("node"), "node", "left_semi")
    rows = written(own.select("node", "set").mapInArrow(flat, "node long, shingle long"), "dup-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n = own.select("node", (F.length("set") / 8).cast("long").alias("n"))
    listed = rows.join(often, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    room = F.col("n") - F.ceil(F.col("n") * pct / 100) + 1 - (F.col("n") - F.size("all"))
    placed = F.transform(F.slice("all", 1, F.greatest(room, F.lit(0)).cast("int")), lambda x, k: F.struct(x["shingle"].alias("shingle"), (F.col("n") - F.size("all") + k).cast("long").alias("at")))
    return listed.join(n, "node").withColumn("pre", placed).where(F.size("pre") > 0).join(rest, "node").select("node", "comp", "n", "pre")


def _open_pairs(sets: DataFrame, rest: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """a, b: pairs of rest nodes (node, comp) in different components that may be links; each pair comes once."""
    prefixes = written(_prefixes(sets, rest, pct), "dup-prefixes")
    own = prefixes.select("node", "comp", F.explode("pre").alias("x")).select("node", "comp", F.col("x.shingle").alias("shingle"), F.col("x.at").alias("at"))
    groups = own.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo <> hi")
    placed = own.join(groups.select("shingle", "blocks"), "shingle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member of block k meets the blocks (j, k) and (k, j)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q")))
    spread = placed.withColumn("m", F.explode(meets)).select("shingle", F.col("m.p").alias("p"), F.col("m.q").alias("q"), "node", "at", "block")
    firsts = prefixes.select("node", "comp", "n", F.transform("pre", lambda x: x["shingle"]).alias("pre")).join(classes.select("node", "sig"), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, size, at, block = (table.column(c).to_numpy() for c in ("node", "comp", "n", "at", "block"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
        pre = [np.asarray(x) for x in table.column("pre").to_pylist()]
        held = [set(x.tolist()) for x in pre]
        key, p, q = (table.column(c)[0].as_py() for c in ("shingle", "p", "q"))
        before = [x[: int(np.flatnonzero(x == key)[0])].tolist() for x in pre]
        least = least_agreement(pct, sig.shape[1])
        right = np.flatnonzero(block == q)
        a, b = [], []
        for k in np.flatnonzero(block == p):
            both = 100 * np.minimum(size[right] - at[right], size[k] - at[k])  # so many shingles in common at most
            ok = right[
                (comp[right] != comp[k])
                & (100 * np.minimum(size[right], size[k]) >= pct * np.maximum(size[right], size[k]))
                & ((100 + pct) * both >= 100 * pct * (size[right] + size[k]))
            ]
            if p == q:
                ok = ok[node[ok] > node[k]]
            if len(ok):
                ok = ok[(sig[ok] == sig[k]).mean(1) >= least]
            for j in ok:
                if held[j].isdisjoint(before[k]):
                    a.append(min(node[j], node[k]))
                    b.append(max(node[j], node[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = spread.join(firsts, "node").select("shingle", "p", "q", "node", "comp", "n", "at", "block", "pre", "sig")
    return full.groupBy("shingle", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    m = bands(threshold_pct / 100)
    sketched = written(_sketches(docs, shingle, m), "dup-sketches")
    named = sketched.where("n_shingles > 0")
    # written: a join of two plain tables, so that Spark can split a fingerprint with very many copies
    reps = written(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "dup-reps")
    with_ids = reps.where("node is not null")
    classes = written(
        named.join(with_ids, (named["fp"] == with_ids["fp"]) & (named["doc_id"] == with_ids["node"])).select("node", "n_shingles", "sig", "subs").dropDuplicates(["node"]), "dup-classes"
    )
    members = written(_memberships(classes, m), "dup-members")
    nodes = members.select("node").distinct()
    check = _Verifier(docs, classes.select("node", "n_shingles", "sig"), nodes, shingle, threshold_pct)
    hubs = members.groupBy("key").agg(F.min("node").alias("a"))
    star = members.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b"))
    links = check.confirm(written(check.likely(star), "dup-likely"))
    comps = components(links)
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    rest = written(placed.join(open_keys.select("key"), "key").select("node", "comp").distinct(), "dup-rest")
    more = check.confirm(written(_open_pairs(check.sets, rest, classes, threshold_pct), "dup-open"))
    comps = components(links.unionByName(more))
    found = (
        sketched.select("doc_id", "fp", "n_shingles").join(reps, "fp", "left").join(comps, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80) -> DataFrame:
    """The documents without those that another one of their group stands for."""
    found = near_duplicates(docs, shingle, threshold_pct)
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
