"""Set-similarity self-join on word n-grams with a prefix tree, down to connected components.

1. One pass gives every document the size and identity of its n-gram set; equal sets become one class.
   The same pass counts n-grams into a fixed number of bins; (bin count, hash) is the global order, rarest first.
2. A set of n can only meet a similar one inside its first n - ceil(t * n) + 1 n-grams in that order. These prefixes
   are dealt by hash into bounded buckets, and n-grams standing in the prefixes of two or more classes are kept.
3. In each n-gram the class whose prefix is shared most is the hub; every other joins its cluster if they share a good
   part of their prefixes. Clusters, mostly families of copies, are joined within themselves block by block:
   every pair is compared and each class gets the number of its similar ones; of the pairs themselves those that join
   two components are kept, so they are never all listed.
4. Pairs from different clusters that share enough of their prefixes to be similar are compared one by one. What two
   sets share up to the end of the shorter prefix is counted in full, so the count and what is left bound their overlap.
Comparisons always put a block of sets into a prefix tree and traverse it once a probe, sharing the overlap of common
beginnings and leaving a branch when what remains is too short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.llm.components import components
from reachworks.session import freeze

WIDTH = 5
PERCENT = 75
BIN_BITS = 18
BUCKET_POSTINGS = 600_000
HOT_COUNT = 1_000_000  # an n-gram counted as often skips the buckets: it is shared for certain
BLOCK_GRAMS = 200_000  # n-grams of the sets that one tree holds
CLUSTER_ROUNDS = 2
CLUSTER_SHARE = 12  # a class joins a hub's cluster if it shares one in so many of the shorter prefix
NODES_SENT = 2_000_000  # ids broadcast to pick texts; beyond that the texts are joined
RECENT_SETS = 200_000  # classes a task remembers not to repeat

_DOCS = "doc_id bigint, n bigint, set_id bigint, bins_at int, bins binary"
_POSTINGS = "bucket bigint, grams binary, sets binary, sizes binary, edges binary"
_SHARED = "gram bigint, set_id bigint, n int, edge bigint"


def _by_document(grams: np.ndarray, doc: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Order by document, then by rank if given, then by hash."""
    high = np.zeros(len(grams), np.uint64) if rank is None else rank.astype(np.uint64) << np.uint64(47)
    key = high | (grams >> np.uint64(17))
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(doc) and doc[-1] < 1 << 16 else np.uint32), kind="stable")]
    k, g, d = key[order], grams[order], doc[order]
    if ((k[1:] == k[:-1]) & (g[1:] != g[:-1]) & (d[1:] == d[:-1])).any():  # equal in the bits compared, not in all
        order = np.lexsort((grams, key, doc))
    return order


def ngram_sets(w: tokens.Words, width: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes by document, document offsets, and one 64-bit identity a set.

    Within a document they ascend by hash, or in the global order where the ranks of the bins are given.
    """
    grams, doc = tokens.shingle_hashes(w, width)
    order = _by_document(grams, doc, None if ranks is None else ranks[_bin(grams)])
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    at = np.searchsorted(doc, np.arange(len(w.at)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    names = tokens.mix((total[at[1:]] - total[at[:-1]]) ^ tokens.mix(np.diff(at).astype(np.uint64)))
    return grams, at, names.view(np.int64)


def _bin(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _ranks(bins: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits, which keeps their order."""
    return np.minimum(2048 * np.log2(1.0 + bins), 65535).astype(np.uint16)


def _survey(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << BIN_BITS, np.int64)
        for part in parts:
            ids = part.column(0)
            for w in tokens.words_of(part.column(1), tokens.NOT_SPACE):
                grams, at, names = ngram_sets(w, width)
                bins += np.bincount(_bin(grams), minlength=len(bins))
                k = len(at) - 1
                yield pa.RecordBatch.from_arrays([ids[w.first:w.first + k], pa.array(np.diff(at)), pa.array(names), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                                                 ["doc_id", "n", "set_id", "bins_at", "bins"])
        size = 1 << (BIN_BITS - 4)
        packed = [zlib.compress(bins[i:i + size].tobytes(), 1) for i in range(0, len(bins), size)]
        k = len(packed)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(packed, pa.binary())],
                                         ["doc_id", "n", "set_id", "bins_at", "bins"])
    return run


def _add_bins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, 0
    for part in parts:
        for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            at, total = k, total + np.frombuffer(zlib.decompress(raw), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bins_at", "bins"])


def _prefixes(sent, width: int, percent: int, buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, hot), seen = sent.value, set()
        for part in parts:
            ids = part.column(0)
            for w in tokens.words_of(part.column(1), tokens.NOT_SPACE):
                grams, at, names = ngram_sets(w, width, ranks)
                own = ids[w.first:w.first + len(at) - 1].is_valid().to_numpy(False)
                fresh = np.zeros(len(names), bool)
                for i, name in enumerate(names.tolist()):
                    fresh[i] = own[i] and name not in seen
                    if own[i]:
                        seen.add(name)
                if len(seen) > RECENT_SETS:
                    seen.clear()
                n = np.diff(at)
                reach = np.where(fresh, np.minimum(n, n - (percent * n + 99) // 100 + 1), 0)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(grams)) - at[doc]
                keep = place < reach[doc]
                # Where a set's prefix ends in the global order.
                edge = np.zeros(len(n), np.int64)
                some = np.flatnonzero(reach)
                last = grams[at[some] + reach[some] - 1]
                edge[some] = (ranks[_bin(last)].astype(np.int64) << 47) | (last >> np.uint64(17)).astype(np.int64)
                grams, doc = grams[keep], doc[keep]
                bucket = (tokens.mix(grams) % np.uint64(buckets)).astype(np.int64)
                bucket[ranks[_bin(grams)] >= hot] = -1
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-2))
                columns = [[] for _ in range(5)]
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                    some = order[a:b]
                    for c, v in zip(columns, (int(bucket[some[0]]), grams[some].tobytes(), names[doc[some]].tobytes(),
                                              n[doc[some]].astype(np.int32).tobytes(), edge[doc[some]].tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                                 ["bucket", "grams", "sets", "sizes", "edges"])
    return run


def _rows(blobs: tuple[list[bytes], ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(c), t) for c, t in zip(blobs, (np.int64, np.int64, np.int32, np.int64)))


def _batch(columns: tuple[np.ndarray, ...], at: int = 0, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for k in range(at, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[k:k + size]) for c in columns], ["gram", "set_id", "n", "edge"])


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one bucket whose n-gram stands in two classes or more, once a class."""
    blobs: tuple[list[bytes], ...] = ([], [], [], [])
    for part in parts:
        for c, name in zip(blobs, ("grams", "sets", "sizes", "edges")):
            c += part.column(part.schema.get_field_index(name)).to_pylist()
    grams, sets, sizes, edges = _rows(blobs)
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    again = np.zeros(len(g), bool)
    again[1:] = g[1:] == g[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((sets[order], grams[order]))]
    g, s = grams[order], sets[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    order, g = order[first], g[first]
    again = np.zeros(len(g), bool)
    again[1:] = g[1:] == g[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    yield from _batch((grams[order], sets[order], sizes[order], edges[order]))


def _hot(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k in range(part.num_rows):
            yield from _batch(_rows(tuple([part.column(c)[k].as_py()] for c in range(4))))


class PrefixTree:
    """Sets in global order, common beginnings stored once; each edge holds a run of n-grams."""

    __slots__ = ("run", "children", "ends", "least", "most")

    def __init__(self, sets: list[tuple[list[int], object]], depth: int = 0) -> None:
        """`sets` share their first `depth` n-grams and are in lexicographic order."""
        first, last = sets[0][0], sets[-1][0]
        stop, limit = depth, min(len(first), len(last))
        while stop < limit and first[stop] == last[stop]:
            stop += 1
        if len(sets) == 1:
            stop = len(first)
        self.run = first[depth:stop]
        self.ends = [name for items, name in sets if len(items) == stop]
        self.least = min(len(items) for items, _ in sets)
        self.most = max(len(items) for items, _ in sets)
        self.children, rest = [], [x for x in sets if len(x[0]) > stop]
        start = 0
        for k in range(1, len(rest) + 1):
            if k == len(rest) or rest[k][0][stop] != rest[start][0][stop]:
                self.children.append(PrefixTree(rest[start:k], stop))
                start = k

    def matches(self, place: dict[int, int], n: int, percent: int) -> list[tuple[object, int]]:
        """(name, overlap) of the sets whose overlap with the probe is at least `percent` of the union."""
        out, todo = [], [(self, 0, 0, -1)]
        while todo:
            node, depth, overlap, last = todo.pop()
            # The smallest overlap that any set below could do with.
            need = -(-percent * (n + node.least) // (100 + percent))
            alive = True
            for k in range(0, len(node.run), 64):
                hits = [place[g] for g in node.run[k:k + 64] if g in place]
                if hits:
                    overlap, last = overlap + len(hits), hits[-1]
                depth += len(node.run[k:k + 64])
                if overlap + min(node.most - depth, n - 1 - last) < need:
                    alive = False
                    break
            if not alive:
                continue
            if (100 + percent) * overlap >= percent * (n + depth):
                out += [(name, overlap) for name in node.ends]
            todo += [(child, depth, overlap, last) for child in node.children]
        return out


def _sets(part: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in names]
    for *keys, grams in zip(*columns):
        yield *keys, np.frombuffer(grams, np.int64).tolist()


def _compare(percent: int):
    """One probe (a) against the sets of its block."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, sets = None, {}
        for part in parts:
            for a, b, items in _sets(part, "a", "b", "grams"):
                if a == b:
                    probe = (a, items)
                else:
                    sets[b] = items
        others = [(items, b) for b, items in sets.items()]
        out = ([], [], [])
        if probe and others:
            others.sort()
            name, items = probe
            for b, overlap in PrefixTree(others).matches({g: k for k, g in enumerate(items)}, len(items), percent):
                for c, v in zip(out, (name, b, overlap)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "overlap"])
    return run


def _join_block(percent: int):
    """All sets of one part of a cluster against all of another, or of the same.

    Out come the links that join components, and for each class with links a row (class, null, number of them).
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[dict, dict] = ({}, {})
        apart = False
        for part in parts:
            for chunk, low, high, name, items in _sets(part, "chunk", "low", "high", "id", "grams"):
                sides[chunk != low][name] = items  # repeated rows are one set
                apart = low != high
        tree = sorted((items, name) for name, items in sides[0].items())
        probes = [(items, name) for name, items in sides[1].items()] if apart else tree
        up = {name: name for _, name in [*tree, *probes]}
        met = dict.fromkeys(up, 0)

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = ([], [], [])
        if tree:
            root = PrefixTree(tree)
            for items, name in probes:
                for b, overlap in root.matches({g: k for k, g in enumerate(items)}, len(items), percent):
                    if b == name:
                        continue
                    met[name] += 1
                    if apart:  # within one part each of the two is a probe
                        met[b] += 1
                    x, y = top(name), top(b)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        for c, v in zip(out, (name, b, overlap)):
                            c.append(v)
        for name, n in met.items():
            if n:
                for c, v in zip(out, (name, None, n)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "overlap"])
    return run


def _write_sets(sent, width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = sent.value
        for part in parts:
            for w in tokens.words_of(part.column(1), tokens.NOT_SPACE):
                grams, at, _ = ngram_sets(w, width, ranks)
                k = len(at) - 1
                yield pa.RecordBatch.from_arrays([part.column(0)[w.first:w.first + k], pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "grams"])
    return run


_LINKS = "a bigint, b bigint, overlap bigint"


def _sets_of(texts: DataFrame, nodes: DataFrame, sent, width: int) -> DataFrame:
    """(id, grams in global order) of the classes in `nodes`."""
    few = nodes.count() <= NODES_SENT
    chosen = texts.join(F.broadcast(nodes) if few else nodes, texts["doc_id"] == nodes["id"], "left_semi")
    return freeze(chosen.mapInArrow(tokens.tidy(_write_sets(sent, width)), "id bigint, grams binary"))


def _families(texts: DataFrame, clusters: DataFrame, sizes: DataFrame, sent, width: int, percent: int) -> DataFrame:
    """Links within clusters (id, component), enough of them to join all that is reachable, and rows with the number of all."""
    sets = _sets_of(texts, clusters.select("id"), sent, width)
    clusters = clusters.join(sizes, "id")
    chunks = clusters.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("chunks"))
    members = clusters.join(freeze(chunks), "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    # Every pair of parts is a block; a set goes to as many blocks as its cluster has parts.
    blocks = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(
        "component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id")
    return freeze(freeze(blocks).join(sets, "id").groupBy("component", "low", "high").applyInArrow(tokens.tidy(_join_block(percent)), _LINKS))


def _links(texts: DataFrame, pairs: DataFrame, sent, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n of b) of class ids that are similar enough; a is the probe of its blocks."""
    nodes = freeze(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = _sets_of(texts, nodes, sent, width)
    blocks = freeze(pairs.groupBy("a").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("blocks")))
    pairs = freeze(pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).select("a", "block", "b"))
    trees = pairs.join(sets, pairs["b"] == sets["id"]).select("a", "block", "b", "grams")
    probes = pairs.select("a", "block").distinct()
    probes = probes.join(sets, probes["a"] == sets["id"]).select("a", "block", F.col("a").alias("b"), "grams")
    return freeze(trees.unionByName(probes).groupBy("a", "block").applyInArrow(tokens.tidy(_compare(percent)), _LINKS))


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, class_id, component_id, n_links; spanning links between class ids).

    A class is the documents of one n-gram set, named by its smallest id; its members need no links among them. n_links
    is the number of other classes that are similar enough, all of them counted. The spanning links, a part of these
    with their overlaps, join all that is reachable; within a cluster other similar pairs are not listed. Documents without words,
    with null or empty text are linked with nothing; so are rows of null id, whose component is null. Repeated rows are
    one document; an id is taken to name one text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = freeze(texts.mapInArrow(tokens.tidy(_survey(width)), _DOCS))
    rows = seen.where("bins_at is null").select("doc_id", "n", "set_id")
    parts = seen.where("bins_at is not null").select("bins_at", "bins").groupBy("bins_at").applyInArrow(tokens.tidy(_add_bins), "bins_at int, bins binary").orderBy("bins_at").collect()
    bins = np.frombuffer(b"".join(r["bins"] for r in parts), np.int64) if parts else np.zeros(1 << BIN_BITS, np.int64)
    hot = 2048 * np.log2(1.0 + max(HOT_COUNT, 64 * int(bins.mean())))
    sent = spark.sparkContext.broadcast((_ranks(bins), hot))  # 2 ** BIN_BITS numbers, whatever the input

    classes = freeze(rows.where("n > 0 and doc_id is not null").groupBy("set_id", "n").agg(F.min("doc_id").alias("class_id")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, -(-total * (100 - percent) // 100 // BUCKET_POSTINGS))
    dealt = texts.mapInArrow(tokens.tidy(_prefixes(sent, width, percent, buckets)), _POSTINGS)
    spread = freeze(dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(tokens.tidy(_shared), _SHARED))
    shared = spread
    if _ranks(bins).max() >= hot:
        # What skips the buckets may come once from each task that met the class.
        shared = freeze(shared.unionByName(dealt.where("bucket < 0").drop("bucket").mapInArrow(tokens.tidy(_hot), _SHARED)).distinct())
    # How much of its prefix a class shares, beside its name.
    part = shared.groupBy("set_id").agg((F.count(F.lit(1)) / F.first("n")).alias("part"))
    names = freeze(classes.select("set_id", "class_id").join(part, "set_id"))
    shared = freeze(shared.join(names, "set_id").select("gram", F.col("class_id").alias("id"), "n", "edge", "part"))
    found, labels, clusters, near = [], None, None, []
    for _ in range(CLUSTER_ROUNDS):
        more = _candidates(_between(shared, clusters), percent)
        if more.isEmpty():
            break
        near.append(more)
        clusters = components(_all(near))
    if near:
        found.append(_families(texts, clusters, classes.select(F.col("class_id").alias("id"), "n"), sent, width, percent))
    pairs = freeze(_cross(shared, clusters, percent))
    if not pairs.isEmpty():
        found.append(_links(texts, pairs, sent, width, percent))
    if found:
        links = _all(found).where("b is not null")
        labels = components(links)
        # Clusters have counted theirs; pairs between clusters are all listed, each once.
        counts = found[0].where("b is null").select(F.col("a").alias("class_id"), F.col("overlap").alias("k")) if near else None
        if len(found) > bool(near):
            ends = found[-1].select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("bigint").alias("k"))
            counts = ends if counts is None else counts.unionByName(ends)
        labels = labels.withColumnRenamed("id", "class_id").join(counts.groupBy("class_id").agg(F.sum("k").alias("links")), "class_id")
    if labels is not None:
        classes = freeze(classes.join(labels, "class_id", "left"))
    else:
        classes = classes.withColumn("component", F.lit(None).cast("bigint")).withColumn("links", F.lit(None).cast("bigint"))
    out = rows.join(classes, ["set_id", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                     F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
                     F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0).cast("bigint"))).alias("n_links"))
    links = links if found else spark.createDataFrame([], "a bigint, b bigint, overlap bigint")
    return out, links


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _alike(percent: int) -> F.Column:
    return 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")


def _enough(met: DataFrame, percent: int) -> DataFrame:
    """Pairs whose shared prefix n-grams leave similarity possible.

    Up to the end of the prefix that ends first in the global order every shared n-gram is counted; after it the set
    has ceil(t * n) - 1 left.
    """
    left = F.when(F.col("xe") < F.col("ye"), F.col("xn")).when(F.col("xe") > F.col("ye"), F.col("yn")).otherwise(F.greatest("xn", "yn"))
    return met.where(F.col("common") + F.ceil(percent * left / 100) - 1 >= F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent)))


def _met(x: DataFrame, y: DataFrame, different: F.Column, percent: int) -> DataFrame:
    """Class pairs (a, b) on either side of an n-gram, what they share counted over all n-grams, sizes and prefix ends."""
    rows = x.alias("x").join(y.alias("y"), "gram").where(different & _alike(percent))
    return rows.groupBy(F.col("y.id").alias("a"), F.col("x.id").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.max("x.n").alias("xn"), F.max("y.n").alias("yn"), F.max("x.edge").alias("xe"), F.max("y.edge").alias("ye"))


def _between(shared: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """Postings with their cluster, of the n-grams that stand in two clusters or more."""
    if clusters is None:
        return shared.withColumn("cluster", F.col("id"))
    named = freeze(shared.join(clusters, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component"))
    mixed = named.groupBy("gram").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("gram")
    return freeze(named.join(freeze(mixed), "gram"))


def _candidates(left: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the hubs of its n-grams, where they share a good part of the shorter prefix.

    This chooses what is joined as one cluster and filters nothing: pairs that stay in different clusters come to
    _cross. The least altered of a family of copies shares most and becomes its hub.
    """
    hubs = freeze(left.groupBy("gram").agg(F.max(F.struct("part", F.xxhash64("id").alias("h"), "id", "n", "edge", "cluster")).alias("hub"))
                  .select("gram", "hub.id", "hub.n", "hub.edge", "hub.cluster"))
    shorter = F.least("xn", "yn")
    prefix = shorter - F.ceil(percent * shorter / 100) + 1
    met = _met(left, hubs, F.col("x.cluster") != F.col("y.cluster"), percent)
    return freeze(met.where(CLUSTER_SHARE * F.col("common") >= prefix).select("a", "b"))


def _cross(shared: DataFrame, clusters: DataFrame | None, percent: int) -> DataFrame:
    """(a, b, n of b): every pair of different clusters that can still be similar, once."""
    named = _between(shared, clusters)
    met = _met(named, named, F.col("y.cluster") < F.col("x.cluster"), percent)
    return _enough(met, percent).select("a", "b", F.col("xn").alias("n"))


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component left, the one of smallest id, with all their columns.

    Rows of null id stay, and so do rows that repeat the id that stays.
    """
    groups, _ = similar_sets(docs, width, percent, doc_id, text)
    gone = freeze(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    # One way at every size: texts are dealt by id once and never sorted.
    return docs.join(gone.hint("shuffle_hash"), F.col(doc_id).cast("bigint") == F.col("__gone"), "left_anti")
