"""Exact Jaccard join of documents' word n-gram sets, and its connected components.

Sets are joined by prefix trees. A tree holds the sets of a block in one global order of
n-grams (most frequent in the block first, so that sets share long beginnings). One set at
a time walks down the tree; the overlap counted at a node serves all sets below it, and a
subtree is left when even the rest of its longest set, or the rest of the walking set, can
not lift the overlap to what the threshold asks of the subtree's shortest set.

Which sets meet in a block is exact as well. A set of ``n`` n-grams lacks at most
``n - ceil(t n)`` of them in a set that it links with. So, all n-grams being in one order,
any order, the first ``k`` shared ones are among its first ``n - ceil(t n) + k``. This is
used twice:

* In the order of hashes, each set shows a part of its n-grams (``shown``), long enough that
  of a link both ends see ``asked`` of theirs in other sets. Sets that see fewer have no
  link and are done; a passage that many documents share does not keep a set that has much
  else. One range-partitioned sort, which splits n-grams of very many documents.
* The rest is ordered by the number of sets that hold an n-gram, rarest first. Linked sets
  share one of the first ``n - ceil(t n) + 1``. Sets are tied by those, each to the first
  one that holds the n-gram, and tied sets form clusters; every link lies inside one.

Clusters too large for one task are cut into chunks, each joined on its own together with a
few hub documents. Pairs of chunks are then joined for the documents that are not of the
cluster's largest component so far: those walk the trees of all chunks (see ``_linked``).

N-grams are 64-bit hashes, document sets are told apart by 128 bits: two different n-grams
have one hash with a chance of about 2 ** -58 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, bound_batches, hot_join, map_batches, sent_if_small, texts, tidied
from plurality.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: N-grams a block or chunk holds about at most (unless one document has more).
CHUNK_NGRAMS = 250_000
#: More shown n-grams leave fewer sets to the second dealing.
SURPLUS_PERCENT = 15
#: Documents of a chunked cluster that are in every chunk, about.
HUBS = 32
#: Rows of the block table (four numbers each) up to which it is sent to every executor.
BROADCAST_ROWS = 200_000
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> SHIFT)) * MIX1
    x = (x ^ (x >> SHIFT)) * MIX2
    return x ^ (x >> SHIFT)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams (shorter texts: all words as one)."""
    words = text.encode("utf-8").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    # remembering words would cost more than hashing them again
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(h))
    count = len(h) - width + 1
    total = h[:count] + np.uint64(width)
    for i in range(1, width):
        total *= MIX1
        total += h[i : i + count]
    total = np.sort(mixed(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def overlap_of(n: int, percent: int) -> int:
    """N-grams that a set of ``n`` shares at least with one that it links with."""
    return -(-percent * n // 100)


def surplus(n: int) -> int:
    """Shared n-grams that a set of ``n`` shows beyond what it may lack."""
    return max(1, n * SURPLUS_PERCENT // 100)


def shown(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Of sorted hashes the first ones, ``surplus`` shared ones among them in any link."""
    n = len(tokens)
    return tokens[: n - overlap_of(n, percent) + surplus(n)] if n else tokens


def asked(n: int, percent: int) -> int:
    """Shown n-grams that a set of ``n`` sees in others if it has a link: a partner has at
    least ``overlap_of`` n-grams, and shows its own surplus only."""
    return surplus(overlap_of(n, percent))


class PrefixTree:
    """A block's sets in a compressed trie; ``links`` walks one set through it."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        # an n-gram of one set only adds to no overlap: it counts in the size alone
        shared = counts[inverse] > 1
        ranks, owner = rank[inverse][shared], owner[shared]
        order = np.lexsort((ranks, owner))
        ranks, owner = ranks[order], owner[order]
        ends = np.searchsorted(owner, np.arange(len(sets) + 1))
        paths = [ranks[ends[i] : ends[i + 1]] for i in range(len(sets))]
        self.place = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.place]
        self.lengths = np.array([len(p) for p in self.paths], np.int64)
        self.flag = np.zeros(len(counts) + 1, bool)
        self._build()

    def _build(self) -> None:
        paths, m = self.paths, len(self.paths)
        common = np.zeros(m, np.int64)
        for i in range(1, m):
            a, b = paths[i - 1], paths[i]
            k = min(len(a), len(b))
            unlike = np.flatnonzero(a[:k] != b[:k])
            common[i] = unlike[0] if len(unlike) else k
        lo, hi, start, stop, parent, source = [0], [m], [0], [0], [-1], [0]
        stack = [0]
        for i in range(m):
            depth, below = int(common[i]), -1
            while stop[stack[-1]] > depth:
                below = stack.pop()
                hi[below] = i
                above = stack[-1]
                if stop[above] < depth:  # part the edge: a new node takes its beginning
                    lo.append(lo[below]), hi.append(m), start.append(start[below]), stop.append(depth), parent.append(above), source.append(source[below])
                    start[below], parent[below] = depth, len(lo) - 1
                    stack.append(len(lo) - 1)
            if len(paths[i]) > depth:
                lo.append(i), hi.append(m), start.append(depth), stop.append(len(paths[i])), parent.append(stack[-1]), source.append(i)
                stack.append(len(lo) - 1)
        self.lo, self.hi, self.stop, parent = np.array(lo), np.array(hi), np.array(stop), np.array(parent)
        start = np.array(start)
        level = np.zeros(len(lo), np.int64)
        todo = parent.copy()
        while (todo >= 0).any():
            level += todo >= 0
            todo = np.where(todo >= 0, parent[todo], -1)
        order = np.lexsort((parent, level))
        self.first = np.searchsorted(level[order], np.arange(level.max() + 2))
        renumber = np.empty(len(order), np.int64)
        renumber[order] = np.arange(len(order))
        self.lo, self.hi, self.stop = self.lo[order], self.hi[order], self.stop[order]
        self.parent = np.where(parent[order] >= 0, renumber[parent[order]], 0)
        pieces = [paths[source[k]][start[k] : stop[k]] for k in order]
        self.edge = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        self.edge_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        last = self.edge[np.maximum(self.edge_at[1:] - 1, 0)] if len(self.edge) else np.zeros(len(order), np.int64)
        self.last = np.where(np.diff(self.edge_at) > 0, last, -1)
        # what the length bounds need of each subtree
        sizes, lengths = self.sizes[self.place], self.lengths
        self.sorted_sizes = sizes
        self.least = np.array([sizes[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)])
        self.most = np.array([sizes[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])
        self.longest = np.array([lengths[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])

    def links(self, at: int, open_: np.ndarray) -> np.ndarray:
        """Places (in tree order) of the open sets that link with the set at ``at``."""
        path, size, t = self.paths[at], int(self.sorted_sizes[at]), self.percent
        below = np.concatenate([[0], np.cumsum(open_)])
        self.flag[path] = True
        overlap = np.zeros(len(self.lo), np.int64)
        alive = np.zeros(len(self.lo), bool)
        found = []
        for k in range(len(self.first) - 1):
            nodes = np.arange(self.first[k], self.first[k + 1])
            if k:
                nodes = nodes[alive[self.parent[nodes]]]
            nodes = nodes[(below[self.hi[nodes]] > below[self.lo[nodes]]) & (100 * self.most[nodes] >= t * size) & (100 * size >= t * self.least[nodes])]
            if not len(nodes):
                break
            counts = self.edge_at[nodes + 1] - self.edge_at[nodes]
            ends = np.cumsum(counts)
            index = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(self.edge_at[nodes], counts)
            hits = np.concatenate([[0], np.cumsum(self.flag[self.edge[index]])])
            overlap[nodes] = (overlap[self.parent[nodes]] if k else 0) + hits[ends] - hits[ends - counts]
            # sets that end here: those of the node's range whose path is no longer
            here = overlap[nodes]
            ending = nodes[(self.lengths[np.minimum(self.lo[nodes], len(self.lengths) - 1)] == self.stop[nodes])]
            for node in ending.tolist():
                for place in range(self.lo[node], self.hi[node]):
                    if self.lengths[place] != self.stop[node]:
                        break
                    both = int(overlap[node])
                    if open_[place] and 100 * both >= t * (size + int(self.sorted_sizes[place]) - both):
                        found.append(place)
            rest = np.minimum(self.longest[nodes] - self.stop[nodes], len(path) - np.searchsorted(path, self.last[nodes], "right"))
            reach = here + rest
            alive[nodes[(rest >= 0) & ((100 + t) * reach >= t * (size + np.maximum(self.least[nodes], -(-t * size // 100))))]] = True
        self.flag[path] = False
        return np.array(found, np.int64)

    def met(self, walks: np.ndarray, open_: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each walking set the least id of the open sets it links with, else its own."""
        place = np.array(self.place)
        out, inside = ids.copy(), open_[place]
        for at in np.flatnonzero(walks[place]):
            near = self.links(int(at), inside)
            if len(near):
                out[place[at]] = ids[place[near]].min()
        return out[walks]

    def components(self) -> np.ndarray:
        """For each set (in given order) the index of a set that names its component."""
        m = len(self.place)
        label, open_ = np.full(m, -1, np.int64), np.ones(m, bool)
        for seed in range(m):
            if not open_[seed]:
                continue
            open_[seed], label[seed] = False, seed
            queue = [seed]
            while queue and open_.any():
                near = self.links(queue.pop(), open_)
                open_[near], label[near] = False, seed
                queue += near.tolist()
        out = np.empty(m, np.int64)
        out[self.place] = label
        return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: each document with the first one of its cell (kind 0), and
    the cell and first document of the partition's first and last cells (kinds 1, 2)."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None

    def rows(kind: int, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(cell), pa.array(a), pa.array(b)], ["kind", "part", "cell", "a", "b"])

    for batch in batches:
        cell, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cell):
            continue
        begins = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        hubs = doc[begins]
        if last is None:
            first = cell[0], doc[0]
        elif last[0] == cell[0]:
            hubs[0] = last[1]
        last = cell[-1], hubs[-1]
        hub = np.repeat(hubs, np.diff(np.append(begins, len(cell))))
        linked = np.flatnonzero(hub != doc)
        if len(linked):
            pairs = np.unique(np.stack([hub[linked], doc[linked]]), axis=1)
            yield rows(0, np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1])
    for kind, end in ((1, first), (2, last)):
        if end is not None:
            yield rows(kind, np.array([end[0]]), np.array([end[1]]), np.array([end[1]]))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, hits`` of a sorted partition: n-grams of the document that others show too.

    An n-gram at either end of a partition counts as shared, as it may go on in the next.
    """

    def rows(docs: np.ndarray) -> pa.RecordBatch:
        ids, hits = np.unique(docs, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits)], ["doc", "hits"])

    last = None
    for batch in batches:
        cell, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cell):
            continue
        again = cell[1:] == cell[:-1]
        shared = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        found = []
        if last is None:
            shared[0] = True
        elif last[0] == cell[0]:
            shared[0] = True
            found = [] if last[2] else [last[1]]
        last = cell[-1], doc[-1], shared[-1]
        yield rows(np.concatenate([doc[shared], np.array(found, np.int64)]))
    if last is not None and not last[2]:
        yield rows(np.array([last[1]]))


def _sorted_cells(cells: DataFrame) -> DataFrame:
    parts = max(8, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartitionByRange(parts, "cell", "doc").sortWithinPartitions("cell", "doc")


def _tied(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` over documents of ``cells(cell long, doc long)`` that share a cell,
    directly or by others."""
    spark = cells.sparkSession
    starred = scratch.keep(_sorted_cells(cells).mapInArrow(tidied(_stars), "kind int, part int, cell long, a long, b long"))
    # two rows a partition: a cell that goes on in the next partition joins both hubs
    firsts, lasts = {}, {}
    for row in starred.where("kind > 0").select("kind", "part", "cell", "a").collect():
        (firsts if row.kind == 1 else lasts)[row.part] = row.cell, row.a
    parts = sorted(firsts)
    seams = [(lasts[p][1], firsts[q][1]) for p, q in zip(parts, parts[1:], strict=False) if lasts[p][0] == firsts[q][0] and lasts[p][1] != firsts[q][1]]
    edges = starred.where("kind = 0").select("a", "b")
    if seams:
        edges = edges.union(spark.createDataFrame(seams, "a long, b long"))
    found = connected_components(edges, scratch)
    scratch.drop(starred)
    return found


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _clusters(classes: DataFrame, tied: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, k1, k2, n, cluster, ngrams, sets`` of classes that are not alone in a cluster.

    A class is of the cluster of its ``rep``; sizes of clusters ride on its rows.
    """
    inside = scratch.keep(classes.join(tied.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep").select("rep", "k1", "k2", "n", "cluster"))
    totals = inside.groupBy("cluster").agg(F.sum("n").alias("ngrams"), F.count("*").alias("sets")).where("sets > 1")
    totals = scratch.keep(totals)
    found = scratch.keep(hot_join(inside, totals, "cluster", F.col("sets"), inside.count()).select("rep", "k1", "k2", "n", "cluster", "ngrams", "sets"))
    scratch.drop(inside)
    scratch.drop(totals)
    return found


def _with_texts(source: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``wanted`` (by ``rep``) with the rows of ``source`` that have the id.

    Mostly few documents are wanted: spare the others the shuffle if the wanted rows are few
    enough to be sent.
    """
    return source.join(sent_if_small(wanted.withColumnRenamed("rep", "doc"), scratch, BROADCAST_ROWS), "doc")


def _rarest(source: DataFrame, classes: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """``node, component`` over documents that share one of their rarest n-grams.

    The order is by the number of sets that hold an n-gram, then by hash; those of one set
    only can be shared with none and are left out. An id with several sets is one document
    of all their n-grams, of which so many more are looked at as its other sets have.
    """
    least = F.floor((F.col("n") * percent + 99) / 100)
    # n-grams of a document that need not be looked at
    spared = classes.groupBy("rep").agg((F.min(least) - 1).cast("int").alias("spared"))
    wanted = classes.join(spared, "rep").select("rep", "k1", "k2", "spared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spared = (batch.column(i).to_numpy() for i in (0, 3))
            k1, k2 = (batch.column(i).to_pylist() for i in (1, 2))
            sets = [shingles(x, size) for x in texts(batch.column(4))]
            own = [i for i, x in enumerate(sets) if _set_key(x) == (k1[i], k2[i])]
            if own:
                counts = [len(sets[i]) for i in own]
                columns = np.concatenate([sets[i] for i in own]).view(np.int64), np.repeat(ids[own], counts), np.repeat(spared[own], counts)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "doc", "spared"])

    laid = _with_texts(source, wanted, scratch).select("doc", "k1", "k2", "spared", "text")
    tokens = scratch.keep(laid.mapInArrow(tidied(cut), "cell long, doc long, spared int"))
    shared = scratch.keep(tokens.groupBy("cell").agg(F.count("*").alias("sets")).where("sets > 1"))
    ranked = hot_join(tokens, shared, "cell", F.col("sets"), tokens.count())
    of_doc = Window.partitionBy("doc")
    first = ranked.select("cell", "doc", F.row_number().over(of_doc.orderBy("sets", "cell")).alias("at"), F.count("*").over(of_doc).alias("shared"), "spared").where("at <= shared - spared")
    found = _tied(first.select("cell", "doc"), scratch)
    scratch.drop(tokens)
    scratch.drop(shared)
    return found


#: What a set is to its block: one that walks and is met, one that walks only, one met only.
BOTH, WALKS, MET = 0, 1, 2


def _join_blocks(percent: int, size: int):
    """Streams rows sorted by block and joins one block at a time."""

    def flush(docs: list[int], sets: list[np.ndarray], roles: list[int]) -> pa.RecordBatch:
        ids, role = np.array(docs, np.int64), np.array(roles)
        tree = PrefixTree(sets, percent)
        if (role == BOTH).all():
            label = tree.components()
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            a, b = ids, least[label]
        else:
            a, b = ids[role == WALKS], tree.met(role == WALKS, role == MET, ids)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets, roles, seen = None, [], [], [], None
        for batch in batches:
            blocks, ids, k1, k2, role = (batch.column(i).to_pylist() for i in range(5))
            for i, text in enumerate(batch.column(5)):
                if blocks[i] != key and docs:
                    yield flush(docs, sets, roles)
                    docs, sets, roles = [], [], []
                key = blocks[i]
                now = key, ids[i], k1[i], k2[i]
                if now == seen:
                    continue
                # a repeated id brings each of its rows; only the class's own text counts
                tokens = shingles(text.as_py() or "", size)
                if _set_key(tokens) == now[2:]:
                    seen = now
                    docs.append(ids[i])
                    sets.append(tokens)
                    roles.append(role[i])
        if docs:
            yield flush(docs, sets, roles)

    return run


def _linked(source: DataFrame, units: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """``node, component`` over verified links inside clusters.

    A cluster of one chunk is a block. Of larger ones each chunk is a block, with about
    ``HUBS`` documents that all chunks have, so that copies of one text become one component
    whatever their number. Links that are left have an end outside the largest component:
    such documents are joined with each other in pairs of chunks, and walk the trees of the
    largest component's chunks, each link of theirs to it being one row. This work grows
    with the cluster times the part outside its largest component, and no link is lost.
    """

    def joined(blocks: DataFrame) -> DataFrame:
        laid = _with_texts(source, blocks.select("rep", "k1", "k2", "block", "role"), scratch).select("block", "doc", "k1", "k2", "role", "text")
        bound_batches(source.sparkSession)
        return laid.repartition("block").sortWithinPartitions("block", "doc", "k1", "k2").mapInArrow(tidied(_join_blocks(percent, size)), "a long, b long")

    chunks = lambda ngrams: F.ceil(F.col(ngrams) / CHUNK_NGRAMS).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep", "k1"), n).cast("int")
    dealt = units.withColumn("chunks", chunks("ngrams"))
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("k2", "rep"), F.greatest(F.lit(1), F.col("sets") / HUBS).cast("long")) == 0)
    places = F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own(F.col("chunks"))))
    alone = dealt.withColumn("chunk", F.explode(places)).select("rep", "k1", "k2", F.xxhash64("cluster", "chunk").alias("block"), F.lit(BOTH).alias("role"))
    first = scratch.keep(joined(alone).where("a <> b"))
    if not dealt.where("chunks > 1").limit(1).count():
        return connected_components(first, scratch)
    parts = connected_components(first, scratch)
    large = scratch.keep(dealt.where("chunks > 1").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "k1", "k2", "n", "cluster", F.coalesce("component", "rep").alias("part")))
    sums = large.groupBy("cluster", "part").agg(F.sum("n").alias("ngrams"), F.count("*").alias("rows"))
    most = sums.groupBy("cluster").agg(F.max(F.struct("ngrams", "part")).alias("most"), F.sum("ngrams").alias("all"), F.sum("rows").alias("rows")).select("cluster", "rows", F.col("most.part").alias("main"), F.col("most.ngrams").alias("inner"), (F.col("all") - F.col("most.ngrams")).alias("outer"))
    most = scratch.keep(most.where("outer > 0"))
    placed = hot_join(large, most, "cluster", F.col("rows"), large.count()).drop("rows").withColumn("in_main", F.col("part") == F.col("main")).withColumn("ins", chunks("inner")).withColumn("outs", chunks("outer"))
    placed = placed.withColumn("chunk", own(F.when(F.col("in_main"), F.col("ins")).otherwise(F.col("outs"))))
    block = lambda kind, a, b: F.xxhash64("cluster", F.lit(kind), a, b).alias("block")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    keys = ["rep", "k1", "k2"]
    outside, inside = placed.where(~F.col("in_main")), placed.where("in_main")
    pairs = outside.select(*keys, "cluster", "chunk", each("outs")).select(*keys, block("pair", F.least("chunk", "other"), F.greatest("chunk", "other")), F.lit(BOTH).alias("role"))
    walkers = outside.select(*keys, "cluster", "chunk", each("ins")).select(*keys, block("walk", "chunk", "other"), F.lit(WALKS).alias("role"))
    met = inside.select(*keys, "cluster", "chunk", each("outs")).select(*keys, block("walk", "other", "chunk"), F.lit(MET).alias("role"))
    second = joined(pairs.union(walkers).union(met)).where("a <> b")
    return connected_components(first.union(second), scratch)


def ngram_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``.

    Words are runs of other than blank, tab, line and page feeds, after lower-casing A-Z;
    a set holds the distinct ``size``-word n-grams (all words as one if there are fewer).
    Two documents link when ``100 * both >= percent * either``; ``component_id`` is the
    smallest id reachable over links. Null and empty texts have an empty set and link with
    nothing, not even each other. Rows that repeat an id are each judged by their own text; with a
    null id a row keeps its size, and its ``component_id`` is null. ``id`` must be integral.
    Texts of any length are taken whole; a task holds the sets of one block at a time, one of
    them at least. N-grams are 64-bit hashes, so sizes and links are exact but for a chance of
    about 2 ** -58 for each pair of different n-grams that meet.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def describe(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        sizes, keys, cells = [], [], []
        for doc, text in zip(ids.to_pylist(), texts(column), strict=True):
            tokens = shingles(text, size)
            sizes.append(len(tokens))
            keys.append(_set_key(tokens))
            cells.append(shown(tokens, percent).view(np.int64) if doc is not None else np.empty(0, np.int64))
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
        flat = np.concatenate(cells) if cells else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["doc", "n", "k1", "k2", "cells"],
        )

    signed = scratch.keep(map_batches(source, ["doc", "text"], describe, "doc long, n long, k1 long, k2 long, cells array<long>"))
    base = scratch.keep(signed.select("doc", "n", "k1", "k2"))
    # equal sets are one class, told by the smallest id
    classes = scratch.keep(base.where("n > 0 AND doc IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")))
    hits = _sorted_cells(signed.select(F.explode("cells").alias("cell"), "doc")).mapInArrow(tidied(_seen), "doc long, hits long").groupBy("doc").agg(F.sum("hits").alias("hits"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(least * SURPLUS_PERCENT / 100))
    left = scratch.keep(classes.join(hits.withColumnRenamed("doc", "rep"), "rep").where(enough).select("rep", "k1", "k2", "n"))
    scratch.drop(signed)
    units = _clusters(left, _rarest(source, left, percent, size, scratch), scratch)
    linked = _linked(source, units, percent, size, scratch)

    reps = scratch.keep(classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("found")))
    # a text of very many copies is one row of the classes, and met where its copies are
    joined = hot_join(base.where("n > 0 AND doc IS NOT NULL"), reps, ["k1", "k2"], F.col("copies"), base.count())
    rest = base.where("n = 0 OR doc IS NULL").withColumn("found", F.col("doc"))
    return joined.select("doc", "n", "found").union(rest.select("doc", "n", "found")).toDF(id_col, "n_shingles", "component_id")
