"""Exact Jaccard join of word n-gram sets, with count-vector R-trees.

Sets of n-gram hashes are blocked by prefixes: under any one order of the
n-grams, two sets of the wanted similarity have a common element among the first
size - ceil(percent * size / 100) + 1 of each.  N-grams that many documents of a
task share come last in that order, so common passages rarely make a block; the
order only saves work, the result is the same under every order.

Every set also shows all its n-grams below a threshold of the hash.  Those that no
other set shows are certain mismatches: a set with more of them than the
similarity allows has no partner and is dropped before any set is moved.  Of two
partners, the one that is not larger has even fewer mismatches; n-grams that no
such core set shows are mismatches too.

Sets that blocks connect are a cluster; all links lie within clusters.  An R-tree
over count vectors (see rtree.py) finds the pairs of a cluster whose summed
coordinate minima allow the similarity, and each of them is verified on the whole
sets where it was found; only each set's number of links and the edges of a
spanning forest leave the task.  A cluster of more sets or elements than a tile is
dealt out as pairs of tiles, by size and by least element.  There the trees are
searched with the count vectors alone first, and only sets with a candidate are
sent, whole, to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm import rtree, textbuf
from cartulary.llm.components import components
from cartulary.llm.workspace import Workspace, lean

WORDS = 5
PERCENT = 80
#: The share of all n-grams that is shown, those of the lowest hashes.
SHOWN = 0.28
#: Parts over which the sets of a common n-gram are dealt.
SPREAD = 64
#: N-grams in as many documents of a task's sample of COMMON_WINDOW n-grams are ordered last; the most common of them, to bound what is sent to tasks.
COMMON_COPIES = 4
COMMON_WINDOW = 1 << 21
COMMON_MOST = 100_000
#: Sets in a tile of a large cluster, and elements of the sets that are verified together, in expectation; a larger set is alone.
TILE = 1024
ELEMENTS = 1 << 20
#: Ids that are broadcast at most; beyond, texts are shuffled.
BROADCAST_ROWS = 1_000_000

_STEPS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_THRESHOLD = np.uint64(int(SHOWN * 2**64))


def ngram_sets(chunk: textbuf.Chunk, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each document's word n-grams: of the whole sequence if it has fewer words, none if it has no word."""
    hashed, docs = textbuf.word_hashes(chunk)
    steps = _STEPS[np.arange(words) % len(_STEPS)] + np.uint64(2) * (np.arange(words) // len(_STEPS)).astype(np.uint64)
    m = max(0, len(hashed) - words + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(words):
        rolled += hashed[k : k + m] * steps[k]
    rolled = textbuf.mix64(rolled)
    for i in range(chunk.n):
        first, last = int(docs[i]), int(docs[i + 1])
        if last - first >= words:
            own = np.sort(rolled[first : last - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif last > first:
            yield textbuf.mix64((hashed[first:last] * steps[: last - first]).sum(dtype=np.uint64, keepdims=True) + np.uint64(last - first))
        else:
            yield np.empty(0, np.uint64)


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    x = textbuf.mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], np.uint64) * textbuf._MULT
    return int(textbuf.mix64(x).view(np.int64)[0])


def _shown(own: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The n-grams of a set that make blocks: its first by (common, hash), and all others under the threshold that are not common.

    Also whether each is one of the latter kind, and how many of those must be
    shared if the set is to have a partner, and to have one that is not smaller.
    """
    most = len(own) + (-percent * len(own) // 100)  # n-grams that a partner may lack
    below = int(np.searchsorted(own, _THRESHOLD))
    head = own[: max(below, 2 * (most + 1))]
    while True:
        at = np.searchsorted(common, head)
        at[at == len(common)] = 0
        rare = head[common[at] != head] if len(common) else head
        low = int(np.searchsorted(rare, _THRESHOLD))
        if len(rare) > most or len(head) == len(own):
            break
        head = own
    grams = rare[: max(low, most + 1)]
    if len(grams) <= most:
        late = own[~np.isin(own, rare, assume_unique=True)]
        grams = np.concatenate([grams, late[: most + 1 - len(grams)]])
    # A partner that is not smaller lacks fewer: it shares at least percent of the mean of the union and both sizes.
    few = len(own) + (-2 * percent * len(own) // (100 + percent))
    return grams, np.arange(len(grams)) < low, max(0, low - most), max(0, low - few)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """Two kinds of rows: (false, doc_id, fingerprint, size) of each document, and (true, n-gram, copies, 0) of what a task sees often."""

    @textbuf.frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["common", "key", "value", "n"]
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            key, copies = np.unique(np.concatenate(held), return_counts=True)
            key, copies = key[copies >= COMMON_COPIES], copies[copies >= COMMON_COPIES]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), bool)), pa.array(key.view(np.int64)), pa.array(copies), pa.array(np.zeros(len(key), np.int64))], names)

        for batch in batches:
            for chunk in textbuf.chunks(batch.column(1)):
                marks, sizes = [], []
                for own in ngram_sets(chunk, words):
                    marks.append(fingerprint(own))
                    sizes.append(len(own))
                    if marks[-1] not in seen:
                        seen.add(marks[-1])
                        held.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(chunk.n, bool)), batch.column(0).slice(chunk.first, chunk.n), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64())], names)
                if sum(map(len, held)) >= COMMON_WINDOW:
                    yield often()
                    held, seen = [], set()
        if held:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(scan, "common boolean, key long, value long, n long")


def _prefixes(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(gram, node, need, core, part) of the n-grams that are shown; need holds twice what _shown says must be shared, and 1 more if the row counts for that; core what a set shares that has a partner not smaller than itself; part deals out common n-grams and is 0 for others.  A set that a task has met before is passed over."""

    @textbuf.frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(0)):
                grams, nodes, needs, cores = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
                for own in ngram_sets(chunk, words):
                    node = fingerprint(own)
                    if len(own) and node not in seen:
                        seen.add(node)
                        shown, low, need, core = _shown(own, common, percent)
                        grams.append(shown)
                        nodes.append(np.full(len(shown), node))
                        needs.append((2 * need + low).astype(np.int32))
                        cores.append(np.full(len(shown), core, np.int32))
                gram, node = np.concatenate(grams), np.concatenate(nodes)
                part = np.where(np.isin(gram, common), 1 + node % SPREAD, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(node), pa.array(np.concatenate(needs)), pa.array(np.concatenate(cores)), pa.array(part)], ["gram", "node", "need", "core", "part"])

    return docs.select("text").mapInArrow(scan, "gram long, node long, need int, core int, part int")


def _members(prefixes: DataFrame) -> DataFrame:
    """(gram, node, need, core), each once, of the n-grams that several sets show, or that are common.  A stream over sorted rows: one row is held back."""

    @textbuf.frugal
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "node", "need", "core"]
        held, held_shared = None, False
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in (*names, "part")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[new] for c in cols]
            shared = cols[4] > 0
            same = cols[0][1:] == cols[0][:-1]
            shared[1:] |= same
            shared[:-1] |= same
            shared[0] |= held_shared
            held, held_shared = [c[-1:] for c in cols], bool(shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][shared[:-1]]) for c in cols[:4]], names)
        if held_shared:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:4]], names)

    return prefixes.repartition("gram", "part").sortWithinPartitions("gram", "node").mapInArrow(runs, "gram long, node long, need int, core int")


def _rarest(shown: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, lead): of the sets that may have a partner the n-grams of which a pair has one in common; lead: also as the smaller of the two.

    The order of the n-grams begins with those under the threshold, the ones that no
    pair has before the rest by their copies, so a chance meeting in a frequent
    n-gram is behind the prefix.  Those of other kinds stay in the order they have.
    """
    low = F.col("need") % 2
    shared = shown.groupBy("node").agg(F.sum(low).alias("shared"), F.max(F.floor(F.col("need") / 2)).alias("least"), F.max("core").alias("core"))
    alive = shared.where("shared >= least").select("node", "least", "core", (F.col("shared") >= F.col("core")).alias("is_core")).join(nodes.select("node", "n"), "node")
    left = shown.select("gram", "node", low.alias("low")).join(alive, "node")
    # Of two partners the smaller one is a core set: an n-gram without any links nothing.
    copies = left.groupBy("gram").agg(F.count("*").alias("sets"), F.count_if("is_core").alias("cores")).where("sets > 1 and cores > 0").select("gram", "sets")
    own = Window.partitionBy("node")
    rows = left.join(copies, "gram").select("*", F.sum("low").over(own).alias("shared"), F.row_number().over(own.orderBy(F.desc("low"), "sets", "gram")).alias("place"))
    # Before place there are those that a set shares with no other; what is left of the prefix is one more than what it shares beyond its need.
    rows = rows.where("shared >= least and (low = 0 or place <= shared - least + 1)")
    return rows.select("gram", "node", "n", F.expr("is_core and shared >= core and (low = 0 or place <= shared - core + 1)").alias("lead"))


def _star(rare: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: edges that connect all partners.  A hub is one of an n-gram's leading sets of a band of sizes or the one below; a set's partners that are not smaller are in its own band or the next."""
    # Bands are a trifle wider than the similarity asks, so rounding parts no partners.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-4)).cast("int")
    rows = rare.select("gram", "node", "lead", band.alias("band"))
    hubs = rows.where("lead").select("gram", "node", F.explode(F.array("band", F.col("band") + 1)).alias("band")).groupBy("gram", "band").agg(F.min("node").alias("hub"))
    leads = rows.where("lead").withColumn("band", F.col("band") + 1)
    return rows.union(leads).join(hubs, ["gram", "band"]).where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2 or 4 bytes that holds them all."""
    most = int(counts.max(initial=0))
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row of counts for each value of _packed."""
    rows = [np.frombuffer(x, f"<u{len(x) // rtree.GROUPS}") for x in column.to_pylist()]
    return np.array(rows, np.int32).reshape(-1, rtree.GROUPS)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, size, least element, counts and elements of the documents' sets."""

    @textbuf.frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "n", "least", "counts", "elements"]
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(0)):
                sets = [own for own in ngram_sets(chunk, words) if len(own)]
                columns = [pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([int(x[0].view(np.int64)) for x in sets], pa.int64())]
                counts = [_packed(rtree.counts_of(x, np.array([len(x)]))) for x in sets]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names)

    return docs.select("text").mapInArrow(scan, "node long, n long, least long, counts binary, elements binary")


def _tiles(large: DataFrame, percent: int) -> DataFrame:
    """(meet, first, node, n, copies) for all pairs of tiles of a cluster that may hold partners; in a tile's meeting with itself first is null.

    Tiles are bands of sizes; bands of many sets are dealt by least element, which near copies mostly share.
    """
    rows = large.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int"))
    parts = rows.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / ELEMENTS)).cast("int").alias("parts"))
    rows = rows.join(parts, ["cluster", "band"]).withColumn("tile", F.struct("band", F.pmod(F.xxhash64("least"), F.col("parts")).cast("int").alias("part")))
    tiles = rows.groupBy("cluster", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = tiles.select("cluster", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Tiles meet if any two of their sizes may be partners.
    meet = tiles.join(other, "cluster").where(f"tile <= tile2 and {percent} * low <= 100 * high2 and {percent} * low2 <= 100 * high").select("cluster", "tile", "tile2", F.xxhash64("cluster", "tile", "tile2").alias("meet"))
    left = rows.join(meet, ["cluster", "tile"]).select("meet", F.when(F.col("tile") < F.col("tile2"), F.lit(True)).alias("first"), "node", "n", "copies")
    right = rows.withColumnRenamed("tile", "tile2").join(meet.where("tile < tile2"), ["cluster", "tile2"]).select("meet", F.lit(False).alias("first"), "node", "n", "copies")
    return left.union(right)


def _sides(first: pa.ChunkedArray | pa.Array) -> np.ndarray | None:
    """Which rows are on the first side of a meeting; None in a tile's meeting with itself."""
    side = first.to_numpy(zero_copy_only=False) if isinstance(first, pa.Array) else first.to_numpy()
    return None if not len(side) or side[0] is None else side.astype(bool)


def _candidate_blocks(meets: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(block, first, node, n, copies): the sets of each meeting that have a candidate, in blocks that candidates connect."""

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = _sides(rows["first"])
        tree = rtree.CountTree(rows["n"].to_numpy(), _unpacked(rows["counts"]), side)
        forest = rtree.Forest(rows.num_rows)
        for i, near in tree.candidates(percent):
            forest.link(i, near)
        held = np.bincount(forest.root, minlength=rows.num_rows)[forest.root] > 1
        meet = rows["meet"].to_numpy()
        block = textbuf.mix64(meet.view(np.uint64) + textbuf.mix64(forest.root.astype(np.uint64))).view(np.int64)
        return pa.table({"block": block} | {c: rows[c] for c in ("first", "node", "n", "copies")}).filter(pa.array(held))

    # The vectors join last: they are the widest column.
    return meets.join(points.select("node", "counts"), "node").groupBy("meet").applyInArrow(search, "block long, first boolean, node long, n long, copies long")


def _linked(blocks: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The verified links of blocks: a row (node, node, documents linked to) of each set with a link, and rows (a, b, 0) that join all that is linked."""

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        block, node, n, copies = (rows[c].to_numpy() for c in ("block", "node", "n", "copies"))
        raw, first = rows["elements"], rows["first"]
        order = np.lexsort([node, block])
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        a, b, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[x:y]
            own = own[np.concatenate([[True], node[own][1:] != node[own][:-1]])]  # repeated documents give repeated sets
            elements = np.frombuffer(b"".join(raw[int(i)].as_py() for i in own), np.uint64)
            forest, degree = rtree.Forest(len(own)), np.zeros(len(own), np.int64)
            for i, near in rtree.verified(elements, n[own], percent, _sides(first.take(pa.array(own)))):
                degree[i] += copies[own[near]].sum()
                degree[near] += copies[own[i]]
                forest.link(i, near)
            met = np.flatnonzero(degree)
            a += [node[own[met]], *(node[own[[i]]] for i, _ in forest.edges)]
            b += [node[own[met]], *(node[own[[j]]] for _, j in forest.edges)]
            links += [degree[met], np.zeros(len(forest.edges), np.int64)]
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "links": np.concatenate(links)})

    whole = blocks.join(sets.select("node", "elements"), "node").withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))
    return whole.groupBy("bucket").applyInArrow(verify, "a long, b long, links long")


def join(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, n_links.

    Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z.  A set holds the distinct
    n-grams; with fewer words, the whole sequence as one.  Null or empty texts, and
    texts without words, have the empty set and are linked with nothing, not even
    each other.  Repeated rows are returned as often as they occur.  An empty table
    gives no rows; other columns of docs are ignored.  component_id is the smallest
    doc_id that links reach, null if they reach null only; n_links is the number of
    other rows that a row is linked with, copies included.  Links are exact on
    64-bit hashes of the n-grams.
    """
    docs = lean(docs)
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    scanned = work.table("signatures", _signatures(docs, words))
    documents = scanned.where("not common").select(F.col("key").alias("doc_id"), F.col("value").alias("node"), "n")
    often = scanned.where("common").groupBy("key").agg(F.sum("value").alias("copies")).orderBy(F.desc("copies"), "key").limit(COMMON_MOST)
    common = np.array(sorted(np.array([r[0] for r in often.select("key").collect()], np.int64).view(np.uint64)), np.uint64)

    nodes = documents.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n").alias("n"))
    shown = work.table("shown", _members(_prefixes(docs, common, words, percent)))
    rare = work.table("rare", _rarest(shown, nodes, percent))
    work.drop("shown")
    star = work.table("star", _star(rare, percent))
    work.drop("rare")
    clusters = components(work, star, "clusters").withColumnRenamed("label", "cluster")
    clustered = work.table("clustered", clusters.join(nodes.drop("n"), "node"))

    read = docs.select("doc_id", "text")
    wanted = clustered.select("doc_id")
    kept = F.broadcast(wanted) if clustered.count() <= BROADCAST_ROWS else wanted
    # A set may have no other id than null.
    sets = work.table("sets", _sets(read.join(kept, read["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi"), words))

    points = sets.select("node", "n", "least", "counts").dropDuplicates(["node"])
    rows = clustered.select("node", "cluster", "copies").join(points.select("node", "n", "least"), "node")
    sizes = rows.groupBy("cluster").agg((F.count("*") > TILE).alias("many"), (F.sum("n") > ELEMENTS).alias("long"))
    rows = work.table("rows", rows.join(sizes, "cluster"))
    found = work.table("found", _candidate_blocks(_tiles(rows.where("many or long"), percent), points, percent))
    blocks = rows.where("not (many or long)").select(F.col("cluster").alias("block"), F.lit(None).cast("boolean").alias("first"), "node", "n", "copies").union(found)
    elements = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = work.table("links", _linked(blocks, sets, percent, max(1, elements // ELEMENTS)))

    degree = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    labels = components(work, links.where("a <> b"), "labels")
    least = nodes.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = labels.join(least, "label").select("node", "component_id").join(degree, "node")
    classes = nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = documents.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return own.union(alone)
