"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct 2-word shingles (words between ASCII white
space, A-Z in lower case).  Documents whose Jaccard similarity reaches 75 % are linked; a
component is what links connect.

1. Documents with equal sets form a class; only the class with the smallest id of
   its members takes part from here on, so copies cost nothing more.
2. Each of TREES independent trees branches documents by the minwise tokens chosen
   along a path: documents that agree in the first DEPTH choices share a node.  A pair at
   the threshold meets in one tree with probability 0.75**DEPTH, and in none of the trees
   with probability 2e-6.
3. Round one: every document is compared with the smallest member of each of its
   nodes by a sketch (one byte per minwise token), and the best is confirmed on the full
   sets.  The links of a node are a star, never all its pairs; one node may hold a third of all rows.
4. Round two looks only where members of one node are still in different components.
   Nodes of at most LARGE members are compared exhaustively, those above BLOCK block by block,
   so a pair that meets in one is never lost, whatever its size.  A larger node branches, to the
   six tokens of two other trees at each level, if its children take at most half its
   comparisons; else it is compared block by block as well.  A pair at the threshold stays
   together with probability 1 - 0.25**6 a level.  Pairs whose sketches come near the threshold are
   confirmed on the full sets.

Full sets are 64-bit shingle hashes; they are made again from the text for candidates only.
Candidate ids are broadcast up to BROADCAST_BYTES; beyond that they are joined.

Defined results
* null or empty text, or white space alone: 0 shingles, its own component, kept.
* one word: a set of that one sequence.
* null doc_id: counted, linked with nothing, ``component_id`` null, kept.
* rows that share an id count as one document that holds all their texts; each is returned.
* very long texts: whole.  Ties (equal estimates) go to the smallest id.
* other columns, whatever their names: ignored by ``components``.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._arrow import free_name, give_back, map_batches, project, slices, texts_of

PERCENT = 75
TREES, DEPTH = 24, 3
COORDINATES = TREES * DEPTH
SMALL = 1024  # a node of no more is one block
BLOCK, LARGE = 2048, 16384
#: Least sketch estimate for a star link to be worth confirming, and for a pair of round two.
LIKELY, NEAR = 0.6, 0.55
BROADCAST_BYTES = 64 << 20
PARTNERS = 128  # documents of a cluster that are brought together to confirm pairs among them and with as many others,
BUCKET_BYTES = 32 << 20  # and about the most that the sets of so many may take; very long texts share a bucket with fewer

_rng = np.random.default_rng(75)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) > 1:
        h = (h[:-1] * _A) ^ (h[1:] + (h[1:] >> np.uint64(29)) * _B)
    h = h * _C
    return np.unique(h ^ (h >> np.uint64(31)))


def signature(own: np.ndarray) -> np.ndarray:
    """The minwise tokens: COORDINATES values of 32 bits."""
    out = np.empty(COORDINATES, np.uint32)
    for k in range(COORDINATES):
        x = (own ^ _XOR[k]) * _MUL[k]
        out[k] = int(((x ^ (x >> np.uint64(32))) * _B >> np.uint64(32)).min())
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on full sets (sorted, distinct)."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sign(part: pa.RecordBatch) -> dict[str, object]:
    sizes, digests, signatures, sketches = [], [], [], []
    for text in texts_of(part.column("text")):
        own = shingles(text)
        sizes.append(len(own))
        digests.append(xxhash.xxh3_128_digest(own.tobytes()))
        sig = signature(own) if len(own) else None
        signatures.append(None if sig is None else sig.view(np.int32).tolist())
        sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
    return {"doc_id": part.column("doc_id"), "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(signatures, pa.list_(pa.int32())), "sketch": pa.array(sketches, pa.binary())}


def _path(tree: Column, depth: int) -> Column:
    """The node of a tree that the first ``depth`` of its own chosen tokens lead to."""
    at = lambda k: F.get("sig", (tree * DEPTH + F.lit(k)).cast("int"))
    return F.xxhash64(tree, *(at(k) for k in range(depth)))


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """(node, id, tree) for all trees."""
    return classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(_path(F.col("tree"), depth).alias("node"), "id", "tree")


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from sketches: agreeing bytes, less those that agree by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def star_candidates(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, cluster): for each class the centre of its nodes that its sketch is most like, if likely enough."""
    sketch = classes.select(F.col("id").alias("least"), F.col("sketch").alias("centre"))
    centres = nodes.join(sketch, "least").select("node", "least", "centre")
    members = nodes.select("node").join(_nodes(classes, DEPTH), "node")
    pairs = members.join(centres, "node").filter("id <> least").join(classes.select("id", "sketch"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("id"), batch.column("least"), pa.array(_estimate(_sketches(batch.column("sketch")), _sketches(batch.column("centre"))))], ["id", "least", "like"])

    judged = pairs.select("id", "least", "sketch", "centre").mapInArrow(run, "id long, least long, like double").filter(F.col("like") >= LIKELY)
    best = judged.groupBy("id").agg(F.max(F.struct("like", -F.col("least"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("a"), F.col("id").alias("b"), (-F.col("best.col2")).alias("cluster"))


def _sets(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens): the full sets of the named documents, made from their whole texts."""
    spark = base.sparkSession
    if ids.count() * 8 <= BROADCAST_BYTES:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["id"] for r in ids.toLocalIterator()], np.int64)))
        source = base
    else:
        wanted, source = None, base.join(ids, base["doc_id"] == ids["id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if wanted is not None:
                    own = part.column("doc_id").fill_null(-1).to_numpy()
                    at = np.searchsorted(wanted.value, own)
                    hit = (wanted.value[np.minimum(at, len(wanted.value) - 1)] == own) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(wanted.value) else np.zeros(len(own), bool)
                    part = part.filter(pa.array(hit))
                yield pa.record_batch([part.column("doc_id"), pa.array([shingles(x).tobytes() for x in texts_of(part.column("text"))], pa.binary())], ["id", "tokens"])

    return source.mapInArrow(run, "id long, tokens binary")


def confirmed(base: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked.  pairs: (a, b, cluster), a pair maybe under several clusters; classes: (id, n, ...).

    A cluster's documents are dealt to buckets of about PARTNERS, or BUCKET_BYTES if that is fewer, and pairs meet by their two
    buckets: a set is sent once for every bucket its document has a pair in, not for every
    pair, and a cluster with a third of all documents is spread over many tasks.
    """
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("cluster").alias("cluster")), "near-pairs")
    both = F.explode(F.array("a", "b")).alias("id")
    sizes = pairs.select("cluster", both).distinct().join(classes.select("id", "n"), "id").groupBy("cluster")
    sizes = sizes.agg(F.greatest(F.ceil(F.count("*") / PARTNERS), F.ceil(F.sum("n") * 8 / BUCKET_BYTES)).cast("int").alias("buckets"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.col("buckets")).cast("int")
    keys = ["cluster", "low", "high"]
    placed = pairs.join(sizes, "cluster").select("cluster", F.least(bucket("a"), bucket("b")).alias("low"), F.greatest(bucket("a"), bucket("b")).alias("high"), "a", "b")
    placed = materialize(placed, "near-placed")
    needed = materialize(placed.select(*keys, both).distinct(), "near-needed")
    sets = _sets(base, materialize(needed.select("id").distinct(), "near-ids"))
    if needed.count() * 32 <= BROADCAST_BYTES // 4:  # else the sets are joined by shuffle
        needed = F.broadcast(needed)
    null = F.lit(None).cast("long")
    rows = sets.join(needed, "id").select(*keys, F.col("id").alias("a"), null.alias("b"), "tokens").unionByName(placed.select(*keys, "a", "b", F.lit(None).cast("binary").alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found: dict[str, list[int]] = {"a": [], "b": []}
            for *key, a, b, raw in zip(*(batch.column(k).to_pylist() for k in (*keys, "a", "b", "tokens")), strict=True):
                if key != now:
                    now, held = key, {}
                if b is None:
                    held.setdefault(a, []).append(np.frombuffer(raw, np.uint64))
                elif any(linked(x, y) for x in held.get(a, ()) for y in held.get(b, ())):
                    found["a"].append(a)
                    found["b"].append(b)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found.values()], list(found))
        held.clear()
        give_back()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first(), "a")
    return materialize(ordered.mapInArrow(run, "a long, b long").distinct(), "near-links")


def connect(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every id in a link.

    Least labels spread over links, then labels take the label of their label, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain.  Every round is written.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "near-both")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "near-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        spread = materialize(labels.join(heard, "id").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("component")), "near-labels")
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = materialize(spread.join(jump, "component").select("id", "old", F.col("next").alias("component")), "near-labels")
        labels = after.select("id", "component")
        if not after.filter("old <> component").head(1):
            return labels


def _open(members: DataFrame) -> DataFrame:
    """Members (node, id, component, ...) of the nodes that still hold different components, with the node's size."""
    states = members.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(states.filter("low < high").select("node", "size"), "node")


def _agree(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many bytes of each sketch agree with one sketch: eight bytes are added at a time."""
    lanes = (many == one).view(np.uint64)
    total = lanes[:, 0].copy()
    for k in range(1, lanes.shape[1]):
        total += lanes[:, k]
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _compare(rows: DataFrame) -> DataFrame:
    """(a, b, cluster): pairs of different components within a node whose sketches come near the threshold.  rows: (node, block, other, own, id, component, sketch).

    A group is one block of a node, or two (block < other), of which only pairs across are compared.
    """
    enough = COORDINATES * (NEAR * (1 - 1 / 256) + 1 / 256)

    def pairs(block: int, other: int, group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        """(a, all b of it); members are in order of their components, and a component is not compared with itself."""
        group = sorted(group, key=lambda x: x[2])
        own, ids, parts = (np.array([x[k] for x in group], np.int64) for k in range(3))
        sketches = np.frombuffer(b"".join([x[3] for x in group]), np.uint8).reshape(-1, COORDINATES)
        left, right = (own == block, own == other) if block != other else (slice(None), slice(None))
        (ids_a, parts_a, sketches_a), (ids_b, parts_b, sketches_b) = ((ids[x], parts[x], sketches[x]) for x in (left, right))
        lows, highs = np.searchsorted(parts_b, parts_a, "left"), np.searchsorted(parts_b, parts_a, "right")
        for i in range(len(ids_a)):
            for start, end in ((0, lows[i] if block != other else 0), (highs[i], len(ids_b))):
                if start < end and len(near := np.flatnonzero(_agree(sketches_b[start:end], sketches_a[i]) >= enough)):
                    yield ids_a[i], ids_b[start + near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def out() -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def send() -> pa.RecordBatch:
                a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([np.full(len(y), x, np.int64) for x, y in held], [y for _, y in held]))
                return pa.record_batch([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), np.full(len(a), least, np.int64))], ["a", "b", "cluster"])

            if len(group) > 1:
                least = min(x[1] for x in group)
                for found in pairs(*now[1:], group):
                    held.append(found)
                    n += len(found[1])
                    if n >= 1 << 16:
                        yield send()
                        held, n = [], 0
                if held:
                    yield send()

        for batch in batches:
            for *key, own, i, part, sketch in zip(*(batch.column(k).to_pylist() for k in (*keys, "own", "id", "component", "sketch")), strict=True):
                if key != now:
                    yield from out()
                    now, group = key, []
                group.append((own, i, part, sketch))
        yield from out()

    keys = ["node", "block", "other"]
    return rows.select(*keys, "own", "id", "component", "sketch").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "a long, b long, cluster long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Members (node, size, id, component) of nodes dealt to blocks, once for every pair of blocks (block <= other) with their ``own``."""
    blocks = F.when(F.col("size") <= SMALL, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = rows.select("node", "id", "component", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("node", "id", "component", "own", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"))


def rest_candidates(classes: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, cluster): pairs that share a node, lie in different components, and look near the threshold."""
    of = known.select(F.col("id").alias("k_id"), "component")
    members = nodes.select("node").join(_nodes(classes, DEPTH), "node").join(of, F.col("id") == F.col("k_id"), "left").select("node", "id", "tree", F.coalesce("component", "id").alias("component"))
    wide = materialize(_open(members), "near-open")
    columns = ["node", "size", "id", "component"]
    whole = [wide.filter(F.col("size") <= LARGE).select(columns)]
    wide = wide.filter(F.col("size") > LARGE)
    for level in range(1, (TREES + 1) // 2):
        if not wide.head(1):
            break
        # the tokens of two other trees, none twice on a path: strides are prime to TREES
        stride = F.element_at(F.array(*(F.lit(x) for x in (1, 5, 7, 11, 13, 17, 19, 23))), F.col("tree") % 8 + 1)
        first = lambda x: F.pmod(F.col("tree") + x * stride, F.lit(TREES)) * DEPTH  # noqa: B023, E731
        on = lambda x, k: F.xxhash64("parent", F.lit(x), F.lit(k), F.get("sig", (first(x) + k).cast("int")))  # noqa: B023, E731
        born = wide.withColumnsRenamed({"node": "parent", "size": "parent_size"}).join(classes.select("id", "sig"), "id")
        born = born.select("parent", "parent_size", "id", "tree", "component", F.explode(F.array(*(on(x, k) for x in (2 * level - 1, 2 * level) for k in range(DEPTH)))).alias("node"))
        children = materialize(_open(born), "near-children")
        # a member of a node of n takes n comparisons
        heavy = children.groupBy("parent", "parent_size").agg(F.sum("size").alias("work")).filter(2 * F.col("work") > F.col("parent_size").cast("double") * F.col("parent_size"))
        heavy = materialize(heavy.select(F.col("parent").alias("heavy")), "near-heavy")
        whole.append(wide.join(heavy, F.col("node") == F.col("heavy"), "left_semi").select(columns))
        children = children.join(heavy, F.col("parent") == F.col("heavy"), "left_anti")
        whole.append(children.filter(F.col("size") <= LARGE).select(columns))
        wide = children.filter(F.col("size") > LARGE).select(*columns, "tree")
    whole.append(wide.select(columns))  # all tokens used up
    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    return _compare(_blocks(rows).join(classes.select("id", "sketch"), "id"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, confirmed_links) of every row; confirmed_links, those of its class that were confirmed, is a lower bound of its links."""
    base = project(docs, doc_id=doc_id, text=text)
    signed = materialize(map_batches(base, _sign, "doc_id long, n long, digest binary, sig array<int>, sketch binary"), "near-signed")
    with_set = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(with_set.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "near-classes")
    nodes = materialize(_nodes(classes, DEPTH).groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1"), "near-nodes")
    stars = confirmed(base, star_candidates(classes, nodes), classes)
    known = connect(stars)
    more = confirmed(base, rest_candidates(classes, nodes, known), classes)
    links = materialize(stars.unionByName(more).filter("a <> b").distinct(), "near-links")
    known = connect(links) if more.head(1) else known
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("confirmed_links"))
    found = classes.select(F.col("digest").alias("c_digest"), "id").join(known, "id", "left").join(degree, "id", "left")
    rows = signed.select("doc_id", "n", "digest").join(found, (F.col("digest") == F.col("c_digest")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("confirmed_links", F.lit(0)).cast("long").alias("confirmed_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the rows with its smallest id.

    What is joined with the texts is one id per removed document.
    """
    name = free_name(docs, "gone")
    gone = components(docs, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "near-gone")
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
