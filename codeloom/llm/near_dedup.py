"""MinHash near-dedup by a chosen-path set similarity join.

Each distinct set of word shingles gets 64 minwise tokens. In each of TREES independent trees the sets start at nodes of two
selected coordinates' tokens; a node of more than NODE sets branches by the tokens of each of three further selected coordinates.
A branching counts only if it leaves no more rows in large nodes than it took, so that no level holds more than three times the rows of
the first; else the node stays as it is, and so does one most of whose sets are so alike that branching hardly splits it. Sets that meet no other drop out;
the others' texts are read once more for their full sets and for sketches of 512 minwise bytes. Nodes of up to NODE sets are
compared exhaustively by sketches, and what passes is confirmed on the full sets.

A pair of similarity 0.8 starts together in a tree with probability 0.64, and misses all 13 trees with 1.7e-6 where no node
branches, 3.7e-6 after one branching and 4.8e-6 after eight, by the number of its 64 coordinates that agree; the sketch threshold lies 4.5 standard deviations below 0.8.

A node that stays large is cut into blocks of NODE / 2 by a hash, and PIVOTS of its sets stand in all of its blocks, so that most of
its sets are linked at once. Then the sets outside of its largest component meet the whole node, block by block: any two sets of it
are of one component or meet.

Components need only enough links to connect them: a node first proposes a spanning forest of its most similar pairs. A node of
which a proposed pair failed on the full sets then proposes all remaining pairs between different components. Where these are more
than PAIRS for each set, they aren't written: the sets concerned come to the node's task with their full sets and are linked there,
in parts of at most WEIGHT bytes. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import bounded, trimmed
from codeloom.llm.components import components
from codeloom.llm.rows import without
from codeloom.llm.scratch import Scratch, held

COORDINATES = 64
PLACES = 512
TREES = 13
NODE = 2_048
#: Branchings below a tree's first nodes. Sets that still share a node of over NODE agree in over ten tokens.
LEVELS = 8
#: Sets of a node that is still large that stand in each of its blocks.
PIVOTS = 16
#: Branching hardly splits nodes of which half the pairs agree in so many tokens.
DENSE = 46
SKETCH = 370
#: Pairs for each set that a node proposes at most; with more it is resolved in its task, which holds so many bytes of full sets at once.
PAIRS = 4
WEIGHT = 64 << 20

_FACTORS = np.random.default_rng(20_240_229).integers(1, 1 << 63, COORDINATES + PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def _forget() -> None:
    _known.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def shingles(text: str, words: int = 4) -> np.ndarray:
    """The set of a text as sorted 64-bit values. Words are runs of anything but ASCII white space, with A-Z in lower case."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = _known
    if len(known) > 200_000:
        known.clear()
    for w in set(parts).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    codes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    h = np.full(len(parts) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _PRIME + codes[j : len(parts) - k + 1 + j]
    return np.unique(_mix(h))


def _least(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 262_144 // len(factors))
    for k in range(0, len(values), step):
        low = np.minimum(low, (factors[:, None] * values[None, k : k + step]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of 32 bits."""
    return _least(values, _FACTORS[:COORDINATES])


def sketch(values: np.ndarray) -> np.ndarray:
    """PLACES minwise tokens of 8 bits."""
    return _least(values, _FACTORS[COORDINATES:]).astype(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sig = [], [], []
        for text in batch.column(3):
            values = shingles(text.as_py() or "", words)
            n.append(len(values))
            digest.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            sig.append(signature(values).tobytes() if len(values) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["row_id", "doc_id", "text_hash", "n_shingles", "digest", "sig"])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _node(path: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return _mix(_mix(path * _PRIME + coordinate.astype(np.uint64)) + token.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sig) to a row (node, cid) for each tree."""
    order = np.random.default_rng(7).permutation(COORDINATES)
    for batch in batches:
        if not len(batch):
            continue
        ids, sig = batch.column(0), _matrix(batch.column(1), np.uint32)
        for t in range(TREES):
            node = np.full(len(ids), t + 1, np.uint64)
            for c in order[2 * t : 2 * t + 2]:
                node = _node(node, np.array([c]), sig[:, c])
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), ids], names=["node", "cid"])


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, cid, sig) to rows (node, cid, up) one level below; the node, up, selects the coordinates."""
    for batch in batches:
        if not len(batch):
            continue
        node, sig = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2), np.uint32)
        first = (_mix(node + np.uint64(1)) >> np.uint64(20)) % np.uint64(COORDINATES)
        step = (_mix(node + np.uint64(2)) >> np.uint64(20)) | np.uint64(1)
        for k in range(3):
            c = (first + np.uint64(k) * step) % np.uint64(COORDINATES)
            below = _node(node, c, sig[np.arange(len(node)), c.astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), batch.column(1), batch.column(0)], names=["node", "cid", "up"])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tokens of some of its sets) to the nodes of which half the pairs agree in DENSE tokens or more."""
    for batch in batches:
        keep = []
        for sigs in batch.column(1):
            sig = np.stack([np.frombuffer(x, np.uint32) for x in sigs.as_py()])
            a, b = np.triu_indices(len(sig), 1)
            keep.append(len(a) > 0 and float(((sig[a] == sig[b]).sum(axis=1) >= DENSE).mean()) >= 0.5)
        yield batch.select([0]).filter(pa.array(keep, pa.bool_()))


def _forest(ids: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches agree in SKETCH places or more, most similar first."""
    n = len(ids)
    if n == 2:
        return [(0, 1)] if int((sketch[0] == sketch[1]).sum()) >= SKETCH else []
    best, source, out = np.zeros(n, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    at, found = 0, []
    for _ in range(n - 1):
        out[at] = False
        near = (sketch == sketch[at]).sum(axis=1, dtype=np.int32)
        better = near > best
        best[better], source[better] = near[better], at
        k = int(np.argmax(np.where(out, best, -1)))
        if best[k] >= SKETCH:
            found.append((int(source[k]), k))
        at = k
    return found


def _rest(sketch: np.ndarray, comp: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """All pairs between different components whose sketches pass; where they are more than so many, the sets in them, each as a pair with itself."""
    found: list[tuple[int, int]] = []
    concerned = np.zeros(len(comp), bool)
    for k in range(len(comp) - 1):
        other = np.flatnonzero(comp[k + 1 :] != comp[k]) + k + 1
        other = other[(sketch[other] == sketch[k]).sum(axis=1, dtype=np.int32) >= SKETCH]
        if len(other):
            concerned[other] = concerned[k] = True
            if len(found) <= most:
                found += [(k, j) for j in other.tolist()]
    if len(found) <= most:
        return found, False
    return [(k, k) for k in np.flatnonzero(concerned).tolist()], True


def _by_node(batches: Iterator[pa.RecordBatch], columns) -> Iterator[tuple]:
    """Rows in order of node, cid, as arrays by column for each run of whole nodes, with the places where nodes begin. columns makes the arrays of a batch."""
    held: list[tuple] = []

    def joined():
        rest = [sum((list(x) for x in c), []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*held)]
        node = rest[0]
        return rest, [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()]

    for batch in batches:
        if not len(batch):
            continue
        held.append(columns(batch))
        if held[-1][0][-1] == held[0][0][0]:
            continue
        rest, cuts = joined()
        yield rest, cuts
        held = [tuple(x[cuts[-1] :] for x in rest)]
    if held:
        rest, cuts = joined()
        yield rest, [*cuts, len(rest[0])]


def _compare(batches: Iterator[pa.RecordBatch], turn: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, cid, comp, sketch) in order of node, cid to proposed pairs (a, b, node, dense). A set that comes twice in a node counts once."""
    for (node, ids, comp, sketches), cuts in _by_node(batches, lambda b: (*(b.column(k).to_numpy() for k in range(3)), _matrix(b.column(3), np.uint8))):
        out: tuple[list, ...] = ([], [], [], [])
        for start, end in zip(cuts, cuts[1:]):
            own, labels, sketch = ids[start:end], comp[start:end], sketches[start:end]
            if end - start > 1 and (own[1:] == own[:-1]).any():
                once = np.concatenate([[True], own[1:] != own[:-1]])
                own, labels, sketch = own[once], labels[once], sketch[once]
            if len(own) < 2 or (labels == labels[0]).all():
                continue
            pairs, dense = _rest(sketch, labels, most * len(own)) if turn else (_forest(own, sketch), False)
            for x, y in pairs:
                x, y = int(own[x]), int(own[y])
                for o, v in zip(out, (min(x, y), max(x, y), int(node[start]), dense)):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.bool_())], names=["a", "b", "node", "dense"])


def _links(ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, whole: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components, confirmed on the full sets: enough to connect all that are linked."""
    _, label = np.unique(comp, return_inverse=True)
    for k in range(len(ids) - 1):
        other = np.arange(k + 1, len(ids))
        other = other[label[other] != label[k]]
        agree = (sketch[other] == sketch[k]).sum(axis=1, dtype=np.int32)
        other = other[agree >= SKETCH][np.argsort(-agree[agree >= SKETCH], kind="stable")]
        while len(other):
            some, other = other[:64], other[64:]
            sizes = np.array([len(whole[j]) for j in some])
            flat = np.concatenate([whole[j] for j in some])
            at = np.minimum(np.searchsorted(whole[k], flat), len(whole[k]) - 1)
            both = np.add.reduceat((whole[k][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for j in some[100 * both >= percent * (sizes + len(whole[k]) - both)].tolist():
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    yield int(ids[k]), int(ids[j])
            other = other[label[other] != label[k]]


def _resolve(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, cid, comp, sketch, whole) in order of node, cid to links (a, b)."""
    read = lambda b: (*(b.column(k).to_numpy() for k in range(3)), _matrix(b.column(3), np.uint8), [np.frombuffer(x.as_py(), np.uint64) for x in b.column(4)])
    for (_, ids, comp, sketches, whole), cuts in _by_node(batches, read):
        pairs = [p for start, end in zip(cuts, cuts[1:]) for p in _links(ids[start:end], comp[start:end], sketches[start:end], whole[start:end], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _whole_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(cid, digest, text) to (cid, n, whole, sketch), for texts that have the set of that digest."""
    for batch in batches:
        ids, n, whole, short = [], [], [], []
        for cid, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            values = shingles(text.as_py() or "", words)
            if hashlib.blake2b(values.tobytes(), digest_size=16).digest() == digest:
                ids.append(cid)
                n.append(len(values))
                whole.append(values.tobytes())
                short.append(sketch(values).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(short, pa.binary())], names=["cid", "n", "whole", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _blocks(deep: DataFrame) -> DataFrame:
    """Large nodes (node, cid, n) as small ones: blocks of about NODE / 2 by a hash, PIVOTS sets of a node in all of its blocks."""
    many = F.ceil(F.col("n") / max(1, NODE // 2))
    own = F.pmod(F.xxhash64("cid", F.lit(77)), many)
    block = lambda i: F.xxhash64(F.col("node"), i, F.lit("block")).alias("node")
    pivot = F.pmod(F.xxhash64("cid", "node"), F.lit(1_000_000)) * F.col("n") < PIVOTS * 1_000_000
    pivots = deep.where(pivot).select("node", "cid", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("i")).where("i <> own")
    return deep.select(block(own), "cid").unionByName(pivots.select(block(F.col("i")), "cid"))


def _outside(deep: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Large nodes (node, cid, n): the sets outside of a node's largest component with all of its sets, in small nodes of half and half."""
    label = deep.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("node", "cid", "n", F.coalesce("component", "cid").alias("comp"))
    label = scratch.save(label, "deep-labels")
    core = label.groupBy("node", "comp").agg(F.count("*").alias("held")).groupBy("node").agg(F.max(F.struct("held", "comp")).alias("m")).select("node", F.col("m.comp").alias("core"), F.col("m.held").alias("held"))
    core = scratch.save(core, "deep-cores")
    half = max(1, NODE // 2)
    far = label.join(core, "node").where("held < n").withColumn("left", F.col("comp") != F.col("core"))
    own, some, all_ = F.xxhash64("cid", F.lit(77)), F.ceil((F.col("n") - F.col("held")) / half), F.ceil(F.col("n") / half)
    far = far.select("node", "cid", "left", F.pmod(own, some).alias("i"), F.pmod(own, all_).alias("j"), some.alias("some"), all_.alias("all_"))
    first = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rows = far.where("left").select("node", "cid", "i", F.explode(first(F.col("all_"))).alias("j"))
    every = far.select("node", "cid", F.explode(first(F.col("some"))).alias("i"), "j")
    return scratch.save(rows.unionByName(every).select(F.xxhash64("node", "i", "j").alias("node"), "cid"), "deep-nodes")


def _tried(pairs: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs by their full sets."""
    both = pairs.join(values.select(F.col("cid").alias("a"), F.col("whole").alias("x")), "a").join(values.select(F.col("cid").alias("b"), F.col("whole").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda b: trimmed(_confirm(b, percent)), "a long, b long, linked boolean")


def _nodes_of(tokens: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(cid, sig) to written nodes (node, cid): those of two to NODE sets, and large ones (node, cid, n) that branching doesn't split."""
    now = tokens.mapInArrow(_roots, "node long, cid long")
    nodes, deep, level = [], [], 0
    while True:
        now = scratch.save(now, f"paths-{level}")
        size = now.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = scratch.save(now.join(size, "node"), f"nodes-{level}")
        if level:
            # Nodes whose branching left more of their sets' rows in large nodes than they had: they stay, and what came of them goes.
            left = met.where(f"n > {NODE}").groupBy("up").agg(F.count("*").alias("left"))
            had = large.select(F.col("node").alias("up"), F.col("n").alias("had")).distinct()
            stuck = scratch.save(left.join(had, "up").where("left > had").select("up"), f"stuck-{level}")
            if not stuck.isEmpty():
                deep.append(scratch.save(large.join(stuck, large["node"] == stuck["up"], "left_semi").select("node", "cid", "n"), f"kept-{level}"))
                met = scratch.save(met.join(stuck, "up", "left_anti"), f"split-{level}")
                scratch.drop(f"nodes-{level}")
        scratch.drop(f"paths-{level}", f"large-{level - 1}")
        nodes.append(met.where(f"n <= {NODE}").select("node", "cid"))
        large = met.where(f"n > {NODE}")
        if large.isEmpty():
            break
        if level == LEVELS:
            deep.append(large.select("node", "cid", "n"))
            break
        large = scratch.save(large.join(tokens, "cid").select("node", "cid", "n", "sig"), f"large-{level}")
        some = large.where("pmod(xxhash64(cid, node), 1000000) * n < 32000000").groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
        dense = scratch.save(some.mapInArrow(_dense, "node long"), f"dense-{level}")
        deep.append(scratch.save(large.join(dense, "node", "left_semi").select("node", "cid", "n"), f"deep-{level}"))
        now = large.join(dense, "node", "left_anti").select("node", "cid", "sig").mapInArrow(_branches, "node long, cid long, up long")
        level += 1
    return nodes, deep


def _all(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    return found


def _values(docs: DataFrame, classes: DataFrame, sets: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(cid, n, whole, sketch) of the classes in nodes, from the texts of their rows."""
    wanted = classes.join(nodes.select("cid").distinct(), "cid", "left_semi").select("cid", "digest", F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    wanted = scratch.save(wanted, "wanted")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.join(wanted.where("i >= -9223372036854775808"), (F.col("doc_id") == F.col("i")) & (F.xxhash64("text") == F.col("h"))).select("cid", "digest", "text")
    nameless = not wanted.where("i is null").isEmpty()
    if nameless:
        got = got.unionByName(text.where("doc_id is null").join(wanted.where("i is null"), F.xxhash64("text") == F.col("h")).select("cid", "digest", "text"))
    got = got.mapInArrow(lambda b: trimmed(_whole_sets(b, words), _forget), "cid long, n long, whole binary, sketch binary")
    if nameless or not sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        got = got.dropDuplicates(["cid"])  # rows that repeat a doc_id and text
    # Where the ids are too many to broadcast, Spark drops most other texts before it deals them out, by a Bloom filter of
    # bounded size over the ids. Its rule looks for a comparison on the side that makes the filter, and of itself leaves tables under 10 GB alone.
    with held(docs.sparkSession, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}):
        return scratch.save(got, "values")


def _proposed(rows: DataFrame, values: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """Written pairs (a, b, node, dense) of nodes (node, cid, comp)."""
    met = rows.join(values.select("cid", "sketch"), "cid").select("node", "cid", "comp", "sketch").repartition("node").sortWithinPartitions("node", "cid")
    most = PAIRS
    return scratch.save(met.mapInArrow(lambda b: trimmed(_compare(b, turn, most)), "a long, b long, node long, dense boolean"), f"pairs-{turn}")


def _resolved(dense: DataFrame, comps: DataFrame, values: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Written links (a, b) of nodes (node, cid) by their full sets, in parts: any two of a node's sets are in one of its parts."""
    weight = dense.join(values.select("cid", "n"), "cid").groupBy("node").agg(F.ceil(F.sum("n") * 16 / WEIGHT).alias("many"))
    weight = scratch.save(weight, "weights")
    own = F.pmod(F.xxhash64("cid", F.lit(78)), F.col("many"))
    part = dense.join(weight, "node").select("node", "cid", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("j"))
    part = part.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "cid")
    rows = part.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("node", "cid", F.coalesce("component", "cid").alias("comp"))
    rows = rows.join(values.select("cid", "sketch", "whole"), "cid").select("node", "cid", "comp", "sketch", "whole").repartition("node").sortWithinPartitions("node", "cid")
    return scratch.save(rows.mapInArrow(lambda b: trimmed(_resolve(b, percent)), "a long, b long"), "resolved")


def classes_of(docs: DataFrame, scratch: Scratch, words: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Written tables: (row_id, doc_id, text_hash, n_shingles, digest, sig) by row of docs, and (digest, component_id, first_row) by distinct
    set that several rows have or that is linked."""
    bounded(docs.sparkSession)
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.select("row_id", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sets = scratch.save(read.mapInArrow(lambda b: trimmed(_sets(b, words), _forget), "row_id long, doc_id long, text_hash long, n_shingles long, digest binary, sig binary"), "sets")

    # One class for each distinct set, named by its first row: that with the smallest doc_id, which gives the text when the set is needed again.
    classes = sets.where("n_shingles > 0").groupBy("digest").agg(F.first("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id", "text_hash")).alias("of"), F.count("*").alias("rows"))
    classes = scratch.save(classes.select(F.col("of.row_id").alias("cid"), "digest", "sig", "of.doc_id", "of.text_hash", "rows"), "classes")

    nodes, deep = _nodes_of(classes.select("cid", "sig"), scratch)
    if deep:
        large = _all(deep)
        nodes.append(scratch.save(_blocks(large), "blocks"))
    values = _values(docs, classes, sets, _all(nodes), words, scratch)
    first = _proposed(_all(nodes).select("node", "cid", F.col("cid").alias("comp")), values, 0, scratch)
    tried = scratch.save(_tried(first.select("a", "b").distinct(), values, percent), "tried-0")
    good = tried.where("linked").select("a", "b")
    comps = components(good, scratch, "components-0")

    # A node is done if all that it proposed holds. The others' sets, and those outside of a large node's main component, once more.
    again = scratch.save(first.join(tried.where("not linked"), ["a", "b"], "left_semi").select("node").distinct(), "again")
    rows = _all(nodes).join(again, "node", "left_semi")
    if deep:
        rows = rows.unionByName(_outside(large, comps, scratch))
    if deep or not again.isEmpty():
        labelled = rows.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("node", "cid", F.coalesce("component", "cid").alias("comp"))
        second = _proposed(labelled, values, 1, scratch)
        fresh = second.where("not dense").select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        links = scratch.save(_tried(fresh, values, percent), "tried-1").where("linked").select("a", "b")
        dense = second.where("dense").select("node", F.col("a").alias("cid"))
        if not dense.isEmpty():
            links = links.unionByName(_resolved(dense, comps, values, percent, scratch))
        if not links.isEmpty():
            comps = components(links.unionByName(comps.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch, "components-1")

    member = classes.join(comps, F.col("cid") == F.col("id")).select("component", "digest", "doc_id", "cid")
    best = member.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cid"))["cid"].alias("first_row"))
    told = member.join(best, "component").select("digest", "component_id", "first_row")
    alone = classes.where("rows > 1").join(comps, F.col("cid") == F.col("id"), "left_anti").select("digest", F.col("doc_id").alias("component_id"), F.col("cid").alias("first_row"))
    return sets.drop("sig"), scratch.save(told.unionByName(alone), "told")


def link(docs: DataFrame, words: int = 4, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept, stays, text_hash.

    Sets of word shingles (see shingles) of similarity percent / 100 or more are linked; component_id is the smallest doc_id
    reachable. Texts that are null, or have no words, have the empty set and their own doc_id. Rows without a doc_id take part
    and get the component's id, null where no row of it has one. kept is doc_id = component_id; stays marks one row of each
    component, the first of those kept where rows are repeated. Sketches that tie go by the smaller id of a set; repeated rows are one
    set and have a row each. An empty table gives no rows. Other columns of docs, whatever their names, are not read; very long texts
    count whole. Shingles are compared by 64-bit hashes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    sets, told = classes_of(docs, scratch, words, percent)
    scratch.keep("sets", "told")
    # Rows without a set stay apart, so that a join doesn't gather them.
    rows = sets.where("digest is not null").join(told, "digest", "left")
    rows = rows.unionByName(sets.where("digest is null").withColumns({"component_id": F.lit(None).cast("long"), "first_row": F.lit(None).cast("long")}))
    stays = F.col("row_id") == F.coalesce("first_row", "row_id")
    own = F.when(F.col("first_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", "n_shingles", own.alias("component_id"), stays.alias("stays"), "text_hash")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays")).alias("kept"), "stays", "text_hash")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stays for each component, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "near")
    decided = scratch.save(link(docs, words, percent, scratch).select("doc_id", F.col("text_hash").cast("string").alias("text_key"), F.col("stays").alias("kept")), "decided")
    return without(docs, decided, scratch, F.xxhash64(F.col("text").cast("string")).cast("string"))
