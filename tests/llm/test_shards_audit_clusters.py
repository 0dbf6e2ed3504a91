"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import clustering, filter_audit, sharding
from codeloom.llm.scratch import Scratch, shared_dir
from tests.llm.test_operators import ODD, docs_of, prose


# 11 sharding


def key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def plain_shards(rows, n, slack):
    """Shards of (doc_id, text) rows, by one sorted list."""
    rows = sorted(rows, key=lambda r: (key(r[1]), -(1 << 63) if r[0] is None else r[0]))
    size = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, own = sum(size), 0, []
    for s in size:
        own.append(min(n - 1, (2 * before + s) * n // (2 * total)))
        before += s
    at = 0
    for k, same in itertools.groupby(range(len(rows)), key=lambda i: key(rows[i][1])):
        same = list(same)
        weight = sum(size[i] for i in same)
        if own[same[0]] != own[same[-1]] and weight * n <= slack * total:
            home = (2 * at + weight) * n // (2 * total)
            for i in same:
                own[i] = home
        at += weight
    seen = Counter()
    out = []
    for (i, t), s, o in zip(rows, size, own):
        out.append((i, s, zlib.crc32((t or "").encode()), o, seen[o]))
        seen[o] += 1
    return sorted(out, key=str)


def told(df):
    rows = df.collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows), key=str)


def many(seed=3):
    """Short and long texts, nulls, a text that a third of the rows have, ids that repeat or are missing."""
    rng = random.Random(seed)
    texts = [*ODD, *(prose(k, rng.choice([1, 5, 40, 200])) for k in range(250)), *["a hot text"] * 140, *["warm"] * 9]
    return [(None if rng.random() < 0.05 else rng.randrange(300), t) for t in texts]


@pytest.mark.parametrize("most,fan,slack", [(10_000, 64, 0.01), (20, 4, 0.01), (5, 8, 0.2), (40, 3, 0.0)])
def test_shards_equal_one_sorted_list(spark, most, fan, slack):
    rows = many()
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnsRenamed({"component": "shard", "h": "key", "sig": "range"})
    assert told(sharding.shard(docs, most=most, fan=fan, slack=slack)) == plain_shards(rows, 16, slack)


def test_ranges_are_bounded_and_in_order(spark):
    rows = many(5)
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    found, level = sharding.ranged(sharding.facts(docs), Scratch(spark, "test"), most=15, fan=4)
    got = sorted((r.key, r.doc, r.row, r.range) for r in found.collect())
    assert level > 1 and [r[3] for r in got] == sorted(r[3] for r in got)
    assert max(Counter(r[3] for r in got).values()) <= 15
    # Only the text that very many rows have is cut inside.
    cut = {k for k, some in itertools.groupby(got, key=lambda r: r[0]) if len({r[3] for r in some}) > 1}
    assert key("a hot text") in cut and len(cut) <= 3


def test_shards_are_near_equal_and_hold_copies(spark):
    rows = [(k, prose(k // 2, 60)) for k in range(4_000)]
    got = told(sharding.shard(docs_of(spark, [t for _, t in rows]), most=100, fan=8))
    size = Counter()
    for _, s, _, shard, _ in got:
        size[shard] += s
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 4 * max(s for _, s, *_ in got)
    homes = defaultdict(set)
    for i, _, _, shard, _ in got:
        homes[i // 2].add(shard)
    assert all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("texts", [[], [None], ["x", "x"], ["", None, "one row that outweighs all others " * 50]])
def test_few_rows_in_shards(spark, texts):
    assert told(sharding.shard(docs_of(spark, texts))) == (plain_shards(list(enumerate(texts)), 16, 0.01) if texts else [])


def test_written_shards_hold_the_rows(spark):
    rows = many(9)
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, folder, shards=5, files=2)
    back = spark.read.parquet(folder)
    assert back.columns == [*docs.columns, "_shard"]
    want = Counter((i, s, o) for i, s, _, o, _ in plain_shards(rows, 5, 0.01))
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, r._shard) for r in back.collect()) == want


# 12 filter audit


def plain_audit(rows, labels):
    """All orders, filter by filter, over lists of (doc_id, text, source) and (doc_id, quality, toxic)."""
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    parts = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i,
        }
        parts[source or ""].append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        steps, sums = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[0][f]]
                redundant = sum(d[0][f] for d in gone)
                left, gone = [d for d in left if not d[0][f]], gone + removed
                sums[f] += len(removed)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                steps.append((part, "".join(order), step, len(left), len(removed), redundant, alone, sum(d[1] for d in removed), sum(d[2] for d in removed)))
        out += [(*s, sums[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_equals_filtering_in_every_order(spark, monkeypatch):
    rng = random.Random(4)
    texts = [*ODD, *(rng.choice([prose(k, rng.choice([20, 250])), prose(0, 3) + " " + prose(k, 220), "A LOUD text " * rng.choice([3, 90]), "hot copy", f"costs $ {k}"]) for k in range(160))]
    rows = [(None if rng.random() < 0.1 else rng.randrange(120), t, rng.choice(["a", "b", "", None, "ü&"])) for t in texts]
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, source string, part int, bits string, key string")
    told_ = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    want = plain_audit(rows, labels)
    assert sorted(tuple(r) for r in filter_audit.audit(docs, told_).collect()) == want and len(want) == 4 * 600
    # In small batches, counts given out again and again.
    monkeypatch.setattr(filter_audit, "ROWS", 7)
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    import pyarrow as pa

    bits = [(p, rng.randrange(128)) for p in rng.choices("abc", k=100)]
    batches = [pa.RecordBatch.from_pylist([{"part": p, "flags": f} for p, f in bits[k : k + 6]], schema=pa.schema([("part", pa.string()), ("flags", pa.int32())])) for k in range(0, 100, 6)]
    got = Counter()
    for b in filter_audit._index(iter(batches)):
        for r in b.to_pylist():
            got[r["part"], r["first"], r["nth"]] += np.array([r[c] for c in filter_audit.COUNTS])
    for (part, first, nth), counts in got.items():
        mine = [f for p, f in bits if p == part]
        hit = [f for f in mine if f >> nth & 1]
        removed = [f for f in hit if not f & first]
        assert counts.tolist() == [len(removed), len(hit) - len(removed), sum(f >> 5 & 1 for f in removed), sum(f >> 6 & 1 for f in removed), sum(not f & (first | 1 << nth) for f in mine)]
    assert len(got) == 3 * 80


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], none.schema)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)


# 13 clustering


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for k in range(len(c)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    by = Counter()
    for d, k in own:
        by[k] += d
    return sorted(((i, k, d, by[k], sum(by.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, own)), key=str)


def vectors(seed=1, n=300):
    rng = np.random.default_rng(seed)
    some = np.round(rng.normal(size=(12, 64))[rng.integers(0, 12, n)] + rng.normal(scale=0.2, size=(n, 64)), 2)
    rows = [(int(k), v.tolist()) for k, v in enumerate(some)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), *((1_000 + k, rows[5][1]) for k in range(150))]
    rows += [(2_000, None), (2_001, []), (2_002, [1.0] * 63), (2_003, [1.0] * 63 + [None]), (2_004, [float("nan")] * 64), (2_005, [float("inf")] * 64), (2_006, [0.0] * 64), (2_007, [-0.001] * 64)]
    return rows


@pytest.mark.parametrize("seed,rows", [(1, 4_096), (2, 50), (3, 7)])
def test_clusters_equal_all_distances(spark, seed, rows):
    data = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, n string").repartition(3)
    got = clustering.cluster(df, rows=rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(data)


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], kind)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, None), (2, [1.0])], kind)).count() == 0
    data = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [2.0] * 64)]
    assert sorted((tuple(r) for r in clustering.cluster(spark.createDataFrame(data, kind)).collect()), key=str) == plain_clusters(data)
    far = clustering.cluster(spark.createDataFrame([(1, [2.0**20] * 64), (2, [-(2.0**20)] * 64), (3, [1e30] * 64)], kind)).collect()
    assert sorted((r.vec_id, r.distance) for r in far) == [(1, 0), (2, 0)]


def test_nodes_are_settled_rightly():
    """Whole nodes and leaves together give each vector the nearest centroid; ties the smaller number; near groups settle whole nodes."""
    rng = np.random.default_rng(6)
    for case in range(60):
        near = case % 2
        middle = rng.integers(-400, 400, (5, 64))
        v = (middle[rng.integers(0, 5, 200)] + rng.integers(-3, 4, (200, 64))) if near else rng.integers(-2, 3, (200, 64))
        c = np.concatenate([middle, middle[:2] + 1, middle[:1]]) if near else rng.integers(-1, 2, (9, 64))
        tree, order = clustering.grown(v.astype(np.int64), leaf=8)
        assert (tree.vectors == v[order]).all() and (tree.sums[0] == v.sum(axis=0)).all()
        want = ((v[order][:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        whole, places, nearest = clustering.walked(tree, c.astype(np.int64))
        own = np.full(200, -1)
        own[places] = nearest
        for node, k in whole:
            s, e = tree.nodes[node, :2]
            assert (own[s:e] == -1).all() and (tree.sums[node] == tree.vectors[s:e].sum(axis=0)).all()
            own[s:e] = k
        assert (own == want).all()
        assert not near or whole


def test_dominated_centroids_win_at_no_vector():
    rng = np.random.default_rng(8)
    for _ in range(50):
        low = rng.integers(-5, 5, (1, 3))
        high = low + rng.integers(0, 4, (1, 3))
        c = rng.integers(-8, 8, (6, 3))
        best = np.array([rng.integers(0, 6)])
        out = clustering.dominated(low, high, c, np.ones((1, 6), bool), best)[0]
        points = np.array(list(itertools.product(*(range(a, b + 1) for a, b in zip(low[0], high[0])))))
        winners = set(((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist())
        assert not winners & set(np.flatnonzero(out).tolist()) and not out[best[0]]
