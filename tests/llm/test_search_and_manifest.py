"""Hard negatives, exact top-k and the Merkle manifest against brute force and on edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.llm import bond, kdtree, merkle
from claimsieve.llm import vectors as V

KIND = "vec_id long, embedding array<float>, label int, score int, row string"
inf, nan = float("inf"), float("nan")


def scaled(rows, scale):
    """Usable rows: (id, integer vector, label)."""
    out = []
    for vec_id, e, label, *_ in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            out.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in e], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order_key(x):
    return (-x[0], x[1] is None, x[1] or 0)


def odd_rows(n=330, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)], int(rng.integers(4)), 7, "x") for i in range(n)]
    rows += [(100, rows[100][1], rows[100][2], 7, "x"), (100, rows[7][1], 1, 7, "x")]  # a repeated row, a repeated id
    rows += [(None, rows[3][1], 2, 7, "x"), (400, None, 1, 7, "x"), (500, [], 1, 7, "x"), (600, [1.0, None] + [0.0] * 4, 1, 7, "x")]
    rows += [(700, [inf] * dim, 1, 7, "x"), (800, [nan] * dim, 1, 7, "x"), (900, rows[0][1], None, 7, "x"), (1000, [0.5, 0.25], 3, 7, "x")]
    rows += [(2000 + i, rows[11][1], 1 + i % 2, 7, "x") for i in range(150)]  # copies
    return rows


def brute_top(rows, k, scale=1024):
    use = scaled(rows, scale)
    out = []
    for i, (q, v, _) in enumerate(use):
        if q is not None and q % 100 == 0:
            all_ = sorted([(dot(v, w), c) for j, (c, w, _) in enumerate(use) if j != i], key=order_key)[:k]
            out += [(q, r + 1, c, s) for r, (s, c) in enumerate(all_)]
    return sorted(out, key=str)


def brute_negatives(rows, positives=5, negatives=10, scale=256):
    use = [x for x in scaled(rows, scale) if x[2] is not None]
    out = []
    for i, (a, v, label) in enumerate(use):
        if a is None or a % 100:
            continue
        others = sorted([(dot(v, w), c, b) for j, (c, w, b) in enumerate(use) if j != i], key=order_key)
        for p, c, _ in [x for x in others if x[2] == label][:positives]:
            fits = [x for x in others if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(a, c, r + 1, x[1], p, x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 64)
    monkeypatch.setattr(V.blocks, "__defaults__", (64,))


@pytest.mark.parametrize("block", [V.BLOCK_QUERIES, 4])
def test_top_k_equals_brute_force(spark, small_shards, block):
    rows = odd_rows()
    out = kdtree.top_k(spark.createDataFrame(rows, KIND).repartition(3), block=block)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got(out) == brute_top(rows, 10)


def test_trees_pass_over_far_boxes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 3)) * 1000
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 3))).astype(np.int64)
    ids = np.arange(4000)
    tree = kdtree.Tree.build(points, ids, ids)
    again = kdtree.Tree.unpack(*tree.pack())
    assert all((getattr(tree, c) == getattr(again, c)).all() for c in ("points", "ids", "rows", "nodes", "lo", "hi"))
    leaves = int((tree.nodes[:, 2] == 0).sum())
    found = V.Found(20, 5)
    read = kdtree.search_tree(again, points[::200], ids[::200], [None] * 20, found)
    assert read < 20 * leaves / 4
    for q, at in enumerate(ids[::200]):
        want = sorted([(-int(points[at] @ points[i]), i) for i in ids if i != at])[:5]
        assert list(zip((-found.score[q]).tolist(), found.id[q].tolist())) == want


def test_tree_of_equal_vectors_returns_smallest_ids():
    points = np.ones((1000, 4), dtype=np.int64)
    ids = np.random.default_rng(2).permutation(1000)
    found = V.Found(1, 3)
    read = kdtree.search_tree(kdtree.Tree.build(points, ids, ids), points[:1], np.array([0]), [None], found)
    assert found.id[0].tolist() == [1, 2, 3] and read <= 2


@pytest.mark.parametrize("block", [V.BLOCK_QUERIES, 4])
def test_hard_negatives_equal_brute_force(spark, small_shards, block):
    rows = odd_rows(seed=5)
    out = bond.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), F.col("label"), block=block)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert want and got(out) == want


def test_vertical_scan_reads_less_and_loses_nothing():
    rng = np.random.default_rng(6)
    points = np.floor(rng.normal(size=(3000, 32)) * np.geomspace(400, 2, 32)).astype(np.int64)
    ids = np.arange(3000)
    shard, queries = bond.Shard.unpack(*bond.Shard(points.T, ids, ids, ids % 3).pack()).ready(points[:5])
    for q in queries:
        exact = points @ q.astype(np.int64)
        top = int(exact.max())
        windows = [(top * 3 // 10, top * 9 // 10), (top * 2 // 10, top // 2)]
        at, score, read = bond.vertical_scan(shard, q, ids, windows, 10)
        assert read < points.size * 3 // 4 and (score == exact[at]).all()
        for lo, hi in windows:
            want = sorted([-s for s in exact.tolist() if lo <= s <= hi])[:10]
            assert sorted([-s for s in score.tolist() if lo <= s <= hi])[:10] == want


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [1e5 + i, -3e3 * i], 1, 0, "x") for i in range(120)]
    df = spark.createDataFrame(rows, KIND.replace("float", "double"))
    use = [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows]
    want = sorted([(-dot(use[100][1], v), c) for c, v in use if c != 100])[:10]
    assert [(r["vec_id"], r["score"]) for r in kdtree.top_k(df).filter("query_id = 100").orderBy("rank").collect()] == [(c, -s) for s, c in want]
    with pytest.raises(ValueError):
        V.exact_kind(np.array([[2**40]]), np.array([[2**40]]))


def test_no_vectors_no_queries(spark):
    empty = spark.createDataFrame([], KIND)
    one = spark.createDataFrame([(100, [1.0], 1, 0, "x")], KIND)
    odd = spark.createDataFrame([(101, [1.0], 1, 0, "x"), (102, [], None, 0, "x")], KIND)
    for df in (empty, one, odd):
        assert kdtree.top_k(df).count() == 0 and bond.hard_negatives(df, F.col("label")).count() == 0


# 13 manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, run string, n string, node string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows, fanout):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: sha("".join(map(code, (d, s, la, n, t))))

    def climb(nodes):
        """Top and, for every node, (before, after) by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                lo = p // fanout * fanout
                paths[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + fanout])))
            nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
            at = [p // fanout for p in at]
        return nodes[0], paths

    runs = {}
    for d, t, la, s, n, *_ in rows:
        told = n + 1 if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0 else n
        runs.setdefault(la, []).append((d is not None, d or 0, leaf(d, t, la, s, n), leaf(d, t, la, s, told)))
    langs = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    built = [climb([x[2] for x in sorted(runs[la])]) for la in langs]
    root, above = climb([b[0] for b in built])
    out = []
    for la, (sub, paths), up in zip(langs, built, above):
        for (named, d, h, told), path in zip(sorted(runs[la]), paths):
            fold = told
            for a, b in path + up:
                fold = sha(a + fold + b)
            out.append((d if named else None, h, sub, root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return sorted(out, key=str)


def manifest_of(df, **kw):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claimed = [*cols[:3], F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")), cols[4]]
    return merkle.manifest(df, F.col("lang"), "doc_id", cols, claimed, **kw)


@pytest.mark.parametrize("fanout,height", [(2, 10), (2, 2), (3, 2)])
def test_manifest_equals_brute_force(spark, fanout, height):
    rows = [(i, f"text {i} é", "en" if i % 3 else "dé", "s", i, "r", "n", "x") for i in range(70)]
    rows += [(500, "alone", "zz", None, None, "r", "n", "x"), (501, None, None, "s", None, "r", "n", "x"), (502, "", None, "", 0, "r", "n", "x"), (502, "", "", "", 0, "r", "n", "x")]
    rows += [(None, "a", "en", "s", 1, "r", "n", "x"), (None, "b", "en", "s", 1, "r", "n", "x"), (7, "again", "en", "s", 1, "r", "n", "x"), (8, "l" * 300_000, "en", "s", 1, "r", "n", "x")]
    rows += [(9, "same", "en", "s", 1, "r", "n", "x")] * 5
    out = got(manifest_of(spark.createDataFrame(rows, DOCS).repartition(4), fanout=fanout, height=height))
    assert out == brute_manifest(rows, fanout)
    assert any(not r[-1] for r in out) and any(r[-1] for r in out)


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)).count() == 0
    one = manifest_of(spark.createDataFrame([(1, "a", "en", "s", 1, "", "", "")], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")

