"""Exact Jaccard self-join on word shingles by prefix filters under several global token orders.

If two sets are similar enough, they share a token among the first ``n - ceil(t n) + 1`` tokens of each, whatever total
order the tokens are put in; with ``l`` more tokens they share ``l + 1``.  So the filters of different orders can be
intersected and no link is lost.

1. One scan gives every document its set size, a 128-bit digest of its set and the first quarter or so of its tokens in
   hash order.  Equal sets become one class.  A class stays if enough of those tokens are shared with another class; of
   a usual corpus only near copies and their like remain.
2. For the classes that stay, tokens are counted.  Every order puts the tokens of a single class first; then come rising
   counts (first order) or one of two hashes.  A class whose prefix has single tokens only has no link.
3. The first order's prefix tokens are the buckets, and a token's position in it bounds the overlap.  Small buckets give
   all their pairs.  A large bucket gives the pairs with one pivot, the class with the fewest single tokens; then only
   pairs between different components are left.  Rows outside the bucket's main component become pivots in turns, each
   turn with eight times as many as the one before, and what a turn links is not listed again; so a group of thousands
   of near copies costs a few times its size, not its square.  Unlike rows of one bucket all meet in the end, but only
   those of like size, in blocks that many tasks share.
4. A pair goes on if its sizes and positions fit and the prefixes of the second and third orders meet too; then the
   exact overlap decides.

Shingles are compared by 64-bit hashes.  Only counts reach the driver.

Defined results: null or empty text and text of white space has an empty set and no link; fewer words than the shingle
length are one shingle; equal rows are one class; null ids are kept and never chosen as a component's id unless all its
ids are null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from hashlib import blake2b
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.llm.graph import components
from claimsieve.llm.words import SPACED, Scan, bounded_batches, chunks, encoded, gram_hashes
from claimsieve.session import materialize

SMALL_BUCKET = 16
LOOSE = 10  # a tenth of a set is added to the prefix of the first step
LINEAR = 8  # pivots of the first turn, and how many times more each further turn has
BLOCK = 1024  # rows and pivots of a hot bucket that meet in one task
FILTER_BITS = 1 << 25  # 4 MB, sent to every task
FEW_PAIRS = 50_000
FEW_ENDS = 200_000  # pairs whose ends are sent to every task


def _token_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for lo, hi in chunks(texts):
        scan = Scan(texts[lo:hi], SPACED, lower=True)
        words = scan.hashes()
        for a, b in zip(scan.first[:-1], scan.first[1:]):
            yield np.unique(gram_hashes(words[a:b], min(k, max(b - a, 1))))


def _least_overlap(n, percent: int):
    return -(-n * percent // 100)


def _scan(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n, d1, d2, need, first``: the class digest, and the hash-order prefix with the share of it that must be shared."""
    names = ["doc_id", "n", "d1", "d2", "need", "first"]
    long = T.LongType()
    kinds = [docs.schema["doc_id"].dataType, long, long, long, long, T.ArrayType(long)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            prefixes, at = [], [0]
            for tokens in _token_sets(encoded(batch.column(1)), k):
                n = len(tokens)
                d1, d2 = np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist() if n else (None, None)
                prefix = tokens[: n - _least_overlap(n, percent) + max(1, n // LOOSE)] if n else tokens
                for column, value in zip(rows, (n, d1, d2, max(1, _least_overlap(n, percent) // LOOSE))):
                    column.append(value)
                prefixes.append(prefix)
                at.append(at[-1] + len(prefix))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in rows], lists], names)

    schema = T.StructType([T.StructField(a, b) for a, b in zip(names, kinds)])
    return docs.select("doc_id", F.col("text").cast("string").alias("_t")).mapInArrow(read, schema)


def _bitmap(ids: DataFrame, column: str) -> dict[int, bytes]:
    """Set bits at the hashes of a column, in pages of 32,768 bits; at most ``FILTER_BITS`` bits reach the driver."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1  # positions are counted from 1
    pages = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    return {r["page"]: bytes(r["bits"]) for r in pages.collect()}


def _full_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """``d1, d2, n, tokens`` of the rows whose ``doc_id`` is wanted, and of few others.

    A bounded bitmap of the wanted ids lets the scan pass over the other texts, so that no text is shuffled; where the
    ids are too many for it, the texts are joined with them instead."""
    names = ["d1", "d2", "n", "tokens"]
    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("_b"), "doc_id", F.col("text").cast("string").alias("text"))
    bits: dict[int, bytes] = {}
    if wanted.count() <= FILTER_BITS // 8:
        bits = _bitmap(wanted, "_w")
    else:
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = {p: np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little") for p, b in sent.value.items()}
        for batch in batches:
            if pages:
                at = batch.column(0).to_numpy()
                keep = np.zeros(len(at), dtype=bool)
                for page in np.unique(at // 32768):
                    if page + 1 in pages:
                        own = at // 32768 == page
                        keep[own] = pages[page + 1][at[own] % 32768] == 1
                batch = batch.filter(pa.array(keep))
            columns: list[list] = [[] for _ in names]
            for tokens in _token_sets(encoded(batch.column(1)), k):
                if len(tokens):
                    d = np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
                    for column, value in zip(columns, [*d, len(tokens), tokens.view(np.int64)]):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))], names)

    return texts.select("_b", "text").mapInArrow(read, "d1 bigint, d2 bigint, n bigint, tokens array<bigint>")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, single, common, p0, p1, p2``: how many tokens no other class has, the others, and those of them that are
    in each prefix."""
    each = sets.select("node", F.explode("tokens").alias("token"))
    # counts and heads are written, so both sides of their joins are plain shuffles and a hot token's rows can be divided
    shared = materialize(each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    own = each.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))  # at most one set
    own = own.join(sets.select("node", "n"), "node")
    tokens = F.col("s.token")
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    own = own.withColumn("single", F.col("n") - F.size("s")).withColumn("take", (size - F.col("single")).cast("int")).filter("take > 0")

    def by_hash(seed: int) -> F.Column:
        keyed = F.sort_array(F.transform(tokens, lambda t: F.struct(F.xxhash64(t, F.lit(seed)).alias("h"), t.alias("t"))))
        return F.transform(F.slice(keyed, F.lit(1), F.col("take")), lambda x: x["t"])

    return own.select("node", "n", "single", tokens.alias("common"), F.slice(tokens, F.lit(1), F.col("take")).alias("p0"), by_hash(1).alias("p1"), by_hash(2).alias("p2"))


def _ordered(x: F.Column, y: F.Column) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _may_link(n: F.Column, at: F.Column, m: F.Column, to: F.Column, percent: int) -> F.Column:
    """Sizes ``n`` and ``m`` with a first common token at positions ``at`` and ``to`` leave room for the wanted overlap."""
    most = F.least(n - at, m - to)
    return most * 100 >= (n + m - most) * percent


def _turn(node: str) -> F.Column:
    """A fixed number from 0 to 1 that says when a row becomes a pivot."""
    return F.pmod(F.xxhash64(node, F.lit(0)), F.lit(1 << 30)) / (1 << 30)


def _share(turn: int) -> F.Column:
    """The part of a bucket of ``m`` rows that has been asked before this turn: about 0, 8, 64, 512 rows, at last all."""
    return F.least(F.lit(1.0), F.lit(float(LINEAR**turn)) / F.col("m")) if turn else F.lit(0.0)


def _meet(placed: DataFrame, pivots: DataFrame, part: F.Column, percent: int) -> DataFrame:
    """``a, b``: pivots with the rows of their bucket that have another root and a fitting size and position.

    Rows meet by size band, so unlike sizes are never listed, and the rows and pivots of a hot bucket are dealt over a
    grid of blocks: a task lists about ``BLOCK`` by ``BLOCK`` pairs and a row is sent once for each block across."""
    width = math.log(100 / percent) * 1.001 if percent < 100 else 0.5  # wider than the ratio, so rounding loses no pair
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    down, across = F.ceil(F.col("m") / BLOCK), F.ceil(F.greatest(F.lit(1.0), F.col("m") * part) / BLOCK)

    def blocks(count: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    rows = placed.select("token", "node", "n", "at", "root", band.alias("band"), F.pmod(F.xxhash64("node", F.lit(1)), down).alias("i"), blocks(across).alias("j"))
    asks = pivots.select("token", F.struct("node", "n", "at", "root").alias("x"), band.alias("band"), down.alias("down"), F.pmod(F.xxhash64("node", F.lit(2)), across).alias("j"))
    asks = asks.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumn("i", blocks(F.col("down"))).drop("down")
    met = rows.join(asks, ["token", "band", "i", "j"])
    fits = (F.col("root") != F.col("x.root")) & _may_link(F.col("n"), F.col("at"), F.col("x.n"), F.col("x.at"), percent)
    return met.filter(fits).select(*_ordered(F.col("x.node"), F.col("node")))


def _named(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` of the nodes that pairs name, so that a turn of few pairs shuffles few sets; all rows if the pairs are many."""
    if pairs.count() > FEW_ENDS:
        return rows
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return rows.join(F.broadcast(ends), "node", "left_semi")


def _verify(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs, as written, that pass the other orders' filters and then the exact test."""
    narrow = _named(prefixes.select("node", "n", "p1", "p2"), pairs)
    left = narrow.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    right = narrow.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    kept = pairs.join(left, "a").join(right, "b").filter(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b", "na", "nb")
    kept = materialize(kept, "candidates")
    near = F.broadcast(kept) if kept.count() <= FEW_PAIRS else kept  # four numbers each
    full = _named(prefixes.select("node", "common"), kept)
    both = near.join(full.select(F.col("node").alias("a"), F.col("common").alias("ta")), "a").join(full.select(F.col("node").alias("b"), F.col("common").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "na", "nb", common.alias("common")).filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def _staying(docs: DataFrame, scanned: DataFrame, k: int) -> DataFrame:
    """``node, d1, d2, n, tokens`` of the classes with enough shared tokens in their hash-order prefix."""
    tokens = scanned.filter("n > 0").select(F.explode("first").alias("token"), "d1").groupBy("token").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    alone = tokens.filter("lo = hi").groupBy(F.col("lo").alias("d1")).agg(F.count("*").alias("alone"))
    classes = scanned.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first(F.size("first")).alias("size"), F.first("need").alias("need"))
    staying = classes.join(alone, "d1", "left").filter(F.col("size") - F.coalesce("alone", F.lit(0)) >= F.col("need"))
    staying = materialize(staying.select("doc_id", "d1", "d2"), "staying")
    wanted = staying.select(F.col("doc_id").alias("_w")).distinct()
    sets = _full_sets(docs, k, wanted).join(staying.select("d1", "d2"), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    return materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def similar_classes(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, classes, links)``: the class digest of every row, the classes with links and the ``root`` of their
    component, and links between nodes.  Links within a large group are enough to connect it; not every pair is listed."""
    bounded_batches(docs.sparkSession)
    scanned = materialize(_scan(docs, k, percent), "scanned")
    sets = _staying(docs, scanned, k)
    prefixes = materialize(_prefixes(sets, percent), "prefixes")

    index = prefixes.select("node", "n", "single", F.posexplode("p0").alias("at", "token")).withColumn("at", F.col("single") + F.col("at"))
    pivot = F.min(F.struct("single", F.xxhash64("node").alias("h"), "node", "n", "at"))
    heads = index.groupBy("token").agg(F.count("*").alias("m"), pivot.alias("pivot")).filter("m > 1")
    heads = materialize(heads, "heads")
    index = materialize(index.drop("single").join(heads, "token"), "index")
    entry = F.struct("node", "n", "at")
    few = index.filter(F.col("m") <= SMALL_BUCKET).groupBy("token").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    few = few.select("e", F.posexplode("e").alias("i", "x")).select("x", F.explode(F.slice("e", F.col("i") + 2, SMALL_BUCKET)).alias("y"))
    few = few.filter(_may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = index.filter(F.col("m") > SMALL_BUCKET)
    stars = many.filter(F.col("node") != F.col("pivot.node")).filter(_may_link(F.col("n"), F.col("at"), F.col("pivot.n"), F.col("pivot.at"), percent))
    done = materialize(few.union(stars.select(*_ordered(F.col("pivot.node"), F.col("node")))).distinct(), "pairs")
    links = materialize(_verify(done, prefixes, percent), "links")

    many = materialize(many.select("token", "m", "node", "n", "at"), "large")
    rows, roots, turn = many.count(), components(links), 0
    if rows:
        parts = many.join(roots, "node", "left").groupBy("token", F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("c"))
        mains = materialize(parts.groupBy("token").agg(F.max(F.struct("c", "root"))["root"].alias("main")), "mains")
    while rows:
        # a row of the main component stays in it, so each pair of other rows is asked about by the first of them whose turn comes
        now = mains.join(roots.select(F.col("node").alias("main"), F.col("root").alias("now")), "main", "left").select("token", F.coalesce("now", "main").alias("main"))
        placed = many.join(now, "token").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = placed.withColumn("waits", (F.col("root") != F.col("main")) & (_turn("node") >= _share(turn)))
        placed = materialize(placed, "placed")  # read several times below, so the joins above are done once
        waiting = placed.filter("waits")
        weight = waiting.agg(F.sum("m")).first()[0] or 0
        if not weight:
            break
        until = F.lit(1.0) if weight <= LINEAR * rows else _share(turn + 1)
        met = _meet(placed, waiting.filter(_turn("node") < until), until - _share(turn), percent)
        fresh = materialize(met.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        more = materialize(_verify(fresh, prefixes, percent), "links")
        done = done.union(fresh)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
        if weight <= LINEAR * rows:
            break
        mains = materialize(mains.join(waiting.select("token").distinct(), "token", "left_semi"), "mains")  # of buckets in which a row waits
        many, turn = placed.select("token", "m", "node", "n", "at"), turn + 1
    classes = sets.select("node", "d1", "d2", "n").join(roots, "node").select("d1", "d2", "root")
    return scanned.select("doc_id", "n", "d1", "d2"), classes, links


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; linked documents share the smallest ``doc_id`` that links reach."""
    members, classes, _ = similar_classes(docs, k, percent)
    least = members.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    least = materialize(least.join(classes, ["d1", "d2"], "left"), "least")
    joint = least.filter("root is not null").groupBy("root").agg(F.min("least").alias("joint"))
    named = least.join(joint, "root", "left").select("d1", "d2", F.coalesce("joint", "least").alias("component_id"))
    empty = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return members.filter("n > 0").join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def _with_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the size ``_n`` and the digest ``_d1, _d2`` of every row's set."""
    long = T.LongType()
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, long) for c in ("_n", "_d1", "_d2")]])
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(3)]
            for tokens in _token_sets(encoded(batch.column(at).cast(pa.string())), k):
                n = len(tokens)
                d1, d2 = np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist() if n else (None, None)
                for column, value in zip(rows, (n, d1, d2)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in rows]], schema.names)

    return docs.mapInArrow(read, schema)


def one_row_of_each_group(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Exactly one row of every group, and all rows with an empty set.

    The row with the smallest ``doc_id`` stays (a null one only if the group has no other); of several with that id, the
    one with the smallest digest, and of those with equal sets the smallest row.  Rows whose id is their own go by id;
    only rows with a null or repeated id are scanned again to tell them apart."""
    members, classes, _ = similar_classes(docs, k, percent)
    placed = members.filter("n > 0").join(classes, ["d1", "d2"], "left")
    alone = F.col("root").isNull()
    keyed = placed.groupBy("root", F.when(alone, F.col("d1")).alias("g1"), F.when(alone, F.col("d2")).alias("g2"))
    stays = keyed.agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "d1", "d2")).alias("s"))
    stays = materialize(stays.select("s.doc_id", "s.d1", "s.d2"), "survivors")
    unclear = materialize(members.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").select(F.col("doc_id").alias("_u")), "unclear")
    # an id of one row stays if it survives in any group: it has one group only
    gone = members.filter("n > 0").select("doc_id").join(stays.select("doc_id"), "doc_id", "left_anti").filter("doc_id is not null")
    if unclear.isEmpty():
        return docs.join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("_u"))
    clear = docs.join(unclear, same, "left_anti").join(gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")
    told = materialize(_with_sets(docs.join(unclear, same, "left_semi"), k), "told")
    chosen = stays.select(F.col("doc_id").alias("_s"), F.col("d1").alias("_s1"), F.col("d2").alias("_s2"))
    kept = told.filter("_n > 0").join(chosen, F.col("doc_id").eqNullSafe(F.col("_s")) & (F.col("_d1") == F.col("_s1")) & (F.col("_d2") == F.col("_s2")), "left_semi")
    first = kept.groupBy("doc_id", "_d1", "_d2").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return clear.unionByName(told.filter("_n = 0").select(*docs.columns)).unionByName(first)
