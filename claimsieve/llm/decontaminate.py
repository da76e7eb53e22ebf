"""Benchmark decontamination with a distributed positional inverted index.

The index is divided by documents: every stored row is one segment (about 4 MB of text) with its own sorted term
dictionary and, for each term, the ascending list of token positions.  A search takes the windows of the test items in
blocks of bounded size, looks up their terms in every segment, starts from the rarest term of each window there and
intersects the other lists, shifted by their offset in the window.  No posting leaves its segment, so a term that
occurs in every document costs no more than its share of each segment.

Terms are 64-bit hashes of words; a false phrase would need a colliding word inside an otherwise equal window.

Defined results: null or empty text has no words and is never hit; an item without words matches nothing; an item with
fewer words than the window is one window; repeated documents and items are treated one by one; a null ``doc_id`` is
kept; a null ``item_id`` is an item without a name and counts as the string "null".  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.llm.words import ALNUM, Scan, bounded_batches, encoded, row_hashes
from claimsieve.session import materialize

SEGMENT_BYTES = 4 << 20
WINDOW = 10
BLOCK_WORDS = 1_000_000
PIECE_WORDS = 100_000


def _segment(ids: list, texts: list[bytes]) -> dict:
    scan = Scan(texts, ALNUM, lower=True)
    terms, inverse = np.unique(scan.hashes(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(terms)))))
    gaps = np.diff(order, prepend=0)
    if len(order):
        gaps[offsets[:-1]] = order[offsets[:-1]]  # each list starts with a position, then gaps
    return {
        "doc_ids": ids,
        "token_at": scan.first.astype(np.uint32).tobytes(),
        "terms": terms.tobytes(),
        "offsets": offsets.astype(np.uint32).tobytes(),
        "postings": gaps.astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the positional index of ``docs``: one row per segment, ``segment`` unique within this table."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    binary = ["token_at", "terms", "offsets", "postings"]
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), *[T.StructField(c, T.BinaryType()) for c in binary]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, kind = [], [], 0, None

        def row() -> pa.RecordBatch:
            made = _segment(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([made["doc_ids"]], pa.list_(kind)), *[pa.array([made[c]], pa.binary()) for c in binary]], ["doc_ids", *binary])

        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                if texts and size + len(t) > segment_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    made = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).mapInArrow(build, schema)
    return materialize(made.withColumn("segment", F.monotonically_increasing_id()), "postings")


def _item_pieces(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Term hashes of every item, long items in overlapping pieces."""
    schema = T.StructType([T.StructField("item_id", items.schema[item_col].dataType), T.StructField("terms", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                words = Scan([t], ALNUM, lower=True).hashes()
                for lo in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    ids.append(i)
                    pieces.append(words[lo : lo + PIECE_WORDS + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(pieces, pa.binary())], ["item_id", "terms"])

    pieces = items.select(F.col(item_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).mapInArrow(cut, schema)
    return materialize(pieces.filter(F.length("terms") > 0), "items")


class _Windows:
    """Distinct windows of one block of items, by length, and the items that hold each of them."""

    def __init__(self, pieces: list[tuple[int, bytes]], window: int):
        by_length: dict[int, tuple[list, list]] = {}
        for item, raw in pieces:
            words = np.frombuffer(raw, dtype=np.uint64)
            size = min(window, len(words))
            rows, owners = by_length.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(words, size))
            owners.append(np.full(len(words) - size + 1, item, dtype=np.int64))
        self.groups = []
        for size, (rows, owners) in sorted(by_length.items()):
            table, owner = np.concatenate(rows), np.concatenate(owners)
            key = row_hashes(table)
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            at = np.concatenate(([0], np.cumsum(np.bincount(inverse))))
            terms, cell = np.unique(table[first], return_inverse=True)
            self.groups.append((terms, cell.reshape(len(first), size), at, owner[order]))


def _matches(group: tuple, terms: np.ndarray, offsets: np.ndarray, keys: np.ndarray, n: int, token_at: np.ndarray, slop: int | None):
    """(window, first position) of exact matches; with ``slop``, of anchors with every other term at most so far away."""
    wanted, cell, _, _ = group
    none = np.zeros(0, dtype=np.int64)
    if not len(terms):
        return none, none
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    count = np.where(terms[at] == wanted, offsets[at + 1] - offsets[at], 0)
    sizes = count[cell]
    live = np.flatnonzero((sizes > 0).all(axis=1))
    order = np.argsort(sizes[live], axis=1, kind="stable")  # rarest first
    if not len(live):
        return none, none
    anchor = order[:, 0]
    lens = sizes[live, anchor]
    row = np.repeat(np.arange(len(live)), lens)
    within = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    place = keys[offsets[at[cell[live, anchor]]][row] + within] % n
    if slop is None:
        place = place - anchor[row]
        ok = place >= 0
        row, place = row[ok], place[ok]
    for step in range(1, cell.shape[1]):
        j = order[row, step]
        term = at[cell[live[row], j]]
        if slop is None:
            ok = place + j < n
            look = term * n + np.minimum(place + j, n - 1)
            k = np.minimum(np.searchsorted(keys, look), len(keys) - 1)
            ok &= keys[k] == look
        else:
            k = np.minimum(np.searchsorted(keys, term * n + np.maximum(place - slop, 0)), len(keys) - 1)
            doc = np.searchsorted(token_at, place, side="right") - 1
            lo = np.maximum(place - slop, token_at[doc])
            k = np.minimum(np.searchsorted(keys, term * n + lo), len(keys) - 1)
            ok = keys[k] <= term * n + np.minimum(place + slop, token_at[doc + 1] - 1)
        row, place = row[ok], place[ok]
    if slop is None:
        size = cell.shape[1]
        same = np.searchsorted(token_at, place, side="right") == np.searchsorted(token_at, place + size - 1, side="right")
        row, place = row[same], place[same]
    return live[row], place


def _search_segment(row: dict, windows: _Windows, names: list, slop: int | None):
    token_at = np.frombuffer(row["token_at"], dtype=np.uint32).astype(np.int64)
    terms = np.frombuffer(row["terms"], dtype=np.uint64)
    offsets = np.frombuffer(row["offsets"], dtype=np.uint32).astype(np.int64)
    gaps = np.frombuffer(row["postings"], dtype=np.uint32).astype(np.int64)
    n = max(int(token_at[-1]), 1)
    # a gap never crosses lists: restart the running sum at each list
    run = np.cumsum(gaps)
    starts = offsets[:-1]
    back = run[starts] - gaps[starts] if len(starts) else starts
    lens = np.diff(offsets)
    keys = run - np.repeat(back, lens) + np.repeat(np.arange(len(terms)) * n, lens)
    cover = np.zeros(n + 1, dtype=np.int64)
    pairs = []
    for group in windows.groups:
        which, place = _matches(group, terms, offsets, keys, n, token_at, slop)
        size = group[1].shape[1] if slop is None else 1
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        _, _, at, owner = group
        k = at[which + 1] - at[which]
        doc = np.repeat(np.searchsorted(token_at, place, side="right") - 1, k)
        item = owner[np.repeat(at[which], k) + np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)]
        pairs.append(np.unique(np.stack([doc, item]), axis=1))
    hit = np.cumsum(cover[:-1]) > 0
    items: list[list] = [[] for _ in range(len(token_at) - 1)]
    for doc, item in np.concatenate(pairs, axis=1).T if pairs else ():
        items[doc].append(names[item])
    spans: list[list] = [[] for _ in items]
    if hit.any():
        new_doc = np.zeros(n + 1, dtype=bool)
        new_doc[token_at] = True
        opens = np.flatnonzero(hit & (~np.concatenate(([False], hit[:-1])) | new_doc[:-1]))
        closes = np.flatnonzero(hit & (~np.concatenate((hit[1:], [False])) | new_doc[1:])) + 1
        for lo, hi in zip(opens.tolist(), closes.tolist()):
            d = int(np.searchsorted(token_at, lo, side="right")) - 1
            spans[d].append({"start": lo - int(token_at[d]), "end": hi - int(token_at[d])})
    return np.diff(token_at).tolist(), items, spans


def search(
    index: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per indexed document: ``doc_id, n_words, items`` (items with an occurring window) and ``spans`` of hit
    words.  ``slop=None`` asks for exact phrases; a number asks for proximity: the rarest term of a window with every
    other term of the window at most ``slop`` words away in the same document (the span is then that one word).

    Each distinct text of an item is searched once, however many items share it, and its finds are joined with its items.
    The texts are numbered and sent to the tasks in blocks of about ``block_words`` words, so what is sent at once is bounded."""
    spark = index.sparkSession
    pieces = _item_pieces(items, item_col, text_col, window)
    texts = materialize(pieces.select("terms").distinct().withColumn("piece", F.monotonically_increasing_id()), "pieces")
    total = texts.agg(F.sum(F.length("terms")) / 8).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    doc_type, item_type = index.schema["doc_ids"].dataType.elementType, pieces.schema["item_id"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("place", T.LongType()), T.StructField("doc_id", doc_type),
        T.StructField("n_words", T.LongType()), T.StructField("pieces", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(span)),
    ])

    def block(number: int) -> DataFrame:
        rows = texts.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == number).collect()  # bounded by block_words
        names = [r["piece"] for r in rows]
        sent = spark.sparkContext.broadcast(([bytes(r["terms"]) for r in rows], names))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, names = sent.value
            windows = _Windows(list(enumerate(raw)), window)
            for batch in batches:
                for row in batch.to_pylist():
                    n_words, found, spans = _search_segment(row, windows, names, slop)
                    k = len(n_words)
                    columns = [[row["segment"]] * k, range(k), row["doc_ids"], n_words, found, spans]
                    kinds = [pa.int64(), pa.int64(), batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], schema.names)

        return index.mapInArrow(find, schema)

    out = block(0)
    for number in range(1, blocks):
        out = out.unionByName(block(number))
    if blocks > 1:
        out = out.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("pieces")).alias("pieces"), F.flatten(F.collect_list("spans")).alias("spans"),
        )
    found = materialize(out, "found")
    owners = pieces.join(texts, "terms").select("piece", "item_id").distinct()
    named = found.select("segment", "place", F.explode("pieces").alias("piece")).join(owners, "piece").groupBy("segment", "place")
    # a null item_id is an item too, which collecting plain values would leave out
    named = named.agg(F.collect_set(F.struct("item_id")).alias("_i"))
    items_of = F.coalesce(F.transform("_i", lambda x: x["item_id"]), F.array().cast(T.ArrayType(item_type)))
    return found.join(named, ["segment", "place"], "left").select("doc_id", "n_words", items_of.alias("items"), F.array_sort("spans").alias("spans"))


def covered(spans: F.Column) -> F.Column:
    """Words inside the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, contaminated`` of every document against exact windows of the items."""
    found = search(build_index(docs), items, item_col=item_col, window=window)
    return found.withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, with all their columns.  Rows are judged by id and text, so rows that share
    an id, or have none, stay or go by their own texts."""
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    key = F.md5(F.concat(name, F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
    keyed = docs.select(key.alias("doc_id"), "text")
    bad = materialize(contamination(keyed, items, window).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, key == F.col("_bad"), "left_anti")
