"""Token ids in fixed-width bit-packed files.

A file holds consecutive documents in ascending order of ``doc_id``:

    b"IDPK", version (u8), width (u8), ids of a block (u32), ids of the file (u64)
    payload: blocks of ``block`` ids, each id in ``width`` bits, low bits first; every block starts at a byte
    document table: start of each document within the file (u64, one more than documents)
    block table: byte offset of each block (u64, one more than blocks)
    footer: offset of the document table (u64), documents (u64), blocks (u64), b"IDPK"

``width`` is the least number of bits that holds every id of the vocabulary.  Any range of ids needs the blocks that it
touches only, and a block is unpacked by a few numpy operations.

Texts are encoded by the ``tokenizers`` library.  Its byte-level splitter is regular, so words are found by a vectorised
scan whose character classes are asked of the library itself, and each distinct word is encoded once for a task; texts
with an added token or characters beyond the basic plane, or a tokenizer of another kind, are encoded whole.  Ids are
those of an untouched ``Tokenizer`` without special tokens added, so an added token in a text has its own id.

Defined results: null and empty texts have the end id only; rows with equal ``doc_id`` follow each other by a hash of
their texts; null ids come first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimsieve.llm.files import AtomicFile, open_store, read_range
from claimsieve.llm.words import bounded_batches, mix, span_hashes
from claimsieve.session import materialize, scratch_path

MAGIC = b"IDPK"
BLOCK = 8_192
_HEAD = struct.Struct("<4sBBIQ")
_FOOT = struct.Struct("<QQQ4s")
KNOWN_WORDS = 2_000_000
CHUNK_CHARS = 2 << 20
JOINED_WORDS = 4_096


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Bit-pack ids, low bits first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block: every id is cut out of the eight bytes at its first byte."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    bit = np.arange(n, dtype=np.int64) * width
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range((width + 7 + 7) // 8):
        value |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class PackWriter:
    def __init__(self, uri: str, width: int, block: int = BLOCK):
        self.file, self.width, self.block = AtomicFile(uri), width, block
        self.total, self.starts, self.offsets, self.rest = 0, [0], [], np.zeros(0, dtype=np.uint32)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.file.write(_HEAD.pack(MAGIC, 1, width, block, 0))  # the number of ids is in the document table

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        """``ids`` of several documents of ``lens`` ids each."""
        self.starts.extend((self.total + np.cumsum(lens)).tolist())
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else self.rest
        whole = len(ids) if last else len(ids) // self.block * self.block
        for lo in range(0, whole, self.block):
            self.offsets.append(self.file.write(pack(ids[lo : min(lo + self.block, whole)], self.width)))
        self.held = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.offsets.append(self.file.size)
        at = self.file.write(np.array(self.starts, dtype="<u8").tobytes())
        self.file.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.file.write(_FOOT.pack(at, len(self.starts) - 1, len(self.offsets) - 1, MAGIC))
        self.file.close()


class PackReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.handle = store.open_input_file(path)
        size = self.handle.size()
        magic, _, self.width, self.block, _ = _HEAD.unpack(read_range(self.handle, 0, _HEAD.size))
        at, docs, blocks, end = _FOOT.unpack(read_range(self.handle, size - _FOOT.size, _FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is not a packed id file")
        tables = np.frombuffer(read_range(self.handle, at, 8 * (docs + blocks + 2)), dtype="<u8").astype(np.int64)
        self.starts, self.offsets = tables[: docs + 1], tables[docs + 1 :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file, from the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, dtype=np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        raw = read_range(self.handle, int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, int(self.starts[-1]) - b * self.block)
            a, z = (int(x - self.offsets[first]) for x in (self.offsets[b], self.offsets[b + 1]))
            parts.append(unpack(raw[a:z], self.width, n))
        return np.concatenate(parts)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.handle.close()


_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE, _FAR = range(6)
_EDGE_CHAR = 0x10FFFF + 1
#: The endings that the byte-level splitter cuts off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def word_keys(chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and a second one over other values of its characters, by which equal hashes are told apart."""
    return span_hashes(chars, start, stop), span_hashes(_character_values()[chars], start, stop)


@lru_cache(maxsize=1)
def _character_values() -> np.ndarray:
    return mix(np.arange(_EDGE_CHAR + 1, dtype=np.uint64))


class WordEncoder:
    """Encodes texts with one tokenizer, each distinct word once while it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # for single words, of which none is an added token
        self.regular = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self._forget()
        if self.regular:
            self.classes = self._classes()

    def _forget(self) -> None:
        """Words met so far: sorted hashes, a second hash of each, and where each one's ids lie in the pool."""
        self.keys, self.pool = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        self.second = np.zeros(0, dtype=np.uint64)
        self.at = self.size = np.zeros(0, dtype=np.int64)

    def _encode_words(self, words: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of all words, the order in which the words were encoded, and the number of ids of each word.  Words that begin with a blank fall apart again when joined,
        so many of them go to the library as one text."""
        lead = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words], dtype=bool)
        size = np.zeros(len(words), dtype=np.int64)
        place = np.flatnonzero(lead)
        ids: list[list[int]] = []
        groups = [place[i : i + JOINED_WORDS] for i in range(0, len(place), JOINED_WORDS)]
        for group in groups:
            made = self.plain.encode("".join([words[i] for i in group.tolist()]), add_special_tokens=False)
            counts = np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(group))
            if len(counts) != len(group):
                raise ValueError("joined words did not fall apart again")
            size[group] = counts
            ids.append(made.ids)
        rest = np.flatnonzero(~lead)
        alone = [e.ids for e in self.plain.encode_batch_fast([words[i] for i in rest.tolist()], add_special_tokens=False)]
        size[rest] = [len(x) for x in alone]
        return ids + alone, np.concatenate([*groups, rest]), size

    def _learn(self, keys: np.ndarray, words: list[str], ends: np.ndarray, second: np.ndarray, end_id: int) -> None:
        """Add words; ``ends`` are the keys of the mark between texts, ``second`` the second hashes of both."""
        made, order, size = self._encode_words(words)
        size = np.concatenate([size[order], np.ones(len(ends), dtype=np.int64)])
        flat = np.fromiter(chain(chain.from_iterable(made), [end_id] * len(ends)), dtype=np.uint32, count=int(size.sum()))
        at = len(self.pool) + np.cumsum(size) - size
        keys, second = np.concatenate([keys[order], ends]), np.concatenate([second[: len(order)][order], second[len(order) :]])
        rank = np.argsort(keys, kind="stable")
        slot = np.searchsorted(self.keys, keys[rank])
        self.keys, self.pool = np.insert(self.keys, slot, keys[rank]), np.concatenate([self.pool, flat])
        self.at, self.size = np.insert(self.at, slot, at[rank]), np.insert(self.size, slot, size[rank])
        self.second = np.insert(self.second, slot, second[rank])

    def _classes(self) -> np.ndarray:
        """Class of every character of the basic plane, as the library's own splitter shows it."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        out = np.full(_EDGE_CHAR + 1, _FAR, dtype=np.int8)
        for c in range(0x10000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            joined = [len(split(y + x)) == 1 for y in "a1!"]
            out[c] = _LETTER if joined[0] else _NUMBER if joined[1] else _OTHER if joined[2] else _SPACE
        out[_EDGE_CHAR] = _EDGE
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _starts(self, chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Marks the first character of every word of the splitter."""
        start = np.ones(len(chars), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _EDGE)
        # white space before a word: its last character is a word of its own, or, if it is a blank, part of that word
        after = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _EDGE))
        start[after] = True
        start[after[chars[after] == 32] + 1] = False
        quote = np.flatnonzero((chars == 39) & start)  # an apostrophe that begins a word
        for ending in _ENDINGS:
            ok = quote[quote + len(ending) < len(chars)]
            for k, x in enumerate(ending, 1):
                ok = ok[chars[ok + k] == ord(x)]
            start[ok + 1] = False
            after = ok + len(ending) + 1
            start[after[after < len(chars)]] = True
        return start

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the number of ids of each."""
        if not self.regular:
            parts = [np.append(self.whole(t), np.uint32(end_id)) for t in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        joined = "\udc00".join(texts) + "\udc00"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        chars[chars == 0xDC00] = _EDGE_CHAR
        kind = self.classes[chars]
        edges = np.flatnonzero(kind == _EDGE)
        start = np.flatnonzero(self._starts(chars, kind))
        stop = np.append(start[1:], len(chars))
        key, second = word_keys(chars, start, stop)
        far = np.diff(np.concatenate(([0], np.cumsum(kind == _FAR)[edges]))) > 0  # texts for the library as a whole
        far |= np.array([any(x in t for x in self.added) for t in texts], dtype=bool)
        far = np.flatnonzero(far)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = self.keys[place] != uniq if len(self.keys) else np.ones(len(uniq), dtype=bool)
        if new.any():
            edge = new & (kind[start[first]] == _EDGE)
            word = new & ~edge
            words = [joined[a:z] for a, z in zip(start[first[word]].tolist(), stop[first[word]].tolist())]
            self._learn(uniq[word], words, uniq[edge], second[np.concatenate([first[word], first[edge]])], end_id)
            place = np.searchsorted(self.keys, uniq)
        other = start[self.second[place][inverse] != second]  # another word has this word's hash: its text goes whole
        far = np.union1d(far, np.searchsorted(edges, other))
        lens = self.size[place][inverse]
        ids = self.pool[np.repeat(self.at[place][inverse], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]
        bound = np.concatenate(([0], np.cumsum(lens)[np.searchsorted(start, edges)]))
        counts = np.diff(bound)
        if len(far):
            parts = np.split(ids, bound[1:-1])
            for k in far:
                parts[k] = np.append(self.whole(texts[k]), np.uint32(end_id))
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_packed(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the packed files to ``folder`` in ascending ``id_col`` order, and return one row per
    file: ``part, file, n_docs, n_tokens, doc_ids``.  The rows are written once, so the files are too."""
    bounded_batches(docs.sparkSession)
    width = bits_for(vocabulary)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, writer, ids, id_type = f"{folder}/ids-{part:06d}.idpk", None, [], pa.int64()
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or PackWriter(name, width)
            id_type = batch.column(0).type
            ids += batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lo = size = 0
            for i, t in enumerate([*texts, None]):
                if t is None or (size and size + len(t) > CHUNK_CHARS):
                    writer.add(*_encoder(tokenizer).encode(texts[lo:i], end_id))
                    lo, size = i, 0
                size += len(t or "")
        if writer:
            writer.close()
            row = [[part], [name], [len(ids)], [writer.total], [ids]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(id_type)))], schema.names)

    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    rows = rows.withColumn("_d", F.xxhash64("_t"))  # rows of a repeated id can go to several tasks
    ordered = rows.repartitionByRange("_i", "_d").sortWithinPartitions("_i", "_d", "_t").drop("_d")
    return materialize(ordered.mapInArrow(write, schema), "packs")


def read_packed(spark: SparkSession, packs: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    kind = packs.schema["doc_ids"].dataType.elementType
    # two numbers for each file, of which there are as many as tasks wrote
    before = packs.select("part", F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("base"))
    located = packs.join(before, "part").select("file", F.coalesce("base", F.lit(0)).alias("base"), "doc_ids")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                reader = PackReader(file)
                starts = reader.starts
                step = 64 * reader.block
                crcs: list[int] = []
                k, docs = 0, len(starts) - 1
                while k < docs:  # neighbouring documents of about ``step`` ids at a time
                    z = max(k + 1, int(np.searchsorted(starts, starts[k] + step, side="right")) - 1)
                    part = reader.ids(int(starts[k]), int(starts[z])).astype("<u4")
                    view, origin = memoryview(part).cast("B"), int(starts[k])
                    crcs += [zlib.crc32(view[4 * (int(starts[i]) - origin) : 4 * (int(starts[i + 1]) - origin)]) for i in range(k, z)]
                    k = z
                reader.close()
                columns = [pa.array(ids, batch.schema.field("doc_ids").type.value_type), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    tasks = spark.sparkContext.defaultParallelism
    return located.repartition(max(tasks, 1), F.xxhash64("file")).mapInArrow(read, schema)


def pack_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    """Write all documents to packed files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_packed(spark, write_packed(docs, tokenizer, scratch_path(spark, "ids"), vocabulary, end_id))
