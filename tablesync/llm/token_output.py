"""Token ids as files: canonical length-limited Huffman codes of ids from counts over the whole corpus.

The format is a folder with two tables. ``codebook`` holds one row, the code length of every id that occurs; canonical codes
follow from the lengths alone. ``blocks`` holds independent blocks of whole documents in ascending order of the id: the codes
of all their ids as one bit string, the bit offset of every ``CHECKPOINT``-th id, the documents with their numbers of ids,
and the number of ids before the block. A block is decoded by a table of ``2 ** limit`` entries, all checkpoints at once;
any document can be decoded alone from the checkpoint before it.

Steps: documents are range-partitioned by id and tokenized once, their ids staged; counts of ids (at most the vocabulary)
go to the driver and give the code; staged ids are encoded where they lie. A document's start is the sum of the partitions
before its own (one number a partition) and of the ids before it in the partition, counted while they are tokenized.

Defined cases: a null or empty text has the end id only; rows that repeat an id are documents of their own, ordered by
their text; a row without id comes first; a very long text is a block of its own; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.sources.folders import fresh_folder

#: Longest code in bits; the decoding table has 2 ** LIMIT entries.
LIMIT = 20
#: Ids after which a block ends with the current document, and ids between two checkpoints.
BLOCK_IDS = 1 << 18
CHECKPOINT = 256
#: Blocks that a task decodes together.
BLOCKS = 8
#: Bytes of remembered pieces of text and their ids in a Python worker, and of the text that is split at once.
MEMORY = 192 << 20
CHUNK = 8 << 20
#: A remembered piece costs about this much besides its own bytes; longer pieces than LONGEST are not remembered.
PIECE_COST, LONGEST = 160, 256

# How byte-level BPE splits a text before merging, for texts of the characters in PLAIN only. Runs of letters, of
# digits and of other characters, each with one blank before it; runs of white space; and these endings after an apostrophe.
SPACES, LETTERS, DIGITS = "\t\n\r ", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9"
PLAIN = "\t\n\r -~¡-±´-¸º»¿-ÿ"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, LETTER, DIGIT, OTHER, END, ODD = range(6)


def _classes() -> np.ndarray:
    """Class of every Latin-1 character; 0 ends a text."""
    out = np.full(256, ODD, np.uint8)
    for kind, chars in ((OTHER, PLAIN), (SPACE, SPACES), (LETTER, LETTERS), (DIGIT, DIGITS)):
        pattern = re.compile(f"[{chars}]")
        out[[i for i in range(256) if pattern.match(chr(i))]] = kind
    out[0] = END
    return out


CLASSES = _classes()


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in Latin-1 texts, each followed by a 0, which is a piece of its own."""
    kind = CLASSES[data]
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    ends = kind == END
    starts |= ends
    # The last character of white space before a word: a blank goes with the word, another one stands by itself.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~ends[1:])
    starts[last] = True
    starts[last[data[last] == 32] + 1] = False
    # An apostrophe that begins a run and is followed by one of the endings.
    quotes = np.flatnonzero((data == 39) & starts)
    for ending in ENDINGS:
        hit = quotes[quotes + len(ending) < len(data)]
        for i, char in enumerate(ending, 1):
            hit = hit[data[hit + i] == ord(char)]
        starts[hit + 1] = False
        after = hit + len(ending) + 1
        starts[after[after < len(data)]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian numbers of 2 bytes if the vocabulary permits, else of 4.

    The tokenizer treats the pieces between its own split points separately. The texts of a chunk are split by array
    operations, equal pieces are put together, and each distinct one is looked up or tokenized once; what was tokenized is
    remembered up to a bound in bytes. Texts with other characters than PLAIN, or with an added token, are encoded as a whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        kind = {2: "H", 4: "I"}[self.dtype.itemsize]
        return [struct.pack(f"<{len(ids)}{kind}", *ids) for ids in (e.ids for e in found)]

    def _ids_of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        values = list(map(self.known.get, pieces))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            if self.held > MEMORY:  # words met early are the frequent ones
                self.known = dict(islice(self.known.items(), len(self.known) // 2))
                self.held = sum(len(k) + len(v) + PIECE_COST for k, v in self.known.items())
            for i, ids in zip(missing, self._encode([pieces[i].decode("latin-1") for i in missing]), strict=True):
                values[i] = ids
                if len(pieces[i]) <= LONGEST:
                    self.known[pieces[i]] = ids
                    self.held += len(pieces[i]) + len(ids) + PIECE_COST
        return values

    def _plain(self, text: str) -> bytes | None:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        kinds = CLASSES[np.frombuffer(data, np.uint8)]
        return None if (kinds >= END).any() or any(a in text for a in self.added) else data

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, each text with the end id, and the number of ids of every text."""
        plain = [self._plain(t) for t in texts]
        found = self._split(b"\0".join([p for p in plain if p is not None]) + b"\0") if any(p is not None for p in plain) else None
        if all(p is not None for p in plain):
            return found or (np.empty(0, self.dtype), np.empty(0, np.int64))
        whole = iter(self._encode([t for t, p in zip(texts, plain, strict=True) if p is None]))
        ends = np.cumsum(found[1]) if found else None
        rows, at = [], 0
        for p in plain:
            if p is None:
                rows.append(np.frombuffer(next(whole) + self.end, self.dtype))
            else:
                rows.append(found[0][ends[at] - found[1][at] : ends[at]])
                at += 1
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _split(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        view = np.frombuffer(data, np.uint8)
        starts = piece_starts(view)
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        end = distinct.index(b"\0")
        words = distinct[:end] + distinct[end + 1 :]
        values = self._ids_of_pieces(words)
        values.insert(end, self.end)
        # Every piece gives way to its ids; the bytes of all of them lie one after the other.
        ids = pa.array(values, pa.large_binary()).take(pieces.indices)
        _, ends, flat = ids.buffers()
        of_texts = np.flatnonzero(pieces.indices.to_numpy() == end)
        ends = np.frombuffer(ends, np.int64)[of_texts + 1] // self.dtype.itemsize
        return np.frombuffer(flat, self.dtype), np.diff(ends, prepend=0)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def ids_of(row: bytes, n: int) -> np.ndarray:
    """Ids of a staged row of ``n`` ids."""
    return np.frombuffer(row, f"<u{len(row) // n}")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Staged rows (part, doc_id, before, n, ids, counts): parts are ranges of the id, in order, each sorted.

    ``before`` is how many ids the part has before the row. A part's last row has no ids but how often each id occurs in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, counts, kind, part = encoder(tokenizer, end_id), 0, np.zeros(0, np.int64), None, None
        names = ["part", "doc_id", "before", "n", "ids", "counts"]
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for some in of_size(batch, CHUNK):
                part = some["part"][0].as_py()
                ids, n = encode(some["text"].to_pylist())
                seen = np.bincount(ids, minlength=len(counts))
                seen[: len(counts)] += counts
                counts, ends = seen, np.cumsum(n)
                offsets = np.append(0, ends * encode.dtype.itemsize).astype(np.int64)
                rows = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]
                )
                yield pa.RecordBatch.from_arrays(
                    [some["part"], some["doc_id"], pa.array(before + ends - n), pa.array(n), rows.cast(pa.binary()), pa.nulls(len(n), pa.binary())],
                    names,
                )
                before += int(ends[-1])
        if part is not None:
            found = np.flatnonzero(counts).astype("<i8")
            packed = found.tobytes() + counts[found].astype("<i8").tobytes()
            last = [pa.array([part], pa.int32()), pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*last, pa.array([packed], pa.binary())], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"part int, doc_id {kind}, before long, n long, ids binary, counts binary")
    path = fresh_folder(docs.sparkSession, "token-ids")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def of_size(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = (np.cumsum(lengths) - lengths) // size
    first = np.flatnonzero(np.diff(which, prepend=-1))
    for lo, hi in zip(first, [*first[1:], len(batch)], strict=True):
        yield batch.slice(lo, hi - lo)


def id_counts(staged: DataFrame) -> dict[int, int]:
    """How often each id occurs in the corpus: at most one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch["counts"].to_pylist():
                pairs = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["id", "n"])

    rows = staged.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge; a single id gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        level = merged[by_weight]
        is_leaf.append(by_weight < n)
    # The cheapest 2n - 2 items of the last level: their leaves are a prefix of all leaves, their packages a prefix of the
    # pairs of the level below.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ids with given lengths: shorter codes first, equal lengths in the order of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths[-1]) if len(order) else 0
        # In units of the longest code, codes follow each other without a gap.
        spans = np.left_shift(1, self.limit - self.lengths)
        self.codes = (np.cumsum(spans) - spans) >> (self.limit - self.lengths)
        self.spans = spans
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes, self.lengths

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of all codes, and the bit offset of every CHECKPOINT-th id."""
        n, codes = self.length_of[ids], self.code_of[ids]
        ends = np.cumsum(n)
        starts = ends - n
        bits = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        # A code of at most 64 bits lies in one or two words of 64 bits; codes of one word are disjoint, so adding is or-ing.
        word, free = starts >> 6, 64 - (starts & 63) - n
        high = np.where(free >= 0, codes << np.maximum(free, 0), codes >> np.maximum(-free, 0)).astype(np.uint64)
        over = free < 0
        first = np.flatnonzero(np.diff(word, prepend=-1))
        bits[word[first]] = np.add.reduceat(high, first)
        bits[word[over] + 1] += codes[over].astype(np.uint64) << (64 + free[over]).astype(np.uint64)
        return bits.astype(">u8").tobytes()[: (int(ends[-1]) + 7) >> 3], starts[::CHECKPOINT]

    def table(self) -> np.ndarray:
        """Id and code length (the last five bits) for every value of the next ``limit`` bits."""
        return np.repeat(self.ids.astype(np.uint64) << np.uint64(5) | self.lengths.astype(np.uint64), self.spans)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
        """The ``n`` ids of a block, or of its stretches from a checkpoint on."""
        return self.decode_blocks([(payload, checkpoints, n)], table)[0]

    def decode_blocks(self, blocks: list[tuple[bytes, np.ndarray, int]], table: np.ndarray) -> list[np.ndarray]:
        """All ids of some blocks (payload, checkpoints, number of ids), one id of every checkpoint's stretch at a time."""
        data = np.frombuffer(b"".join(payload + bytes(8) for payload, *_ in blocks), np.uint8)
        # The five bytes at every place: they hold any code of up to 33 bits, wherever in the first byte it begins.
        window = np.zeros(len(data), np.uint64)
        for i in range(5):
            window[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(32 - 8 * i)
        base = np.cumsum([0, *(8 * (len(payload) + 8) for payload, *_ in blocks[:-1])])
        at = np.concatenate([np.asarray(marks, np.int64) + b for (_, marks, _), b in zip(blocks, base, strict=True)]).astype(np.uint64)
        left = np.concatenate([np.minimum(n - CHECKPOINT * np.arange(len(marks)), CHECKPOINT) for _, marks, n in blocks])
        order = np.argsort(-left, kind="stable")  # shorter stretches last
        at, alive = at[order], np.searchsorted(-left[order], -np.arange(CHECKPOINT), side="left")
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        shift, mask = np.uint64(40 - self.limit), np.uint64((1 << self.limit) - 1)
        for row in range(CHECKPOINT):
            m = alive[row]
            if not m:
                break
            here = at[:m]
            value = (window[here >> np.uint64(3)] >> (shift - (here & np.uint64(7)))) & mask
            entry = table[value]
            out[row, :m] = entry >> np.uint64(5)
            at[:m] += entry & np.uint64(31)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        by_stretch, ids, first = out.T, [], 0
        for _, marks, n in blocks:
            ids.append(by_stretch[back[first : first + len(marks)]].reshape(-1)[:n])
            first += len(marks)
        return ids


CODEBOOK = "ids array<int>, lengths array<int>, end_id int"


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all documents to the folder ``path`` in the format above."""
    spark = docs.sparkSession
    staged = tokenized(docs, tokenizer, end_id, doc_id, text)
    counts = sorted(id_counts(staged).items())
    staged = staged.where("counts IS NULL").drop("counts")
    ids = np.array([i for i, _ in counts], np.int64)
    lengths = code_lengths(np.array([n for _, n in counts], np.int64), limit)
    book = [(ids.tolist(), lengths.tolist(), end_id)]
    spark.createDataFrame(book, CODEBOOK).coalesce(1).write.parquet(f"{path}/codebook")
    spread = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary
    parts = staged.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in parts]).tolist()  # one number for each range partition
    starts = spark.sparkContext.broadcast({r["part"]: end - r["n"] for r, end in zip(parts, ends, strict=True)})
    kind = staged.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, schema, rows, data, held, follows = Code(*spread.value), None, [], [], 0, None

        def block() -> pa.RecordBatch:
            payload, checkpoints = code.encode(np.concatenate(data))
            part, _, before, _ = rows[0]
            row = [starts.value[part] + before, held, [r[1] for r in rows], [r[3] for r in rows], payload, checkpoints.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                of_id = batch.schema.field("doc_id").type
                schema = pa.schema({
                    "start": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(of_id), "sizes": pa.list_(pa.int64()),
                    "payload": pa.binary(), "checkpoints": pa.list_(pa.int64()),
                })
            columns = [batch[c].to_pylist() for c in ("part", "doc_id", "before", "n", "ids")]
            for part, doc, before, n, ids in zip(*columns, strict=True):
                # A task may read pieces of several parts; a block is a run of one.
                if held and (held >= block_ids or (part, before) != follows):
                    yield block()
                    rows, data, held = [], [], 0
                rows.append((part, doc, before, n))
                data.append(ids_of(ids, n))
                held, follows = held + n, (part, before + n)
        if held:
            yield block()

    fields = f"start long, n_ids long, doc_ids array<{kind}>, sizes array<long>, payload binary, checkpoints array<long>"
    staged.mapInArrow(run, fields).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of blocks, decoded: doc_id, start, n_tokens, ids (little-endian 32-bit numbers, end id included)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.schema(CODEBOOK).parquet(f"{path}/codebook").first()
    spread = spark.sparkContext.broadcast((np.array(book["ids"], np.int64), np.array(book["lengths"], np.int64)))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*spread.value)
        table = code.table()
        for batch in batches:
            for lo in range(0, len(batch), BLOCKS):
                some = batch.slice(lo, BLOCKS)
                marks = [m.values.to_numpy() for m in some["checkpoints"]]
                decoded = code.decode_blocks(list(zip(some["payload"].to_pylist(), marks, some["n_ids"].to_pylist(), strict=True)), table)
                for row, ids in enumerate(decoded):
                    sizes, start = some["sizes"][row].values.to_numpy(), some["start"][row].as_py()
                    ends = np.cumsum(sizes)
                    offsets = np.append(0, 4 * ends).astype(np.int64)
                    cut = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [some["doc_ids"][row].values, pa.array(start + ends - sizes), pa.array(sizes), cut.cast(pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.select("doc_ids", "sizes", "payload", "checkpoints", "n_ids", "start").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids binary"
    )


def crc_of_ids(documents: DataFrame) -> DataFrame:
    """Documents of ``read_ids`` with the CRC-32 of their ids instead of the ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write and read back: the documents as decoded from the files."""
    path = fresh_folder(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
