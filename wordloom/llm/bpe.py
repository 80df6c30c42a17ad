"""Byte-level BPE encoding and decoding in Spark SQL functions (operator 1).

Texts are cut into pretokens block by block.  The distinct pretokens that a task
has not met before are then encoded by higher-order functions: each one's bytes become an array of
one-byte pieces, and a fold joins the adjacent pair of the least rank, looked
up in a literal rank map, until no pair has a rank.  Decoding concatenates the
pieces of the ids.  Nothing is shuffled and no dictionary of the corpus is kept.

Two exact shortcuts keep words short: pretokens are also cut between bytes that
stand side by side in no piece, and those that are still over ``LONG`` bytes
are cut at their tokens, found with a heap, as the fold's time grows with the
square of the length.  The expressions then look each of those tokens up.

Inside these expressions a byte is the character of the same number
(ISO 8859-1), so pieces are short strings.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import pieces, slices

#: The rank map is dealt into so many small maps, as Spark looks a key up by going through a map.
BUCKETS = 1 << 15
#: Bytes up to which a word is folded by the expressions as it is.
LONG = 512
IDS, CODED = "array<int>", "struct<ids:array<int>,piece:binary>"


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def token_ends(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the tokens of a word end, joining the leftmost pair of the least rank as long as there is one."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] == n or end[end[i]] != stop:
            continue  # one of the two has been joined otherwise
        end[end[i]], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [x for x in end if x]


def cutter(ranks: dict[bytes, int]) -> Callable[[np.ndarray, bytes, np.ndarray], np.ndarray]:
    """Cuts pretokens where no token can go on, and long ones at their tokens."""
    apart = np.ones(1 << 16, bool)
    for piece in ranks:
        octets = np.frombuffer(piece, np.uint8).astype(np.int64)
        apart[octets[:-1] * 256 + octets[1:]] = False

    def cut(octets: np.ndarray, raw: bytes, begin: np.ndarray) -> np.ndarray:
        first = np.zeros(len(octets), bool)
        first[1:] = apart[octets[:-1].astype(np.uint16) << 8 | octets[1:]]
        first[begin] = True
        begin = np.flatnonzero(first)
        size = np.diff(begin, append=len(raw))
        for i in np.flatnonzero(size > LONG):
            first[begin[i] + np.array(token_ends(raw[begin[i] : begin[i] + size[i]], ranks)[:-1], np.int64)] = True
        return np.flatnonzero(first) if (size > LONG).any() else begin

    return cut


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once; ``kind`` is the type of the result, which is not copied."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def with_state(value: Column, state: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` with a state and a value worked out once."""
    return F.aggregate(F.array(value), state, body)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A constant: an array of maps from piece to rank, by xxhash64 of the piece."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("iso-8859-1")
        maps[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def piece_array(ranks: dict[bytes, int]) -> Column:
    """A constant: the pieces' bytes by id."""
    out = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        out[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(out)), "array<binary>")


def pair_ranks(ranks: dict[bytes, int]) -> Column:
    """A constant: the ranks of all pairs of bytes, at 256 times the first plus the second; -1 for none."""
    numbers = (ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256))
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def rank_of(ranks: Column, piece: Column) -> Column:
    return F.element_at(F.get(ranks, F.xxhash64(piece).bitwiseAND(BUCKETS - 1).cast("int")), piece)


def encode_word(ranks: Column, pairs: Column, word: Column) -> Column:
    """Ids of one pretoken, a string of ISO 8859-1 characters.

    The fold's state holds the cuts ``c`` between pieces, from 0 to the length,
    and ``r``, the ranks of the pairs at these cuts: null at both ends and where
    a pair has none.  Joining a pair takes its cut away, so only the ranks at
    the cuts beside it change.
    """

    def piece(c: Column, low: Column, high: Column) -> Column:
        start = F.get(c, low)
        return F.substring(word, start + 1, F.get(c, high) - start)

    def join_pair(s: Column, i: Column) -> Column:
        c, r = s["c"], s["r"]
        left, right = rank_of(ranks, piece(c, i - 2, i + 1)), rank_of(ranks, piece(c, i - 1, i + 2))
        return F.struct(
            F.array_remove(c, F.get(c, i)).alias("c"),
            F.flatten(F.array(F.slice(r, F.lit(1), i - 1), F.array(left, right), F.slice(r, i + 3, F.size(r)))).alias("r"),
        )

    def step(s: Column, _: Column) -> Column:
        place = F.array_position(s["r"], F.array_min(s["r"])).cast("int") - 1
        return with_state(place, s, lambda s, i: F.when(i.isNull(), s).otherwise(join_pair(s, i)))

    def fold(bytes_: Column) -> Column:
        before = F.flatten(F.array(F.array(F.lit(None).cast("string")), bytes_))
        r = F.zip_with(before, bytes_, lambda a, b: F.nullif(F.get(pairs, F.ascii(a) * 256 + F.ascii(b)), F.lit(-1)))
        ids = lambda s: F.transform(F.sequence(F.lit(1), F.size(s["c"]) - 1), lambda j: rank_of(ranks, piece(s["c"], j - 1, j)))
        return F.aggregate(F.sequence(F.lit(2), F.size(bytes_)), F.struct(F.sequence(F.lit(0), F.size(bytes_)).alias("c"), r.alias("r")), step, ids)

    return let(rank_of(ranks, word), IDS, lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(let(F.split(word, ""), IDS, lambda b: F.when(F.size(b) > 1, fold(b)).otherwise(F.array(rank_of(ranks, word))))))


def decode_ids(by_id: Column, ids: Column) -> Column:
    """The bytes of ids: their pieces one after another."""
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(by_id, i)))


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """For an array of pretokens (binary): an array of structs of their ids and of those ids' bytes."""

    def one(table: Column, pairs: Column, by_id: Column, word: Column) -> Column:
        ids = let(F.decode(word, "ISO-8859-1"), IDS, lambda w: encode_word(table, pairs, w))
        return let(ids, CODED, lambda ids: F.struct(ids.alias("ids"), decode_ids(by_id, ids).alias("piece")))

    each = lambda table, pairs, by_id: F.transform(words, lambda w: one(table, pairs, by_id, w))
    kind = f"array<{CODED}>"
    return let(rank_map(ranks), kind, lambda table: let(pair_ranks(ranks), kind, lambda pairs: let(piece_array(ranks), kind, lambda by_id: each(table, pairs, by_id))))


def cut_documents(rows: DataFrame, ranks: dict[bytes, int], block_bytes: int = 500_000, remember: int = 1_000_000) -> DataFrame:
    """A row a document of ``rows`` (doc_id, text: bytes): doc_id, index, words, fresh.

    Documents stand in blocks.  The first of a block has the block's new
    distinct pretokens (``words``), in the others these are null; ``index`` has
    the numbers of the document's own pretokens.  Where ``fresh``, numbers start anew.
    As a document is a row, what Spark hands on at once is as long as some documents, not as some blocks.
    """
    further = cutter(ranks)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        """Texts and doc_ids one by one, so that a batch is never held twice."""
        for b in batches:
            for text, doc in zip(b.column("text"), b.column("doc_id"), strict=True):
                yield text.as_py(), doc.as_py()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        for block in slices(rows_of(batches), block_bytes):
            if fresh := len(number) > remember:
                number = {}
            words, sizes = pieces([t for t, _ in block], further)
            before = len(number)
            table = np.array([number.setdefault(w, len(number)) for w in words.dictionary.to_pylist()], np.int32)
            new = words.dictionary.filter(pa.array(table >= before)) if len(table) else words.dictionary
            index = table[np.asarray(words.indices)] if len(table) else table
            n, at = len(block), 4 * np.concatenate([[0], np.cumsum(sizes)])
            own = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(index)])
            first = pa.ListArray.from_arrays(pa.array([0] + [len(new)] * n, pa.int32()), new, mask=pa.array([False] + [True] * (n - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in block], pa.int64()), own, first, pa.array([fresh] + [False] * (n - 1))], ["doc_id", "index", "words", "fresh"])

    return rows.mapInArrow(cut, "doc_id bigint, index binary, words array<binary>, fresh boolean")


def encode_documents(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 500_000, remember: int = 1_000_000, splits: int = 4) -> DataFrame:
    """Per document: doc_id, ids (array of int), decoded (the bytes those ids stand for).

    A task works through its texts in blocks of ``block_bytes`` (a longer text
    is a block of its own) and encodes the distinct pretokens that its blocks
    before did not have; it starts anew once it has met over ``remember`` of
    them, which bounds its memory.  It takes about ``splits`` input splits (a half more
    at most), among which words repeat, if all cores have as many.  A null text counts as empty; an empty text
    has no ids.  Null and repeated doc_ids are kept row by row, and an empty
    table gives no rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(cores * max(1, round(rows.rdd.getNumPartitions() / (cores * splits))))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents from the blocks of one task, in their order; a batch may begin within a block."""
        ids, piece = pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("index")
            at = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset)
            begins = np.flatnonzero(np.asarray(b.column("coded").is_valid()))
            bounds = np.unique(np.concatenate([[0], begins, [b.num_rows]])).tolist()
            for start, end in zip(bounds, bounds[1:], strict=False):
                if b.column("fresh")[start].as_py():
                    ids, piece = ids[:0], piece[:0]
                if b.column("coded")[start].is_valid and len(coded := b.column("coded")[start].values):
                    ids, piece = pa.concat_arrays([ids, coded.field("ids").cast(ids.type)]), pa.concat_arrays([piece, coded.field("piece").cast(piece.type)])
                held = (at[end] - at[start]) // 4
                index = pa.array(np.frombuffer(own.buffers()[2], np.int32, held, at[start]) if held else np.zeros(0, np.int32))
                of = (at[start : end + 1] - at[start]) // 4
                numbers, text = ids.take(index), piece.take(index)
                number_at = np.asarray(numbers.offsets)
                text_at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(number_at[of].astype(np.int32)), numbers.values)
                raw = pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer(text_at[of].astype(np.int32)), text.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[start:end], lists, raw], ["doc_id", "ids", "decoded"])

    # both passes and the expressions between them run in one task, so blocks keep their order
    blocks = cut_documents(rows, ranks, block_bytes, remember)
    coded = blocks.select("doc_id", "index", "fresh", encode_words(F.col("words"), ranks).alias("coded"))
    return coded.mapInArrow(put_together, "doc_id bigint, ids array<int>, decoded binary")
