"""Near duplicates by SimHash fingerprints (operator 8).

Fingerprints at most ``radius`` bits apart agree on at least two of radius + 2
parts, so the pairs of parts are the keys under which distinct fingerprints
meet (for a radius of 2: six keys of 32 bits).  Those under one key are compared bit-sliced: their
bit planes stand vertically in 64-bit words, and carry-save counters update 64
distances at once.  Links become components by repeated star joins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import slices
from wordloom.llm.shared import shared_dir, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALL = np.uint64(2**64 - 1)


def shingle_hashes(texts: list[bytes], words: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts in a row, and each text's number of shingles."""
    raw = b"\n".join(texts).translate(LOWER) + b"\n"
    octets = np.frombuffer(raw, np.uint8)
    word = ~SEPARATORS[octets]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    text_end = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    bounds = np.concatenate([[0], np.searchsorted(begin, text_end)])
    n_words = np.diff(bounds)
    # words joined by single blanks: a shingle is then one slice
    gap = np.ones(len(octets), bool)
    gap[:-1] = SEPARATORS[octets[1:]]
    keep = word | (SEPARATORS[octets] & np.concatenate([[False], word[:-1]]))
    place = np.cumsum(keep) - 1
    joined = np.where(word, octets, 0x20).astype(np.uint8)[keep].tobytes()
    begin, end = place[begin], place[end - 1] + 1 if len(end) else end
    n = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    total = int(n.sum())
    first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
    last = np.minimum(first + words, np.repeat(bounds[1:], n)) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    if not total:
        return np.zeros(0, np.uint64), n
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, total), n


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A fingerprint for each text: the bits that are set in over half of its hashes."""
    ones = np.zeros((len(counts), 64), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(hashes), block):
        part, own = hashes[low : low + block], text[low : low + block]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel() if len(counts) else np.zeros(0, np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, slice_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed number.  Null texts count as empty (fp 0)."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in slices(zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True), slice_bytes):
                found = fingerprints_of(*shingle_hashes([t for t, _ in group], words))
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in group], pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(mark, "doc_id bigint, fp bigint")


def near_in_groups(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints (uint64) at most ``radius`` bits apart within a group.

    ``group`` ascends.  Where a group has rows of both sides, only pairs of
    different sides are compared; else all its pairs are.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, len(fps)))
    lane = np.arange(len(fps)) - np.repeat(starts, size)
    blocks = -(-size // 64)
    block_at = np.cumsum(blocks) - blocks
    own_block = np.repeat(block_at, size) + lane // 64
    bit = np.uint64(1) << (lane % 64).astype(np.uint64)
    planes = np.zeros((64, int(blocks.sum())), np.uint64)
    filled, second = np.zeros(planes.shape[1], np.uint64), np.zeros(planes.shape[1], np.uint64)
    np.bitwise_or.at(filled, own_block, bit)
    np.bitwise_or.at(second, own_block, np.where(side == 1, bit, np.uint64(0)))
    for b in range(64):
        np.bitwise_or.at(planes[b], own_block, np.where(fps >> np.uint64(b) & np.uint64(1) == 1, bit, np.uint64(0)))
    mixed = np.add.reduceat(side, starts) > 0
    mixed = np.repeat(mixed & (np.add.reduceat(1 - side, starts) > 0), size)
    # each row against its group's blocks, from its own on
    n = np.repeat(block_at + blocks, size) - own_block
    n = np.where(mixed, np.repeat(blocks, size) * (side == 0), n)
    from_block = np.where(mixed, np.repeat(block_at, size), own_block)
    pairs: list[tuple] = []
    ends = np.cumsum(n)
    low = 0
    while low < len(fps):  # so many comparisons at a time
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 200_000, side="right")))
        row = np.repeat(np.arange(low, high), n[low:high])
        word = from_block[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
        later = np.where(word == own_block[row], ~((bit[row] << np.uint64(1)) - np.uint64(1)), ALL)
        live = filled[word] & np.where(mixed[row], second[word], later)
        over = np.zeros(len(row), np.uint64)
        counters = [over.copy() for _ in range((radius + 8).bit_length())]
        for b in range(64):
            carry = planes[b][word] ^ np.where(fps[row] >> np.uint64(b) & np.uint64(1) == 1, ALL, np.uint64(0))
            for k, counter in enumerate(counters[: (b + 1).bit_length()]):
                counters[k], carry = counter ^ carry, counter & carry
            if b % 8 == 7:
                equal = ALL
                for k in range(len(counters) - 1, -1, -1):
                    if radius >> k & 1:
                        equal = equal & counters[k]
                    else:
                        over |= equal & counters[k]
                        equal = equal & ~counters[k]
                left = np.flatnonzero(live & ~over)
                if len(left) < len(row):  # all 64 distances of the others exceed the radius
                    row, word, live, over = (x[left] for x in (row, word, live, over))
                    counters = [x[left] for x in counters]
                if not len(row):
                    break
        near = live & ~over
        hit = np.flatnonzero(near)
        r, lanes = np.nonzero(np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(hit) else (hit, hit)
        at = hit[r]
        group_of = np.searchsorted(block_at, word[at], side="right") - 1
        pairs.append((row[at], starts[group_of] + (word[at] - block_at[group_of]) * 64 + lanes))
        low = high
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` indices is linked to, directly or not."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def link(distinct: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """Edges (a, b), a > b, that connect all distinct fingerprints within ``radius`` (0 to 62) of each other.

    The wider the radius, the shorter are the keys and the more is compared.

    Under a key with over ``tile`` fingerprints, those are dealt into tiles and
    the pairs of tiles are compared; the links found in one comparison leave it
    as a spanning forest.
    """
    if not 0 <= radius <= 62:
        raise ValueError("radius must be from 0 to 62")
    n = radius + 2
    borders = [64 * i // n for i in range(n + 1)]
    part = lambda i: F.shiftrightunsigned(F.shiftleft("fp", 64 - borders[i + 1]), 64 - borders[i + 1] + borders[i])
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(part(i), borders[j + 1] - borders[j]).bitwiseOR(part(j)).alias("key")) for t, (i, j) in enumerate(itertools.combinations(range(n), 2))]
    keyed = distinct.select("fp", F.inline(F.array(*keys)))
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("bigint")
    met = keyed.join(counts, ["t", "key"]).select("t", "key", "fp", F.pmod(F.xxhash64("fp"), tiles).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("other"))
    met = met.select("t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("bigint").alias("side"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate([[False], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            a, b = near_in_groups(rows[:, 5].view(np.uint64), np.cumsum(change), rows[:, 4], radius)
            label = least_labels(len(rows), a, b)
            member = np.flatnonzero(label != np.arange(len(rows)))
            x, y = rows[member, 5], rows[label[member], 5]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([np.asarray(batch.column(c), np.int64) for c in ("t", "key", "low", "high", "side", "fp")]))
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            if len(rows) >= 50_000 and len(cut):  # the last group may go on
                yield edges(np.ascontiguousarray(rows[: cut[-1] + 1]))
                rows = rows[cut[-1] + 1 :]
            held = [rows]
        if held and len(held[0]):
            yield edges(np.ascontiguousarray(held[0]))

    group = ["t", "key", "low", "high"]
    return met.select(*(F.col(c).cast("bigint") for c in (*group, "side", "fp"))).repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    Large and small stars in turn: each step hangs a node's neighbours on the
    least of them.  Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{base}/edges")
    state, now, turn = None, (), 0
    while now != state:
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a > b")
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        edges = written(small, f"{base}/edges-{turn}")
        now, turn = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), turn + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of ``df``.

    ``component_id``: the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart, null if no reachable row has an id; ``root``: the
    least fingerprint of the component.  Texts without words have fingerprint 0,
    linked like any other; null texts count as empty.  Repeated rows stay apart
    with equal results.  An empty table gives no rows.
    """
    marked = written(fingerprints(df, id_col, text_col, words), name="fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(link(distinct.select("fp"), radius))
    placed = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "root")
