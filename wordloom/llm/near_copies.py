"""SimHash near-dedup by the similarity of word shingles, for the pipeline (operator 8).

Texts are sets of five-word shingles; two are near copies if the Jaccard
similarity of their sets is 0.8 or more.  By calculation SimHash fingerprints
of such sets differ in 9.7 of 64 bits on average (deviation 2.9), so fingerprints
up to ``RADIUS`` bits apart are candidates (four in a million are missed), of which the shingles are compared.

For so wide a radius, parts of fingerprints make no useful keys.  Fingerprints
meet under keys of least shingle hashes instead: 20 keys of 4 minima each, of
which a pair of similarity 0.8 has none in common with a chance of 3 in 100,000.

The fingerprints under one key are first compared with one of them.  Those that
this leaves in different components are dealt into tiles, and the pairs of
tiles are compared bit-sliced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import slices
from wordloom.llm.shared import written
from wordloom.llm.simhash import components, fingerprints_of, least_labels, near_in_groups, shingle_hashes

#: Bits by which the fingerprints of near copies may differ.
RADIUS = 24
BANDS, ROWS = 20, 4
# An odd multiplier for each minimum, and one that joins the minima of a band.
FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
JOIN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, in a row, and each text's number of them."""
    hashes, counts = shingle_hashes(texts, words)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The MinHash keys of each text (a row of BANDS numbers); texts without shingles have zeros."""
    keys = np.zeros((len(counts), BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
                key = (key ^ np.minimum.reduceat(hashes * factor, first)) * JOIN
                key ^= key >> np.uint64(29)
            keys[full, band] = key
    return keys


def similar(texts: list[bytes], sims: np.ndarray, side: np.ndarray, words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of texts with a similarity of ``least`` or more; where both sides have rows, of different sides only."""
    a, b = near_in_groups(sims, np.zeros(len(texts), np.int64), side, RADIUS)
    if not len(a):
        return a, b
    some = np.union1d(a, b)
    texts, side, wanted = [texts[i] for i in some], side[some], np.zeros((len(some), len(some)), bool)
    wanted[np.searchsorted(some, a), np.searchsorted(some, b)] = True
    hashes, counts = shingle_sets(texts, words)
    owner = np.repeat(np.arange(len(texts)), counts)
    _, column, shared = np.unique(hashes, return_inverse=True, return_counts=True)
    many = shared[column] > 1
    owner, column = owner[many], np.unique(column[many], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(texts), len(texts)), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, n_columns, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(texts), min(4096, n_columns - low)), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        both += block @ block.T
    near = (both > 0) & (both * (1 + least) >= least * (counts[:, None] + counts[None, :]) - 1e-6)
    x, y = np.nonzero(near & wanted)
    return some[x], some[y]


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, tile: int = 256, slice_bytes: int = 2_000_000) -> DataFrame:
    """All columns of ``df``, and _row (a number for each row), _fp (of the text's shingle set) and _root.

    ``_root`` is equal for texts that are linked, directly or not, by a
    similarity of ``least`` or more.  Texts without words are equal; null texts
    count as empty.  Ids take no part, so null and repeated ones do no harm.
    """
    n = len(df.columns)
    plain = df.toDF(*(f"c{k}" for k in range(n))).withColumn("_text", F.coalesce(F.col(f"c{df.columns.index(text_col)}").cast("string"), F.lit("")).cast("binary"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, keys = [], [], []
            for group in slices(((t,) for t in b.column("_text").to_pylist()), slice_bytes):
                hashes, counts = shingle_sets([t for (t,) in group], words)
                ends = np.cumsum(counts)
                view = memoryview(np.ascontiguousarray(hashes.astype("<u8"))).cast("B")
                fps += [xxhash.xxh64_intdigest(view[8 * (e - c) : 8 * e], 42) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                sims.append(fingerprints_of(hashes, counts))
                keys.append(band_keys(hashes, counts))
            flat = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(fps) + 1) * BANDS, pa.int32())
            own = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.concatenate(sims).view(np.int64) if sims else np.zeros(0, np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *own], [*b.schema.names[:n], "_fp", "_sim", "_keys"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:n])
    marked = written(plain.mapInArrow(mark, f"{types}, _fp bigint, _sim bigint, _keys array<bigint>").withColumn("_row", F.monotonically_increasing_id()), name="marked")

    keyed = written(marked.select("_fp", "_sim", "_keys").dropDuplicates(["_fp"]).select("_fp", "_sim", F.explode("_keys").alias("key")).filter("key <> 0"), name="keyed")
    centres = keyed.groupBy("key").agg(F.min(F.struct("_fp", "_sim")).alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("centre._fp").alias("centre"), F.col("centre._sim").alias("sim"))
    stars = keyed.join(centres, "key").filter((F.col("_fp") != F.col("centre")) & (F.bit_count(F.col("_sim").bitwiseXOR(F.col("sim"))) <= RADIUS)).select(F.col("_fp").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(stars, name="stars")
    text = f"c{df.columns.index(text_col)}"
    wanted = keyed.join(centres.select("key"), "key", "left_semi").select("_fp").distinct()
    texts = marked.join(wanted, "_fp", "left_semi").select("_fp", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    # one text for each set of shingles: the least of those with the same words differs in case and blanks only
    texts = written(texts.groupBy("_fp").agg(F.min("text").alias("text")), name="texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in slices(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True), slice_bytes):
                x, n_x = shingle_sets([g[0] for g in group], words)
                y, n_y = shingle_sets([g[1] for g in group], words)
                own, other = np.split(x, np.cumsum(n_x)[:-1]), np.split(y, np.cumsum(n_y)[:-1])
                shared = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(own, other, strict=True)])
                hit = np.flatnonzero(shared * (1 + least) >= least * (n_x + n_y) - 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array([group[i][2] for i in hit], pa.int64()), pa.array([group[i][3] for i in hit], pa.int64())], ["a", "b"])

    side = lambda name: texts.select(F.col("_fp").alias(name), F.col("text").alias(f"text_{name}"))
    linked = written(stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a bigint, b bigint"), name="linked")
    placed = components(linked)

    # what one comparison under each key leaves apart
    left = keyed.join(centres.select("key"), "key", "left_semi").join(placed.withColumnRenamed("node", "_fp"), "_fp", "left").select("key", "_fp", "_sim", F.coalesce("root", "_fp").alias("root"))
    apart = left.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("n > 2 AND r0 <> r1")
    tiles = F.ceil(F.col("n") / tile).cast("bigint")
    met = left.select("key", "_fp", "_sim").join(apart, "key").select("key", "_fp", "_sim", F.pmod(F.xxhash64("_fp"), tiles).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("bigint").alias("side"), "_fp", "_sim").join(texts, "_fp")
    group = ["key", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def edges() -> pa.RecordBatch:
            fps = np.array([r[4] for r in held], np.int64)
            a, b = similar([r[6] for r in held], np.array([r[5] for r in held], np.int64).view(np.uint64), np.array([r[3] for r in held]), words, least)
            label = least_labels(len(held), a, b)
            member = np.flatnonzero(label != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(fps[member]), pa.array(fps[label[member]])], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*group, "side", "_fp", "_sim", "text")), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield edges()
                    held = []
                held.append(row)
        if held:
            yield edges()

    more = met.select(*group, "side", "_fp", "_sim", "text").repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a bigint, b bigint")
    roots = components(linked.unionByName(written(more, name="more")).distinct())
    out = marked.join(roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root")), "_fp", "left")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)), "_row", "_fp", F.coalesce("_root", "_fp").alias("_root"))
