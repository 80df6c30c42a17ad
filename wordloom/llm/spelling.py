"""Spelling variants: words one edit apart, and the form each one stands for (operator 11).

Frequent words are sorted and cut into shards of bounded size, each built as a
compact trie (nodes in level order, so a node's children are a slice) by the
task that holds it.  A few shards at a time are broadcast.  Every task
intersects the distance-one Levenshtein automata of its words with each of
them, depth first: the states (word, node, place, edits) of the deepest level go
on before others, in blocks.  Each word gets at most one row of partial counts
from a shard; the rows are then reduced to counts and best forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import shared_dir, written

#: Runs of the letters A to Z, a to z and U+00C0 to U+00FF in UTF-8, behind lower-casing.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _counted(text: bytes, long: int = 1 << 22) -> Counter:
    """Runs of a text and how often each occurs; those of a long text are not all held at a time."""
    low = text.translate(LOWER)
    return Counter(RUN.findall(low)) if len(low) < long else Counter(m.group() for m in RUN.finditer(low))


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 7, every: int = 31, held: int = 100_000) -> DataFrame:
    """(word, n): occurrences of runs of letters over all texts, with at least ``least_points`` code points.

    A run of a document loses a code point where the crc32 of "id:run" is a
    multiple of ``every``.  Null texts have no words; a null id counts as an
    empty one.  Tasks add up ``held`` words at a time before the shuffle.
    """
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        crc = zlib.crc32
        for b in batches:
            for id_, text in zip(b.column("id"), b.column("text"), strict=True):
                prefix = crc(f"{id_.as_py()}:".encode())
                for word, n in _counted(text.as_py()).items():
                    if len(word) < least_points:
                        continue
                    h = crc(word, prefix)
                    if h % every == 0:
                        points = word.decode()
                        at = h % len(points)
                        word = (points[:at] + points[at + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") >= least_points:
                        total[word] += n
                if len(total) >= held:
                    yield flush()
        if total:
            yield flush()

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words in a row, and where each word begins (one more entry than words)."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


class Trie(NamedTuple):
    """Nodes in level order, the root first; those below node i are first[i] to first[i + 1] - 1, by rising letter."""

    letter: np.ndarray  # uint32: by which a node is entered
    first: np.ndarray  # int64, one more than nodes
    word: np.ndarray  # int64: the word that ends at a node, or -1
    keys: np.ndarray  # int64: parent and letter of each node but the root, rising
    words: pa.Array
    n: np.ndarray

    def below(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below by a letter, or 0."""
        key = node << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, at + 1, 0) if len(self.keys) else np.zeros(len(node), np.int64)


def built(words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, first children and words of the trie of sorted words (see Trie)."""
    points, begin = code_points(words)
    size = np.diff(begin)
    own, node = np.arange(len(words)), np.zeros(len(words), np.int64)
    letters, parents, ends, depth, nodes = [np.zeros(1, np.uint32)], [np.zeros(0, np.int64)], [np.full(1, -1, np.int64)], 0, 1
    if len(own) and size[0] == 0:
        ends[0][0] = 0
    while len(own := own[size[own] > depth]):
        at = node[own]
        letter = points[begin[own] + depth]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (letter[1:] != letter[:-1])])
        place = np.cumsum(new) - 1
        node[own] = nodes + place
        last = np.full(place[-1] + 1, -1, np.int64)
        full = size[own] == depth + 1
        last[place[full]] = own[full]
        letters.append(letter[new])
        parents.append(at[new])
        ends.append(last)
        nodes, depth = nodes + int(place[-1]) + 1, depth + 1
    parent = np.concatenate(parents)
    first = 1 + np.searchsorted(parent, np.arange(nodes + 1))
    return np.concatenate(letters), first, np.concatenate(ends)


def packed(words: pa.Array, n: np.ndarray) -> dict[str, bytes]:
    """A trie as plain bytes: four bytes a node for its letter, four for its children, four for its word."""
    letter, first, end = built(words, n)
    ipc = pa.BufferOutputStream()
    table = pa.table({"word": words, "n": pa.array(n, pa.int64())})
    with pa.ipc.new_stream(ipc, table.schema) as out:
        out.write_table(table)
    return {"letter": letter.astype("<u4").tobytes(), "first": first.astype("<u4").tobytes(), "end": end.astype("<i4").tobytes(), "entries": ipc.getvalue().to_pybytes()}


def unpacked(shard: dict[str, bytes]) -> Trie:
    letter = np.frombuffer(shard["letter"], "<u4")
    first = np.frombuffer(shard["first"], "<u4").astype(np.int64)
    table = pa.ipc.open_stream(shard["entries"]).read_all().combine_chunks()
    parent = np.repeat(np.arange(len(letter)), np.diff(first))
    return Trie(letter, first, np.frombuffer(shard["end"], "<i4").astype(np.int64), parent << 21 | letter[1:].astype(np.int64), table.column("word").combine_chunks(), np.asarray(table.column("n")))


def neighbours(trie: Trie, points: np.ndarray, begin: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (word, word of the trie) at one inserted, deleted or replaced code point, each pair once.

    Words are given as by ``code_points``.  A state has read a word up to a
    place and stands at a node.  With no edit so far it may still make one; with
    one it must read on exactly.  Equal letters in a row are deleted or inserted
    at the last of their places only, so that no pair is met twice.
    """
    size = np.diff(begin)
    total = len(points)
    letter_at = lambda w, p: np.where(p < size[w], points[np.minimum(begin[w] + p, max(total - 1, 0))].astype(np.int64) if total else 0, -1)
    found_word, found_node = [], []
    start = np.arange(len(size), dtype=np.int64)
    # the stack: blocks of states; the last one is the deepest
    stack = [(start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), bool))] if len(start) else []
    while stack:
        word, node, place, edited = stack.pop()
        if len(word) > block:
            stack.append((word[block:], node[block:], place[block:], edited[block:]))
            word, node, place, edited = word[:block], node[:block], place[:block], edited[:block]
        letter = letter_at(word, place)
        ended = (letter < 0) & edited
        accepted = ended & (trie.word[node] >= 0)
        found_word.append(word[accepted])
        found_node.append(node[accepted])
        # read a letter
        on = np.flatnonzero(letter >= 0)
        down = trie.below(node[on], letter[on])
        on, down = on[down > 0], down[down > 0]
        new = [(word[on], down, place[on] + 1, edited[on])]
        free = np.flatnonzero(~edited)
        if len(free):
            # delete a letter
            after = letter_at(word[free], place[free] + 1)
            gone = free[(letter[free] >= 0) & (after != letter[free])]
            new.append((word[gone], node[gone], place[gone] + 1, np.ones(len(gone), bool)))
            # replace it by, or insert, another one
            many = trie.first[node[free] + 1] - trie.first[node[free]]
            of = np.repeat(free, many)
            child = np.repeat(trie.first[node[free]] - (np.cumsum(many) - many), many) + np.arange(len(of))
            other = trie.letter[child] != letter[of]
            of, child = of[other], child[other]
            # a state is kept only if its next letter can be read, or the word has ended
            for step in (1, 0):
                able = of if step == 0 else of[letter[of] >= 0]
                to = child if step == 0 else child[letter[of] >= 0]
                next_ = letter_at(word[able], place[able] + step)
                reads = next_ < 0
                rest = np.flatnonzero(~reads)
                reads[rest] = trie.below(to[rest], next_[rest]) > 0
                able, to = able[reads], to[reads]
                new.append((word[able], to, place[able] + step, np.ones(len(able), bool)))
        state = tuple(np.concatenate(parts) for parts in zip(*new, strict=True))
        if len(state[0]):
            stack.append(state)
    if not found_word:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_word), trie.word[np.concatenate(found_node)]


def shards_of(words: DataFrame, shard_words: int, shard_bytes: int) -> DataFrame:
    """One row for each trie: (shard, size, letter, first, end, entries).  ``words`` has (word, n), each word once."""
    parts = max(1, -(-words.count() // shard_words))
    ranged = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            trie = packed(table.column("word").combine_chunks().cast(pa.string()), np.asarray(table.column("n")))
            return pa.RecordBatch.from_pylist([{"shard": place << 32 | number, "size": sum(map(len, trie.values())), **trie}], schema=pa.schema([("shard", pa.int64()), ("size", pa.int64()), *((k, pa.binary()) for k in ("letter", "first", "end", "entries"))]))

        for b in batches:
            at = 0
            while at < len(b):
                lengths = pc.binary_length(b.column("word").slice(at)).to_numpy(zero_copy_only=False)
                # a word of m bytes takes at most 12 bytes a node and 16 more
                fits = int(np.searchsorted(np.cumsum(13 * lengths + 16), shard_bytes - size, side="right"))
                fits = min(max(fits, 0 if held else 1), len(b) - at)
                held.append(b.slice(at, fits))
                size += int((13 * lengths[:fits] + 16).sum())
                at += fits
                if at < len(b):
                    yield shard()
                    held, size, number = [], 0, number + 1
        if held:
            yield shard()

    return ranged.mapInArrow(build, "shard bigint, size bigint, letter binary, first binary, end binary, entries binary")


def near_words(words: DataFrame, shard_words: int = 1 << 17, shard_bytes: int = 1 << 24, wave_bytes: int = 1 << 23, batch: int = 1 << 14) -> DataFrame:
    """(word, n_near, near, near_n) for every word of ``words`` (word, n; each once) with near words.

    ``near``: the near word of largest n, of equal ones the least in code-point
    order.  A shard is bounded in words and bytes (of a word longer than that
    alone); as many as hold ``wave_bytes`` are broadcast at a time, one at least.
    """
    spark = words.sparkSession
    base = shared_dir(spark)
    shards = written(shards_of(words, shard_words, shard_bytes), f"{base}/shards")
    sizes = sorted((r["shard"], r["size"]) for r in shards.select("shard", "size").collect())
    waves: list[list[int]] = []
    held = wave_bytes
    for shard, size in sizes:
        if held + size > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append(shard)
        held += size
    out = []
    for k, wave in enumerate(waves):
        rows = [r.asDict() for r in shards.filter(F.col("shard").isin(wave)).collect()]
        sent = spark.sparkContext.broadcast([{name: bytes(r[name]) for name in ("letter", "first", "end", "entries")} for r in rows])

        def meet(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [unpacked(s) for s in sent.value]
            for whole in batches:
                for b in (whole.slice(at, batch) for at in range(0, len(whole), batch)):
                    own = b.column("word").cast(pa.string())
                    points, begin = code_points(own)
                    for trie in tries:
                        word, near = neighbours(trie, points, begin)
                        if not len(word):
                            continue
                        # words of a trie ascend, so the least of equal n is the first
                        order = np.lexsort((near, -trie.n[near], word))
                        word, near = word[order], near[order]
                        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(word[head])), pa.array(np.diff(np.append(head, len(word))), pa.int64()), trie.words.take(pa.array(near[head])), pa.array(trie.n[near[head]], pa.int64())], ["word", "n_near", "near", "near_n"])

        out.append(written(words.select("word").mapInArrow(meet, "word string, n_near bigint, near string, near_n bigint"), f"{base}/near-{k}"))
        sent.destroy()
    if not out:
        return spark.createDataFrame([], "word string, n_near bigint, near string, near_n bigint")
    met = spark.read.schema(out[0].schema).parquet(*(f"{base}/near-{k}" for k in range(len(out))))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last form that following leads to.

    Counts grow tenfold with each step, so chains are short; they are doubled
    until none can go on.
    """
    spark = forms.sparkSession
    base = shared_dir(spark)
    ahead = written(forms.select("word", F.col("form").alias("root")), f"{base}/ahead-0")
    turn = 0
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        step = written(step, f"{base}/ahead-{turn}")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        ahead = step.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, factor: int = 10, least_points: int = 7, every: int = 31, **sizes: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of at least ``least`` occurrences.

    Two words are near if one inserted, deleted or replaced code point parts
    them.  ``form`` is the near word of largest n (ties: the least in code-point order)
    if that is at least ``factor`` times the word's own n, else null, as is
    ``form_n``; ``root`` is where following forms ends.

    Null and empty texts have no words, a null id counts as an empty one,
    repeated rows count again, an empty table gives no rows, and other columns are of no
    matter.  ``sizes``: as of ``near_words``.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    words = written(word_counts(df, id_col, text_col, least_points, every).filter(F.col("n") >= least), f"{base}/words")
    near = near_words(words, **sizes)
    is_form = F.col("near_n") >= factor * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    found = written(found, f"{base}/forms")
    roots = roots_of(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
