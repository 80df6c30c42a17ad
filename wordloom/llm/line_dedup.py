"""Removal of passages that repeat across documents (operator 2).

Texts are cut into lines behind line ends and, as passages also begin within
wrapped text, at every blank that follows a mark or a byte of one residue class
or precedes a byte of one (``CUT``): one rule for every language and length.  A rolling hash goes
over each two lines in a row, and a line where it is less than at both
neighbours is a boundary.  Chunks are what lies between boundaries, so both
ends of a chunk follow from the text there, and inserted text shifts no border
but those beside it.

Chunks are counted by a 64-bit hash; the bytes of those that occur again are
then compared.  All but the first of equal chunks are repeated, and runs of
repeated chunks of two or more lines are removed.

Everything is built-in Spark functions; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import written

def _bytes(of: int, residue: int) -> str:
    return "".join(rf"\x{b:02x}" for b in range(33, 256) if b % of == residue)


#: A blank ends a line behind a byte of one residue of 8 (the full stop has it) or another mark, and before a byte of one residue of 4.
ENDS, BEGINS = _bytes(8, 6) + ",;:!?", _bytes(4, 2)
#: Places between lines, in a text of which each byte is a character; the last two are marks of languages without blanks.
#: The last byte before a place is looked at first, as most places fail by it.
CUT = rf"(?<=[\n \x81\x82\x8c\x9f])(?:(?<= )(?:(?<=[{ENDS}] )|(?=[{BEGINS}]))|(?<=\n)|(?<=\xe3\x80[\x81\x82])|(?<=\xef\xbc[\x81\x8c\x9f]))"
LATIN = "ISO-8859-1"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def lines_of(data: Column) -> Column:
    """The lines of a text given as bytes, each byte as one character."""
    return F.array_remove(F.split(F.decode(data, LATIN), CUT), "")


def _starts(lengths: Column) -> Column:
    """Where each of some pieces begins: sums of blocks, then within a block, so n pieces take n ** 1.5 steps."""

    def of_block(block: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")), lambda b: _sum(F.slice(lengths, b * block + 1, block)))

        return _let(whole, lambda whole: F.transform(lengths, lambda _, k: _let(F.floor(k / block).cast("int"), lambda b: _sum(F.slice(whole, F.lit(1), b)) + _sum(F.slice(lengths, b * block + 1, k - b * block)))))

    return _let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), of_block)


def chunks(data: Column, bits: int = 64) -> Column:
    """The chunks of a text of one byte or more: an array of structs (at: first byte from 0, n: bytes, lines, hash of ``bits`` bits)."""

    def placed(parts: Column) -> Column:
        return _let(_let(F.transform(parts, lambda p: p["n"]), _starts), lambda at: F.transform(parts, lambda p, k: F.struct(F.get(at, k).alias("at"), p["n"].alias("n"), p["lines"].alias("lines"), p["hash"].alias("hash"))))

    def of_bounds(lines: Column, bounds: Column) -> Column:
        def part(first: Column, k: Column) -> Column:
            count = F.get(bounds, k + 1) - first
            hash_ = lambda x: F.xxhash64(x) if bits == 64 else F.shiftrightunsigned(F.xxhash64(x), 64 - bits)
            return _let(F.array_join(F.slice(lines, first + 1, count), ""), lambda x: F.struct(F.length(x).alias("n"), count.alias("lines"), hash_(x).alias("hash")))

        return _let(F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), part), placed)

    def of_hashes(lines: Column, hashes: Column) -> Column:
        rolling = F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 1), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1)))
        least = lambda r: F.transform(r, lambda x, i: F.when((x < F.get(r, i - 1)) & (x < F.get(r, i + 1)), i))
        inner = _let(rolling, lambda r: F.array_compact(least(r)))
        return _let(F.concat(F.array(F.lit(0)), inner, F.array(F.size(lines))), lambda bounds: of_bounds(lines, bounds))

    return _let(lines_of(data), lambda lines: _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: of_hashes(lines, hashes)))


def _place() -> Column:
    """A number that orders occurrences: by id (null ids last), by the text's hash, by the row's number where the id is null, by place."""
    power = lambda n: F.lit(str(2**n)).cast("decimal(38,0)")
    big = lambda c: c.cast("decimal(20,0)")
    key = F.shiftrightunsigned("_key", 33)
    own = big(F.col("_i")) * power(62) + big(key * 2**31 + F.col("at"))
    none = power(125) + big(key) * power(94) + big(F.col("_i")) * power(31) + big(F.col("at"))
    return F.when(F.col("_has"), own.cast("decimal(38,0)")).otherwise(none.cast("decimal(38,0)"))


def _runs(found: Column, total: Column, least_bytes: int) -> Column:
    """Runs (at, n, chunks) of the repeated chunks that follow each other, with ``least_bytes``, and two lines unless they are the whole text."""

    def of_sorted(c: Column) -> Column:
        end = lambda x: x["at"] + x["n"]
        begins = F.array_compact(F.transform(c, lambda x, i: F.when(F.coalesce(end(F.get(c, i - 1)) < x["at"], F.lit(True)), F.struct(x["at"].alias("at"), x["lines"].alias("lines"), i.alias("i")))))
        ends = F.array_compact(F.transform(c, lambda x, i: F.when(F.coalesce(F.get(c, i + 1)["at"] > end(x), F.lit(True)), F.struct(end(x).alias("to"), i.alias("i")))))
        runs = F.zip_with(begins, ends, lambda b, e: F.struct(b["at"].alias("at"), (e["to"] - b["at"]).alias("n"), (e["i"] - b["i"] + 1).alias("chunks"), b["lines"].alias("lines")))
        return F.filter(runs, lambda r: (r["n"] >= least_bytes) & ((r["chunks"] > 1) | (r["lines"] > 1) | (r["n"] == total)))

    return _let(F.array_sort(found), of_sorted)


def _without(data: Column, runs: Column) -> Column:
    """The bytes outside of the runs, as text."""
    start = lambda k: F.coalesce(F.get(runs, k - 1)["at"] + F.get(runs, k - 1)["n"], F.lit(0))
    piece = lambda k: F.decode(F.substring(data, start(k) + 1, F.coalesce(F.get(runs, k)["at"], F.length(data)) - start(k)), LATIN)
    return F.encode(F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), piece), ""), LATIN).cast("string")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 80, bits: int = 64) -> DataFrame:
    """All columns of ``df``, ``text_col`` without repeated chunks, and removed_chunks and removed_chars.

    The first of equal chunks stays whole: the one of the smallest id (rows
    without an id come last), then of the least hash of the text, then of the
    least place.  Repeated rows (equal id and text) are one document and keep
    the same text; rows without an id are documents of their own.  Repeated
    chunks go in runs: those that follow each other in a text, if they have
    ``least_bytes`` bytes (UTF-8) and two lines, or are the whole text.  The
    ends of a passage, up to its first and from its last boundary, may stay.
    A null text stays null and an empty one empty; a text of which nothing is
    left becomes empty.  Bytes that are no UTF-8 stay as they are.  An empty
    table gives no rows.  Columns of ``df`` that bear a name of the two new
    ones give way to them; other names are free.

    ``bits``: of the chunks' hash; fewer only cause more comparisons.
    """
    names = [c for c in df.columns if c not in ("removed_chunks", "removed_chars")]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    own, id_, text = f"c{names.index(text_col)}", F.col(f"c{names.index(id_col)}").cast("bigint"), F.col(f"c{names.index(text_col)}").cast("string")
    # rows without an id get a number, which stays as it is once written
    numbered = written(plain.filter(id_.isNull()).withColumn("_i", F.monotonically_increasing_id()), name="numbered")
    plain = plain.filter(id_.isNotNull()).select("*", id_.alias("_i"), F.lit(True).alias("_has")).unionByName(numbered.withColumn("_has", F.lit(False)))
    plain = plain.withColumns({"_key": F.xxhash64(text), "_data": text.cast("binary")})
    doc = ["_has", "_i", "_key"]
    docs = plain.select(*doc, "_data").filter(F.length("_data") >= least_bytes)

    found = written(docs.select(*doc, F.inline(chunks(F.col("_data"), bits))), name="chunks")
    firsts = found.groupBy("hash").agg(F.count("*").alias("_n"), F.min(_place()).alias("_first")).filter("_n > 1").drop("_n")
    firsts = written(firsts, name="firsts")  # apart from the join, whose hot hashes Spark can then split
    again = written(found.join(firsts, "hash").select(*doc, "at", "n", "lines", "hash", (_place() > F.col("_first")).alias("later")), name="again")

    # the bytes of all chunks of one hash
    listed = docs.join(again.groupBy(*doc).agg(F.collect_set(F.struct("at", "n", "lines", "hash")).alias("_chunks")), doc)
    texts = listed.select(*doc, "_data", F.inline("_chunks")).select(*doc, "at", "n", "lines", "hash", F.substring("_data", F.col("at") + 1, F.col("n")).alias("bytes"))
    clashes = written(texts.select("hash", "bytes").distinct().groupBy("hash").count().filter("count > 1").select("hash"), name="clashes")
    removed = again.filter("later").select(*doc, "at", "n", "lines", "hash")
    if not clashes.isEmpty():  # different texts of one hash are told apart by their bytes
        apart = texts.join(clashes, "hash")
        first = apart.groupBy("hash", "bytes").agg(F.min(_place()).alias("_first"))
        apart = apart.join(first, ["hash", "bytes"]).filter(_place() > F.col("_first")).select(*removed.columns)
        removed = removed.join(clashes, "hash", "left_anti").select(*removed.columns).unionByName(apart)

    gone = removed.groupBy(*doc).agg(F.collect_set(F.struct("at", "n", "lines")).alias("_gone"))
    out = plain.join(gone, doc, "left").withColumn("_runs", F.when(F.col("_gone").isNotNull(), _runs(F.col("_gone"), F.length("_data"), least_bytes)))
    out = out.withColumn("_clean", F.when(F.size("_runs") > 0, _without(F.col("_data"), F.col("_runs"))))
    columns = [(F.coalesce("_clean", text) if f"c{k}" == own else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)]
    count = F.coalesce(F.aggregate("_runs", F.lit(0), lambda total, r: total + r["chunks"]), F.lit(0))
    return out.select(*columns, count.alias("removed_chunks"), F.coalesce(F.length(text) - F.length("_clean"), F.lit(0)).alias("removed_chars"))
