"""The numbered operators against brute force on small tables and odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import bpe, licenses, quality, queries, toxicity, words
from wordloom.llm.ann import nearest
from wordloom.llm.line_dedup import CUT, dedup_lines
from wordloom.llm.packing import SumOfSquares, pack_documents
from wordloom.llm.pretokens import pieces
from wordloom.llm.shared import shared_dir
from wordloom.llm.simhash import components, link, near_duplicates, near_in_groups
from wordloom.llm.token_files import bits_for, pack_bits, read_span, read_token_files, unpack_bits, write_token_files
from wordloom.llm.tokens import TextEncoder
from wordloom.llm.topk import exact_top_k

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "It's  a test,\n\n  isn't it? 'sfoo ''ll", "naïve Straße 12½ ☃☃ 日本語 \U0001f600　x", "ab" * 3000, "the the the", "the the the", "a\x00b\x1cc\x85d", "x" * 40_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with names that operators use inside."""
    rows = [(k, t, "own", 1.0, k) for k, t in enumerate(TEXTS)] + [(None, "the the the", "own", 1.0, 0), (6, "the the the", "own", 1.0, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, _id long").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pretokens_follow_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    signs = list("aé'ſstrevlmdLD  \n\t　\xa012²,!☃\U0001f600中\x1c\x85")
    rng = random.Random(1)
    for _ in range(500):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        found, counts = pieces([t.encode() for t in texts])
        wanted = [pattern.findall(t) for t in texts]
        assert [w.decode() for w in found.to_pylist()] == [w for ws in wanted for w in ws] and counts.tolist() == list(map(len, wanted))


def test_byte_bpe(odd, empty):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode_documents(odd, ranks, block_bytes=200, remember=5).collect()
    assert len(rows) == 12
    texts = {k: t or "" for k, t in enumerate(TEXTS)} | {None: "the the the"}
    for r in rows:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    assert bpe.encode_documents(empty, ranks).count() == 0


def test_byte_bpe_hands_on_documents_not_blocks(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [f"word{k} and more words " * 50 for k in range(40)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe.cut_documents(df.withColumn("text", F.col("text").cast("binary")), ranks, block_bytes=4000).collect()
    assert [r["doc_id"] for r in rows] == list(range(41))
    assert max(len(r["index"]) for r in rows) <= 4 * 6 * 50 and sum(r["words"] is not None for r in rows) > 5
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_documents(df, ranks, block_bytes=4000, remember=20).collect()
    assert {r["doc_id"]: (r["ids"], bytes(r["decoded"]).decode()) for r in coded} == {k: (encoding.encode_ordinary(t), t) for k, t in enumerate(texts)}


def test_byte_bpe_hands_python_some_megabytes_at_once(spark, tmp_path, monkeypatch):
    key, at, cut = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path / "sizes"), bpe.cut_documents
    texts = [f"word{k} and more words " * 200 for k in range(4000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def measured(batches):
        for b in batches:
            with open(at, "a") as f:
                f.write(f"{b.nbytes}\n")
            yield b

    monkeypatch.setattr(bpe, "cut_documents", lambda rows, *a: cut(rows.mapInArrow(measured, rows.schema), *a))
    before = spark.conf.get(key)
    rows = queries.op1_byte_bpe(spark, str(tmp_path)).collect()
    assert spark.conf.get(key) == before and sorted(r["doc_id"] for r in rows) == list(range(4000))
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    sizes = [int(x) for x in open(at)]
    assert sum(sizes) > 16e6 and max(sizes) < 8e6


def test_byte_bpe_of_very_long_pretokens(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=1_000_000)), "a" * 40_000 + "b", "the" * 5000, "日本語" * 2000, "=" * 3000, "".join(rng.choices("etaoin", k=30_000))]
    for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def test_token_ends():
    """As joining the leftmost pair of the least rank again and again."""
    rng = random.Random(6)
    for _ in range(300):
        pieces_ = [bytes([c]) for c in b"abc"] + ["".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(12)]
        ranks = {p: k for k, p in enumerate(dict.fromkeys(pieces_))}
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.token_ends(word, ranks) == np.cumsum([len(p) for p in parts]).tolist()


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = pack_bits(ids, bits)
    assert len(packed) == -(-1000 * bits // 8) and (unpack_bits(packed, bits, 137, 501) == ids[137:638]).all()
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_texts_that_spell_special_tokens(library):
    texts = ["a <|endoftext|>b c", "", "<|endoftext|><|endoftext|>", "plain <|endoftex", "é<|endoftext|> "]
    ids, counts = TextEncoder.of(JSON).encode([t.encode() for t in texts], 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*library(t), 7] for t in texts]


def test_token_files(spark, odd, empty, library):
    path = shared_dir(spark)
    write_token_files(odd, path, JSON, end_id=2, block_ids=100)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(rows) == 12
    texts = {k: t or "" for k, t in enumerate(TEXTS)} | {None: "the the the"}
    at, everything = 0, []
    for r in rows:
        wanted = [*library(texts[r["doc_id"]]), 2]
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == wanted
        at += len(wanted)
        everything += wanted
    assert read_span(spark, path, 5, 300).tolist() == everything[5:305]
    write_token_files(empty, path, JSON, end_id=2)
    assert read_token_files(spark, path).count() == 0


def check_packing(rows, texts, library, end, capacity):
    for doc in {r["doc_id"] for r in rows}:
        own = [r for r in rows if r["doc_id"] == doc]
        wanted, covered = [*library(texts[doc]), end], Counter()
        for r in own:
            assert r["doc_tokens"] == len(wanted) and np.frombuffer(r["ids"], "<u4").tolist() == wanted[r["start"] : r["start"] + r["length"]]
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert len(covered) == len(wanted) and len(set(covered.values())) == 1
    windows: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert windows.get(r["sequence_id"], 0) == r["offset"]
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == capacity or n & (n - 1) == 0 for n in windows.values())


@pytest.mark.parametrize(("capacity", "most_open"), [(64, 4096), (64, 2), (1000, 4096)])
def test_packing(odd, empty, library, capacity, most_open):
    rows = pack_documents(odd, JSON, end_id=0, capacity=capacity, most_open=most_open).collect()
    check_packing(rows, {k: t or "" for k, t in enumerate(TEXTS)} | {None: "the the the"}, library, 0, capacity)
    assert pack_documents(empty, JSON, end_id=0).count() == 0


def test_sum_of_squares_level():
    packer, rng = SumOfSquares(20), np.random.default_rng(3)
    for _ in range(300):
        packer.count[1:20] = rng.integers(0, 4, 19)
        size = int(rng.integers(1, 20))

        def after(h, size=size):
            n = packer.count.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 20
            return int((n[1:20] ** 2).sum())

        options = [h for h in range(0, 21 - size) if h == 0 or packer.count[h]]
        least = min(map(after, options))
        assert packer.level(size) == max(h for h in options if after(h) == least)


def brute_lines(data):
    """Lines of a text of bytes, by one pass over them."""
    lines, start = [], 0
    for k in range(1, len(data) + 1):
        before = data[start:k]
        mark = data[:k].endswith((b"\n", "。".encode(), "、".encode(), "！".encode(), "？".encode(), "，".encode()))
        blank = data[k - 1 : k] == b" "
        blank = blank and (k > 1 and data[k - 2] > 32 and (data[k - 2] % 8 == 6 or data[k - 2] in b",;:!?") or k < len(data) and data[k] > 32 and data[k] % 4 == 2)
        if mark or blank or k == len(data):
            lines.append(before)
            start = k
    return lines


def brute_chunks(data):
    """(first byte, bytes, lines) of each chunk."""

    def h(*xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(8, "little"), seed)
        return seed

    lines = brute_lines(data)
    hashes = [h(x.decode("latin1").encode()) for x in lines]
    rolling = [(h(*two) + 2**63) % 2**64 for two in zip(hashes, hashes[1:])]
    bounds = [0, *(i for i in range(1, len(rolling) - 1) if rolling[i] < min(rolling[i - 1], rolling[i + 1])), len(lines)]
    at = 0
    for first, end in zip(bounds, bounds[1:]):
        n = sum(map(len, lines[first:end]))
        yield at, n, end - first
        at += n


def brute_dedup(rows):
    """Texts without runs of repeated chunks, told apart by their bytes; rows of no id are numbered by their place."""
    first, found, seen = {}, [], Counter()
    for doc, text in rows:
        data = text.encode()
        key = xxhash.xxh64_intdigest(data, 42)
        seen[key] += doc is None
        order = (2**63 if doc is None else doc, key >> 33, seen[key] if doc is None else 0)
        found.append((doc, order, data, list(brute_chunks(data)) if len(data) >= 80 else []))
        for at, n, _ in found[-1][3]:
            piece = data[at : at + n]
            first[piece] = min(first.get(piece, (*order, at)), (*order, at))
    for doc, order, data, chunks in found:
        runs, open_ = [], False
        for at, n, lines in chunks:
            again = first[data[at : at + n]] < (*order, at)
            if again and open_:
                runs[-1] = (runs[-1][0], runs[-1][1] + n, runs[-1][2] + lines)
            elif again:
                runs.append((at, n, lines))
            open_ = again
        for at, n, lines in reversed(runs):
            if n >= 80 and (lines > 1 or n == len(data)):
                data = data[:at] + data[at + n :]
        yield doc, data.decode()


@pytest.mark.parametrize("bits", [64, 10])
def test_line_dedup(spark, sf, bits):
    """As by brute force; with hashes of 10 bits most chunks share theirs with other texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: r["text"] for r in dedup_lines(docs, bits=bits).collect()}
    assert found == dict(brute_dedup((r["doc_id"], r["text"]) for r in docs.collect()))


def test_line_dedup_of_odd_texts(spark, odd, empty):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randint(2, 9))) for _ in range(n))
    passage, signs = say(60), "".join(f"\x01{k}\x02b. \x02a\x02{k}e " for k in range(30))
    rows = [(1, f"{say(9)} {passage} {say(9)}"), (2, f"{passage}\n{say(4)}"), (2, f"{say(7)}. {passage}"), (None, f"{say(5)} {signs}"), (None, f"{signs}{say(5)}"), (None, passage), (None, passage), (3, None), (4, ""), (5, f"{signs} \x01 {say(3)}")]
    df = spark.createDataFrame([(i, t, 1, "x", 5, 6.0, 7) for i, t in rows], "doc_id long, text string, _id int, _was string, _key int, removed_chunks double, c1 int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_id", "_was", "_key", "c1", "removed_chunks", "removed_chars"]
    got = out.collect()
    assert all((r["_id"], r["_was"], r["_key"], r["c1"]) == (1, "x", 5, 7) for r in got)
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["text"] is not None), key=str) == sorted(brute_dedup((i, t) for i, t in rows if t is not None), key=str)
    assert [r["doc_id"] for r in got if r["text"] is None] == [3] and {r["doc_id"]: r["text"] for r in got}[1] == rows[0][1]
    assert sum(r["removed_chars"] for r in got) == sum(len(t or "") for _, t in rows) - sum(len(r["text"] or "") for r in got)
    same = dedup_lines(odd)
    assert same.columns == [*odd.columns, "removed_chunks", "removed_chars"] and same.count() == odd.count() and dedup_lines(empty).count() == 0


def test_lines_end_where_the_plain_rules_say():
    ends = lambda b: b % 8 == 6 and b > 32 or chr(b) in ",;:!?"
    rng = random.Random(8)
    for _ in range(200):
        text = bytes(rng.choice(b"\n  ab.,nfrz\xe3\x80\x81\x82\xef\xbc\x8c\x9f\xc3\xa9") for _ in range(80))
        cuts = [
            k for k in range(1, 80)
            if text[k - 1] == 10 or text[k - 1] == 32 and (k > 1 and ends(text[k - 2]) or text[k] > 32 and text[k] % 4 == 2)
            or text[k - 3 : k] in (b"\xe3\x80\x81", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x8c", b"\xef\xbc\x9f")
        ]
        assert [x.start() for x in re.finditer(CUT, text.decode("iso-8859-1")) if 0 < x.start() < 80] == cuts
    assert all(re.match(r"[\n \x81\x82\x8c\x9f]", part) for part in re.findall(r"^\(\?<=(\[.*?\])\)", CUT)[0][1:-1].encode().decode("unicode_escape"))


def test_passages_in_lines_of_any_length(spark):
    """No 50 words in a row stay in two texts, wherever the passage begins; first copies stay whole."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) + rng.choice("eeenrstx")
    say = lambda n: " ".join(word() + rng.choice(["", "", "", "", "", ","]) for _ in range(n))
    short = "\n".join(say(2) for _ in range(40))
    signs = "".join(f"{word()}$$$ " for _ in range(70))
    passage = ". ".join(say(20) for _ in range(4))
    texts = [f"{say(3)}\n{passage}\n{say(4)}.", f"{say(6)} {passage} {say(30)}.\n{say(5)}", f"{say(200)} {passage} {say(100)}\n", f"{say(5)}.\n{short}\n{say(9)}.", f"{say(4)}\n{say(4)}\n{short}\n{say(3)}", f"{short}\n", f"{say(8)} {signs}", f"{signs}{say(30)}"]
    rows = [*enumerate(texts), (None, f"{say(7)}\n{passage}"), (None, f"{say(7)}\n{passage}"), (10, None), (11, "")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {}
    for r in out:
        words = (r["text"] or "").split()
        for k in range(len(words) - 49):
            assert seen.setdefault(tuple(words[k : k + 50]), r) is r
    kept = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(kept[k] == texts[k] for k in (0, 3, 6)) and sum(r["removed_chars"] for r in out) > 5 * len(passage) * 0.8


def test_short_texts_long_lines_and_rows_without_id(spark):
    """A passage that is a line here and part of one there; twins of five lines and a text that holds them; twins without an id; bytes that are no UTF-8."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 5))) for _ in range(n))
    passage, five, alone = say(55), "\n".join(say(45) for _ in range(5)), say(300)
    rows = [(1, f"{say(3)}\n{passage}\n{say(3)}"), (2, f"{say(20)} {passage} {say(20)}"), (3, five), (4, five), (5, f"{say(9)}\n{five}\n{say(9)}"), (None, alone), (None, alone), (None, alone)]
    df = spark.createDataFrame([(i, t.encode()) for i, t in rows] + [(k, b"\xff\xfe " + say(1).encode() + b" \xc3 " + say(99).encode()) for k in (6, 7)], "doc_id long, data binary")
    out = dedup_lines(df.select("doc_id", F.col("data").cast("string").alias("text"))).select("doc_id", F.col("text").cast("binary").alias("data"), "removed_chars").collect()
    kept = {r["doc_id"]: bytes(r["data"]) for r in out if r["doc_id"]}
    given = {r["doc_id"]: bytes(r["data"]) for r in df.collect()}
    assert all(kept[k] == given[k] for k in (1, 3, 6, 7)) and kept[4] == b"" and len(kept[5]) < 300
    assert len(kept[2]) < len(given[2]) - len(passage) * 0.5
    assert sorted(len(r["data"]) for r in out if r["doc_id"] is None) == [0, 0, len(alone)]


# Openings of public licence texts, by licence.
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
}


def test_wrapped_licences_in_comments(spark):
    wrap = lambda t, sign: "\n".join(f"{sign}{line}" for p in t.split("\n\n") for line in [*textwrap.wrap(p, 72), ""])
    forms = [lambda t: t, lambda t: wrap(t, ""), lambda t: wrap(t, "# "), lambda t: wrap(t, "// "), lambda t: "/*\n" + wrap(t, " * ") + "\n */", lambda t: f"Some words before\nCopyright (c) 2020 Somebody\n\n{wrap(t, '')}\nint main() {{}}"]
    rows = [(k * 100 + j, form(text)) for k, text in enumerate(HEADERS.values()) for j, form in enumerate(forms)]
    notices = ["This project is licensed under the MIT license.", "no end before\nReleased under the MIT License\nnor here", "Copyright 2020 X\nPermission is granted to anyone to use this software for any\npurpose, including commercial applications, and to alter it and\nredistribute it freely, subject to the following restrictions: 1", "A sentence. This work is licensed under CC BY-SA 4.0!"]
    rows += [(9000 + k, t) for k, t in enumerate(notices)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, licenses.scan_licenses(df).collect()))
    by_doc = {}
    for doc, _, licence, _, _ in found:
        by_doc.setdefault(doc, set()).add(licence)
    for k, licence in enumerate(HEADERS):
        for j in range(len(forms)):
            assert licence in by_doc.get(k * 100 + j, ()), (licence, j, by_doc.get(k * 100 + j))
    assert [by_doc[9000 + k] for k in range(4)] == [{"MIT"}, {"MIT"}, {"Zlib"}, {"CC-BY-SA-4.0"}]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert found == sorted(con.execute(licenses.oracle_sql()).fetchall())


def test_licenses(spark, sf, odd, empty):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{sf}/documents.parquet' UNION ALL SELECT 9001, 'Released under the MIT License. All rights reserved.' UNION ALL SELECT 9002, 'LICENSED under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.'")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, "Released under the MIT License. All rights reserved."), (9002, 'LICENSED under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.')], "doc_id long, text string"))
    found = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    assert found == sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert [r[1:3] for r in found if r[0] > 9000] == [("notice-mit-reserved", "MIT"), ("apache-header-short", "Apache-2.0")]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_nearest_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = {}
    for r in nearest(rows.filter("vec_id % 5 = 0"), rows, k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    pdf = rows.toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = pdf["vec_id"].to_numpy(), 0
    for q in np.flatnonzero(ids % 5 == 0):
        score = x @ x[q]
        best = [ids[i] for i in np.lexsort((ids, -score)) if i != q][:5]
        own = sorted(found[ids[q]])
        hits += len(set(best) & {v for _, v, _ in own})
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in own)
    assert hits / (5 * (ids % 5 == 0).sum()) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest(df.filter("vec_id IN (0, 5, 10)"), df, k=3, probes=729).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]
    assert nearest(df.limit(0), df, k=3).count() == 0 and nearest(df, df.limit(0), k=3).count() == 0


def test_neighbours_send_no_table_through_the_driver(spark, sf):
    """A query's visits shuffle to very little, as its vector repeats, and are large once read."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = nearest(rows.filter("vec_id % 5 = 0"), rows, k=5)
    assert found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [3e300, 0.0]), (3, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest(df.filter("vec_id = 0"), df, k=3, probes=729).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and np.allclose([r[3] for r in got], [1, 0.5**0.5, 0.5**0.5], rtol=1e-15)


def test_ids_with_many_vectors(spark):
    """Six vectors of id 7 and three of the query's own id leave room for the others."""
    rows = [(0, [9, 9]), (0, [8, 8]), (0, [7, 7])] + [(7, [50 + k, 50]) for k in range(6)] + [(k, [k, 1]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
    query = spark.createDataFrame([(0, [9, 9])], "query_id long, vector array<bigint>")
    got = exact_top_k(query, df, k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, 945), (5, 54), (4, 45), (3, 36), (2, 27)]
    near = nearest(df.filter("vec_id = 0"), df, k=5, vector_col="vector", probes=729).filter("rank <= 5").collect()
    assert {r["vec_id"] for r in near} == {7, 1, 2, 3, 4}


def test_exact_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-3, 4, 4).tolist()) for k in range(300)] + [(7, [9, 9, 9, 9]), (300, None), (301, [1, None, 1, 1]), (302, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
    got = {}
    for r in exact_top_k(df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), df, k=5, query_tile=3, row_tile=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 50):
        own, best = dict(rows[:300])[q], {}
        for i, v in rows[:301]:
            if i != q:
                best[i] = max(best.get(i, -(10**9)), int(np.dot(own, v)))
        wanted = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[q]) == [(k, i, s) for k, (i, s) in enumerate(wanted, 1)]
    big = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20, 3]), (2, [2**40, 0])], "vec_id long, vector array<bigint>")
    top = exact_top_k(big.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), big, k=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in top] == [(2, 2**63 - 1), (1, 2**60 + 3)]


def test_bit_sliced_comparison():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(20)]))
    rng.shuffle(fps)
    group = np.sort(rng.integers(0, 3, len(fps)))
    for radius in (0, 1, 2, 3, 20, 31, 62):
        a, b = near_in_groups(fps, group, np.zeros(len(fps), np.int64), radius)
        wanted = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius}
        assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == wanted and len(a) == len(wanted)
    side = rng.integers(0, 2, len(fps))
    a, b = near_in_groups(fps, np.zeros(len(fps), np.int64), side, 2)
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if side[i] == 0 and side[j] == 1 and bin(int(fps[i] ^ fps[j])).count("1") <= 2}


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_links_of_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 6).tolist()
    fps += [int(x) ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)) for x in fps for n in (1, 3, 4, 9, 10)]
    near = {frozenset((x, y)) for x in fps for y in fps if x != y and bin(x ^ y).count("1") <= radius}
    found = link(spark.createDataFrame([(x,) for x in set(fps)], "fp long"), radius).collect()
    label = {x: x for x in fps}
    for edges in (near, {frozenset(e) for e in found}):
        own = dict(label)
        for _ in fps:
            for e in edges:
                own |= dict.fromkeys(e, min(own[x] for x in e))
        if edges is near:
            wanted = own
    assert own == wanted
    with pytest.raises(ValueError):
        link(spark.createDataFrame([(1,)], "fp long"), 63)


def test_many_texts_without_words(spark):
    rows = spark.range(10_000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN ' \n ' END AS text")
    assert near_duplicates(rows).filter("fp = 0 AND component_id = 0").count() == 10_000


def test_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(50, 60), (60, 70), (-5, 70), (3, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[k] == 0 for k in range(1, 31)) and {found[50], found[60], found[70]} == {-5}


def test_near_duplicates(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    prints = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(lower))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids, least = sorted(prints), {i: i for i in prints}
    for _ in range(6):
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    least[i] = least[j] = min(least[i], least[j])
    assert got == {i: (prints[i], least[i]) for i in ids}
    rows = near_duplicates(odd).collect()
    assert len(rows) == 12 and {r["component_id"] for r in rows if r["fp"] == 0} == {0} and {r["component_id"] for r in rows if r["doc_id"] is None} == {6}
    assert near_duplicates(empty).count() == 0


def held_out_rows(scores, labels, name):
    joined = scores.join(labels, "doc_id").filter("held_out").select("score", "predicted", name).collect()
    return [(r["score"], r["predicted"], r[name]) for r in joined]


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    scores = queries.op9_quality(spark, sf)
    rows = held_out_rows(scores, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.95 and all(0 <= s <= 1 for s, _, _ in rows)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scores = queries.op7_toxicity(spark, sf)
    rows = held_out_rows(scores, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert np.mean([p == y for _, p, y in rows]) > 0.97
    assert np.mean([p for _, p, y in rows if y == 1]) > 0.85


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7} and w{k % 5} the w{k % 3}, of") for k in range(60)], "doc_id long, text string")
    one, many = quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(50))
    assert (one == many).all()
    places, signs = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.SIZE))
    for k in range(60):
        found, _ = words.tokens([f"w{k % 7} and w{k % 5} the w{k % 3}, of".encode()], quality.BUCKETS)
        for i, a in enumerate(found):
            for b in [*found[max(0, i - quality.WINDOW) : i], *found[i + 1 : i + 1 + quality.WINDOW]]:
                for j in range(places.shape[1]):
                    sums[a, places[b, j]] += signs[b, j]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(one, sums / np.where(length > 0, length, 1), atol=1e-6)
    pooled = quality.pool([b"w1 and w2", b""], one)
    v = [one[w] for w in words.tokens([b"w1 and w2"], quality.BUCKETS)[0]]
    by_hand = np.concatenate([np.mean(v, axis=0), sum(a * b for a, b in zip(v, v[1:], strict=False)) / len(v), [np.log1p(len(v)) / 10]])
    assert np.allclose(pooled[0], by_hand, atol=1e-5) and not pooled[1].any()


def test_positive_unlabelled_risk():
    """The estimate by hand, and its gradients by finite differences."""
    rng = np.random.default_rng(3)
    sets = [(np.repeat(np.arange(n), 4), rng.integers(0, 6, 4 * n), n) for n in (5, 9)]
    w, prior = rng.standard_normal(7), 0.3
    z = [np.array([w[col[row == k]].sum() + w[-1] for k in range(n)]) for row, col, n in sets]
    loss = lambda x: np.log1p(np.exp(-x)).mean()
    plus, rest, of_plus, of_rest = toxicity.risks(w, *sets, prior)
    assert np.isclose(plus, prior * loss(z[0])) and np.isclose(rest, loss(-z[1]) - prior * loss(-z[0]))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        high, low = toxicity.risks(w + step, *sets, prior), toxicity.risks(w - step, *sets, prior)
        assert np.isclose(of_plus[k], (high[0] - low[0]) / 2e-6, atol=1e-6) and np.isclose(of_rest[k], (high[1] - low[1]) / 2e-6, atol=1e-6)


def test_classifiers_take_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for score, train in ((quality.score_quality, quality.train), (toxicity.score_toxicity, toxicity.train)):
        out = score(odd, train(odd, labels))
        assert out.columns[:-1] == odd.columns and out.filter(f"`{out.columns[-1]}` BETWEEN 0 AND 1").count() == 12
        name = out.columns[-1]
        again = score(odd.withColumn(name, F.lit("own")), train(odd.withColumn(name, F.lit("own")), labels))
        assert sorted(again.columns) == sorted(out.columns) and again.schema[name].dataType.typeName() == "double"
        assert score(empty, train(empty, labels.limit(0))).count() == 0


def test_word_buckets():
    found, counts = words.tokens([b"The the THE!!", b"", "Élan élan 12".encode()], 1000)
    assert counts.tolist() == [4, 0, 3] and found[0] == found[1] != found[2] and found[2] < 8


def test_contract_columns(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    row = queries.op1_byte_bpe(spark, sf).filter("doc_id = 3").first()
    assert row["decoded_sha256"] == hashlib.sha256(docs[3].encode()).hexdigest()
    row = queries.op6_packing(spark, sf).filter("doc_id = 3").orderBy("start").first()
    t = Tokenizer.from_file(JSON)
    ids = np.array([*t.encode(docs[3], add_special_tokens=False).ids, 0], "<u4")
    assert row["doc_tokens"] == len(ids) and row["ids_crc32"] == zlib.crc32(ids[: row["length"]].tobytes())
    assert queries.op8_simhash(spark, sf).filter(F.length("fingerprint") != 16).count() == 0
