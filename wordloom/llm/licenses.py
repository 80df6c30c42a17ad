"""Licence scans by known sentences and ordered rules (operator 4).

A text is cut into sentences: at ``.!?:;`` before white space, and at lines
without letters and digits.  Licence texts are wrapped and stand in comments,
so other line ends are white space, and signs count for nothing: a sentence is
normalised to ASCII lower case with everything but letters and digits one
blank.  A sentence that is not known is cut at its line ends as well, so that
titles and notices on lines of their own are found.

Known sentences become identifiers.  A rule is a sequence of identifiers that
must follow each other; rules are tried in order at each known sentence, and a
match within a longer one is left out.

Everything is built-in Spark functions; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: "v. 2.0" is no end of a sentence: its point goes.
VERSION = r"([ (,\n][vV])[.][ \t\r\n#*/;%-]*([0-9])"
SPLIT = r"[.!?:;][ \t\r\n]+|\n[^A-Za-z0-9\n]*\n"
#: Openings of notices, all of which become "under".
OPENING = (
    r"^(this (project|software|work|file|code|library|program|package|document|repository|material|content|source code|module) (is|are) |it is |all (code|content) is |code is |content is )?(dual )?"
    r"(licensed|released|distributed|available|made available|provided|published|offered|shared|redistributed)( to you| here)? under (the )?(terms of (the )?)?(terms and conditions of (the )?)?"
)

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    # notices, without their opening
    "apache-notice": "under apache license version 2 0",
    "apache-notice-defined": "under apache license version 2 0 the license",
    "apache-notice-short": "under apache license 2 0",
    "apache-notice-spdx": "under apache 2 0 license",
    "mit-notice": "under mit license",
    "mit-notice-short": "under mit",
    "gpl2-notice": "under gnu general public license version 2",
    "gpl2-notice-v": "under gnu general public license v2 0",
    "gpl3-notice": "under gnu general public license version 3",
    "gpl3-notice-v": "under gnu general public license v3 0",
    "gpl3-notice-short": "under gplv3",
    "lgpl-notice": "under gnu lesser general public license version 2 1",
    "lgpl3-notice": "under gnu lesser general public license version 3",
    "agpl3-notice": "under gnu affero general public license version 3",
    "bsd-notice": "under bsd 3 clause license",
    "bsd-notice-new": "under 3 clause bsd license",
    "bsd2-notice": "under bsd 2 clause license",
    "bsd2-notice-simplified": "under 2 clause bsd license",
    "isc-notice": "under isc license",
    "mpl-notice-short": "under mozilla public license version 2 0",
    "mpl-notice-v": "under mozilla public license v2 0",
    "epl-notice": "under eclipse public license version 2 0",
    "bsl-notice": "under boost software license version 1 0",
    "zlib-notice": "under zlib license",
    "unlicense-notice": "under unlicense",
    "cc-by-nc-notice": "under cc by nc 4 0",
    "cc-by-notice": "under cc by 4 0",
    "cc-by-sa-notice": "under cc by sa 4 0",
    "cc-by-notice-full": "under a creative commons attribution 4 0 international license",
    "cc-by-sa-notice-full": "under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-notice-full": "under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "under cc0 1 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    # Apache-2.0
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-https": "https www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "apache-copyright-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    # MIT
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-title-both": "the mit license mit",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-grant-to": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    # BSD
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    # ISC
    "isc-title": "isc license",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-permission-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    # GPL, LGPL, AGPL
    "gpl-free": "this program is free software",
    "gpl-free-library": "this library is free software",
    "gpl-published": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-published": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2-1": "either version 2 1 of the license or at your option any later version",
    "either-3": "either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope-library": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-details": "see the gnu affero general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    # MPL, EPL, Unlicense, CC0, Zlib, BSL
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-terms-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-copy": "you should have received a copy of the cc0 public domain dedication along with this software",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-permission": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "bsl-permission": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "reserved": "all rights reserved",
}

# Rules in order: name, licence, identifiers in a row.
RULES = [
    ("apache-header", "Apache-2.0", ["apache-notice-defined", "apache-compliance", "apache-obtain", "apache-url"]),
    ("apache-header-https", "Apache-2.0", ["apache-notice-defined", "apache-compliance", "apache-obtain", "apache-url-https"]),
    ("apache-header-short", "Apache-2.0", ["apache-notice-defined", "apache-compliance"]),
    ("apache-unless", "Apache-2.0", ["apache-unless", "apache-see"]),
    ("mit-full", "MIT", ["mit-permission", "mit-grant-to", "mit-warranty", "mit-liability"]),
    ("mit-conditions", "MIT", ["mit-permission", "mit-grant-to"]),
    ("mit-disclaimer", "MIT", ["mit-warranty", "mit-liability"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("lgpl21-header", "LGPL-2.1-or-later", ["gpl-free-library", "lgpl21-redistribute", "gpl-hope-library", "gpl-implied", "lgpl-details"]),
    ("lgpl3-header", "LGPL-3.0-or-later", ["gpl-free", "lgpl3-redistribute", "gpl-hope", "gpl-implied", "lgpl-details"]),
    ("agpl3-header", "AGPL-3.0-or-later", ["gpl-free", "agpl3-redistribute", "gpl-hope", "gpl-implied", "agpl-details"]),
    ("gpl2-terms-parted", "GPL-2.0-or-later", ["gpl-free", "gpl-published", "either-2"]),
    ("gpl3-terms-parted", "GPL-3.0-or-later", ["gpl-free", "gpl-published", "either-3"]),
    ("lgpl21-terms-parted", "LGPL-2.1-or-later", ["gpl-free-library", "lgpl-published", "either-2-1"]),
    ("gpl2-terms", "GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute"]),
    ("gpl3-terms", "GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute"]),
    ("lgpl21-terms", "LGPL-2.1-or-later", ["gpl-free-library", "lgpl21-redistribute"]),
    ("lgpl3-terms", "LGPL-3.0-or-later", ["gpl-free", "lgpl3-redistribute"]),
    ("lgpl3-library-terms", "LGPL-3.0-or-later", ["gpl-free-library", "lgpl3-redistribute"]),
    ("agpl3-terms", "AGPL-3.0-or-later", ["gpl-free", "agpl3-redistribute"]),
    ("gpl-warranty", "GPL", ["gpl-hope", "gpl-implied", "gpl-details"]),
    ("mpl-header", "MPL-2.0", ["mpl-notice", "mpl-copy-https"]),
    ("mpl-header-http", "MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("zlib-text", "Zlib", ["zlib-warranty", "zlib-liability", "zlib-permission"]),
    ("notice-mit-reserved", "MIT", ["mit-notice", "reserved"]),
    ("notice-apache-reserved", "Apache-2.0", ["apache-notice", "reserved"]),
]

# Licences of single sentences, each of which is a rule of its own after those above.
LICENCES = {
    "MIT": ["mit-notice", "mit-notice-short", "spdx-mit", "mit-title", "mit-title-the", "mit-title-both", "mit-permission", "mit-grant-to", "mit-warranty", "mit-liability"],
    "Apache-2.0": ["apache-notice", "apache-notice-defined", "apache-notice-short", "apache-notice-spdx", "spdx-apache", "apache-title", "apache-compliance", "apache-unless", "apache-see", "apache-copyright-grant"],
    "GPL": ["gpl-free", "gpl-hope", "gpl-details", "gpl-copy", "gpl-published"],
    "GPL-2.0": ["gpl2-notice", "gpl2-notice-v", "gpl2-title"],
    "GPL-2.0-or-later": ["gpl2-redistribute"],
    "GPL-3.0": ["gpl3-notice", "gpl3-notice-v", "gpl3-notice-short", "gpl3-title"],
    "GPL-3.0-or-later": ["gpl3-redistribute"],
    "LGPL": ["gpl-free-library", "gpl-hope-library", "lgpl-details", "lgpl-published"],
    "LGPL-2.1": ["lgpl-notice", "lgpl21-redistribute"],
    "LGPL-3.0": ["lgpl3-notice", "lgpl3-redistribute"],
    "AGPL-3.0": ["agpl3-notice", "agpl3-redistribute", "agpl-details"],
    "BSD-3-Clause": ["bsd-notice", "bsd-notice-new", "bsd-endorse"],
    "BSD-2-Clause": ["bsd2-notice", "bsd2-notice-simplified"],
    "BSD": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"],
    "ISC": ["isc-notice", "isc-title", "isc-permission", "isc-permission-and", "isc-warranty"],
    "0BSD": ["0bsd-permission"],
    "MPL-2.0": ["mpl-notice", "mpl-notice-short", "mpl-notice-v", "mpl-copy", "mpl-copy-https"],
    "EPL-2.0": ["epl-notice", "epl2-terms", "epl2-terms-v"],
    "CC-BY-NC-4.0": ["cc-by-nc-notice", "cc-by-nc-notice-full"],
    "CC-BY-4.0": ["cc-by-notice", "cc-by-notice-full"],
    "CC-BY-SA-4.0": ["cc-by-sa-notice", "cc-by-sa-notice-full"],
    "CC0-1.0": ["cc0-notice", "cc0-dedicated", "cc0-copy"],
    "Unlicense": ["unlicense-notice", "unlicense", "unlicense-anyone"],
    "Zlib": ["zlib-notice", "zlib-permission"],
    "BSL-1.0": ["bsl-notice", "bsl-title", "bsl-permission"],
    "Proprietary": ["reserved"],
}
RULES += [(name, licence, [name]) for licence, names in LICENCES.items() for name in names]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def scan(text: Column, sentences: dict[str, str] | None = None, rules: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """Matches in a text: an array of structs (rule, license, sentence from 1, n_sentences)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    number = {name: k for k, name in enumerate(sentences, 1)}
    table = F.create_map(*(F.lit(x) for name, s in sentences.items() for x in (s, number[name])))
    most = max(len(ids) for _, _, ids in rules)

    def known(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " "))
        return F.element_at(table, F.when(F.contains(plain, F.lit(" under ")), F.regexp_replace(plain, OPENING, "under ")).otherwise(plain))

    def numbers(part: Column) -> Column:
        """Identifiers (or nulls) of the sentences in a part: the whole of it, what follows its first line, or its lines."""
        first, rest = F.substring_index(part, "\n", 1), F.substring(part, F.instr(part, "\n") + 1, F.length(part))
        lines = lambda: F.transform(F.split(part, "\n"), known)
        apart = _let(known(rest), lambda x: F.when(x.isNotNull(), F.array(known(first), x)).otherwise(lines()))
        return _let(known(part), lambda x: F.when(x.isNotNull() | ~F.contains(part, F.lit("\n")), F.array(x)).otherwise(apart))

    def rule_at(ids: Column, k: Column) -> Column:
        found = F.lit(None).cast("struct<rule:string,license:string,n:int>")
        for name, licence, sequence in reversed(rules):
            hit = F.lit(True)
            for j, each in enumerate(sequence):
                x = F.get(ids, k + j)
                hit &= F.coalesce((x["id"] == number[each]) & (x["at"] == F.get(ids, k)["at"] + j), F.lit(False))
            found = F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("license"), F.lit(len(sequence)).alias("n"))).otherwise(found)
        return found

    def matches(ids: Column) -> Column:
        def outermost(found: Column) -> Column:
            def stays(x: Column, k: Column) -> Column:
                covered = F.lit(False)
                for j in range(1, most):
                    y = F.when(k >= j, F.get(found, k - j))
                    covered |= F.coalesce((y["m"]["n"] >= x["m"]["n"] + j) & (y["at"] + j == x["at"]), F.lit(False))
                return x["m"].isNotNull() & ~covered

            return F.transform(F.filter(found, stays), lambda x: F.struct(x["m"]["rule"].alias("rule"), x["m"]["license"].alias("license"), x["at"].alias("sentence"), x["m"]["n"].alias("n_sentences")))

        return _let(F.transform(ids, lambda x, k: F.struct(x["at"].alias("at"), rule_at(ids, k).alias("m"))), outermost)

    ids = F.flatten(F.transform(F.split(F.regexp_replace(text, VERSION, "$1 $2"), SPLIT), numbers))
    return _let(F.filter(F.transform(ids, lambda x, i: F.struct((i + 1).alias("at"), x.alias("id"))), lambda x: x["id"].isNotNull()), matches)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: doc_id, rule, license, sentence (from 1), n_sentences.

    Null and empty texts have no match; null and repeated ids are scanned row by
    row; an empty table gives no rows.  Nothing is shuffled.
    """
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.inline(scan(F.col(f"`{text_col}`").cast("string"))))


def oracle_sql(table: str = "documents") -> str:
    """The same result as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(name)})" for name, s in SENTENCES.items())
    branches = []
    for k, (name, licence, ids) in enumerate(RULES):
        joins = "".join(f" JOIN k k{j} ON k{j}.r = k0.r AND k{j}.pos = k0.pos + {j} AND k{j}.id = {quote(each)}" for j, each in enumerate(ids) if j)
        branches.append(f"SELECT k0.r, k0.doc_id, {quote(name)} AS rule, {quote(licence)} AS license, k0.pos, {len(ids)} AS n, {k} AS o FROM k k0{joins} WHERE k0.id = {quote(ids[0])}")
    plain = lambda s: f"regexp_replace(trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), '{OPENING}', 'under ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(text, '{VERSION}', '\\1 \\2', 'g'), '{SPLIT}') AS s FROM {table} WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS part FROM d),
names(sentence, id) AS (VALUES {known}),
w AS (SELECT u.*, n.id, instr(s, chr(10)) AS cut FROM u LEFT JOIN names n ON {plain('s')} = n.sentence),
x AS (SELECT w.*, n.id AS rest FROM w LEFT JOIN names n ON w.id IS NULL AND cut > 0 AND {plain('substring(s, cut + 1)')} = n.sentence),
lines AS (
  SELECT r, doc_id, part, 1 AS line, id, CAST(NULL AS VARCHAR) AS s FROM x WHERE id IS NOT NULL OR cut = 0
  UNION ALL SELECT r, doc_id, part, 1, NULL, substring(s, 1, cut - 1) FROM x WHERE rest IS NOT NULL
  UNION ALL SELECT r, doc_id, part, 2, rest, NULL FROM x WHERE rest IS NOT NULL
  UNION ALL SELECT r, doc_id, part, generate_subscripts(string_split(s, chr(10)), 1), NULL, unnest(string_split(s, chr(10))) FROM x WHERE id IS NULL AND rest IS NULL AND cut > 0),
numbered AS (SELECT r, doc_id, id, s, row_number() OVER (PARTITION BY r ORDER BY part, line) AS pos FROM lines),
k AS MATERIALIZED (SELECT r, doc_id, pos, coalesce(l.id, n.id) AS id FROM numbered l LEFT JOIN names n ON l.s IS NOT NULL AND {plain('l.s')} = n.sentence WHERE coalesce(l.id, n.id) IS NOT NULL),
m AS ({' UNION ALL '.join(branches)}),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY o) = 1)
SELECT doc_id, rule, license, CAST(pos AS INTEGER) AS sentence, n AS n_sentences FROM best b
WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.r = b.r AND y.pos < b.pos AND y.pos + y.n >= b.pos + b.n)"""
