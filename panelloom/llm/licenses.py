"""Licence scan by sentence rules: known sentences have identifiers, licences are ordered lists of identifiers.

A text is cut into sentences three times, once with every line end as a boundary (short notices without a full stop before
them), once across lines (wrapped licence texts) and once across lines with the ends of colons and list marks. Sentences are normalised to lower-case letters and digits and
looked up; what is left of a document is a short sequence of identifiers, in which every rule is searched as an ordered
subsequence. All of it is one projection of DataFrame functions: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licence texts and notices.
SENTENCES = {
    "mit.notice": "Released under the MIT License",
    "mit.notice2": "Licensed under the MIT License",
    "mit.notice3": "This project is licensed under the MIT License",
    "mit.spdx": "SPDX-License-Identifier: MIT",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd.intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd.spdx2": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd.spdx3": "SPDX-License-Identifier: BSD-3-Clause",
    "apache.notice": "Licensed under the Apache License, Version 2.0",
    "apache.notice2": "This project is licensed under the Apache License, Version 2.0",
    "apache.spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache.grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3.spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl3.spdx2": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl2.spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl3.grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl.grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl.grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl.grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl.spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc.by": "Licensed under CC BY 4.0",
    "cc.bysa": "Licensed under CC BY-SA 4.0",
    "cc.bync": "Licensed under CC BY-NC 4.0",
    "cc.byncnd": "Licensed under CC BY-NC-ND 4.0",
    "cc.by.long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc.bysa.long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc.bync.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc.zero": "SPDX-License-Identifier: CC0-1.0",
    "apache.full": "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    "apache.full.copy": "You must give any other recipients of the Work or Derivative Works a copy of this License",
    "apache.full.marks": "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file",
    "gpl.full.copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl3.full.free": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl3.full.share": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users",
    "gpl2.full.share": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "agpl.full.free": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3.full.terms": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "lgpl2.full.libraries": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it",
    "lgpl3.spdx": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "agpl.spdx": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "mpl.full.grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
    "mpl.full.source": "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License",
    "epl.notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl.spdx": "SPDX-License-Identifier: EPL-2.0",
    "bsl.notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl.spdx": "SPDX-License-Identifier: BSL-1.0",
    "bsl.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib.spdx": "SPDX-License-Identifier: Zlib",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc.by.accept": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")",
    "cc.bysa.accept": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")",
    "unlicense.intro": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
#: Fixed values: (licence, identifiers that must occur in this order).
RULES = [
    ("MIT", ["mit.notice"]), ("MIT", ["mit.notice2"]), ("MIT", ["mit.notice3"]), ("MIT", ["mit.spdx"]),
    ("MIT", ["mit.grant", "mit.condition", "mit.warranty", "mit.liability"]),
    ("ISC", ["isc.grant", "isc.warranty"]),
    ("BSD-2-Clause", ["bsd.intro", "bsd.source", "bsd.binary", "bsd.warranty"]),
    ("BSD-3-Clause", ["bsd.intro", "bsd.source", "bsd.binary", "bsd.names", "bsd.warranty"]),
    ("BSD-2-Clause", ["bsd.spdx2"]), ("BSD-3-Clause", ["bsd.spdx3"]),
    ("Apache-2.0", ["apache.notice"]), ("Apache-2.0", ["apache.notice2"]), ("Apache-2.0", ["apache.spdx"]),
    ("Apache-2.0", ["apache.grant", "apache.copy", "apache.warranty"]),
    ("GPL-3.0", ["gpl3.notice"]), ("GPL-3.0", ["gpl3.spdx"]), ("GPL-3.0", ["gpl3.spdx2"]), ("GPL-2.0", ["gpl2.spdx"]),
    ("GPL-3.0", ["gpl3.grant", "gpl.warranty"]), ("GPL-2.0", ["gpl2.grant", "gpl.warranty"]),
    ("LGPL-2.1", ["lgpl.grant"]), ("AGPL-3.0", ["agpl.grant"]), ("MPL-2.0", ["mpl.grant"]), ("MPL-2.0", ["mpl.spdx"]),
    ("CC-BY-4.0", ["cc.by"]), ("CC-BY-SA-4.0", ["cc.bysa"]), ("CC-BY-NC-4.0", ["cc.bync"]),
    ("CC-BY-NC-ND-4.0", ["cc.byncnd"]), ("CC-BY-4.0", ["cc.by.long"]), ("CC-BY-SA-4.0", ["cc.bysa.long"]),
    ("CC-BY-NC-4.0", ["cc.bync.long"]), ("CC0-1.0", ["cc.zero"]), ("Unlicense", ["unlicense.intro"]),
    ("all-rights-reserved", ["reserved"]),
    ("Apache-2.0", ["apache.full", "apache.full.copy", "apache.full.marks"]),
    ("GPL-3.0", ["gpl.full.copies", "gpl3.full.free", "gpl3.full.share"]), ("GPL-2.0", ["gpl.full.copies", "gpl2.full.share"]),
    ("AGPL-3.0", ["gpl.full.copies", "agpl.full.free"]), ("AGPL-3.0", ["agpl.spdx"]),
    ("LGPL-3.0", ["gpl.full.copies", "lgpl3.full.terms"]), ("LGPL-3.0", ["lgpl3.spdx"]),
    ("LGPL-2.1", ["gpl.full.copies", "lgpl2.full.libraries"]),
    ("MPL-2.0", ["mpl.full.grant", "mpl.full.source"]), ("EPL-2.0", ["epl.notice"]), ("EPL-2.0", ["epl.spdx"]),
    ("BSL-1.0", ["bsl.notice"]), ("BSL-1.0", ["bsl.spdx"]), ("BSL-1.0", ["bsl.grant"]),
    ("Zlib", ["zlib.spdx"]), ("Zlib", ["zlib.warranty", "zlib.liable", "zlib.grant"]), ("0BSD", ["0bsd.grant", "isc.warranty"]),
    ("CC-BY-4.0", ["cc.by.accept"]), ("CC-BY-SA-4.0", ["cc.bysa.accept"]),
]
#: Each known sentence holds at least one of these, parts of single words, so a text without any has no known sentence.
TRIGGERS = ["licens", "derivative", "permission", "redistribut", "warrant", "liable", "reserved", "unencumbered", "copyright"]
#: Sentence ends: with line ends; across lines; and across lines with the ends of colons and list marks. A line without letters
#: and digits is blank, an address is between sentences, 'v.' ends none; a colon before a line end ends a sentence in the last cut.
_STOP = r"(?<![ \t\n,(][vV])[.!?]+"
COMMENT_LINE = _STOP + r"[ \t\r\f]+|\n"
COMMENT_ACROSS = _STOP + r"[ \t\r\n\f]+|\n[^a-zA-Z0-9\n]*(?=\n)|[ \t\r\n]+[^a-zA-Z0-9\n]*https?://[^ \t\r\n]+"
COMMENT_LIST = COMMENT_ACROSS + r"|:[ \t\r]*(?:\*/|-->)?[ \t\r]*\n|\n[^a-zA-Z0-9\n]*[0-9a-zA-Z]{1,2}[.)][ \t]+"
#: Words that begin comment lines.
_COMMENT_WORD = r"(?im)^[ \t]*@?(?:dnl|rem)\b"
_OTHER = "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower()).strip()


def _normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), _OTHER, " "))


def rule_pattern(identifiers: list[str]) -> str:
    """Matches a space-joined, space-framed sequence that holds the identifiers in order, others between them or not."""
    return "".join(f"(.* )?{re.escape(i)} " if n else f" {re.escape(i)} " for n, i in enumerate(identifiers))


def covered(rule: list[str]) -> list[list[str]]:
    """Rules whose identifiers are a proper ordered part of this one's."""
    def inside(part):
        it = iter(rule)
        return all(x in it for x in part)

    return [other for _, other in RULES if other != rule and inside(other)]


def _sequence(text: Column, boundary: str, known: Column) -> Column:
    ids = F.transform(F.split(text, boundary), lambda s: F.try_element_at(known, _normalise(s)))
    return F.concat(F.lit(" "), F.array_join(F.array_compact(ids), " "), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, licenses (sorted, comma-joined), rules (identifier lists found),
    sentences (identifiers found across lines, in order) and n_sentences.

    Null and empty texts have none. Repeated rows stay, a null doc_id stays null, other columns are ignored, an empty
    table gives no rows. Where a longer rule holds, the rules that are an ordered part of it do not count.
    """
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (normalised(s), i)])
    low = F.lower("text")
    any_trigger = F.lit(False)
    for t in TRIGGERS:
        any_trigger = any_trigger | F.contains(low, F.lit(t))
    some = docs.select("doc_id", F.when(any_trigger, F.col("text")).alias("_text"))
    some = some.withColumn("_text", F.regexp_replace("_text", _COMMENT_WORD, ""))
    found = some.select("doc_id", *[_sequence(F.col("_text"), cut, known).alias(name) for name, cut in
                                    (("_lines", COMMENT_LINE), ("_across", COMMENT_ACROSS), ("_lists", COMMENT_LIST))])
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" ".join(ids)).alias("ids"), F.lit(rule_pattern(ids)).alias("pattern"),
                               F.array(*[F.lit(" ".join(c)) for c in covered(ids)]).cast("array<string>").alias("covers"))
                      for name, ids in RULES])
    hits = F.filter(table, lambda r: F.rlike("_lines", r["pattern"]) | F.rlike("_across", r["pattern"]) | F.rlike("_lists", r["pattern"]))
    empty = (F.col("_lines") == "  ") & (F.col("_across") == "  ") & (F.col("_lists") == "  ")
    found = found.withColumn("_hits", F.when(F.col("_lines").isNotNull() & ~empty, hits))
    count = lambda c: F.size(F.array_remove(F.split(c, " "), ""))
    found = found.withColumn("_across", F.when(count("_lists") > count("_across"), F.col("_lists")).otherwise(F.col("_across")))
    kept = F.filter("_hits", lambda r: ~F.exists("_hits", lambda o: F.array_contains(o["covers"], r["ids"])))
    found = found.withColumn("_kept", kept)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("_kept", lambda r: r["name"]))), ",")
    return found.select("doc_id", F.coalesce(names, F.lit("")).alias("licenses"),
                        F.coalesce(F.array_join(F.transform("_kept", lambda r: r["ids"]), ","), F.lit("")).alias("rules"),
                        F.coalesce(F.trim("_across"), F.lit("")).alias("sentences"),
                        F.when(F.col("_across").isNotNull(), count("_across")).otherwise(0).cast("long").alias("n_sentences"))


#: The same cuts for an engine without lookaround, on text in which LINE_END stands before each line end and KEPT_STOP or KEPT_MARK
#: for the stop after a 'v': a blank line is cut from its own line end up to the next LINE_END, and leaves the next line end in place.
KEPT_STOP, KEPT_MARK, LINE_END = "\x01", "\x02", "\x05"
SQL_LINE = r"[.!?]+[ \t\r\f]+|\n"
SQL_ACROSS = (r"[.!?]+[ \t\r\n\f\x05]+|\n[^a-zA-Z0-9\n\x05]*\x05|[ \t\r\n\x05]+[^a-zA-Z0-9\n\x05]*https?://[^ \t\r\n\x05]+")
SQL_LIST = SQL_ACROSS + r"|:[ \t\r]*(\*/|-->)?[ \t\r]*\x05\n|\n[^a-zA-Z0-9\n\x05]*[0-9a-zA-Z]{1,2}[.)\x01][ \t]+"


def oracle_sql() -> str:
    """The scan as DuckDB SQL, from the same tables: sentences are rows, joined to the known ones and listed again."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    mark = lambda s: f"chr({ord(s)})"
    known = ", ".join(f"({quote(normalised(s))}, {quote(i)})" for i, s in SENTENCES.items())
    rules = ", ".join(f"({n}, {quote(name)}, {quote(' '.join(ids))}, {quote(rule_pattern(ids))}, "
                      f"[{', '.join(quote(' '.join(c)) for c in covered(ids))}]::VARCHAR[])" for n, (name, ids) in enumerate(RULES))
    after_v = r"([ \t\n,(][vV])"
    plain = (f"translate(text, {mark(KEPT_STOP)} || {mark(KEPT_MARK)} || {mark(LINE_END)}, repeat(chr(3), 3))")
    plain = rf"regexp_replace({plain}, '(?i)(^|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])[ \t]*@?(dnl|rem)\b', '\1', 'g')"
    plain = rf"regexp_replace({plain}, '{after_v}\.', '\1' || {mark(KEPT_STOP)}, 'g')"
    plain = rf"regexp_replace({plain}, '{after_v}[!?]', '\1' || {mark(KEPT_MARK)}, 'g')"
    cut = lambda mode, boundary, text: (
        f"SELECT doc_id, {mode} AS mode, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM "
        f"(SELECT doc_id, regexp_split_to_array({text}, {quote(boundary)}) AS parts FROM plain)")
    ended = f"replace(text, chr(10), {mark(LINE_END)} || chr(10))"
    return f"""
        WITH known(sentence, id) AS (VALUES {known}), rules(n, name, ids, pattern, covers) AS (VALUES {rules}),
        plain AS (SELECT doc_id, {plain} AS text FROM documents WHERE text IS NOT NULL),
        parts AS ({cut(0, SQL_LINE, 'text')} UNION ALL {cut(1, SQL_ACROSS, ended)} UNION ALL {cut(2, SQL_LIST, ended)}),
        found AS (SELECT doc_id, mode, pos, id FROM parts JOIN known
                  ON trim(regexp_replace(lower(part), '{_OTHER}', ' ', 'g')) = sentence),
        sequences AS (SELECT doc_id, mode, string_agg(id, ' ' ORDER BY pos) AS seq, count(*) AS n FROM found GROUP BY ALL),
        hits AS (SELECT DISTINCT doc_id, rules.n, name, ids, covers FROM sequences JOIN rules
                 ON regexp_matches(' ' || seq || ' ', pattern)),
        kept AS (SELECT * FROM hits h WHERE NOT EXISTS
                 (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND list_contains(o.covers, h.ids))),
        named AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses,
                         string_agg(ids, ',' ORDER BY n) AS rules FROM kept GROUP BY doc_id),
        longest AS (SELECT doc_id, arg_max(seq, 10 * n - mode) AS seq, max(n) AS n FROM sequences WHERE mode > 0 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(named.rules, '') AS rules, coalesce(seq, '') AS sentences,
               coalesce(s.n, 0)::BIGINT AS n_sentences
        FROM documents d LEFT JOIN named USING (doc_id) LEFT JOIN longest s USING (doc_id)"""
