"""Licence scans by sentence rules, in DataFrame operations only.

A text is normalised (A-Z in lower case, runs of anything but a-z and 0-9 as one space) and cut into parts at sentence
ends (. ! ? before white space or the end) and at lines without letters or digits; a part is one or more lines. Every
run of a part's lines, joined by spaces, is looked up in a map from normalised licence sentences to identifiers, so
hard-wrapped texts and comment blocks count like sentences on one line. Only runs whose first line begins a known
sentence are tried, up to the number of words of the longest one, as a line has a word at least. Of runs that begin at
one line the longest counts, and none that lies within another. List numbers (one or two digits or a letter alone in
their part) and addresses of licences are left out; any other line is ``_``. The resulting identifier sequence is
matched against rules, each an ordered sequence of identifiers that has to occur without a gap. Rules are tried in
their order and a match uses up its identifiers, so a full licence text does not also count as each of its parts.

A rule's longest sentence has to occur, so only texts that hold one of a few words, one of each such sentence, are
cut at all.

Everything is one projection over the scan: nothing is shuffled, exploded or broadcast. The sentence and rule
tables are parameters of fixed size. Defined results: null or empty texts and texts without known sentences have
no licence (0 rules, empty string); very long texts are read whole, in one row as they are; a null ``doc_id`` is
carried; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, by identifier.
SENTENCES: dict[str, str] = {
    "mit-short": "Released under the MIT License",
    "mit-short2": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-title2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-grant-only": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-short2": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-more": "See the GNU General Public License for more details",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ccbync4-short": "Licensed under CC BY-NC 4.0",
    "ccby4-short": "Licensed under CC BY 4.0",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-version": "2.0",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl1-short": "Distributed under the Boost Software License, Version 1.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "dual-mit-apache": "Dual licensed under the MIT License or the Apache License, Version 2.0",
    "dual-apache-mit": "Dual licensed under the Apache License, Version 2.0 or the MIT License",
    "dual-either": "Licensed under either of Apache License, Version 2.0 or MIT license at your option",
}
# Names of licences in a line that states one.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "Zlib", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"]
SENTENCES |= {f"spdx-{name.lower().replace(' ', '-')}": f"SPDX-License-Identifier: {name}" for name in SPDX}
# Fixed values: (rule, licence, identifiers in order), longer rules before their parts.
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-full", "MIT", ["mit-grant", "mit-as-is", "mit-liability"]),
    ("mit-lines", "MIT", ["mit-grant-only", "mit-notice", "mit-as-is", "mit-liability"]),
    ("apache-full", "Apache-2.0", ["apache-header", "apache-copy", "apache-basis", "apache-see"]),
    ("gpl3-full", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-more"]),
    ("gpl2-full", "GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-more"]),
    ("bsd3-full", "BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd2-full", "BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit-grant-lines", "MIT", ["mit-grant-only", "mit-notice"]),
    ("apache-header", "Apache-2.0", ["apache-header"]),
    ("gpl3-grant", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl2-grant", "GPL-2.0-or-later", ["gpl2-free"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("mit-title", "MIT", ["mit-title"]),
    ("mit-title2", "MIT", ["mit-title2"]),
    ("mit-short", "MIT", ["mit-short"]),
    ("mit-short2", "MIT", ["mit-short2"]),
    ("apache-short", "Apache-2.0", ["apache-short"]),
    ("gpl3-short", "GPL-3.0-only", ["gpl3-short"]),
    ("gpl3-short2", "GPL-3.0-only", ["gpl3-short2"]),
    ("ccbync4-short", "CC-BY-NC-4.0", ["ccbync4-short"]),
    ("ccby4-short", "CC-BY-4.0", ["ccby4-short"]),
    ("ccbysa4-short", "CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("ccby4-work", "CC-BY-4.0", ["ccby4-work"]),
    ("ccbync4-work", "CC-BY-NC-4.0", ["ccbync4-work"]),
    ("lgpl21-grant", "LGPL-2.1-or-later", ["lgpl21-free"]),
    ("lgpl3-grant", "LGPL-3.0-or-later", ["lgpl3-free"]),
    ("agpl3-grant", "AGPL-3.0-or-later", ["agpl3-free"]),
    ("mpl2-header", "MPL-2.0", ["mpl2-form", "mpl2-version"]),
    ("epl2-terms", "EPL-2.0", ["epl2-terms"]),
    ("bsl1-short", "BSL-1.0", ["bsl1-short"]),
    ("unlicense", "Unlicense", ["unlicense-free"]),
    ("cc0-dedication", "CC0-1.0", ["cc0-dedication"]),
    ("zlib-grant", "Zlib", ["zlib-grant"]),
    ("dual-mit-apache", "MIT OR Apache-2.0", ["dual-mit-apache"]),
    ("dual-apache-mit", "MIT OR Apache-2.0", ["dual-apache-mit"]),
    ("dual-either", "MIT OR Apache-2.0", ["dual-either"]),
]
RULES += [(f"spdx-{name.lower().replace(' ', '-')}", name, [f"spdx-{name.lower().replace(' ', '-')}"]) for name in SPDX]

# Addresses that may stand between sentences or end the sentence ``apache-copy``.
LINKS = ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"]

# Patterns and alphabets that Java and DuckDB read alike.
END = r"[.!?]+([ \t\n\r\f\x0B]+|\z)"
MARK = r"^[ \t]*@?(rem|dnl)[ \t]+"
BLANK = r"\n[^a-z0-9\x01]*\n"
OTHER = r"[^a-z0-9\n\x01]+"
NUMBER = "^([0-9]{1,2}|[a-z])$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence end or a blank line in a normalised text.
HARD = "\u0001"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def table_of(sentences: dict[str, str]) -> dict[str, str]:
    """Identifier, in brackets, by normalised sentence."""
    known = {normalised(x): f"[{name}]" for name, x in sentences.items() if normalised(x)}
    if "apache-copy" in sentences:
        known |= {normalised(f"{sentences['apache-copy']} {url}"): "[apache-copy]" for url in LINKS}
    return known


def hints(sentences: dict[str, str]) -> list[str]:
    """Words of which each sentence holds one: long ones, as few as a greedy choice gives."""
    left, out = [set(normalised(s).split()) for s in sentences.values()], []
    while left := [words for words in left if not words & set(out)]:
        longest = [{w for w in words if len(w) >= 7} or {max(sorted(words), key=len)} for words in left if words]
        if not longest:
            break
        out.append(max(sorted(set().union(*longest)), key=lambda w: sum(w in own for own in longest)))
    return out


def parts(text: Column) -> Column:
    """A text's parts, each the array of its normalised lines."""
    t = F.translate(F.regexp_replace(text, "(?imd)" + MARK, ""), UPPER, LOWER)
    t = F.regexp_replace(F.regexp_replace(t, END, HARD), BLANK, HARD)
    t = F.regexp_replace(t, OTHER, " ")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.split(t, HARD), lines)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sequence(lines: Column, known: dict[str, str], links: list[str]) -> Column:
    """The identifier sequence of one part as a string."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    sentences = F.array(*[F.lit(k) for k in known])
    first = sorted({k.split(" ")[0] for k in known})
    longest = max(len(k.split(" ")) for k in known)
    begins = lambda x: F.substring_index(x, " ", 1).isin(first) & F.exists(sentences, lambda k: (k == x) | k.startswith(F.concat(x, F.lit(" "))))

    def run(i: Column) -> Column:
        name = lambda x: F.when(x.isin(list(known)), F.try_element_at(table, x))
        to = lambda j: F.struct(i.alias("i"), j.alias("j"), _let(F.array_join(F.slice(lines, i + 1, j - i + 1), " "), name).alias("id"))
        found = F.filter(F.transform(F.sequence(i, F.least(i + longest, F.size(lines)) - 1), to), lambda r: r["id"].isNotNull())
        return F.try_element_at(found, F.lit(-1))

    runs = F.array_compact(F.transform(lines, lambda x, i: F.when(begins(x), run(i))))
    outer = lambda all_: F.filter(all_, lambda r: ~F.exists(all_, lambda o: (o["i"] < r["i"]) & (o["j"] >= r["j"])))
    left_out = lambda x: x.isin(links) | ((F.size(lines) == 1) & x.rlike(NUMBER))

    def shown(whole: Column) -> Column:
        at = lambda i: F.try_element_at(F.filter(whole, lambda r: r["i"] == i), F.lit(1))["id"]
        within = lambda i: F.exists(whole, lambda r: (r["i"] < i) & (r["j"] >= i))
        return F.array_join(F.transform(lines, lambda x, i: F.coalesce(at(i), F.when(within(i) | left_out(x), F.lit("")).otherwise(F.lit("_")))), "")

    # lines of a part in which no sentence begins need no search
    plain = F.array_join(F.transform(lines, lambda x: F.when(left_out(x), F.lit("")).otherwise(F.lit("_"))), "")
    return F.when(F.exists(lines, begins), _let(_let(runs, outer), shown)).otherwise(plain)


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES, words: list[str] | None = None) -> Column:
    """The text's identifier sequence as one string, e.g. ``_[mit-short]__``; empty if none of ``words`` (by default one
    of each sentence) occurs."""
    known = table_of(sentences)
    some = F.lit(False)
    for word in hints(sentences) if words is None else words:
        some = some | F.translate(text, UPPER, LOWER).contains(word)
    seq = F.array_join(F.transform(parts(text), lambda lines: _sequence(lines, known, [normalised(u) for u in LINKS])), "")
    return F.when(F.coalesce(some, F.lit(False)), seq).otherwise(F.lit(""))


def licence_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """doc_id, n_matches long, licences string: licence:rule:times of each rule that matched, comma-joined in rule order."""
    longest = {rule: max((sentences[x] for x in ids), key=lambda x: len(normalised(x))) for rule, _, ids in rules}
    rows = docs.select("doc_id", identifiers(F.col("text"), sentences, hints(longest)).alias("seq0"))
    table = F.array(*[F.struct(F.lit("".join(f"[{x}]" for x in ids)).alias("pattern"), F.lit(f"{name}:{rule}:").alias("label")) for rule, name, ids in rules])
    start = F.struct(F.col("seq0").alias("seq"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("shown"))

    def step(a: Column, rule: Column) -> Column:
        left = F.replace(a["seq"], rule["pattern"], F.lit("_"))
        times = ((F.length(a["seq"]) - F.length(left)) / (F.length(rule["pattern"]) - 1)).cast("long")
        more = F.when(times > 0, F.array(F.concat(rule["label"], times.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(left.alias("seq"), (a["n"] + times).alias("n"), F.concat(a["shown"], more).alias("shown"))

    # only the few documents with a known sentence have anything to match
    rows = rows.withColumn("found", F.when(F.col("seq0").contains("["), F.aggregate(table, start, step)))
    return rows.select("doc_id", F.coalesce("found.n", F.lit(0).cast("long")).alias("n_matches"), F.coalesce(F.array_join("found.shown", ","), F.lit("")).alias("licences"))


def oracle() -> str:
    """The same in DuckDB: lines as rows, sentences by joins, rules as a chain of replacements."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = table_of(SENTENCES)
    known = ", ".join(f"({quote(x)}, '{name}')" for x, name in table.items())
    longest = max(len(x.split()) for x in table)
    links = ", ".join(quote(normalised(u)) for u in LINKS)
    steps, prior = [], "s0"
    for i, (_, _, ids) in enumerate(RULES):
        pattern = "".join(f"[{x}]" for x in ids)
        steps.append(f"s{i + 1} AS (SELECT *, replace(q{i}, '{pattern}', '_') AS q{i + 1} FROM {prior})")
        prior = f"s{i + 1}"
    count = lambda i: f"((length(q{i}) - length(q{i + 1})) // {len(''.join(f'[{x}]' for x in RULES[i][2])) - 1})"
    shown = ", ".join(f"CASE WHEN {count(i)} > 0 THEN '{name}:{rule}:' || {count(i)} END" for i, (rule, name, _) in enumerate(RULES))
    total = " + ".join(count(i) for i in range(len(RULES)))
    return f"""
WITH known(sentence, id) AS (VALUES {known}
), d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), p AS (
  SELECT r, string_split(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '(?im){MARK}', '', 'g'), '{UPPER}', '{LOWER}'),
    '{END}', chr(1), 'g'), '{BLANK}', chr(1), 'g'), '{OTHER}', ' ', 'g'), chr(1)) AS ps FROM d
), g AS MATERIALIZED (
  SELECT r, n, list_filter(list_transform(string_split(ps[n], chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS n FROM p)
), b AS (
  SELECT r, n, ls, i FROM (SELECT r, n, ls, unnest(range(1, len(ls) + 1)) AS i FROM g) WHERE split_part(ls[i], ' ', 1) IN (SELECT split_part(sentence, ' ', 1) FROM known)
), w AS (
  SELECT r, n, i, j, array_to_string(ls[i:j], ' ') AS x FROM (SELECT *, unnest(range(i, least(i + {longest}, len(ls) + 1))) AS j FROM b)
), m AS (
  SELECT r, n, i, max(j) AS j, arg_max(id, j) AS id FROM w JOIN known ON x = sentence GROUP BY r, n, i
), k AS MATERIALIZED (
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.r = m.r AND o.n = m.n AND o.i < m.i AND o.j >= m.j)
), l AS (
  SELECT r, n, ls, unnest(range(1, len(ls) + 1)) AS i FROM g WHERE r IN (SELECT r FROM k)
), q AS (
  SELECT l.r, string_agg(coalesce(k.id, CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.r = l.r AND o.n = l.n AND o.i < l.i AND o.j >= l.i)
    OR ls[l.i] IN ({links}) OR (len(ls) = 1 AND regexp_matches(ls[l.i], '{NUMBER}')) THEN '' ELSE '_' END), '' ORDER BY l.n, l.i) AS q0
  FROM l LEFT JOIN k ON k.r = l.r AND k.n = l.n AND k.i = l.i GROUP BY l.r
), s0 AS (
  SELECT d.doc_id, coalesce(q.q0, '') AS q0 FROM d LEFT JOIN q USING (r)
), {", ".join(steps)}
SELECT doc_id, CAST({total} AS BIGINT) AS n_matches, concat_ws(',', {shown}) AS licences FROM {prior}
"""
