"""Licence scans by sentence rules, with DataFrame operations only.

Comment marks at line starts go. End marks before white space, and line ends, may close a sentence or stand inside one (as
in "v. 2.0" and in wrapped lines), so they are kept as marks, and a known sentence is met from any mark to any other, with
marks among its words. Known sentences, normalised to lower-case letters and digits, become identifiers, in order. Ordered rules, most special first, are runs of identifiers, with unknown sentences
between them allowed: each takes the runs it matches out of the sequence, so that a general rule never claims what a more
special one has explained. Both tables are fixed and small, so they are literals of the plan: no join, no shuffle. Every
known sentence holds one of a few stems, and only texts with a stem are cut at all.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Sentences of public licences and licence notices, as their publishers word them, by identifier; "..."
# stands for one to GAP words of any kind, and a list gives wordings that mean the same.
SENTENCES: dict[str, str | list[str]] = {
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)", "MIT License (MIT)", "The Expat License"],
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-title": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zero-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd2-title": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "bsd3-title": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by ...",
    "bsd-names": ["Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of ... nor the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of ... may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY ... \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-terms": "you may not use this file except in compliance with the License",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"],
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gnu-hope": ["This ... is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gnu-details": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "gnu-received": ["You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU Lesser General Public License along with this library", "You should have received a copy of the GNU Affero General Public License along with this program", "You should have received a copy of the GNU Lesser General Public License along with this program"],
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-title": ["Boost Software License - Version 1.0 - ...", "Boost Software License, Version 1.0", "Distributed under the Boost Software License, Version 1.0"],
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "cc0-waiver": "To the extent possible under law, ... has waived all copyright and related or neighboring rights to this work",
    "reserved": "All rights reserved",
}

# Licence identifiers and the names that notices give them.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT license terms"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is released under the {}")
# Identifiers that tags name besides those above.
TAGS = ("MIT-0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense", "WTFPL")

#: (rule, identifiers in order), most special first; an identifier that ends in "?" may be missing.
FORMS: list[tuple[str, tuple[str, ...]]] = [
    ("MIT:full", ("mit-title?", "mit-grant", "mit-condition", "mit-warranty?")),
    ("MIT-0:full", ("mit-title?", "mit0-grant", "mit-warranty?")),
    ("BSD-4-Clause:full", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-warranty?")),
    ("BSD-3-Clause:full", ("bsd3-title?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty?")),
    ("BSD-2-Clause:full", ("bsd2-title?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty?")),
    ("ISC:full", ("isc-title?", "isc-grant")),
    ("Apache-2.0:header", ("apache-header", "apache-copy", "apache-warranty?")),
    ("Apache-2.0:header", ("apache-notice", "apache-terms", "apache-copy", "apache-warranty?")),
    ("Apache-2.0:header", ("apache-header",)),
    ("GPL-2.0-or-later:header", ("gpl2-later", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("GPL-2.0-only:header", ("gpl2-only", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("GPL-3.0-or-later:header", ("gpl3-later", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("GPL-3.0-only:header", ("gpl3-only", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("LGPL-2.1-or-later:header", ("lgpl21-later", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("LGPL-3.0-or-later:header", ("lgpl3-later", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("AGPL-3.0-or-later:header", ("agpl3-later", "gnu-hope?", "gnu-details?", "gnu-received?")),
    ("MPL-2.0:header", ("mpl2-header", "mpl2-copy?")),
    ("Unlicense:full", ("unlicense-domain", "unlicense-grant?")),
    ("Zlib:full", ("zlib-grant",)),
    ("BSL-1.0:full", ("boost-title?", "boost-grant")),
    ("BSL-1.0:notice", ("boost-title",)),
    ("EPL-2.0:header", ("epl2-header",)),
    ("CC0-1.0:waiver", ("cc0-waiver",)),
    ("0BSD:full", ("zero-grant",)),
    ("MIT:grant", ("mit-grant",)),
    ("MIT:title", ("mit-title",)),
    ("Apache-2.0:notice", ("apache-notice",)),
    ("ISC:title", ("isc-title",)),
    ("BSD-2-Clause:title", ("bsd2-title",)),
    ("BSD-3-Clause:title", ("bsd3-title",)),
    *[(f"{name}:notice", (f"notice-{name}",)) for name in NAMES],
    *[(f"{name}:tag", (f"tag-{name}",)) for name in (*NAMES, *TAGS)],
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks that comments put before the text of a line.
COMMENT = r"(^|\n)[ \t]*(/\*+|\*+/?|//+|#+|--+|;+|%+|<!--+|>+|dnl[ \t])"
#: May end a sentence: end marks before white space, and line ends.
BREAK = r"[.;:!?]+[\"')\]]*[ \t\r\n]+|[\r\n]"
OTHER, MARKS = r"[^a-z0-9\x01]+", r" *\x01[ \x01]*"
#: What comes out for a mark: a sentence's end and the next one's begin, so that neighbours share none.
MARK = "\x03\x02"
GAP = 12
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "rights reserved", "public domain", "spdx", "distribute", "gpl", "cc by", "cc0", "mozilla.org/mpl", "endorse or promote", "advertising materials", "restriction")
STEM = "(?i)" + "|".join(s.replace(" ", r"\s+(?:[*#/;%>-]+\s*)?").replace(".", r"\.") for s in STEMS)


def normalise(sentence: str) -> str:
    """The form in which sentences are compared."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def known(sentences: dict[str, str | list[str]] | None = None) -> list[tuple[str, str]]:
    """(normalised sentence, identifier), longest first; a gap shows as a lone "..."."""
    if sentences is None:
        sentences = SENTENCES | {f"notice-{n}": [p.format(name) for name in names for p in NOTICES] for n, names in NAMES.items()} | {f"tag-{n}": f"SPDX-License-Identifier: {n}" for n in (*NAMES, *TAGS)}
    out: dict[str, str] = {}
    for key, own in sentences.items():
        for s in [own] if isinstance(own, str) else own:
            out.setdefault(" ... ".join(normalise(p) for p in s.split("...")).strip(), key)  # the first identifier of a wording
    return sorted(out.items(), key=lambda x: (-len(x[0]), x[0]))


def expanded(forms: list[tuple[str, tuple[str, ...]]] | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """Rules without optional identifiers: of a form, those with more of them first."""
    out: list[tuple[str, tuple[str, ...]]] = []
    for name, ids in FORMS if forms is None else forms:
        ways = [((i[:-1],), ()) if i.endswith("?") else ((i,),) for i in ids]
        runs = {tuple(x for part in way for x in part) for way in product(*ways)}
        out += [(name, run) for run in sorted(runs, key=lambda r: (-len(r), r))]
    return out


def _gap_pattern(sentence: str) -> str:
    """A regular expression for a normalised sentence, soft marks among its words, its gap spelled out."""
    between = r"(?: |\x03\x02)"
    return between.join(f"[a-z0-9]+(?:{between}[a-z0-9]+){{0,{GAP - 1}}}" if w == "..." else w for w in sentence.split(" "))


def _stemmed(pairs: list[tuple[str, str]]) -> bool:
    return all(re.search(STEM, s) for s, _ in pairs)


def scan(docs: DataFrame, sentences: dict[str, str | list[str]] | None = None, forms: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids (comma-joined, in order), licenses (rules met, in rule order, by "|")
    of every row.

    A null or empty text has none and empty strings. Text after a sentence's end mark without white space belongs to that
    sentence. Where known sentences overlap, the longest that begins first counts. Repeated rows come out as often; extra
    columns are left out. A sentence identifier that no rule takes stays in sentence_ids only.
    """
    pairs = known(sentences)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.regexp_replace(text, COMMENT, "$1")
    plain = F.regexp_replace(F.translate(F.regexp_replace(bare, BREAK, "\x01"), UPPER, LOWER), OTHER, " ")
    closed = F.concat(F.lit("\x02"), F.trim(F.regexp_replace(plain, MARKS, MARK)), F.lit("\x03"))
    pattern = r"\x02 ?(" + "|".join(_gap_pattern(s) for s, _ in pairs) + r") ?\x03"
    found = F.transform(F.regexp_extract_all(closed, F.lit(pattern), F.lit(1)), lambda s: F.replace(s, F.lit(MARK), F.lit(" ")))
    exact = [(s, i) for s, i in pairs if "..." not in s]
    mapping = F.create_map(*[F.lit(x) for pair in exact for x in pair])
    loose = [(s, i) for s, i in pairs if "..." in s]
    name = lambda s: F.coalesce(mapping[s], *[F.when(s.rlike("^" + _gap_pattern(p) + "$"), i) for p, i in loose])
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(STEM) if _stemmed(pairs) else F.lit(True), F.transform(found, name)).otherwise(F.array().cast("array<string>")).alias("ids"))
    met = cut.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"))
    # each identifier is closed and opened by marks of its own, so that runs can follow one another
    seq = F.concat(F.lit("<"), F.replace("sentence_ids", F.lit(","), F.lit("><")), F.lit(">"))
    table = F.array(*[F.struct(F.lit(rule).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for rule, run in expanded(forms)])
    start = F.struct(seq.alias("left"), F.lit("").alias("met"))

    def step(acc: Column, rule: Column) -> Column:
        there = F.contains(acc["left"], rule["run"])
        return F.struct(F.replace(acc["left"], rule["run"], F.lit("|")).alias("left"), F.when(there, F.concat(acc["met"], F.lit("|"), rule["name"])).otherwise(acc["met"]).alias("met"))

    rules = F.when(F.col("sentence_ids") == "", "").otherwise(F.array_join(F.array_distinct(F.split(F.substr(F.aggregate(table, start, step)["met"], F.lit(2)), r"\|")), "|"))
    return met.select("doc_id", "n_known", "sentence_ids", rules.alias("licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    def quote(s: str) -> str:
        """A literal; control characters are put in by number."""
        parts = re.split("([\x01-\x03])", s)
        return " || ".join(f"chr({ord(p)})" if p in "\x01\x02\x03" else "'" + p.replace("'", "''") + "'" for p in parts if p) or "''"

    pairs = known()
    rules = expanded()
    runs = "[" + ", ".join("{'name': " + quote(name) + ", 'run': " + quote("".join(f"<{i}>" for i in ids)) + "}" for name, ids in rules) + "]"
    names = "MAP {" + ", ".join(f"{quote(s)}: {quote(i)}" for s, i in pairs if "..." not in s) + "}"
    loose = "".join(f" WHEN regexp_matches(s, {quote('^' + _gap_pattern(p) + '$')}) THEN {quote(i)}" for p, i in pairs if "..." in p)
    pattern = quote(r"\x02 ?(" + "|".join(_gap_pattern(s) for s, _ in pairs) + r") ?\x03")
    return rf"""
WITH RECURSIVE bare AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{COMMENT}', '\1', 'g') AS t FROM documents),
plain AS (SELECT doc_id, regexp_replace(translate(regexp_replace(t, {quote(BREAK)}, chr(1), 'g'), '{UPPER}', '{LOWER}'), '{OTHER}', ' ', 'g') AS t FROM bare),
closed AS (SELECT doc_id, chr(2) || trim(regexp_replace(t, '{MARKS}', {quote(MARK)}, 'g')) || chr(3) AS t FROM plain),
hits AS (SELECT doc_id, list_transform(regexp_extract_all(t, {pattern}, 1), lambda s: replace(s, {quote(MARK)}, ' ')) AS hits FROM closed),
named AS (SELECT doc_id, list_transform(hits, lambda s: coalesce(known[s], CASE{loose} END)) AS own FROM hits, (SELECT {names} AS known)),
ids AS (SELECT doc_id, len(own)::BIGINT AS n_known, coalesce(array_to_string(own, ','), '') AS sentence_ids FROM named),
rules AS (SELECT unnest({runs}) AS r, generate_subscripts({runs}, 1) AS no),
steps AS (
  SELECT doc_id, 0::BIGINT AS no, '<' || replace(sentence_ids, ',', '><') || '>' AS seq, []::VARCHAR[] AS met FROM ids WHERE sentence_ids <> ''
  UNION ALL SELECT doc_id, rules.no, replace(seq, r.run, '|'), CASE WHEN contains(seq, r.run) AND NOT list_contains(met, r.name) THEN list_append(met, r.name) ELSE met END
  FROM steps JOIN rules ON rules.no = steps.no + 1)
SELECT doc_id, n_known, sentence_ids, array_to_string(met, '|') AS licenses FROM ids JOIN steps USING (doc_id) WHERE no = {len(rules)}
UNION ALL SELECT doc_id, n_known, sentence_ids, '' FROM ids WHERE sentence_ids = ''
"""


OP10_SQL = _sql()
