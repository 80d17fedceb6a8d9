"""Licence scan by sentence rules, in DataFrame functions only.

Normalised sentences are looked up among known licence sentences, on a line of their own or wrapped over several; the
sequence of identifiers found is matched against ordered rules, the more specific ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _redistribute(what: str, licence: str) -> str:
    """The opening sentence of the notices of the Free Software Foundation."""
    return (
        f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {licence} as "
        "published by the free software foundation"
    )


def _later(version: str) -> str:
    return f" either version {version} of the license or at your option any later version"


def _named(*names: str) -> list[str]:
    """The short notices with a licence's name."""
    return [f"{start}licensed under {name}" for name in names for start in ("", "this work is ", "this project is ")] + [
        f"released under {name}" for name in names
    ]


#: Fixed: known sentences (lower case, runs of other characters as one blank) by identifier.
SENTENCES = {
    "MIT-NAME": [*_named("the mit license"), "the mit license", "mit license"],
    "MIT-GRANT": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    ],
    "AS-IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "APACHE-NAME": [*_named("the apache license version 2 0"), "licensed under the apache license version 2 0 the license", "apache license version 2 0"],
    "APACHE-COMPLY": ["you may not use this file except in compliance with the license"],
    "APACHE-COPY": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "APACHE-BASIS": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "GPL2-NAME": _named("the gnu general public license version 2"),
    "GPL2-LATER": [_redistribute("program", "general public license") + _later("2")],
    "GPL2-ONLY": [_redistribute("program", "general public license version 2"), _redistribute("program", "general public license") + " version 2"],
    "GPL3-NAME": _named("the gnu general public license version 3"),
    "GPL3-LATER": [_redistribute("program", "general public license") + _later("3")],
    "GPL-WARRANTY": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    ],
    "LGPL21-LATER": [_redistribute("library", "lesser general public license") + _later("2 1")],
    "LGPL3-LATER": [_redistribute(x, "lesser general public license") + _later("3") for x in ("library", "program")],
    "LGPL-WARRANTY": [
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    ],
    "AGPL3-LATER": [_redistribute("program", "affero general public license") + _later("3")],
    "AGPL3-NAME": _named("the gnu affero general public license version 3"),
    # a sentence ends after "v." there
    "MPL2-FORM": ["this source code form is subject to the terms of the mozilla public license v"],
    "MPL2-COPY": [f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0" for x in ("http", "https")],
    "EPL1": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"],
    "EPL2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "CDDL": ["the contents of this file are subject to the terms of the common development and distribution license the license"],
    "ISC-GRANT": [
        f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in ("", "or ")
    ],
    "0BSD-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "POSTGRES-GRANT": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above "
        "copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ],
    "ZLIB-GRANT": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "BSL-GRANT": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce "
        "display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "WTFPL": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "OFL": ["this font software is licensed under the sil open font license version 1 1"],
    "CC0-NAME": _named("cc0 1 0", "the cc0 1 0 universal license"),
    "CC-BY-NC-SA-NAME": _named("cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-NAME": _named("cc by nc nd 4 0", "a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "CC-BY-NC-NAME": _named("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-SA-NAME": _named("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    "CC-BY-ND-NAME": _named("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NAME": _named("cc by 4 0", "a creative commons attribution 4 0 international license"),
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BSD-NAMES": [
        f"neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for x in ("copyright holder", "university", "organization", "author")
    ],
    "BSD-AS-IS": [
        f"this software is provided by the {x} and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed"
        for x in ("copyright holders", "regents")
    ],
}
#: Fixed: each known sentence holds one of these, so texts without them need no splitting.
ANCHORS = ("licen", "released under", "permission", "permitted", "warrant", "redistribut", "copyright", "public domain", " mpl ")
#: Ordered rules: licence and the identifiers that must follow each other; the first that fits names the document.
RULES = [
    ("MIT", ["MIT-NAME", "MIT-GRANT", "AS-IS"]),
    ("MIT", ["MIT-GRANT", "AS-IS"]),
    ("Apache-2.0", ["APACHE-NAME", "APACHE-COMPLY", "APACHE-COPY", "APACHE-BASIS"]),
    ("GPL-3.0-or-later", ["GPL3-LATER", "GPL-WARRANTY"]),
    ("GPL-3.0-or-later", ["GPL3-LATER"]),
    ("GPL-3.0-only", ["GPL3-NAME"]),
    ("GPL-2.0-or-later", ["GPL2-LATER", "GPL-WARRANTY"]),
    ("GPL-2.0-or-later", ["GPL2-LATER"]),
    ("GPL-2.0-only", ["GPL2-ONLY"]),
    ("GPL-2.0-only", ["GPL2-NAME"]),
    ("LGPL-2.1-or-later", ["LGPL21-LATER", "LGPL-WARRANTY"]),
    ("LGPL-2.1-or-later", ["LGPL21-LATER"]),
    ("LGPL-3.0-or-later", ["LGPL3-LATER"]),
    ("AGPL-3.0-or-later", ["AGPL3-LATER"]),
    ("AGPL-3.0-only", ["AGPL3-NAME"]),
    ("MPL-2.0", ["MPL2-FORM", "MPL2-COPY"]),
    ("MPL-2.0", ["MPL2-FORM"]),
    ("EPL-1.0", ["EPL1"]),
    ("EPL-2.0", ["EPL2"]),
    ("CDDL-1.0", ["CDDL"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "BSD-AS-IS"]),
    ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-AS-IS"]),
    ("Apache-2.0", ["APACHE-NAME"]),
    ("ISC", ["ISC-GRANT"]),
    ("0BSD", ["0BSD-GRANT"]),
    ("PostgreSQL", ["POSTGRES-GRANT"]),
    ("Zlib", ["ZLIB-GRANT"]),
    ("BSL-1.0", ["BSL-GRANT"]),
    ("Unlicense", ["UNLICENSE"]),
    ("WTFPL", ["WTFPL"]),
    ("OFL-1.1", ["OFL"]),
    ("CC0-1.0", ["CC0-NAME"]),
    ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-NAME"]),
    ("CC-BY-NC-ND-4.0", ["CC-BY-NC-ND-NAME"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-NAME"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-NAME"]),
    ("CC-BY-ND-4.0", ["CC-BY-ND-NAME"]),
    ("CC-BY-4.0", ["CC-BY-NAME"]),
    ("MIT", ["MIT-NAME"]),
    ("BSD", ["BSD-GRANT"]),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"[.!?]+([ \t\r\n]|\z)"


#: Stands for a sentence's end at a mark; one in the text itself is a blank.
_MARK = "\x01"


def boundaries(text: Column) -> Column:
    """Normalised text: words, a line feed where a line or clause (at ;) ends, and _MARK at a mark that a blank follows.

    Other characters are blanks, and one separator is left between words: the strongest there was.
    """
    marked = F.regexp_replace(F.translate(text, _UPPER + _MARK, _LOWER + " "), SENTENCE_END, _MARK)
    plain = F.regexp_replace(F.replace(marked, F.lit(";"), F.lit("\n")), f"[^a-z0-9\n{_MARK}]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, f"[ \n]*{_MARK}[ \n{_MARK}]*", _MARK), " ?\n[ \n]*", "\n")


def _known_pattern() -> str:
    """A known sentence from boundary to boundary. Line ends inside it are blanks, since licence texts are wrapped."""
    texts = sorted((t for ts in SENTENCES.values() for t in ts), key=len, reverse=True)
    return f"(?<![^\n{_MARK}])(?:" + "|".join(t.replace(" ", "[ \n]") for t in texts) + f")(?![^\n{_MARK}])"


def sentence_ids(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    low = F.translate(text, _UPPER, _LOWER)
    anchored = F.lit(False)
    for a in ANCHORS:
        anchored = anchored | low.contains(a)
    framed = boundaries(F.concat(F.lit("\n"), text, F.lit("\n")))
    found = F.regexp_extract_all(framed, F.lit(_known_pattern()), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    return F.when(F.coalesce(anchored, F.lit(False)), ids).otherwise(F.array().cast("array<string>"))


def _chain(ids: list[str]) -> str:
    return "".join(f"|{x}|" for x in ids)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_known (sentences recognised), sentence_ids (joined by commas), licence, rule.

    ``licence`` and ``rule`` (its number) are of the first rule whose identifiers follow each other among those found;
    both are null without one. Null and empty texts have no sentences; repeated rows are scanned alike; an empty table
    gives an empty result; other columns are ignored. A row needs no other row, so nothing is shuffled.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    chain = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))))
    rule = F.coalesce(*[F.when(F.col("chain").contains(_chain(ids)), F.lit(i)) for i, (_, ids) in enumerate(RULES)])
    licence = F.coalesce(*[F.when(F.col("rule") == i, F.lit(name)) for i, (name, _) in enumerate(RULES)])
    return found.withColumn("chain", chain).withColumn("rule", rule).select("doc_id", F.size("ids").cast("long").alias("n_known"), F.concat_ws(",", "ids").alias("sentence_ids"), licence.alias("licence"), "rule")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def licence_sql() -> str:
    """The scan of sentences that stand on one line, as in the given tables; wrapped ones are beyond this SQL."""
    pairs = [(t, name) for name, texts in SENTENCES.items() for t in texts]
    known = "MAP {" + ", ".join(f"{_quoted(t)}: {_quoted(n)}" for t, n in pairs) + "}"
    whens = " ".join(f"WHEN contains(chain, {_quoted(_chain(ids))}) THEN {i}" for i, (_, ids) in enumerate(RULES))
    names = "[" + ", ".join(_quoted(n) for n, _ in RULES) + "]"
    return rf"""
WITH split AS (
  SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SENTENCE_END}', chr(10), 'g'), chr(10)) AS lines FROM documents
), ids AS (
  SELECT doc_id, list_filter(list_transform(lines, lambda x: {known}[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM split
), chains AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '|' || x || '|'), ''), '') AS chain FROM ids
), ruled AS (
  SELECT doc_id, ids, CAST(CASE {whens} END AS INTEGER) AS rule FROM chains
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, {names}[rule + 1] AS licence, rule FROM ruled
"""
