"""License scans: known licence sentences become identifiers, and identifier sequences are matched by ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Well-known licence sentences by identifier, as normalised() leaves them; {} is a slot of one to twelve words.
SENTENCES = {
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-ref": "this work is licensed under the gnu affero general public license version 3",
    "apache-ref": "licensed under the apache license version 2.0",
    "apache-head": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-ref": "released under the bsd license",
    "boost-ref": "distributed under the boost software license version 1.0",
    "cc-by-ref": "licensed under cc by 4.0",
    "cc-by-sa-ref": "licensed under cc by sa 4.0",
    "cc-by-nc-ref": "licensed under cc by nc 4.0",
    "cc0-ref": "released into the public domain",
    "epl1-ref": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at {}",
    "epl2-ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at {}",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "isc-as-is": "the software is provided as is and {} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl-ref": "this work is licensed under the gnu lesser general public license version 3",
    "mit-ref": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at {}",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Rules in order of precedence, (sequence of sentence identifiers, licence). What a rule matches is gone for later ones.
RULES = (
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liable"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("agpl-free", "gpl-hope", "agpl-see"), "AGPL-3.0-or-later"),
    (("lgpl2-free", "lgpl-hope", "lgpl-see"), "LGPL-2.1-or-later"),
    (("lgpl3-free", "lgpl-hope", "lgpl-see"), "LGPL-3.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl2-only", "gpl-hope", "gpl-see"), "GPL-2.0-only"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("zlib-as-is", "zlib-grant"), "Zlib"),
    (("mpl-ref", "mpl-copy"), "MPL-2.0"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("apache-head", "apache-copy", "apache-as-is", "apache-see"), "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl-free", "gpl-hope", "gpl-see"), "GPL-3.0-or-later"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("gpl2-only",), "GPL-2.0-only"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("lgpl2-free",), "LGPL-2.1-or-later"),
    (("lgpl3-free",), "LGPL-3.0-or-later"),
    (("isc-grant",), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("boost-ref",), "BSL-1.0"),
    (("epl1-ref",), "EPL-1.0"),
    (("epl2-ref",), "EPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("apache-head",), "Apache-2.0"),
    (("mit-grant",), "MIT"),
    (("agpl-ref",), "AGPL-3.0"),
    (("gpl3-ref",), "GPL-3.0"),
    (("gpl2-ref",), "GPL-2.0"),
    (("lgpl-ref",), "LGPL-3.0"),
    (("mpl-ref",), "MPL-2.0"),
    (("apache-ref",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("bsd-ref",), "BSD"),
    (("cc-by-nc-ref",), "CC-BY-NC-4.0"),
    (("cc-by-sa-ref",), "CC-BY-SA-4.0"),
    (("cc-by-ref",), "CC-BY-4.0"),
    (("cc0-ref",), "public-domain"),
    (("reserved",), "all-rights-reserved"),
)
#: A sentence may start and end at these: the ends of lines, and .!?: before white space.
END = r"[.!?:]+\s+|\n+"
DROPPED = r"[^\p{L}\p{N}.]+"
MARK = "\x01"  # stands for END in marked()
SLOT = 12  # words at most


def pattern(sentence: str, gap: str) -> str:
    """The pattern of a sentence with gap between its words; a slot takes as few words as it can."""
    word = rf"[^ {MARK}]+"
    return gap.join(f"{word}(?:{gap}{word}){{0,{SLOT - 1}}}?" if w == "{}" else re.escape(w) for w in sentence.split())


#: A known sentence from one MARK to another, the longest first; lines are joined, so that it may have others inside.
ORDERED = sorted(SENTENCES.values(), key=len, reverse=True)
KNOWN = f"(?<={MARK})(?:{'|'.join(pattern(s, f'[ {MARK}]') for s in ORDERED)})(?={MARK})"


def normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and dots, with one space for anything else; no dots or spaces at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), DROPPED, " "), r"^[ .]+|[ .]+$", "")


def marked(text: Column) -> Column:
    """As normalised(), with MARK before, after and at every END. Comment marks are neither letters nor digits (but for dnl and rem)."""
    bare = F.regexp_replace(F.translate(F.lower(text), MARK, " "), r"(?m)^[ \t]*@?(?:dnl|rem)[ \t]", "")
    ends = F.concat(F.lit(MARK), F.regexp_replace(F.regexp_replace(bare, r"\.{3,}", ".."), END, MARK), F.lit(MARK))
    return F.regexp_replace(F.regexp_replace(ends, DROPPED.replace("^", f"^{MARK}"), " "), f"[ .]*{MARK}[ .{MARK}]*", MARK)


def licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_sentences (known ones), sentences (their identifiers in order, comma-joined),
    licences (those that rules found, in order of the text and with repeats, comma-joined).

    A known sentence may be wrapped over lines, with comment marks in front and blank lines inside; a holder or an address in it may be
    any one to SLOT words. Other sentences between known ones are passed over. Each row is worked out where it is read: no shuffle, and the
    tables of sentences and rules are constants. Null, empty and very long texts give what their sentences give: of null
    and empty, none. Repeated or null ids do no harm; other columns are not read.
    """
    ids = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() if "{}" not in s for x in (s, k)))
    slotted = [(k, pattern(s, " ")) for k, s in SENTENCES.items() if "{}" in s]
    named_by = lambda x: F.coalesce(F.try_element_at(ids, x), *(F.when(x.rlike(f"^(?:{p})$"), k) for k, p in slotted))
    cut = F.regexp_extract_all(marked(F.coalesce(text_col, F.lit(""))), F.lit(KNOWN), F.lit(0))
    found = F.transform(cut, lambda s: named_by(F.translate(s, MARK, " ")))
    seq = F.array_join(F.transform("found", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")
    for sequence, licence in RULES:
        seq = F.replace(seq, F.lit("".join(f"<{k}>" for k in sequence)), F.lit(f"[{licence}]"))
    named = F.array_join(F.regexp_extract_all(seq, F.lit(r"\[([^\]]+)\]"), F.lit(1)), ",")
    return docs.select(F.col(id_col), found.alias("found")).select(id_col, F.size("found").cast("long").alias("n_sentences"), F.array_join("found", ",").alias("sentences"), named.alias("licences"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same by marks of both sides: each MARK is two, one for the sentence that ends and one for that which begins."""
    pairs = ", ".join(f"('{s}', '{k}')" for k, s in SENTENCES.items() if "{}" not in s)
    slots = ", ".join(f"('{pattern(s, ' ')}', '{k}')" for k, s in SENTENCES.items() if "{}" in s)
    known = f"{MARK}({'|'.join(pattern(s, f'(?: |{MARK}{MARK})') for s in ORDERED)}){MARK}"
    m, dropped = "chr(1)", DROPPED.replace("^", f"^{MARK}")
    bare = rf"regexp_replace(replace(lower(coalesce(text, '')), {m}, ' '), '(?m)^[ \t]*@?(?:dnl|rem)[ \t]', '', 'g')"
    ends = rf"{m} || regexp_replace(regexp_replace({bare}, '\.{{3,}}', '..', 'g'), '{END}', {m}, 'g') || {m}"
    text = rf"regexp_replace(regexp_replace({ends}, '{dropped}', ' ', 'g'), '[ .]*{MARK}[ .{MARK}]*', {m}, 'g')".replace(MARK, r"\x01")
    seq = "coalesce(list_reduce(list_transform(f, lambda k: '<' || k || '>'), lambda a, b: a || b, ''), '')"
    for sequence, licence in RULES:
        seq = f"replace({seq}, '{''.join(f'<{k}>' for k in sequence)}', '[{licence}]')"
    return rf"""
WITH known(s, k) AS (VALUES {pairs}), slot(p, k) AS (VALUES {slots.replace(MARK, r"\x01")}),
d AS (SELECT row_number() OVER () AS r, doc_id, {text} AS t FROM documents),
p AS (SELECT r, generate_subscripts(parts, 1) AS i, unnest(parts) AS x FROM (SELECT r, regexp_extract_all(replace(t, {m}, {m} || {m}), '{known.replace(MARK, r"\x01")}', 1) AS parts FROM d)),
n AS (SELECT r, i, replace(x, {m} || {m}, ' ') AS s FROM p),
g AS (SELECT r, list(k ORDER BY i) AS f FROM (SELECT r, i, k FROM n JOIN known USING (s) UNION ALL SELECT r, i, k FROM n JOIN slot ON regexp_full_match(s, p) WHERE s NOT IN (SELECT s FROM known)) GROUP BY r),
m AS (SELECT doc_id, coalesce(f, []) AS f, {seq} AS seq FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(f) AS BIGINT) AS n_sentences, array_to_string(f, ',') AS sentences, array_to_string(regexp_extract_all(seq, '\[([^\]]+)\]', 1), ',') AS licences FROM m"""


QUERIES = {"op5_licences": op5_licences}
ORACLE_SQL = {"op5_licences": _sql()}
