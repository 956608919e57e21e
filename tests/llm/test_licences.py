from auditloom.llm import licences as X


def test_rules_and_edges(spark):
    s = X.SENTENCES
    full_mit = ". ".join(s[k].capitalize() for k in ("mit-grant", "mit-notice", "mit-as-is")) + "."
    texts = [
        (None, "", ""), ("", "", ""), ("Licensed under CC BY-NC 4.0.\nx", "cc-by-nc-ref", "CC-BY-NC-4.0"),
        ("Some text. " + full_mit + " All rights reserved.", "mit-grant,mit-notice,mit-as-is,reserved", "MIT,all-rights-reserved"),
        (s["mit-grant"] + "\nother\n" + s["mit-notice"], "mit-grant,mit-notice", "MIT"), (s["mit-notice"], "mit-notice", ""),
        ("This work is licensed under the GNU General Public License, version 3. Released under the MIT License! Released under the MIT License.", "gpl3-ref,mit-ref,mit-ref", "GPL-3.0,MIT,MIT"),
        ("w " * 90000 + "\nAll   rights\treserved ...", "reserved", "all-rights-reserved"), ("Licensed under the Apache License, Version 2.0.", "apache-ref", "Apache-2.0"), ("not all rights reserved", "", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)] + [(None, "all rights reserved"), (0, None)], "doc_id long, text string").selectExpr("*", "1 found", "2 sentences")
    got = [tuple(r) for r in X.licences(docs).collect()]
    assert got == [(i, len([x for x in k.split(",") if x]), k, v) for i, (_, k, v) in enumerate(texts)] + [(None, 1, "reserved", "all-rights-reserved"), (0, 0, "", "")]
    assert X.licences(docs.limit(0)).count() == 0


def test_sentences_are_in_normal_form_and_rules_known(spark):
    df = spark.createDataFrame([(k, s.replace("{}", "x")) for k, s in X.SENTENCES.items()], "k string, s string")
    assert df.where(X.normalised(df.s) != df.s).count() == 0
    assert all(k in X.SENTENCES for seq, _ in X.RULES for k in seq)


HEADERS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
}


def test_wrapped_headers(spark):
    want = {"MIT": 3, "Apache-2.0": 4, "BSD-3-Clause": 4, "GPL-3.0-or-later": 3}
    rows = [(name, front.join(["", *text.split("\n")]).replace("\n", end)) for name, text in HEADERS.items() for front in ("\n", "\n# ", "\n * ", "\n// ", "\ndnl ") for end in ("\n", "\r\n")]
    got = X.licences(spark.createDataFrame([(n, f"/*{t}\n */\nint x;") for n, t in rows], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.n_sentences, r.licences) for r in got] == [(n, want[n], n) for n, _ in rows]


def test_wrapped_and_one_line_notices(spark):
    texts = ["Licensed under the\nMIT License", "This code is\n# released under the\n# BSD license", "x = 1\nReleased under the MIT License\ny = 2", "not\x01all rights reserved", "Notice: all rights\nreserved."]
    got = X.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licences for r in got] == ["MIT", "BSD", "MIT", "", "all-rights-reserved"]


WARRANTY = """
This {0} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE.  See the GNU {1}General Public License for more details."""
FREE = """This {0} is free software; you can redistribute it and/or modify it under the
terms of the GNU {1}General Public License as published by the Free
Software Foundation; either version {2} of the License, or (at your option)
any later version.
""" + WARRANTY
MORE = {
    "GPL-2.0-or-later": FREE.format("program", "", "2"),
    "LGPL-2.1-or-later": FREE.format("library", "Lesser ", "2.1"),
    "LGPL-3.0-or-later": FREE.format("library", "Lesser ", "3"),
    "AGPL-3.0-or-later": FREE.format("program", "Affero ", "3"),
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
""" + WARRANTY.format("program", ""),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL ISC BE LIABLE""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt)""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License,
v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.""",
    "BSD-3-Clause": HEADERS["BSD-3-Clause"].replace("copyright holder", "University of Somewhere, its regents and 3 others") + """

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT""",
    "MIT": HEADERS["MIT"].replace("AUTHORS BE LIABLE FOR ANY CLAIM.", """AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
}


def test_slots_and_more_licences_and_their_sql(spark):
    """Notices as they stand in files, on one line and wrapped with marks in front; DuckDB says the same of the same texts."""
    import duckdb

    rows = [(name, "".join(front + line for line in text.split("\n"))) for name, text in [*MORE.items(), *HEADERS.items()] for front in ("\n", "\n * ", "\n# ", " ")]
    n = len(rows)
    long = "word " * (X.SLOT + 1)  # a slot has so many words at most
    rows += [(None, "Neither the name of " + x + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.") for x in (long, long[5:], "")]
    rows += [(None, None), (None, ""), (None, "Released under\nthe MIT license\n\nall rights\nreserved\n\nmore")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = sorted(tuple(r) for r in X.licences(df).collect())
    assert [r[3] for r in got[:n]] == [name for name, _ in rows[:n]]
    assert [r[1] for r in got[n:]] == [0, 1, 0, 0, 0, 2]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(X.ORACLE_SQL["op5_licences"]).fetchall()) == got
