import re

import pytest

from incognita.llm import licenses as L

MIT = """/*
 * Copyright (c) 2020 Some One
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
 * SOFTWARE.
 */
int main() { return 0; }
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice,
#    this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
"""
BSD3 = BSD + """# 3. Neither the name of the copyright holder nor the names of its contributors
#    may be used to endorse or promote products derived from this software
#    without specific prior written permission.
"""
GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


@pytest.mark.parametrize(("text", "want", "left"), [
    (MIT, ["MIT"], []), (BSD, ["BSD-2-Clause"], []), (BSD3, ["BSD-3-Clause"], []), (GPL, ["GPL-3.0-or-later"], []),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], []), ("Some words\nReleased under the MIT License.\nmore", ["MIT"], []),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"], []), ("x. Licensed under CC BY-NC 4.0. y.", ["CC-BY-NC"], []),
    ("Licensed under CC BY 4.0.\n\nAll rights reserved.", ["CC-BY", "proprietary"], []), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["SPDX"], []),
    ("You may not use this file except in compliance with the License.", [], ["apache-not-use"]), ("A license is a license, and copyright law is hard.", [], []),
    ("the mit license is short", [], []), ("", [], []), (None, [], []),
    (GPL.replace("MERCHANTABILITY", "USABILITY"), ["GPL-3.0-or-later"], ["gpl-details"])])
def test_known_texts(text, want, left):
    got = L.scan_text(text)
    assert (got["licences"], got["left"]) == (want, left)
    for s in got["sentences"]:
        assert L.known(L.normal(text[s["begin"]:s["stop"]])) == s["id"]


def test_apache_header():
    got = L.scan_text(APACHE)
    assert got["licences"] == ["Apache-2.0"] and len(got["sentences"]) >= 4


def test_every_sentence_is_known_as_itself_and_holds_a_trigger():
    for name, form in L.SENTENCES:
        for text in _expand(form):
            assert L.known(L.normal(text)) == name, text
            assert any(t in text for t in L.TRIGGERS), text
    names = {n for n, _ in L.SENTENCES}
    assert all(s in names for _, seq in L.RULES for x in seq for s in x.split("|"))


def _expand(form):
    """Two forms of a sentence: with the first and with the last of its choices."""
    values = {"holder": " 2020 the holder", "url": "https://example.org/x", "id": "mit", "n": "3", "version": "4.0", "subject": "this software is ", "org": "the organization"}
    for pick in (0, -1):
        text = form
        while m := re.search(r"\(((?:\(c\)|[^()|]|\([^()]*\))*(?:\|(?:\(c\)|[^()|])*)+|[^()|]*(?=\)\?))\)(\??)", text):
            text = text[:m.start()] + ("" if m[2] and pick else m[1].split("|")[pick]) + text[m.end():]
        for k, v in values.items():
            text = text.replace("{" + k + "}", v)
        yield text.strip()


def test_rules_in_order_take_the_longest_first():
    found, left = L.match(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", None, "bsd-grant", "bsd-source", "bsd-binary", "gpl-hope"])
    assert [f[0] for f in found] == ["BSD-3-Clause", "BSD-2-Clause"] and left == [8]
    found, left = L.match(["bsd-source", "bsd-grant", "bsd-binary"])
    assert found == [] and left == [0, 1, 2]


def test_documents(spark, small_docs):
    rows = [(1, MIT), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (None, "word " * 200_000 + ".\n" + GPL)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, licence_scan string")
    got = sorted((str(r.doc_id), tuple(r.licences), tuple(r.left)) for r in L.licences(df).collect())
    assert got == [("1", ("MIT",), ()), ("2", (), ()), ("3", (), ()), ("4", ("CC-BY-NC",), ()), ("4", ("CC-BY-NC",), ()), ("None", ("GPL-3.0-or-later",), ())]
    assert L.scan(df)[0].columns == [*df.columns, L.scan(df)[1]]
    assert L.licences(small_docs.limit(0)).count() == 0


def test_planted_lines(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary"}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: set(r.licences) for r in L.licences(docs).collect()}
    n = 0
    for r in docs.select("doc_id", "text").collect():
        want = {v for k, v in lines.items() if re.search(f"(?m)^{re.escape(k)}$", r.text)}
        n += bool(want)
        assert want <= got[r.doc_id] and (want or not got[r.doc_id] or re.search("(?i)licen|reserved", r.text)), r.doc_id
    assert n > 100


@pytest.mark.parametrize(("text", "want", "spdx"), [
    ("// SPDX-License-Identifier: MIT\n#include <stdio.h>\n", ["SPDX"], ["MIT"]), ("# SPDX-License-Identifier: Apache-2.0\nimport os\n" + "x = 1\n" * 100, ["SPDX"], ["Apache-2.0"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */\nint my_var;", ["SPDX"], ["GPL-2.0-only", "Linux-syscall-note", "BSD-3-Clause"]),
    ("<!-- SPDX-License-Identifier: mit or isc -->\n<p>", ["SPDX"], ["mit", "isc"]), ("SPDX-License-Identifier: MIT and more words here, so on", ["SPDX"], ["MIT"]),
    ("// Copyright 2020 X\r\n// SPDX-License-Identifier: MIT\r\nint main", ["SPDX"], ["MIT"]), ("SPDX-License-Identifier: MIT\n\n" + BSD, ["SPDX", "BSD-2-Clause"], ["MIT"]),
    ("see SPDX-License-Identifier: LicenseRef-my-own. Then more", ["SPDX"], ["LicenseRef-my-own"]),
    ("Released under the MIT License\nmore text without a stop", ["MIT"], []), ("one line\nReleased under the MIT License\nmore text without a stop", ["MIT"], []),
    ("Copyright 2020 Some One\nReleased under the MIT License\nmore", ["MIT"], []), ("My program\n" + GPL.rstrip()[:-1] + "\nint main", ["GPL-3.0-or-later"], []),
    ("a title\nLicensed under the Apache License,\nVersion 2.0\nmore text", ["Apache-2.0"], []), ("a title\nAll rights reserved\nLicensed under CC BY-NC 4.0\nand on", ["proprietary", "CC-BY-NC"], []),
    ("a title\n" + BSD.replace("disclaimer.", "disclaimer") + "int main", ["BSD-2-Clause"], []), ("Copyright 2020 Some One\n" + MIT, ["MIT"], []), ("a title\n" + MIT[3:], ["MIT"], [])])
def test_lines_without_an_end_sign_and_tags_before_code(text, want, spdx):
    got = L.scan_text(text)
    assert (got["licences"], got["left"], got["spdx"]) == (want, [], spdx)
    for s in got["sentences"]:
        assert L.known(L.normal(text[s["begin"]:s["stop"]])) == s["id"]
    parts = L.identify(text)
    assert [a for _, a, _ in parts] == [0, *(b for _, _, b in parts[:-1])] and parts[-1][2] == len(text)


def test_the_query_reports_spdx_identifiers(spark):
    df = spark.createDataFrame([(1, "// SPDX-License-Identifier: MIT\n#include <stdio.h>\n"), (2, None)], "doc_id bigint, text string")
    assert {(r.doc_id, tuple(r.licences), tuple(r.spdx)) for r in L.licences(df).collect()} == {(1, ("SPDX",), ("MIT",)), (2, (), ())}


def test_time_grows_with_the_lines():
    import time

    L.scan_text("Released under the MIT License\n" * 100)
    took = []
    for n in (2000, 8000):
        begin = time.process_time()
        got = L.scan_text("Released under the MIT License\n" * n)
        took.append(time.process_time() - begin)
        assert got["licences"] == ["MIT"] and len(got["sentences"]) == n
    assert took[1] < 8 * took[0]


def test_neighbours_are_told_apart():
    mit = dict(L.SENTENCES)
    parts = lambda *names: ". ".join(mit[n].replace("{holder}", "the author").replace("{org}", "the author") for n in names) + "."
    bsd = ("bsd-grant", "bsd-source", "bsd-binary")
    assert L.scan_text("Copyright 2001 X. All rights reserved.\n" + parts(*bsd, "bsd-advert", "bsd-endorse"))["licences"] == ["BSD-4-Clause"]
    assert L.scan_text(parts(*bsd, "bsd-endorse"))["licences"] == ["BSD-3-Clause"]
    assert L.scan_text(parts("mit-grant", "mit-notice", "json-good", "mit-as-is", "mit-liable"))["licences"] == ["JSON"]
    assert L.scan_text(parts("mit-grant", "mit-notice", "mit-as-is", "mit-liable"))["licences"] == ["MIT"]
    assert L.scan_text("All rights reserved.")["licences"] == ["proprietary"]


def test_parts_far_apart_are_no_licence():
    mit = dict(L.SENTENCES)
    between = "This sentence has nothing to do with it. " * 2000
    assert L.scan_text(mit["mit-grant"] + ". " + mit["mit-notice"] + ". " + between + mit["mit-as-is"] + ". " + mit["mit-liable"] + ".")["licences"] == []


@pytest.mark.parametrize("text", ["This software is licensed under the MIT License.", "The code is released under the MIT license.", "It is distributed under the terms of the MIT License"])
def test_who_is_licensed_may_be_said(text):
    assert L.scan_text(text)["licences"] == ["MIT"]
