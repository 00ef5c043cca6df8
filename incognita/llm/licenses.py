"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, comment signs and white space are normalised, and
each sentence that equals a known licence sentence (some have variable parts)
becomes that sentence's identifier. The identifiers, in order, are then matched
against ordered rules: a rule names a licence by a sequence of identifiers, the
first rule that occurs takes its sentences, and so on until none occurs.
Identifiers that no rule took are reported as ``left``. A sentence without an end
sign is found at the lines it fills: runs of whole lines are tried where no
sentence is known. SPDX tags are found first, wherever they stand; a tag ends with
its licence expression, whose identifiers are reported as ``spdx``.

Scale: one narrow pass; whole texts are read. A text without any of the
``TRIGGERS``, of which every known sentence holds one, has no known sentence.

Defined cases: null and empty texts hold nothing; repeated rows get equal
results; a licence or SPDX identifier named twice is reported once, in order of its first place;
sentences may be cut by line ends and comment signs but by nothing else; other
columns stay, and result columns get names that the documents do not have.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from incognita.llm.common import fresh, raw

# Identifiers of licence sentences and their normalised form; {} parts vary, as ``_PARTS`` says.
SENTENCES = [
    ("copyright", "(copyright|(c)|©){holder}"),
    ("all-rights", "all rights reserved"),
    ("spdx", "spdx-license-identifier: {id}"),
    ("apache-under", "{subject}licensed under the apache license, version 2.0"),
    ("apache-under-the", "licensed under the apache license, version 2.0 (the \"license\")"),
    ("apache-not-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at {url}"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-released", "{subject}(released|licensed|distributed|available|provided) under the (terms of the )?mit license"),
    ("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("json-good", "the software shall be used for good, not evil"),
    ("isc-grant", "permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-grant", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes software developed by {org}"),
    ("bsd-under", "{subject}(released|licensed|distributed) under the (terms of the )?({n}-clause )?bsd license"),
    ("gpl2-work", "(this work|this file|this program|it) is licensed under the gnu general public license, version 2"),
    ("gpl3-work", "(this work|this file|this program|it) is licensed under the gnu general public license, version 3"),
    ("gpl2-later", "(this program|this file) is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version"),
    ("gpl3-later", "(this program|this file) is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("gpl-hope", "(this program|this file) is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl21-later", "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version"),
    ("agpl3-later", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file, you can obtain one at {url}"),
    ("cc-by", "(this work is )?licensed under (a )?(cc by|creative commons attribution)( {version})?( international)?( license)?"),
    ("cc-by-sa", "(this work is )?licensed under (a )?(cc by-sa|creative commons attribution-sharealike)( {version})?( international)?( license)?"),
    ("cc-by-nc", "(this work is )?licensed under (a )?(cc by-nc|creative commons attribution-noncommercial)( {version})?( international)?( license)?"),
    ("cc-by-nd", "(this work is )?licensed under (a )?(cc by-nd|creative commons attribution-noderivatives)( {version})?( international)?( license)?"),
    ("cc-by-nc-sa", "(this work is )?licensed under (a )?(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)( {version})?( international)?( license)?"),
    ("cc-by-nc-nd", "(this work is )?licensed under (a )?(cc by-nc-nd|creative commons attribution-noncommercial-noderivatives)( {version})?( international)?( license)?"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "this (work|file|software) is (hereby )?(in|released into|placed in) the public domain"),
]
_PARTS = {"holder": ".{0,200}", "org": "[^.]{0,200}", "url": r"\S{1,200}", "id": r"[a-z0-9.+():\- ]+", "n": "[0-9]", "version": r"[0-9]+(\.[0-9]+)?",
          "subject": "(?:(?:this|the) (?:software|project|program|work|file|code|library|package) is |it is )?"}

# Rules in order; the licence, then its sentences in sequence ("a|b" allows either).
RULES = [
    ("Apache-2.0", ["apache-under|apache-under-the", "apache-not-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("JSON", ["mit-grant", "mit-notice", "json-good", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("Apache-2.0", ["apache-under|apache-under-the"]),
    ("MIT", ["mit-released"]),
    ("BSD", ["bsd-under"]),
    ("CC-BY", ["cc-by"]),
    ("CC-BY-SA", ["cc-by-sa"]),
    ("CC-BY-NC", ["cc-by-nc"]),
    ("CC-BY-ND", ["cc-by-nd"]),
    ("CC-BY-NC-SA", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND", ["cc-by-nc-nd"]),
    ("Unlicense", ["unlicense"]),
    ("public-domain", ["public-domain"]),
    ("SPDX", ["spdx"]),
    ("proprietary", ["all-rights"]),
]

# Every known sentence holds one of these.
TRIGGERS = ["licens", "copyright", "(c)", "©", "rights reserved", "permission", "warrant", "redistribut", "public domain", "the mpl", "in no event shall", "used for good", "advertising materials"]


def _regex(form: str) -> str:
    """The expression of a sentence: brackets with | or before ? are choices, other signs are themselves."""
    out, i = [], 0
    while i < len(form):
        if form[i] == "{":
            end = form.index("}", i)
            out.append(_PARTS[form[i + 1:end]])
            i = end + 1
        elif form[i] == "(" and (m := re.match(r"\((?:\(c\)|[^()]|\([^()]*\))*\)", form[i:])) and ("|" in m[0] or form[i + len(m[0]):i + len(m[0]) + 1] == "?"):
            inner = re.split(r"\|", m[0][1:-1])
            out.append("(?:" + "|".join(map(_regex, inner)) + ")")
            i += len(m[0])
            if form[i:i + 1] == "?":
                out.append("?")
                i += 1
        else:
            out.append(re.escape(form[i]))
            i += 1
    return "".join(out)


_KNOWN = [(name, re.compile(_regex(form))) for name, form in SENTENCES]

#: A sentence ends at . ; : ! ? before white space or the end, or at an empty line.
_END = re.compile(r"[.;:!?]+(?=\s|$)|\n[ \t/*#;%>|\-]*\n|\n(?=[ \t/*#;%>|\-]*(?:[Cc]opyright|©|\([cC]\)|SPDX))")
_COMMENT = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|%+|--+|>+|<!--|\|)?[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$")


#: Characters that a known sentence spans at most.
SPAN = 4000
_BLACK = re.compile(r"\S")

#: The number or sign of a list item.
_ITEM = re.compile(r"^(?:\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|-) (?=.)")


#: An SPDX tag with its licence expression; operators in small letters count if the expression ends its line or comment.
_SPDX_ID = r"\(*[ \t]*[A-Za-z0-9](?:[A-Za-z0-9.+:\-]*[A-Za-z0-9+])?(?:[ \t]*\))*"
_TAG = re.compile(rf"(?m)(?i:SPDX-License-Identifier):[ \t]*(?P<expression>{_SPDX_ID}(?:[ \t]+(?i:AND|OR|WITH)[ \t]+{_SPDX_ID})*(?=[ \t.;,]*(?:\*+/|-->|\r?$))|{_SPDX_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_SPDX_ID})*)")


def plain(text: str) -> str:
    """Comment signs dropped, quotes and white space made alike, lower case."""
    return " ".join(re.sub("[“”„«»]|''|``", '"', _COMMENT.sub(" ", text)).lower().split())


def normal(sentence: str) -> str:
    """``plain`` without list numbers and without a sign at the end."""
    return _ITEM.sub("", plain(sentence)).strip(" .;:!?,")


def _over_lines(name: str, pattern: re.Pattern) -> re.Pattern:
    """The expression of a sentence over lines; a copyright holder ends with its line."""
    form = pattern.pattern if name == "copyright" else pattern.pattern.replace(".{0,200}", r"[\s\S]{0,200}")
    return re.compile(r"(?:(?:\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|-) )?(?:" + form.replace(r"\ ", r"\s+") + r")[ .;:!?,]*(?=\n|\Z)")


_LINES = [(name, _over_lines(name, pattern)) for name, pattern in _KNOWN if name != "spdx"]


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, stop) of the sentences, their end signs included; a colon or semicolon may also be inside a longer one."""
    out, at = [], 0
    for m in _END.finditer(text):
        if re.fullmatch("[0-9]{1,2}", _COMMENT.sub(" ", text[max(at, m.start() - 40):m.start()]).strip()):
            continue  # the number of a list item
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def identify(text: str) -> list[tuple[str | None, int, int]]:
    """(identifier or None, begin, stop) in order; SPDX tags, and the sentences between them."""
    out, at = [], 0
    for m in _TAG.finditer(text):
        out += [*_between(text, at, m.start()), ("spdx", *m.span())]
        at = m.end()
    return out + _between(text, at, len(text))


def _between(text: str, begin: int, stop: int) -> list[tuple[str | None, int, int]]:
    """Up to three pieces at : ; . are tried as one sentence, longest first; then the lines in them."""
    parts, out, i = [(begin + a, begin + b) for a, b in sentences(text[begin:stop])], [], 0
    cache: dict[int, tuple[int, str, bool]] = {}
    may = [any(t in text[a:b].lower() for t in TRIGGERS) for a, b in parts]
    while i < len(parts):
        for n in (3, 2, 1):
            if i + n <= len(parts) and any(may[i:i + n]) and parts[i + n - 1][1] - parts[i][0] < SPAN:
                a, b = parts[i][0], parts[i + n - 1][1]
                name = known(normal(text[a:b]))
                if name == "copyright" and "\n" in text[a:b].strip():
                    continue  # its lines may hold more than the holder
                if name:
                    out.append((name, a, b))
                    i += n
                    break
        else:
            got = _in_lines(text, parts[i:i + 3], cache) if any(may[i:i + 3]) else None
            if got is None:
                out.append((None, *parts[i]))
                i += 1
                continue
            name, a, b = got
            if a > parts[i][0]:
                out.append((None, parts[i][0], a))
            out.append(got)
            while i < len(parts) and parts[i][1] <= b:
                i += 1
            if i < len(parts) and parts[i][0] < b:  # the rest of a piece whose first lines are taken
                parts[i] = (b, parts[i][1])
                may[i] = parts[i][1] - b > SPAN or any(t in text[b:parts[i][1]].lower() for t in TRIGGERS)
    return out


def _lines_of(text: str, begin: int, stop: int, cache: dict[int, tuple[int, str, bool]]) -> list[tuple[int, int, str]]:
    """(begin, stop, plain form) of the lines that hold something; each is made plain once."""
    out, at = [], begin
    while at < stop:
        line = cache.get(at)
        if line is None or line[0] > stop:
            end = text.find("\n", at, stop)
            end = stop if end < 0 else end + 1
            line = cache[at] = (end, plain(text[at:end]), bool(text[at:end].strip()))
        if line[2]:
            out.append((at, line[0], line[1]))
        at = line[0]
    return out


def _in_lines(text: str, parts: list[tuple[int, int]], cache: dict[int, tuple[int, str, bool]]) -> tuple[str, int, int] | None:
    """The first, then longest known sentence that fills whole lines and begins in the first of the pieces.

    The first piece is walked in stretches of lines, each seen with the lines that
    follow it, so the time until a find grows with the text before it.
    """
    begin, stop = parts[0]
    last = stop
    for a, b in parts[1:]:
        if b - stop > SPAN:
            break
        last = b
    m = _BLACK.search(text, begin, last)
    first = text.find("\n", m.start(), last) if m else -1
    if first < 0 or not _BLACK.search(text, first, last):
        return None
    ends = [b for _, b in parts if b <= last]
    while begin < stop:
        reach = _line_end(text, begin + SPAN // 8, stop)          # begins of this stretch
        seen = reach if reach < stop else last
        if reach < stop:
            seen = _line_end(text, reach + SPAN, stop)
            seen = seen if seen < stop else last
        lines, at = [], begin
        for end in [e for e in ends if begin < e < seen] + [seen]:  # a piece's end also ends a line
            lines += _lines_of(text, at, end, cache)
            at = end
        joined = "\n".join(line for _, _, line in lines)
        begins, stops, at = [], {}, 0
        for a, b, line in lines:
            if a < reach:
                begins.append((at, a))
            at += len(line)
            stops[at] = b
            at += 1
        for at, a in begins:
            found = [(m.end(), name) for name, pattern in _LINES if (m := pattern.match(joined, at)) and m.end() in stops]
            if found:
                end, name = max(found, key=lambda f: f[0])
                return name, a, stops[end]
        begin = reach
    return None


def _line_end(text: str, at: int, stop: int) -> int:
    """The end of the line at a place, ``stop`` at most."""
    end = text.find("\n", min(at, stop), stop)
    return stop if end < 0 else end + 1


def known(sentence: str) -> str | None:
    for name, pattern in _KNOWN:
        if pattern.fullmatch(sentence):
            return name
    return None


#: Unknown sentences that may stand between two of a rule.
GAP = 3


def match(names: list[str | None]) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """((licence, places of its sentences) in order of place, places that no rule took)."""
    free = [n is not None and n != "copyright" for n in names]
    rest = [i for i, n in enumerate(names) if n is not None and n != "copyright"]
    found, present = [], {names[i] for i in rest}
    for licence, sequence in RULES:
        wanted = [s.split("|") for s in sequence]
        if not all(present.intersection(w) for w in wanted):
            continue
        k = 0
        while k + len(wanted) <= len(rest):
            at = rest[k:k + len(wanted)]
            near = all(sum(names[i] is None for i in range(x + 1, y)) <= GAP for x, y in zip(at, at[1:], strict=False))
            # in sequence: nothing but copyright lines and the like may stand between, and no sentence that another rule took
            if near and all(free[i] and names[i] in w for i, w in zip(at, wanted, strict=True)) and all(free[i] for i in range(at[0], at[-1] + 1) if names[i] is not None and names[i] != "copyright"):
                found.append((licence, at))
                for i in at:
                    free[i] = False
                k += len(wanted)
            else:
                k += 1
    return sorted(found, key=lambda f: f[1][0]), [i for i in rest if free[i]]


def scan_text(text: str | None) -> dict:
    """licences, sentence identifiers, spans, identifiers left over and the identifiers that SPDX tags name."""
    if not text or not any(t in (low := text.lower()) for t in TRIGGERS):
        return {"licences": [], "sentences": [], "left": [], "spdx": []}
    parts = identify(text)
    found, left = match([p[0] for p in parts])
    noticed = [n for n, *_ in parts]
    claims = [f for f in found if f[0] == "proprietary" and not (f[1][0] and noticed[f[1][0] - 1] == "copyright")]
    # "all rights reserved" that ends a copyright line says nothing beside a licence
    others = [f for f in found if f[0] != "proprietary"]
    names = list(dict.fromkeys(f[0] for f in found if not others or f[0] != "proprietary" or f in claims))
    return {"licences": names, "sentences": [{"id": n, "begin": a, "stop": b} for n, a, b in parts if n is not None], "left": [parts[i][0] for i in left],
            "spdx": list(dict.fromkeys(x for m in _TAG.finditer(text) for x in re.findall(r"[^\s()]+", m["expression"]) if x.upper() not in ("AND", "OR", "WITH")))}


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): licences, sentences with spans, left, spdx."""
    kind = pa.struct([("licences", pa.list_(pa.string())), ("sentences", pa.list_(pa.struct([("id", pa.string()), ("begin", pa.int64()), ("stop", pa.int64())]))), ("left", pa.list_(pa.string())), ("spdx", pa.list_(pa.string()))])

    @arrow_udf("licences array<string>, sentences array<struct<id:string,begin:bigint,stop:bigint>>, left array<string>, spdx array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(None if (v := t.as_py()) is None else v.decode("utf-8", "replace")) for t in texts], kind)

    (out,) = fresh(docs, "licence_scan")
    return docs.withColumn(out, of.asNondeterministic()(raw(text))), out


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences, sentence_ids, left, spdx."""
    got, c = scan(docs.select("doc_id", "text"))
    return got.select("doc_id", F.col(c)["licences"].alias("licences"), F.col(c)["sentences"]["id"].alias("sentence_ids"), F.col(c)["left"].alias("left"), F.col(c)["spdx"].alias("spdx"))
