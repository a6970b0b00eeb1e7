import re

from mediasift.llm import licenses as lic

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = "This work is licensed under the GNU General Public License, version 3."
CC = "Licensed under CC BY-NC 4.0."
MANY = "First. Second. Third. Fourth. Fifth."


def _brute(text):
    ids = {v: k for k, v in lic.SENTENCES.items()}
    cut = [re.sub("[^a-z0-9]+", " ", s.lower()).strip() for s in re.split(lic.BOUNDARY, text)]
    known = [(ids[s], i) for i, s in enumerate(cut) if s in ids]
    runs, last = [], None
    for k, i in known:
        if last is None or i - last > lic.MOST_BETWEEN + 1:
            runs.append([])
        runs[-1].append(k)
        last = i
    out = []
    for run in runs:
        at = 0
        while at < len(run):
            for name, rule in lic.RULES:
                if run[at : at + len(rule)] == rule:
                    out.append(name)
                    at += len(rule)
                    break
            else:
                at += 1
    return known, out


TEXTS = [
    MIT, GPL, CC, "Some words.\n" + GPL + "\nMore words. " + CC, "Header line\n" + MIT + MANY + "\n" + CC, MIT.replace("\n", " "), "prose only, nothing else", "",
    None, "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License.", "x " * 50_000 + ".\n" + CC,
]


def test_against_brute_force(spark):
    rows = spark.createDataFrame(enumerate(TEXTS), "doc_id int, text string")
    for r in lic.scan(rows).collect():
        known, matches = _brute(TEXTS[r.doc_id] or "")
        assert ([(k.id, k["at"]) for k in r.known], list(r.matches)) == (known, matches)


def test_licences_found(spark):
    rows = spark.createDataFrame(enumerate(TEXTS), "doc_id int, text string")
    named = lic.scan(rows).withColumn("licenses", lic.licenses_of(lic.F.col("matches")))
    out = {r.doc_id: (list(r.licenses), r.kind) for r in named.withColumn("kind", lic.kind_of(lic.F.col("licenses"))).collect()}
    assert out[0] == (["MIT"], "permissive") and out[1] == (["GPL-3.0"], "copyleft") and out[2] == (["CC-BY-NC-4.0"], "noncommercial")
    assert out[3] == (["GPL-3.0", "CC-BY-NC-4.0"], "noncommercial") and out[4] == (["MIT", "CC-BY-NC-4.0"], "noncommercial")
    assert out[5] == (["MIT"], "permissive") and out[6] == out[7] == out[8] == ([], "none") and out[9][0] == ["Apache-2.0"]
    assert out[10] == ([], "none") and out[11][0] == ["CC-BY-NC-4.0"]


GPL_NOTICE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE_NOTICE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = {"GPL-3.0-or-later": GPL_NOTICE, "Apache-2.0": APACHE_NOTICE, "MIT": MIT, "BSD-2-Clause": BSD_NOTICE, "BSD-3-Clause": BSD_NOTICE + BSD_3}


def _forms(text):
    bare = [line.strip() for line in text.splitlines()]
    yield text
    yield "\n".join(bare)
    yield " ".join(bare).replace("MIT License", "MIT License.")
    for sign in ("    ", "# ", " * ", "// ", ";; "):
        yield "\n".join(f"{sign}{line}".rstrip() for line in bare)


def test_standard_wording_in_any_layout(spark):
    """Wrapped, indented, commented or on one line: the whole grant, once."""
    asked = [(name, form) for name, text in NOTICES.items() for form in _forms(text)]
    rows = spark.createDataFrame([(i, form) for i, (_, form) in enumerate(asked)], "doc_id int, text string")
    found = {r.doc_id: list(r.matches) for r in lic.scan(rows).collect()}
    assert [(n, found[i]) for i, (n, _) in enumerate(asked)] == [(n, [f"{n}#grant"]) for n, _ in asked]


def test_each_rule_fires_on_its_own_sentences(spark):
    text = lambda rule: "\n\n".join(lic.SENTENCES[i] + "." for i in rule)
    rows = spark.createDataFrame([(i, text(rule)) for i, (_, rule) in enumerate(lic.RULES)], "doc_id int, text string")
    found = {r.doc_id: list(r.matches) for r in lic.scan(rows).collect()}
    assert found == {i: [name] for i, (name, _) in enumerate(lic.RULES)}


def test_sentences_are_as_normalised():
    for sentence in lic.SENTENCES.values():
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", sentence)
    assert len(set(lic.SENTENCES.values())) == len(lic.SENTENCES)


def test_long_runs_of_pieces_without_words(spark):
    texts = ["MIT\n" + "第一行\n" * 2500, "licensed\n" + ".\n#\n" * 3000, "The\n" + "Это строка\n" * 200_000, "MIT\n" + "-\n" * 200_000 + "License\n"]
    texts.append("Released under\n" + "—\n" * 5000 + "the MIT license.")
    rows = spark.createDataFrame(enumerate(texts), "doc_id int, text string")
    assert {r.doc_id: list(r.matches) for r in lic.scan(rows).collect()} == {0: [], 1: [], 2: [], 3: ["MIT#notice"], 4: ["MIT#notice"]}


def test_odd_documents(odd_docs, no_docs):
    assert lic.scan(odd_docs).count() == odd_docs.count() and lic.scan(no_docs).count() == 0
