"""Licences by sentence rules, in built-in functions.

A text is cut into pieces at marks and line ends, and the pieces are normalised. A known licence sentence
is found wherever its words are those of one piece or of several in a row, so that it does not matter how
its lines are wrapped, indented or commented, nor which marks stand inside it. What is found is a sequence
of identifiers in the order of the text, in which too many other pieces between two leave a break. Ordered rules are matched against the sequence: at each place the first rule that fits
takes its identifiers, and the matching goes on behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.base import text_array, text_map
from mediasift.llm.common import whole_text

#: Pieces that may lie between two sentences of one licence.
MOST_BETWEEN = 2

# Sentences of public licences, as they stand after normalisation, by identifier.
SENTENCES = {
    "apl": "licensed under the apache license version 2 0",
    "ap1": "licensed under the apache license version 2 0 the license",
    "ap2": "you may not use this file except in compliance with the license",
    "ap3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "ap4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ap5": "see the license for the specific language governing permissions and limitations under the license",
    "ap6": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mtl": "released under the mit license",
    "mt0": "mit license",
    "mt1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mt2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mt3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mt4": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bs1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bs2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bs3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bs4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gp1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gp2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gp3": "see the gnu general public license for more details",
    "cnl": "licensed under cc by nc 4 0",
    "cn1": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccl": "licensed under cc by 4 0",
    "cc1": "this work is licensed under a creative commons attribution 4 0 international license",
}

# Rules in the order in which they are tried; a letter after # tells grant, notice or partial text.
RULES = [
    ("Apache-2.0#grant", ["ap1", "ap2", "ap3", "ap4", "ap5"]),
    ("Apache-2.0#grant", ["ap1", "ap2", "ap6", "ap5"]),  # on one line no mark follows the address
    ("MIT#grant", ["mt0", "mt1", "mt2", "mt3", "mt4"]),
    ("MIT#grant", ["mt1", "mt2", "mt3", "mt4"]),
    ("BSD-3-Clause#grant", ["bs1", "bs2", "bs3", "bs4"]),
    ("BSD-2-Clause#grant", ["bs1", "bs2", "bs3"]),
    ("GPL-3.0-or-later#grant", ["gp1", "gp2", "gp3"]),
    ("Apache-2.0#notice", ["apl"]),
    ("Apache-2.0#notice", ["ap1", "ap2"]),
    ("Apache-2.0#notice", ["ap1"]),
    ("MIT#notice", ["mtl"]),
    ("MIT#notice", ["mt0"]),
    ("GPL-3.0#notice", ["gpl"]),
    ("GPL-3.0-or-later#notice", ["gp1"]),
    ("CC-BY-NC-4.0#notice", ["cnl"]),
    ("CC-BY-NC-4.0#notice", ["cn1"]),
    ("CC-BY-4.0#notice", ["ccl"]),
    ("CC-BY-4.0#notice", ["cc1"]),
    ("MIT#partial", ["mt2", "mt3", "mt4"]),
    ("MIT#partial", ["mt1"]),
    ("BSD#partial", ["bs1", "bs2"]),
]

#: A piece ends at a mark before a space, at an empty line, and at a line's end that is no mere wrap:
#: the next line begins in lower case, or both lines are in capitals.
BOUNDARY = r"(?<=[.!?;:])\s+|\n\s*\n|\n(?![a-z])(?!(?<=[A-Z,]\n)[A-Z])"


#: Marks alone at a line's beginning are comment signs and end no sentence.
MARK_SIGN = r"(?m)^([ \t]*)[.!?;:]+(?=\s)"


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, MARK_SIGN, "$1"), BOUNDARY)


def normalise(sentence: Column) -> Column:
    """Lower-case words and numbers, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


#: Where a piece begins in a text of numbered pieces: a line and the piece's number.
PIECE = "\n[0-9]+:"


def _known(text: Column) -> Column:
    """Known sentences in the order of the text: id, and the numbers of the first and last piece."""
    ids = text_map({v: k for k, v in SENTENCES.items()})
    numbered = F.transform(sentences(text), lambda s, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(":"), normalise(s)))
    longest_first = sorted(SENTENCES.values(), key=len, reverse=True)
    any_of = "|".join(s.replace(" ", f"(?: |{PIECE})") for s in longest_first)
    # pieces without a word are left out before the rest is joined: no pattern has to step over a run of them
    worded = F.filter(numbered, lambda s: ~s.endswith(":"))
    pieces = F.concat(F.array_join(worded, ""), F.lit("\n"))
    found = F.regexp_extract_all(pieces, F.lit(f"{PIECE}(?:{any_of})(?=\n)"), F.lit(0))
    number = lambda x, pattern: F.regexp_extract(x, pattern, 1).cast("int")

    def one(x: Column) -> Column:
        words = F.trim(F.regexp_replace(x, PIECE, " "))
        return F.struct(F.element_at(ids, words).alias("id"), number(x, "^\n([0-9]+):").alias("at"), number(x, "\n([0-9]+):[^\n]*$").alias("last"))

    return F.transform(found, one)


def _sequence(known: Column) -> Column:
    """Identifiers, each with a semicolon, and a bar where too many other sentences lie between."""

    def one(x: Column, i: Column) -> Column:
        far = x["at"] - F.get(known, i - 1)["last"] > MOST_BETWEEN + 1
        return F.concat(F.when((i > 0) & far, "|").otherwise(""), x["id"], F.lit(";"))

    return F.array_join(F.transform(known, one), "")


def scan(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, known (identifier, first and last piece of each recognised sentence), matches.

    `matches` has, in the order of the text, the licence and form of each rule that fits. Null and empty
    texts, and those without a known sentence, have empty arrays; repeated rows are scanned each for
    itself; an empty table gives no rows.
    """
    known = docs.select("doc_id", _known(whole_text()).alias("known"))
    whole = ["".join(f"{i};" for i in rule) for _, rule in RULES]
    first_of = {}
    for (name, _), run in zip(RULES, whole, strict=True):
        first_of.setdefault(run, name)
    runs = F.expr("regexp_extract_all(__sequence, '({})', 1)".format("|".join(whole)))
    names = text_map(first_of)
    sequenced = known.withColumn("__sequence", _sequence(F.col("known")))
    return sequenced.select("doc_id", "known", F.transform(runs, lambda r: F.element_at(names, r)).alias("matches"))


def licenses_of(matches: Column) -> Column:
    """Licences of the matches, each once, in the order of their first match."""
    return F.array_distinct(F.transform(matches, lambda m: F.substring_index(m, "#", 1)))


def kind_of(licenses: Column) -> Column:
    """none, permissive, copyleft or noncommercial: the strictest among the licences."""
    has = lambda *names: F.arrays_overlap(licenses, text_array(names))
    return F.when(F.size(licenses) == 0, "none").when(has("CC-BY-NC-4.0"), "noncommercial").when(has("GPL-3.0", "GPL-3.0-or-later"), "copyleft").otherwise("permissive")
