"""License scans by sentence rules.

A text is cut into sentences, sentences are normalised to lowercase letters and digits, and known ones become identifiers.  The known
sentences and the rules come from the license notices below, cut by the same ends of sentences: a rule is the sequence of its
notice's identifiers, and a license is found where they occur in that order; other known sentences may stand between.  Parts of a
sentence that differ from text to text (names of holders) are gaps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_MIT_FULL = f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
_GNU_HOPE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
_LESSER = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"

#: License notices; ``{}`` is a gap of one or more words.  A license has a rule for each of its notices.
NOTICES = [
    ("MIT", _MIT_FULL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT-0", f"{_MIT}. {_MIT_WARRANTY}"),
    ("X11", f"{_MIT_FULL} Except as contained in this notice, the name of {{}} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {{}}."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} The name {{}} may not be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + _GNU_HOPE),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version." + _GNU_HOPE),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + _GNU_HOPE),
    ("LGPL-2.1", _LESSER % "2.1"),
    ("LGPL-3.0", _LESSER % "3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: A full stop before a word that goes on with a sentence, as after "Inc.", ends nothing.
_ABBREVIATED = r"\.([ \t\r\n]+[^a-z0-9 \t\r\n]*(?:nor|be|may|shall|disclaims|as is)[^a-z0-9])"
#: Ends of sentences: a mark before a blank, a blank line; with ``_LINE`` any line's end.
_END = r"[.;:!?]+[ \t\r\n]+|[.;:!?]+\z|\n[ \t\r]*\n"
_LINE = r"\n"


def sentences_of(notice: str) -> list[str]:
    """The normalised sentences of a notice; a gap is ``{}``."""
    text = re.sub(_ABBREVIATED, r"\1", notice.lower().replace("{}", "\x02"))
    parts = re.sub(_END.replace(r"\z", r"\Z"), "\x01", text).split("\x01")
    found = [re.sub("[^a-z0-9\x02]+", " ", p).replace("\x02", "{}").strip() for p in parts]
    return [p for p in found if p]


def _known() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifiers by sentence, named after the first notice that has it, and the rules."""
    ids: dict[str, str] = {}
    rules = []
    for n, (license_, notice) in enumerate(NOTICES):
        parts = sentences_of(notice)
        for k, s in enumerate(parts):
            ids.setdefault(s, f"n{n}s{k}")
        rules.append((license_, [ids[s] for s in parts]))
    return ids, rules


IDS, RULES = _known()


def _within(short: list[str], long: list[str]) -> bool:
    left = iter(long)
    return all(x in left for x in short)


def vetoes(ids: list[str]) -> list[str]:
    """What a rule mustn't match across: the further sentences of rules that hold all of its own in order, whole or begun."""
    found = {x for _, more in RULES if len(more) > len(ids) and _within(ids, more) for x in more if x not in ids}
    return sorted(found | {f"{x}x" for x in found})


def follows(ids: Column, rule: Column, stops: Column) -> Column:
    """Whether the rule's identifiers stand in order in a text's, with no stop between them nor right after the last.

    One pass with the number of identifiers matched so far as state, so a text may have any number of sentences.
    """
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        stop, whole = F.array_contains(stops, x), s["at"] == F.size(rule)
        further = s["at"] + F.coalesce((F.get(rule, s["at"]) == x).cast("int"), F.lit(0))
        return F.struct(F.when(stop, 0).otherwise(further).alias("at"), (s["done"] | (whole & ~stop)).alias("done"))

    return F.aggregate(ids, none, step, lambda s: s["done"] | (s["at"] == F.size(rule)))


def _sentences(text: Column, ends: str) -> Column:
    """The normalised sentences of a text column."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), _ABBREVIATED, "$1"), ends, "\x01")
    return F.split(F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\x01]+", " "), " *\x01 *", "\x01"), "\x01")


def _gapped(sentence: Column) -> Column:
    """The identifier of a known sentence with gaps, with an ``x`` if only three words or more before the gap agree; null for others."""
    found = F.lit(None).cast("string")
    for known, i in IDS.items():
        if "{}" in known:
            pattern, start = "^" + known.replace("{}", "[a-z0-9].*") + "$", known.split("{}")[0]
            begun = F.when(F.lit(start.count(" ") > 2), f"{i}x")
            found = F.coalesce(F.when(sentence.startswith(start), F.when(sentence.rlike(pattern), i).otherwise(begun)), found)
    return found


def license_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, license, sentences)`` for each license that a row's text states.

    ``sentences`` are the identifiers of the license sentences found, in order.  A text is read twice: with lines run together, as wrapped
    paragraphs need, and with each line's end as a sentence's end, as notices without a full stop before them need; a rule
    matches in one of the two.  A rule whose sentences all stand in a longer one's, as BSD-2-Clause's in BSD-3-Clause's, doesn't match
    across the longer one's further sentences, nor right before them.  Null texts state nothing.  Null ids and equal rows are reported row by row, except that rows
    with equal id and text are one.  Extra columns are ignored; an empty table returns no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, s) for s, i in IDS.items() if "{}" not in s], "id string, sentence string")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), _sentences(F.col("text"), _END).alias("s")),
        F.struct(F.lit(1).alias("way"), _sentences(F.col("text"), f"{_END}|{_LINE}").alias("s")),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode(ways).alias("w")).select("doc_id", "row", "w.way", F.posexplode("w.s").alias("at", "sentence"))
    rows = rows.withColumn("sentence", F.trim("sentence")).join(F.broadcast(known), "sentence", "left")  # a list of this module
    rows = rows.withColumn("id", F.coalesce("id", _gapped(F.col("sentence")))).where("id is not null")
    found = rows.groupBy("doc_id", "row", "way").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    listed = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    rules = F.array(*[F.struct(F.lit(n).alias("license"), listed(ids).alias("rule"), listed(vetoes(ids)).alias("stops")) for n, ids in RULES])
    named = found.withColumn("r", F.explode(rules)).where(follows(F.col("ids"), F.col("r.rule"), F.col("r.stops")))
    return named.groupBy("doc_id", "row", F.col("r.license").alias("license")).agg(F.max(F.array_join("ids", " ")).alias("sentences")).drop("row")
