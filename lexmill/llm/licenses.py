"""Licence scan: sentences become identifiers, ordered identifiers become licences.

A text is cut into sentences, each normalised (lower case, letters and digits only,
single spaces) and looked up among the known licence sentences. The sequence of the
identifiers found is then matched against rules: a licence holds where its identifiers
occur in the rule's order, others in between allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier: fixed values.
SENTENCES = {
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-line-3": "This code is released under the MIT License.",
    "mit-line-4": "This project is licensed under the MIT License.",
    "mit-line-5": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "mit-line-6": "Distributed under the MIT License.",
    "apache-line-2": "This project is licensed under the Apache License 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-any": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "version-21": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "version-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-2": "The name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-3": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "dual-line": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "reserved": "All rights reserved.",
}
#: Licence -> alternatives of ordered sentence identifiers: fixed values.
RULES = {
    "Apache-2.0": [["apache-line"], ["apache-line-2"], ["apache-head", "apache-copy", "apache-basis"], ["apache-head"], ["dual-line"]],
    "MIT": [["mit-line"], ["mit-line-2"], ["mit-line-3"], ["mit-line-4"], ["mit-line-5"], ["mit-line-6"], ["dual-line"], ["mit-grant", "mit-notice", "mit-as-is"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-2"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-3"]],
    "GPL-3.0": [["gpl3-line"], ["gpl-free", "gpl-hope"], ["gpl-free"]],
    "GPL-2.0": [["gpl2-line"], ["gpl2-terms", "version-2"]],
    "LGPL-2.1": [["lgpl21-terms", "version-21"]],
    "LGPL-3.0": [["lgpl3-terms"]],
    "AGPL-3.0": [["agpl3-terms"]],
    "MPL-2.0": [["mpl-form", "mpl-copy"], ["mpl-form", "mpl-copy-2"], ["mpl-form"]],
    "EPL-2.0": [["epl-terms"]],
    "ISC": [["isc-grant", "isc-as-is"], ["isc-grant"]],
    "CC0-1.0": [["cc0-line"]],
    "Unlicense": [["unlicense-free"], ["unlicense-any"]],
    "CC-BY-NC-4.0": [["cc-by-nc-line"]],
    "CC-BY-4.0": [["cc-by-line"]],
    "CC-BY-SA-4.0": [["cc-by-sa-line"]],
    "proprietary": [["reserved"]],
}
#: A licence whose rule another one's goes on from, and that other one: the longer rule wins. Fixed values.
LONGER = {"BSD-2-Clause": "BSD-3-Clause"}
#: Identifiers of machine-readable lines, each a sentence and a rule of its own: fixed values.
SPDX = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "OFL-1.1",
    "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
]
for _id in SPDX:
    for _end in ("", "-only", "-or-later") if "GPL" in _id else ("",):
        SENTENCES[f"spdx-{_id}{_end}".lower()] = f"SPDX-License-Identifier: {_id}{_end}"
        RULES.setdefault(_id, []).append([f"spdx-{_id}{_end}".lower()])
#: Slots of sentences in normal form: whatever stands there counts as the words that the table has. Fixed values.
SLOTS = {
    r"^neither the name of [a-z0-9 ]{1,100}? nor the names of (?:its |the |any )?contributors may": "neither the name of the copyright holder nor the names of its contributors may",
    r"^the name of [a-z0-9 ]{1,100}? may not be used to endorse": "the name of the copyright holder may not be used to endorse",
}
#: Each normalised known sentence holds one of these words: texts without any are not cut.
ANCHORS = ("licens", "copyright", "reserved", "redistribut", "permission", "warrant", "free software", "unencumbered", "mpl", "anyone is free", "endorse")
#: Where a sentence ends, but for line ends.
ENDS = r"(?<=[.!?:;])(?<!(?i:license-identifier:))\s+"


def parts() -> dict[str, list[str]]:
    """The known sentences by identifier, cut as texts are: a part of several is the identifier with its number."""
    out = {}
    for k, s in SENTENCES.items():
        cut = [normal(x) for x in re.split(ENDS, s)]
        out.update({k if len(cut) == 1 else f"{k}-{i}": x for i, x in enumerate(cut, 1)})
    return out


def ordered(rule: list[str], known: list[str]) -> list[str]:
    """A rule's identifiers, each sentence of several parts replaced by its parts."""
    return [p for k in rule for p in ([k] if k in known else [f"{k}-{i}" for i in range(1, 10) if f"{k}-{i}" in known])]


def normal(text: str) -> str:
    """A sentence in normal form (the twin of ``_normal`` for the table above)."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _filled(c: Column) -> Column:
    """A normalised sentence with the table's words in its slots."""
    for pattern, words in SLOTS.items():
        c = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, words)).otherwise(c)
    return c


def _sentences(text: Column, breaks: str) -> Column:
    """The normalised sentences; a machine-readable line gives one for each identifier of its expression."""
    tag = r"(?is)^.*?SPDX-License-Identifier:\s*"

    def expression(s: Column) -> Column:
        terms = F.split(F.regexp_replace(F.regexp_replace(s, tag, ""), r"(?<=[0-9])\+", "-or-later"), r"\s+(?:OR|AND|WITH)\s+")
        return F.transform(terms, lambda t: F.concat(F.lit("spdx license identifier "), _normal(t)))

    return F.flatten(F.transform(F.split(text, breaks), lambda s: F.when(s.rlike(tag), expression(s)).otherwise(F.array(_filled(_normal(s))))))


def license_scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_sentences, sentences, licenses``, one row per input row.

    ``sentences`` joins the identifiers found, in text order, by ``,``; ``licenses`` joins
    the licences whose rules hold, sorted, by ``,``; n_sentences counts the identifiers.
    Sentences end at a line end, or at ``. ! ? : ;`` before white space; a licence text
    wrapped over lines is found by cutting at the latter alone. A known sentence with
    such an end inside counts as its parts, ``NAME-1``, ``NAME-2``. Holders' names are slots:
    any words may stand there. Of SPDX expressions each known identifier counts, whatever
    operators join them; ``+`` is read as ``-or-later``.

    Edge cases: null and empty texts have none. Repeated sentences count each time. Null
    and repeated doc_ids stay as they are. Where a text holds a rule and a longer one that
    goes on from it (BSD-2-Clause, BSD-3-Clause), only the longer licence is given.
    Extra columns are ignored. An empty table gives an empty one.
    """
    by_name = parts()
    known = {s: k for k, s in by_name.items()}
    assert all(any(a in s for a in ANCHORS) or "cc by" in s for s in known)
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    text = F.coalesce(F.col("text"), F.lit(""))
    anchored = text.rlike("(?i)cc by|" + "|".join(ANCHORS))

    def ids(breaks: str) -> Column:
        return F.filter(F.transform(_sentences(text, breaks), lambda s: F.element_at(table, s)), lambda x: x.isNotNull())

    rows = docs.select("doc_id", F.when(anchored, ids(ENDS + r"|[\r\n]+")).alias("by_line"), F.when(anchored, ids(ENDS)).alias("wrapped"))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", F.when(F.size("wrapped") > F.size("by_line"), F.col("wrapped")).otherwise(F.coalesce("by_line", none)).alias("ids"), F.coalesce("wrapped", none).alias("other"))
    line = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    other = F.concat(F.lit(","), F.array_join("other", ",,"), F.lit(","))
    found, holds = [], {}
    for name, rules in sorted(RULES.items()):
        pattern = "|".join(".*".join(f",{re.escape(k)}," for k in ordered(rule, by_name)) for rule in rules)
        holds[name] = line.rlike(pattern) | other.rlike(pattern)
    for name, own in holds.items():
        found.append(F.when(own & ~holds[LONGER[name]] if name in LONGER else own, F.lit(name)))
    return rows.select("doc_id", F.size("ids").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), F.concat_ws(",", *found).alias("licenses"))
