"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines gone,
everything but letters and digits a single space, and equivalent spellings made
one. The SHA-256 of the form is joined with the digests of known licences. A
document is looked up as a whole, and so is each of its lines, for the notices
that name a licence in one line. Both come from one pass over the text.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.llm.common import cut_lineage

#: Digests of known texts that are broadcast at most, 64 characters each.
MOST_BROADCAST = 100_000


def _not_beginning(words: list[str], also: str = "") -> str:
    """A pattern, without lookahead, of the start of what begins with none of ``words``; a line's end counts as any character."""
    heads = sorted({w[0] for w in words})
    more = [h + _not_beginning(rest) for h in heads if all(rest := [w[1:] for w in words if w[0] == h])]
    return "(" + "|".join([f"[^{''.join(heads)}{also}\\n]", *more]) + ")"


#: What follows "copyright" at the start of a wrapped line of a licence, unlike a name.
NOT_NAMES = ["notice", "holder", "owner", "license", "licence", "statement", "disclaimer", "interest", "infring", "protect", "laws", "law ", "and ", "or ", "in ", "is ", "of ", "for ", "on ", "to ", "act "]
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9])|copyright[ \t]+" + _not_beginning(NOT_NAMES, r" \t") + r"|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
OTHER_CHARACTERS = r"[^\p{L}\p{N}\n]+"

# Spellings that count as the same word.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "owner": "holder",
    "owners": "holders",
    "programme": "program",
    "sublicence": "sublicense",
    "whilst": "while",
    "wilful": "willful",
}

# Full texts of short licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE", 1)
UNLICENSE_START = "This is free and unencumbered software released into the public domain."
TEXTS = {"MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3}
# One-line notices.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    "Released under the BSD 2-Clause License.": "BSD-2-Clause",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0",
    UNLICENSE_START: "Unlicense",
}
for _part, _words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    NOTICES |= dict.fromkeys([f"Licensed under CC {_part} 4.0.", f"This work is licensed under CC {_part} 4.0.", f"This work is licensed under a Creative Commons {_words} 4.0 International License.", f"SPDX-License-Identifier: CC-{_part}-4.0"], f"CC-{_part}-4.0")
# Title lines that stand above the full texts.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'], "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License']}
NOTICES |= {f"{_title}\n{TEXTS[_id]}": _id for _id, _titles in TITLES.items() for _title in _titles}

TERMS_END = "END OF TERMS AND CONDITIONS"


def long_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the texts in the folder licence_texts, whole, and without what follows the end of their terms."""
    found = []
    for file in sorted(files("sceneweave.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            found.append((name, text))
            if TERMS_END in text:
                found += [(name, text[: text.index(TERMS_END)]), (name, text[: text.index(TERMS_END) + len(TERMS_END)])]
    return found


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; one empty line for null.

    Words stand between two blanks each while spellings are replaced, so that
    each word has blanks of its own.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.replace(F.regexp_replace(out, OTHER_CHARACTERS, "  "), F.lit("\n"), F.lit(" \n "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for other, usual in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.transform(F.split(F.replace(out, F.lit("  "), F.lit(" ")), "\n"), lambda x: F.trim(x))


def joined(lines: Column) -> Column:
    """The canonical form of the whole text."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in texts and notices."""
    rows = [*TEXTS.items(), *((b, a) for a, b in NOTICES.items()), *long_texts()]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, license_id, n_notices, notice_ids: one row per input row.

    license_id is the licence whose text the whole document is, or null;
    n_notices counts the document's lines that are a known text by themselves,
    and notice_ids lists their licences in order, joined by commas (empty if
    none). Null texts are empty and match nothing. Repeated and null ids are
    rows of their own. If two known texts have one canonical form, the smaller
    license_id stands for it. Other columns are not read. A very long text is
    one row's array of lines.

    Up to ``MOST_BROADCAST`` known digests go to the documents, more are joined
    by shuffle. Of the lines only those that match go on to be gathered by
    document.
    """
    digests = known.select("license_id", joined(canonical_lines(F.col("text"))).alias("form")).where("form <> ''")
    digests = cut_lineage(digests.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("known_id")))
    digests = F.broadcast(digests) if digests.count() <= MOST_BROADCAST else digests
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    forms = F.concat(F.array(joined(F.col("lines"))), F.col("lines"))  # the whole text, then its lines
    looked_up = rows.select("row", "doc_id", F.posexplode(forms).alias("k", "form")).where("k = 0 OR form <> ''")
    looked_up = looked_up.select("row", "doc_id", "k", F.sha2("form", 256).alias("digest")).join(digests, "digest", "left").where("k = 0 OR known_id IS NOT NULL")
    whole, line = F.col("k") == 0, F.col("k") > 0
    gathered = looked_up.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("known_id"))).alias("license_id"),
        F.count_if(line).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("known_id")))), ",").alias("notice_ids"),
    )
    return gathered.drop("row")
