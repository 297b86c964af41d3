"""License scans by canonical digests, in DataFrame functions alone.

A text is made canonical: A-Z lower-cased, lines that only state a copyright
removed, equivalent spellings made one, every run of other characters than letters
and digits one blank. Its sha256 is then looked up among the digests of known
licence texts, a fixed table that is broadcast: TEXTS and the files of licence_texts,
each with and without its titles and in its usual forms. Whole documents
are looked up, and each line of a document, where licence notices stand.

A null or empty text has the digest of an empty text, which no licence has. A known
text is a row of its own under its name; two names with one canonical text
are both found, in order of name. Repeated rows are scanned one by one. Empty tables
give empty results; extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Spellings that licence texts use for the same word, the second made the first.
SPELLINGS = (("license", "licence"), ("sublicense", "sublicence"), ("noninfringement", "non infringement"), ("copyright holder", "copyright owner"),
             ("merchantability", "merchantibility"), ("http", "https"), ("and or", "and/or"), ("percent", "per cent"))

#: Notices as they stand in source files, by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
}

#: Whole licence texts.
_MIT_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
          'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER '
          'LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS '
          'IN THE SOFTWARE.')
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
          "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
          "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
              'MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES '
              'WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR '
              'IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')
TEXTS = {
    "MIT": f"{_GRANT}, subject to the following conditions: {_MIT_CONDITION}{_AS_IS}",
    "MIT-0": f"{_GRANT}. {_AS_IS}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "0BSD": f"{_ISC_GRANT}. {_ISC_AS_IS}",
}

#: Titles that stand above a licence's text, by SPDX name; short and long names as notices give them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"), "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache Software License 2.0"), "MPL-1.1": ("Mozilla Public License 1.1",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "GPL-1.0": ("GNU General Public License v1.0", "GNU GPL v1"), "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "Unlicense": ("The Unlicense", "Unlicense"), "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"), "Artistic-1.0-Perl": ("The Artistic License",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
#: The sentences that name a licence in source files.
SENTENCES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}",
             "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}",
             "This file is licensed under the {}", "This code is licensed under the {}", "License: {}")


def forms(name: str, text: str) -> set[str]:
    """Usual forms of a licence text: without the numbers of a short one's conditions, without the appendix, without and under each title."""
    made = {text, text.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"} if "END OF TERMS AND CONDITIONS" in text else {text}
    if name.startswith("BSD"):
        made |= {re.sub(r"(?m)^\d\. ", "* ", text)}
    return made | {f"{title}\n\n{one}" for title in TITLES.get(name, ()) for one in made}


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of every known form."""
    stored = {f.name.removesuffix(".txt"): f.read_text() for f in files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
    return [(name, form) for name, text in sorted({**stored, **TEXTS}.items()) for form in sorted(forms(name, text))]


def known_notices() -> list[tuple[str, str]]:
    """(name, line) of every known notice: NOTICES, SENTENCES with each title, and SPDX identifiers."""
    said = [(name, sentence.format(title)) for name, titles in TITLES.items() for title in dict.fromkeys((*titles, f"{name} License", name)) for sentence in SENTENCES]
    ids = [(name, f"SPDX-License-Identifier: {name}{end}") for name in TITLES for end in ("", *(("-only", "-or-later", "+") if "GPL" in name else ()))]
    return [*NOTICES.items(), *said, *ids]


#: Words that licences have after 'copyright' or '(c)' inside sentences, so that a line that begins so states none.
PROSE = (r"and|are|disclaimers?|doctrines?|holders?|if|interests?|laws?|licen[sc]es?|notices?|of|on|or|owners?|ownership|permissions?|representations|statements?|treat(?:y|ies)|"
         r"under|you|the\b(?!.*\b(?:authors|contributors|developers|project|foundation|team)\b)")


def canonical(text: Column, lines: bool = False) -> Column:
    """The canonical form; lines keeps line feeds, so that it can be cut at them."""
    c = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = F.regexp_replace(c, rf"(?m)^[^\p{{L}}\p{{N}}\n]*(copyright|\(c\)|©)(?=[ \t(])(?![^\p{{L}}\p{{N}}\n]*(?:(?:{PROSE})\b|$)).*$", "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+" if lines else r"[^\p{L}\p{N}]+", " ")
    for one, other in SPELLINGS:
        if other.replace("/", " ") != one:
            c = F.replace(c, F.lit(other.replace("/", " ")), F.lit(one))
    return c if lines else F.trim(c)


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def known(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """(digest, names) of licence texts, as (name, text)."""
    texts = sorted(texts)
    if not texts:
        return spark.range(0).select(F.lit("").alias("digest"), F.lit("").alias("names"))
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in texts])))
    return rows.groupBy(digest(canonical(F.col("text"))).alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, text_sha256 (of the canonical text), license (names whose text it is, or null) and notices (names of notices that are
    lines of it, sorted, comma-joined)."""
    spark, notices = docs.sparkSession, known_notices() if notices is None else list(notices.items())
    whole, lines = known(spark, known_texts() if texts is None else texts.items()), known(spark, notices)
    # The digests of the fixed notices are in the plan as 256 small maps, by their first two digits, since Spark reads a map from its start: no row for each line.
    table: list[dict[str, str]] = [{"": ""} for _ in range(256)]
    for r in lines.collect():
        table[int(r.digest[:2] or "0", 16)][r.digest] = r.names
    named = F.array(*[F.create_map(*[F.lit(x) for kv in sorted(t.items()) for x in kv]) for t in table])
    place = lambda d: F.conv(F.substring(d, 1, 2), 16, 10).cast("int")
    # A canonical notice is at most twice as long as the notice; longer lines need no digest.
    longest = 2 * max((len(x) for _, x in notices), default=0) + 2
    own = F.filter(F.split(canonical(F.col("text"), lines=True), "\n"), lambda x: F.length(x) <= longest)
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.transform(own, lambda x: digest(F.trim(x))), lambda d: named[place(d)][d]), lambda x: x.isNotNull())))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(canonical(F.col("text").cast("string"))).alias("text_sha256"),
                       F.array_join(found, ",").alias("notices"))
    return rows.join(F.broadcast(whole), rows.text_sha256 == whole.digest, "left").select("doc_id", "text_sha256", F.col("names").alias("license"), "notices")
