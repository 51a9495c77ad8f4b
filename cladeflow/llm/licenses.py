"""License scans: canonical texts, hash-joined by digest to those of known licences."""

from __future__ import annotations

import re
from functools import cache
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of spellings that license matching takes as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Texts and notices by which licences are known.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """BSD Zero Clause License

Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Copyright <year> <owner>

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]

#: A line that begins with a mark of copyright is left out.
COPYRIGHT_LINE = r"(?i)^[ \t*#/;-]*(?:copyright|©|\(c\))(?:[^a-z].*)?$"
#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical(line: Column) -> Column:
    """A line in lower case, its words one blank apart, equivalent spellings made one; a line of
    copyright is empty."""
    to = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    plain = F.trim(F.regexp_replace(F.lower(F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(line)), BETWEEN, " "))
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.element_at(to, w), w)), " ")


def lines_of(text: Column) -> Column:
    """The canonical lines of a text that have words, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]+"), canonical), lambda x: x != "")


# Names by which one-line notices call the licences, besides the identifiers.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"],
    "Artistic-1.0-Perl": ["Artistic License 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0 License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 License"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0 License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0 License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0 License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-1.0": ["GNU General Public License, version 1", "GNU GPL version 1", "GPLv1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL version 3"],
    "ISC": ["ISC License"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "Unicode-3.0": ["Unicode License v3"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
# How a one-line notice begins, and what stands before the licence's name.
BEGINNINGS = ["Licensed", "Released", "Distributed", "This project is licensed", "This work is licensed", "This software is licensed", "This code is licensed", "This file is licensed"]
BEFORE_NAME = ["under", "under the", "under a", "under the terms of", "under the terms of the"]
#: What follows the terms in a whole text, and documents often leave out.
APPENDIX = r"(?m)^[ \t]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms|ADDENDUM: How to use|EXHIBIT A|Exhibit A - ).*(?s:.*)"
#: What stands alone on a line at the end of the terms.
END_OF_TERMS = r"(?mi)^[ \t]*end of terms and conditions[ \t]*$"


def wordings(text: str) -> set[str]:
    """A whole text as documents give it: with and without its title, its appendix, the line "All rights
    reserved", and the numbers of a short text's conditions."""
    cuts = [
        lambda t: re.sub(APPENDIX, "", t),
        lambda t: re.sub(END_OF_TERMS, "", t),
        lambda t: re.sub(r"(?mi)^[ \t]*all rights reserved\.?[ \t]*$", "", t),
        lambda t: re.sub(r"(?m)^[ \t]*\d\.[ \t]", "", t) if len(t) < 3000 else t,
        lambda t: t.lstrip().partition("\n\n")[2] if len(t.lstrip().partition("\n\n")[0]) < 100 else t,
    ]
    found = {text}
    for f in cuts:
        found |= {cut for t in found if len(cut := f(t)) > 400}
    return found


@cache
def all_known() -> list[tuple[str, str]]:
    """``KNOWN``, the whole texts in the folder license_texts (<license>[--<edition>].txt) and those of
    ``KNOWN`` in all ``wordings``, and one-line notices by ``NAMES``."""
    files = [(f.name.removesuffix(".txt").split("--")[0], f.read_text("utf-8")) for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    whole = {(name, t) for name, text in KNOWN + files if len(text) > 400 for t in wordings(text)}
    titles = {name: ["", *names, *[f"The {x}" for x in names], *[f"{x} ({name})" for x in names], *[f"The {x} ({name})" for x in names]] for name, names in NAMES.items()}
    whole |= {(name, f"{title}\n{rights}\n{t}") for name, t in whole if len(t) < 3000 for title in titles[name] for rights in ("", "All rights reserved.")}
    lines = {(name, f"{a} {b} {called}") for name, names in NAMES.items() for a, b, called in product(BEGINNINGS, BEFORE_NAME, [name, *names])}
    tags = {(name, f"{tag}: {name}{more}") for name in NAMES for tag in ("SPDX-License-Identifier", "License") for more in (["", "-only", "-or-later", "+"] if "GPL" in name or "GFDL" in name else [""])}
    return KNOWN + sorted(whole | lines | tags)


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """Known licences: license, digest. As many rows as ``texts`` at most, one for each digest."""
    rows = spark.createDataFrame(texts, "license string, text string")
    whole = F.sha2(F.array_join(lines_of(F.col("text")), " "), 256)
    return rows.select("license", whole.alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: n_words, digest (SHA-256) of its canonical text, license (of the known
    text that it is as a whole, else null), notices (licences that a line of it names by a known
    notice, sorted, joined by commas; empty if none).

    The texts' digests are hash-joined to the known ones, which are broadcast: their number is that
    of ``texts`` (license, text) at most, ``all_known()`` if None. Nothing is shuffled.

    Defined results: null, empty and wordless texts have the digest of the empty text and no
    license; ids may be null and rows may repeat; other columns are not returned.
    """
    rows = known(docs.sparkSession, all_known() if texts is None else texts).collect()
    by_digest = docs.sparkSession.createDataFrame(rows, "digest string, license string")
    lines = docs.select(F.col(id_col), lines_of(F.col(text_col).cast("string")).alias("lines"))
    whole = F.array_join("lines", " ")
    hashed = lines.select(
        id_col,
        F.when(F.size("lines") == 0, 0).otherwise(F.regexp_count(whole, F.lit(" ")) + 1).cast("long").alias("n_words"),
        F.sha2(whole, 256).alias("digest"),
        F.transform("lines", lambda x: F.sha2(x, 256)).alias("line_digests"),
    )
    # lines are looked up in a hash set, and only those found in the map, which is searched from its start
    listed = lambda k: "split('" + " ".join(r[k] for r in rows) + "', ' ')"
    hits = F.expr("filter(line_digests, d -> d IN (" + ", ".join(f"'{r.digest}'" for r in rows) + "))") if rows else F.array().cast("array<string>")
    table = F.expr(f"map_from_arrays({listed('digest')}, {listed('license')})")
    named = F.transform(hits, lambda d: F.element_at(table, d))
    notices = F.array_join(F.array_sort(F.array_distinct(named)), ",")
    return hashed.join(F.broadcast(by_digest), "digest", "left").select(id_col, "n_words", "digest", "license", notices.alias("notices"))
