"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings unified, copyright statements dropped, punctuation
and white space reduced to single spaces. The form does not depend on where lines break. The SHA-256 digest of the whole
form is hash-joined to the digests of known licence texts, with and without their titles and appendices. Each line of the
length of a known form is looked up the same way, which finds notices within longer documents. The known digests are
broadcast up to MAX_KNOWN of them, so no document is shuffled; more are joined by a shuffle.

A copyright statement is a line that begins with "copyright" and a sign or year, with (c) and a year, or with a sign, or
one that only says that all rights are reserved; at the head of the text, also other lines that begin with "copyright".

Null and empty texts have the digest of the empty form and no licence. Repeated rows are returned once each. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings as (pattern, replacement), the pattern of copyright lines, and known texts. The SQL is
# made of SPELLINGS, COPYRIGHT_LINE and KNOWN; it depends on line breaks and drops every line that begins with "copyright".
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\blicensed under the terms of", "licensed under"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-infringement", "noninfringement"),
    (r"\bnon-commercial", "noncommercial"),
    (r"&", " and "),
    (r"https?://(www\.)?", " "),
    (r"\bversion ([0-9])", "v$1"),
    (r"\bv\.? ?([0-9])", "v$1"),
)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n©]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: What is replaced in turn, whatever the line breaks: spellings, then statements; with the strings of which a text that matches holds one.
_PROSE = r"(?![ \t]+(?:holder|owner|notice|statement|law|and|or|in|of|to|is|for|license|interest|disclaimer)s?\b)"
_UNFILLED = r"(?![^\p{L}\n]*(?:\(c\))?[^\p{L}\n]*(?:year|yyyy))"
_BODY = r"(?:everyone is permitted to copy|permission is hereby granted|permission to use, copy|redistribution and use in source|this software is provided 'as-is')"
FORMS = (
    (r"\r\n?", "\n", ("\r",)),
    (r"\blicence", "license", ("licence",)),
    (r"\blicensed\s+under\s+the\s+terms\s+of", "licensed under", ("licensed",)),
    (r"\bsub-\s*license", "sublicense", ("sub-",)),
    (r"\bnon-\s*infringement", "noninfringement", ("non-",)),
    (r"\bnon-\s*commercial", "noncommercial", ("non-",)),
    (r"&", " and ", ("&",)),
    (r"https?://(www\.)?", " ", ("http",)),
    (r"\bversion\s+([0-9])", "v$1", ("version",)),
    (r"\bv\.?\s?([0-9])", "v$1", ("v",)),
    # the steward's own statement is a part of its licence's first paragraph
    (r"\bcopyright\s+\(c\)[\s0-9,-]+free\s+software\s+foundation,?\s+inc\b\.?(?:\s*<[^>]{0,40}>)?", " ", ("foundation",)),
    (rf"[ \t]+(?={_BODY})", "\n", ("permi", "redistribution", "this software")),
    (rf"\A((?:[^\p{{L}}]*[^\n]{{0,60}}\blicense\b[^\n]{{0,30}}\n)?)(?:[^\p{{L}}©]*copyright\b{_PROSE}[^\n]*){{1,20}}", "$1", ("copyright",)),
    (rf"(?m)^[^\p{{L}}\n©]*(?:copyright{_UNFILLED}[^\p{{L}}\n]*(?:\(c\)|©|[0-9]{{4}})|©|\(c\)[^\p{{L}}\n]*(?:copyright\b{_UNFILLED}|[0-9]{{4}}))[^\n]*$", "", ("copyright", "©", "(c)")),
    (r"(?m)^[^\p{L}\n]*all rights reserved[^\p{L}\n]*$", "", ("all rights",)),
    (r"[^\p{L}\p{N}\n]+", " ", ("",)),
)

#: Title lines of whole texts, which files have or leave out.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Apache-2.0": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "CC0-1.0": ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0 1.0 Universal"),
    "Unlicense": ("The Unlicense",),
}
#: Where the appendix of a whole text begins.
APPENDICES = {"Apache-2.0": "APPENDIX: How to apply", "GPL-2.0": "How to Apply These Terms", "GPL-3.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms"}
#: A text of fewer characters is a notice and has no title.
WHOLE = 300
#: Digests that are broadcast; more are joined by a shuffle.
MAX_KNOWN = 10_000


_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""


def known_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN and the long texts of the package."""
    return (*KNOWN, ("Unlicense", _UNLICENSE)) + tuple((path.stem, path.read_text()) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def variants(license_id: str, text: str) -> list[str]:
    """The text with and without its title, its appendix, the appendix's unfilled statement and the numbers of clauses."""
    if len(text) < WHOLE:
        return [text]
    titles = TITLES.get(license_id, ())
    plain = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    body = text.lstrip()
    for title in titles:
        if plain(body).startswith(plain(title)):
            body = body[body.index(title.split()[-1]) + len(title.split()[-1]) :]
    bodies = [body]
    if license_id in APPENDICES:
        bodies.append(body[: body.index(APPENDICES[license_id])])
        bodies.append(re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", body))
    bodies += [re.sub(r"(?m)^ *[0-9]\. ", "", x) for x in bodies if license_id.startswith("BSD")]
    return [x for b in bodies for x in (b, *(f"{title}\n\n{b}" for title in titles))]


def canonical_lines(text: Column) -> Column:
    """The canonical form, lines kept apart; spaces may surround a line. A pattern runs only on texts that hold what it needs."""
    form = F.array(F.lower(F.coalesce(text.cast("string"), F.lit(""))))  # an array of one, so that each step names it once

    def step(pattern: str, replacement: str, held: tuple[str, ...]):
        def run(x: Column) -> Column:
            found = F.contains(x, F.lit(held[0]))
            for part in held[1:]:
                found = found | F.contains(x, F.lit(part))
            return F.when(found, F.regexp_replace(x, pattern, replacement)).otherwise(x)

        return run

    for one in FORMS:
        form = F.transform(form, step(*one))
    return form[0]


def whole_form(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license_id, digest, size), a row for each digest of a variant; of known_texts() by default. size: characters of its form."""
    rows = [(k, x) for k, text in (known_texts() if known is None else known) for x in variants(k, text)]
    table = spark.createDataFrame(rows, "license_id string, text string").select("license_id", whole_form(canonical_lines(F.col("text"))).alias("form"))
    return table.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("form")).alias("size"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices): the licence that the whole text is, and those of its lines, sorted and joined by commas."""
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    found = digests.collect()  # some digests for each known text, so their size is that of the argument
    table = spark.createDataFrame([(r["digest"], r["license_id"]) for r in found], "digest string, license_id string")
    few = len(found) <= MAX_KNOWN
    forms = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    sizes = sorted({r["size"] for r in found})
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes)) if sizes else F.array().cast("array<string>")
    lookup = F.map_from_entries(F.array(*(F.struct(F.lit(r["digest"]), F.lit(r["license_id"])) for r in found))) if found else F.create_map().cast("map<string,string>")
    notices = F.array_compact(F.transform(lines, lambda x: F.try_element_at(lookup, F.sha2(x, 256))))
    marked = forms.select("doc_id", F.sha2(whole_form(F.col("lines")), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(notices)), ",").alias("notices"))
    return marked.join(F.broadcast(table) if few else table, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _sql_form(text: str) -> str:
    form = f"lower(coalesce({text}, ''))"
    for pattern, replacement in (*SPELLINGS, (COPYRIGHT_LINE, ""), (r"[^\p{L}\p{N}\n]+", " ")):
        form = f"regexp_replace({form}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return form


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    whole = r"sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g')))"
    return f"""
WITH known(license_id, text) AS (VALUES {values}),
k AS (SELECT {whole} AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_form('text')} AS lines FROM known) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_form('text')} AS lines FROM documents),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM d) JOIN k USING (digest) GROUP BY r)
SELECT doc_id, {whole} AS digest, k.license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN n USING (r) LEFT JOIN k ON k.digest = {whole}
"""
