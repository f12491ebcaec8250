"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (lower case, no comment marks, no copyright lines, one spelling of equivalent words, no
punctuation; a line is a copyright line where a year, a sign or a name follows the word) and hashed; whole texts are hash-joined to the digests of known licence texts. Every line of a text is a text of its own
for the same lookup among known notices, so a licence notice at the end of prose is found.

Defined results: null counts as empty and has the digest of the empty text, which no licence has; of two known texts with the same
canonical form the smaller licence id counts; rows that repeat an id are reported one by one, and each has the notices of all of
them; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that fall away from the text, and equivalent spellings, applied to lower-cased text.
COMMENT_MARK = r"(?m)^[ \t]*(//+|/\*+|\*+/?|#+|;+|--+|<!--|(?i:rem) )[ \t]*"
#: Words that go on a sentence after "copyright", also where a text is in capitals.
SENTENCE = "AND ARE BY CLAIMS? DISCLAIMER FOR HOLDERS? IN INTERESTS? IS LAWS? LICEN[CS]ES? MAY NOTICES? OF ON OR OWNERS? PROTECTION RIGHTS? STATEMENTS? TO TREAT(?:Y|IES)".split()
SIGN = r"(?:\((?i:c)\)|©|&copy;)"
COPYRIGHT_LINE = (
    rf"(?m)^[ \t]*(?:(?i:copyright):?[ \t]*(?:{SIGN}|[0-9]{{4}}|[<\[{{]|(?:by[ \t]+)?(?!(?i:{'|'.join(SENTENCE)})\b)\p{{Lu}})"
    rf"|{SIGN}[ \t]*(?:(?i:copyright)|[0-9]{{4}})|©|(?i:all rights reserved))[^\n]*$"
)
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
    ("©", "(c)"),
)
#: Fixed value: the holder that a BSD text names.
BSD_NAME = r"neither the names? of (?:(?!neither )[^;]){1,200}?nor the names? of"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’«»–—…•]+"

#: Known notices, and short licence texts without their copyright lines.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
TEXTS = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
        "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute "
        "verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT "
        "THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT "
        "THE FUCK YOU WANT TO.",
    ),
)


BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution.",
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors",
    "Neither the name of the copyright holder nor the names of the contributors",
    "Neither the name of the author nor the names of its contributors",
    "The name of the author may not be used",
    "The names of its contributors may not be used",
)
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {1} BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_PARTIES = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
    ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS"),
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
    "in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
#: Usual titles besides none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License",
        'BSD 3-Clause "New" or "Revised" License',
    ),
    "Unlicense": ("The Unlicense", "Unlicense", "UNLICENSE"),
}
#: Texts in ``licence_texts``: the lines of their title, and where an appendix that may be absent begins.
TITLE_LINES = {
    "Apache-2.0": r"\s*Apache License\s+Version 2\.0, January 2004\s+http://www\.apache\.org/licenses/",
    "CC0-1.0": r"\s*Creative Commons Legal Code\s+(CC0 1\.0 Universal)?",
    "MPL-2.0": r"\s*Mozilla Public License Version 2\.0\s+=+",
} | dict.fromkeys(("GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only"), r"\s*GNU [A-Z ]+\s+Version [^\n]+")
APPENDIX = re.compile(r"(END OF TERMS AND CONDITIONS\s)|\n *(?:APPENDIX: How to apply|How to Apply These Terms)")


@cache
def texts() -> list[tuple[str, str]]:
    """Known whole texts with and without their titles, and with and without an appendix on their use."""
    out = [(licence, body) for licence, body in TEXTS]
    bodies = [(i, re.sub(r"^(MIT|ISC) License\n+", "", body)) for i, body in TEXTS] + [("Unlicense", UNLICENSE)]
    bodies += [("Unlicense", f"{UNLICENSE}\n\nFor more information, please refer to <{url}>") for url in ("http://unlicense.org", "http://unlicense.org/")]
    promoted = "to endorse or promote products derived from this software without specific prior written permission."
    names = [f"{n} {promoted}" if n.endswith("be used") else f"{n} may be used {promoted}" for n in BSD_NAMES]
    for licence, third in [("BSD-2-Clause", None), *[("BSD-3-Clause", n) for n in names]]:
        conditions = [*BSD_CONDITIONS, *([third] if third else [])]
        for marks in (["1. ", "2. ", "3. "], ["a. ", "b. ", "c. "], ["", "", ""]):
            listed = "\n".join(m + c for m, c in zip(marks, conditions))
            bodies += [(licence, f"{BSD_HEAD}\n{listed}\n{BSD_TAIL.format(*party)}") for party in BSD_PARTIES]
    for licence, title in TITLE_LINES.items():
        whole = files("archspark.llm").joinpath("licence_texts", f"{licence}.txt").read_text()
        ends = [whole] + [whole[:at] for m in APPENDIX.finditer(whole) for at in {m.start(), max(m.start(), m.end(1))}]
        out += [(licence, form) for end in ends for form in (end, re.sub(f"^{title}", "", end))]
    out += [(licence, f"{title}\n\n{body}") for licence, body in bodies for title in ("", *TITLES.get(licence, ()))]
    return list(dict.fromkeys(out))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT_MARK, "")
    out = F.translate(F.regexp_replace(out, COPYRIGHT_LINE, ""), UPPER, LOWER)
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    out = F.regexp_replace(out, NOT_WORD, " ")
    named = F.regexp_replace(out, BSD_NAME, "neither the name of the copyright holder nor the names of")
    return F.trim(F.when(F.contains(out, F.lit("neither the name")), named).otherwise(out))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(known_digest, licence) from (licence, text)."""
    rows = known.select("licence", digest(F.col("text")).alias("known_digest"), (F.length(canonical(F.col("text"))) > 0).alias("_some"))
    return rows.filter("_some").groupBy("known_digest").agg(F.min("licence").alias("licence"))


def shipped(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *texts()], "licence string, text string")


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of the whole text, licence of the whole text (or null), notices (sorted licence ids)."""
    digests = known_digests(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = rows.select("id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    # never null, and the planner has to know it: else it tests the digest of every line before the join, working it out again
    lines = lines.select("id", F.coalesce(digest(F.col("line")), F.lit("")).alias("line_digest"))
    found = lines.join(digests, F.col("line_digest") == F.col("known_digest")).groupBy(F.col("id").alias("noticed_id")).agg(
        F.array_sort(F.collect_set("licence")).alias("notices")
    )
    whole = rows.select("id", digest(F.col("text")).alias("digest"))
    whole = whole.join(digests, F.col("digest") == F.col("known_digest"), "left")
    whole = whole.join(found, F.col("id").eqNullSafe(F.col("noticed_id")), "left")
    return whole.select("id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
