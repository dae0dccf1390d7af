"""Licence scan by canonical digests.

A text is brought to a canonical form - lower case, copyright lines dropped, every run of other characters than letters
and digits made one space, equivalent spellings made equal - and the SHA-256 of that form is looked up among the digests
of known licences and licence notices, whole texts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

# Fixed values: (variant, canonical form) of whole words, after case and punctuation are normalised; both are patterns in
# which words are two spaces apart, and \\1 is the ending.
SPELLINGS = [
    (r"licenc(e|es|ed|ee|ees|or|ors|ing)", r"licens\1"), (r"sub  licens(e|es|ed|ing)", r"sublicens\1"), (r"non  (infringement|commercial)", r"non\1"),
    (r"organis(e|es|ed|ing|ation|ations|ational)", r"organiz\1"), (r"authoris(e|es|ed|ing|ation|ations)", r"authoriz\1"), (r"recognis(e|es|ed|ing)", r"recogniz\1"),
    (r"utilis(e|es|ed|ing|ation)", r"utiliz\1"), (r"favour(|s|able|ed)", r"favor\1"), (r"honour(|s|ed|able)", r"honor\1"), (r"fulfil(|s|ment)", r"fulfill\1"),
    (r"acknowledgement(|s)", r"acknowledgment\1"), (r"judgement(|s)", r"judgment\1"), (r"whilst", "while"), (r"wilful(|ly)", r"willful\1"),
    (r"copyright  holder(|s)", r"copyright  owner\1"), (r"per  cent", "percent"), (r"https", "http"),
]
#: A line that names a copyright: it begins so and gives a year or a second sign, or reserves all rights and says no more.
_YEAR = r"[\[<{]?(\d{4}|yyyy|year)"
_COPYRIGHT = rf"(?m)^[ \t#*/;-]*(copyright[ \t]*:?[ \t]*{_YEAR}|copyright[ \t]*(\(c\)|©)|(\(c\)|©)[ \t]*(copyright|{_YEAR})|all rights reserved[ \t.]*$)[^\n]*$"

_NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_TEXTS = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL,
    "0BSD": "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_TAIL,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace(" OR COPYRIGHT HOLDERS", "") + "\n\nFor more information, please refer to <https://unlicense.org/>",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}


# Digests of the canonical forms of whole licence texts, as distributions carry them (appendices and "how to
# apply" parts included).  digest() makes them; a change of the canonical form needs them made again.
DIGESTS = {
    "Apache-2.0": "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
    "Artistic-1.0-Perl": "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2-or-later": "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e",
    "GFDL-1.3-or-later": "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff",
    "GPL-1.0": "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8",
    "LGPL-2.0": "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
    "LGPL-2.1": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of the texts and notices that this module knows."""
    return [(k, t) for k, t in _TEXTS.items()] + [(k, t) for k, ts in _NOTICES.items() for t in ts]


def _let(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def _flat(text: Column) -> Column:
    """Lower case without copyright lines; every run of other characters than letters, digits and line ends is a space."""

    def kept(t: Column) -> Column:
        named = t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved")
        return F.when(named, F.regexp_replace(t, _COPYRIGHT, "")).otherwise(t)

    return F.regexp_replace(_let(F.lower(F.coalesce(text, F.lit(""))), kept), r"[^\p{L}\p{N}\n]+", " ")


def _swap(variant: str, form: str):
    """Replaces one spelling; a plain search for its first letters comes before the pattern."""
    return lambda s: F.when(s.contains(" " + variant.split("(")[0]), F.regexp_replace(s, f" {variant} ", " " + form.replace("\\", "$") + " ")).otherwise(s)


def _spelled(words: Column) -> Column:
    """Words that are a space apart, in equal spellings and two spaces apart."""
    same = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, form in SPELLINGS:
        same = _let(same, _swap(variant, form))
    return same


def _single(spelled: Column) -> Column:
    return F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))


def _whole(flat: Column) -> Column:
    return _single(_spelled(F.trim(F.regexp_replace(flat, r"[ \n]+", " "))))


def _lines(flat: Column) -> Column:
    """The canonical form of each line, from one pass over the text: no spelling spans a line end."""
    return F.transform(F.split(_spelled(F.replace(flat, F.lit("\n"), F.lit(" \n "))), "\n"), _single)


def canonical(text: Column) -> Column:
    """The canonical form; '' for a null or empty text and for one of copyright lines only."""
    return _whole(_flat(text))


def _sha(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def digest(text: Column) -> Column:
    return _sha(canonical(text))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id: one row per digest (the least id where texts of two ids have one form); empty forms go.  Without
    ``known`` texts, those of known_licenses() and DIGESTS."""
    rows = spark.createDataFrame(known_licenses() if known is None else known, "license_id string, text string")
    rows = rows.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license_id")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Known digests are broadcast up to so many rows (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Up to so many known digests, lines are looked up in the row; beyond, they are exploded and hash-joined.
MAP_ROWS = 256


def scan(df: DataFrame, known: DataFrame, text_col: str = "text", lines: bool = True) -> DataFrame:
    """The columns of ``df`` with text_digest (of the whole text), license_id (of the known text with that digest, or
    null) and, with ``lines``, line_licenses: ids of the lines that are whole notices, in order, a line each.

    A null or empty text has the digest of no text and no licence; a text of copyright lines only likewise.  Columns named
    like an output are replaced.  A line without letters and digits has no licence.  Every row stays, repeated ones too.  ``known`` may have any number of rows.
    """
    count = known.limit(BROADCAST_ROWS + 1).count()
    few = count <= BROADCAST_ROWS
    table = known.select(F.col("digest").alias("text_digest"), "license_id").dropDuplicates(["text_digest"])
    names = [c for c in df.columns if c not in ("text_digest", "license_id", "line_licenses")]
    kept = [f"`{c}`" for c in names]
    text = F.col(f"`{text_col}`")
    if not lines:
        out = df.select(*kept, digest(text).alias("text_digest"))
    else:
        # both forms come from one column, whose name no other has
        at = "_forms"
        while at in {c.lower() for c in df.columns}:
            at += "_"
        forms = _let(_flat(text), lambda f: F.struct(_sha(_whole(f)).alias("whole"), F.filter(_lines(f), lambda x: x != "").alias("lines")))
        formed = df.select(*kept, forms.alias(at))
        whole = F.col(f"{at}.whole").alias("text_digest")
        if not count:
            out = formed.select(*kept, whole, F.array().cast("array<string>").alias("line_licenses"))
        elif count <= MAP_ROWS:
            per = F.create_map(*[F.lit(x) for r in sorted(table.collect()) for x in r])
            found = F.filter(F.transform(f"{at}.lines", lambda x: F.try_element_at(per, _sha(x))), lambda x: x.isNotNull())
            out = formed.select(*kept, whole, found.alias("line_licenses"))
        else:
            # rows get a number, kept in a table so that both sides see the same; only lines that match come back
            numbered = written(formed.select(*kept, whole, F.col(f"{at}.lines").alias("_lines"), F.monotonically_increasing_id().alias("_row")), "licences")
            exploded = numbered.select("_row", F.posexplode("_lines").alias("_n", "_line")).select("_row", "_n", _sha(F.col("_line")).alias("text_digest"))
            matched = exploded.join(F.broadcast(table) if few else table, "text_digest").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_n", "license_id"))).alias("_found"))
            out = numbered.drop("_lines").join(matched, "_row", "left")
            found = F.coalesce(F.transform("_found", lambda x: x["license_id"]), F.array().cast("array<string>"))
            out = out.select(*kept, "text_digest", found.alias("line_licenses"))
    out = out.join(F.broadcast(table) if few else table, "text_digest", "left")
    return out.select(*kept, "text_digest", "license_id", *(["line_licenses"] if lines else []))
