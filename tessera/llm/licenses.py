"""License scans by canonical digest: whole texts, brought to one form, are hash-joined to known licences.

Canonical form, in this order: ASCII lower case; typographic quotes, dashes and blanks become blanks; equivalent
spellings become one; a first line that is nothing but a known title goes, if more follows; copyright statements go,
from a line's start (after comment marks) to its end, or to where a licence starts on it, but not what says what a
reader must or may not do; lines that only reserve rights go; everything but ASCII letters and digits and non-ASCII
characters becomes one blank. A text equals a licence if the SHA-256 digests of these forms are equal; an enumerated
clause such as `(c) You must ...` is no copyright statement, so a licence with such a clause added is another one.

Null and empty texts have the digest of the empty form and match nothing. Repeated rows each get their answer. Very
long texts are brought to the form whole. An empty table gives no rows; columns other than the id and the text play no
part, whatever their names. An empty table of licences matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as one, from the public SPDX matching guidelines: (found, kept).
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfill", "fulfil"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("willful", "wilful"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("https://", "http://"),
)
#: Marks that comments put before a line.
_MARKS = r"[ \t#*/;%>|-]*"
#: Typographic characters that stand for ASCII quotes, dashes, marks and blanks; fixed values.
TYPOGRAPHY = "“”„«»‘’‚‹›–—‐‑−…•·   ﻿"
#: Titles of licences, a whole line each; fixed values.
TITLE = r"\A[ \t\r\n#*/;%>|-]*(?:the[ \t]+)?(?:mit|mit[ \t]+\(expat\)|mit no attribution|expat|isc|zlib|zlib/libpng|(?:[a-z]+[ \t]+|\"[a-z]+\"[ \t]+)?bsd(?:[ \t]+[0-4]-clause|[ \t]+zero[ -]clause)?(?:[ \t]+\"[a-z]+\"(?:[ \t]+or[ \t]+\"[a-z]+\")?)?|[0-4]-clause bsd|0bsd|boost software)[ \t]+licen[cs]e(?:[ \t]*(?:\((?:mit|isc|isc-style|x11|zlib|0bsd|bsd-[0-4]-clause)\)|-[ \t]*version[ \t]+1\.0[^\n]*))?[ \t\r:.]*\n"
#: Where a licence starts on the line of a copyright statement, and words that such a statement doesn't have.
_STARTS = r"permission is hereby granted|permission to use|redistribution and use|this software is provided|licensed under|this program is free software|this is free and unencumbered|boost software license"
_DUTIES = r"\b(?:you|must|shall|pay|not|except|only|provided|forbidden|prohibited)\b[^\n]*"
COPYRIGHT = rf"(?m)^{_MARKS}(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{{]|by[ \t])|©|\(c\)[ \t]*(?:copyright\b|[0-9]{{4}}))[^\n]*?({_STARTS}|{_DUTIES}|$)"
RESERVED = rf"(?m)^{_MARKS}all rights reserved\.?[ \t\r]*$"
#: Public licence texts, word for word, as fixed values. Copyright lines don't matter.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text, as stated above; null counts as empty."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.translate(out, TYPOGRAPHY, " " * len(TYPOGRAPHY))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    # (?d): only line feeds end lines
    out = F.regexp_replace(out, "(?d)" + TITLE, "")
    out = F.regexp_replace(F.regexp_replace(out, "(?d)" + COPYRIGHT, "$1"), "(?d)" + RESERVED, "")
    return F.trim(F.regexp_replace(out, r"[\x00-/:-@\[-`{-\x7f]+", " "))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the given licences, or of TEXTS; of equal digests the first id stays."""
    rows = list((TEXTS if texts is None else texts).items())
    df = spark.createDataFrame(rows, "license_id string, body string").select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest"))
    return df.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """`known` of the text files below a shared folder, a licence a file, named by the file."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(?:txt|md)$", "")
    return files.select(name.alias("license_id"), F.sha2(canonical(F.col("value")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest, canonical_chars, license_id): every row of `docs`, license_id null where no licence equals it.

    The licence side is the given or the built-in table, one row a licence, which Spark broadcasts by its
    measured size; the texts are never shuffled unless that table is large.
    """
    form = docs.select(F.col(f"`{key}`").alias("k"), canonical(F.col(f"`{text}`")).alias("form"))
    keyed = form.select("k", F.sha2("form", 256).alias("digest"), F.length("form").cast("long").alias("canonical_chars"))
    lic = known(docs.sparkSession) if licenses is None else licenses.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return keyed.join(lic, "digest", "left").select(F.col("k").alias(key), "digest", "canonical_chars", F.when(F.col("canonical_chars") > 0, F.col("license_id")).alias("license_id"))
