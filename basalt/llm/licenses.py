"""License scans by canonical digest.

A text is brought to a canonical form: lower case, lines of copyright notices left out, equivalent
spellings made equal (licence and license, centre and center, and so on), addresses without their
scheme, and every run of other characters than letters, marks and digits (of any script) one space.
The SHA-256 of the whole form is joined with the digests of known license texts.

All of it is DataFrame expressions. The known texts are a handful of rows from this module (short
ones as texts, long ones as digests of their form), or a table given by the caller; a table is
broadcast only if it has at most ``broadcast_rows`` rows.

Defined results: null, empty and wordless texts have the empty form and match nothing. Long texts
count whole. Repeated rows are scanned each. If several known texts share a digest (a tie), the
smallest name is reported. Other columns, whatever their names, are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of public licenses and notices, by SPDX name.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}

#: Spellings and what they become, as whole words of the canonical form.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("centre", "center"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("recognise", "recognize"))

#: SHA-256 of the canonical forms of long public license texts, by SPDX name.
DIGESTS = {
    "Apache-2.0": "4686e00eea55ccba49c073acb821b6abd6175bddc1ef69e168e4947575b2f91d",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "08e24c3c2c7fe68ac31a8b63885a5ab6bdbaa616d6cdc9ef0a2efdd0d3861f33",
    "GFDL-1.3": "116d307ad8c30cc7389c54d9ecdcf5322890828bf3500932d4f29890a4119b64",
    "GPL-1.0": "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c",
    "GPL-2.0": "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",
    "GPL-3.0": "2984941704ceda4a7d24fb5686cd323c1268e3f675d94889ead6b9288d896761",
    "LGPL-2.0": "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e",
    "LGPL-2.1": "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",
    "LGPL-3.0": "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
    "MPL-1.1": "a73e9859b90b15cd6da836f8d96ca4673c1a0def4416c13da30e573e68769463",
    "MPL-2.0": "0a9e3d32a7f24bf01d16516a5abfba9b19d53f60aef0a720705e0580ea38d942",
}

#: Lines that are dropped: from the start of a line, marks, "copyright" or (c) with a symbol, a year or a place for one, also
#: where the year comes after the holder; and "all rights reserved".
NOTICE = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]|\[|<|\{)|copyright[ \t][^\n]*[^0-9](19|20)[0-9][0-9]|\(c\)[ \t]|©)[^\n]*"
RESERVED = r"(^|\n)[ \t*#/;-]*all rights reserved[ \t]*\.?[ \t]*"
TITLE = r"^[ \t\r\n*#/;-]*(the )?[a-z0-9. -]{1,40} licen[cs]e( \([a-z0-9. -]{1,20}\))?[ \t\r]*\n"


def canonical(text: Column) -> Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, NOTICE, "\n")
    x = F.regexp_replace(x, RESERVED, "\n")
    x = F.regexp_replace(x, TITLE, "\n")
    x = F.regexp_replace(x, r"https?://(www\.)?", "")
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known(spark: SparkSession) -> DataFrame:
    """license, digest of the texts of this module."""
    texts = [F.struct(F.lit(k).alias("license"), digest(canonical(F.lit(v))).alias("digest")) for k, v in KNOWN.items()]
    longer = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("digest")) for k, v in DIGESTS.items()]
    return spark.range(1).select(F.inline(F.array(*texts, *longer)))


def scan(docs: DataFrame, texts: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, n_words (of the canonical form), digest, license (null: none) for each row of ``docs(doc_id, text)``.

    ``texts(license, text)`` replaces the built-in known texts.
    """
    table = known(docs.sparkSession) if texts is None else texts.select("license", digest(canonical(F.col("text"))).alias("digest"))
    table = table.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))
    small = texts is None or table.count() <= broadcast_rows
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    rows = rows.select("doc_id", F.when(F.col("form") == "", 0).otherwise(F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), digest(F.col("form")).alias("digest"))
    return rows.join(F.broadcast(table) if small else table, "digest", "left").select("doc_id", "n_words", "digest", "license")


def sql() -> str:
    """The same for DuckDB, over a view ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ere = lambda s: quote(s).replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")

    def form(text):
        x = f"lower(coalesce({text}, ''))"
        for pattern in (NOTICE, RESERVED, TITLE):
            x = f"regexp_replace({x}, {ere(pattern)}, chr(10), 'g')"
        x = f"regexp_replace({x}, 'https?://(www\\.)?', '', 'g')"
        x = f"' ' || array_to_string(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ' ') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim({x})"

    longer = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in DIGESTS.items())
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"""with known as (select min(license) license, digest from (select license, sha256({form("text")}) digest from (values {values}) t(license, text) union all select * from (values {longer}) t(license, digest)) group by 2),
forms as (select doc_id, {form("text")} form from documents),
rows_ as (select doc_id, case when form = '' then 0 else length(form) - length(replace(form, ' ', '')) + 1 end::bigint n_words, case when form <> '' then sha256(form) end digest from forms)
select doc_id, n_words, digest, license from rows_ left join known using (digest)"""
