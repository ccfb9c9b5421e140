"""Licence scan by canonical digest look-up, in DataFrame and SQL functions only.

A text in canonical form has lower case, no copyright lines, one spelling of
words that the licence matching guidelines call equivalent, and no punctuation;
its SHA-256 is joined with the digests of known licences.  Whole documents and
whole lines (licence notices) are looked up the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same word, variant first.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("non infringement", "noninfringement"),
    ("per cent", "percent"), ("copy right", "copyright"), ("copyright owner", "copyright holder"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known licences and notices: (identifier, text).
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: SHA-256 of the canonical form of whole licences, with and without what follows their terms; each text holds a MARKER.
FULL = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),  # Apache-2.0
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),  # Apache-2.0 to the end of its terms, that line included
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),  # Apache-2.0 to the end of its terms
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),  # Artistic
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),  # CC0-1.0
    ("GFDL-1.2-only", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),  # GFDL-1.2
    ("GFDL-1.3-only", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),  # GFDL-1.3
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),  # GPL-1
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),  # GPL-1 to the end of its terms, that line included
    ("GPL-1.0-only", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),  # GPL-1 to the end of its terms
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),  # GPL-2
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),  # GPL-2 to the end of its terms, that line included
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),  # GPL-2 to the end of its terms
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),  # GPL-3
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # GPL-3 to the end of its terms, that line included
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),  # GPL-3 to the end of its terms
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),  # LGPL-2
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # LGPL-2 to the end of its terms, that line included
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # LGPL-2 to the end of its terms
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),  # LGPL-2.1
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # LGPL-2.1 to the end of its terms, that line included
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # LGPL-2.1 to the end of its terms
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # LGPL-3
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),  # MPL-1.1
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),  # MPL-2.0
)
#: Every canonical text above holds one of these, so a text without them cannot be known; a test checks it.
MARKER = "licens|licenc|permission|redistribution"
#: Words that follow "copyright" in a sentence: a line of prose that begins so is no copyright line.
_PROSE = "holders?|owners?|notices?|licen[cs]es?|laws?|statements?|interests?|rights?|and|or|in|of|to|is|are|by the|acts?|protection|infringement|disclaimers?|ownership|material|works?|treaty|treaties|law|term"
_PROSE_LINE = rf"(?im)^([^\p{{L}}\n]*)copyright([^\p{{L}}\n]+(?:{_PROSE})(?:[^\p{{L}}]|$))"
#: A copyright line: the word or a sign with a year, a sign or a name behind it, or nothing but the reservation of rights.
_NOTICE_LINE = (
    r"(?m)^[^\p{L}\n]*(?:(?i:copyright)[^\p{L}\n]*(?:(?i:\(c\))|©|[0-9]{4}|[<\[{(]+(?i:yyyy|year))|(?i:copyright):?[ \t]+(?:by[ \t]+)?\p{Lu}"
    r"|(?i:\(c\))[ \t]*(?i:copyright|[0-9]{4})|©)[^\n]*$|(?im)^[^\p{L}\n]*all rights reserved[^\p{L}\n]*$"
)


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null stays null."""
    kept = F.lower(F.regexp_replace(F.regexp_replace(text, _PROSE_LINE, "$1copy right$2"), _NOTICE_LINE, ""))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, f" {p[0]}(?=s? )", f" {p[1]}"), EQUIVALENT, words))


def known_digests(spark, known=KNOWN, full=FULL) -> DataFrame:
    """(digest, license_id) of the registry; one digest names one licence."""
    rows = spark.createDataFrame([(i, t) for i, t in known], "license_id string, known_text string")
    digests = rows.select(F.sha2(canonical(F.col("known_text")), 256).alias("digest"), "license_id")
    return digests.unionByName(spark.createDataFrame(list(full), "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, known=KNOWN, full=FULL, marker: str | None = None) -> DataFrame:
    """(doc_id, license_id, notices, n_notices), one row per input row of ``docs`` (doc_id, text).

    ``license_id`` names the licence that the whole text is, else null; ``notices``
    lists, sorted and comma-separated, the licences that whole lines are, '' if
    none; ``n_notices`` counts such lines.  Null, empty and unknown texts get
    null, '' and 0.  Rows that repeat a doc_id share their findings; a null doc_id
    finds nothing.  Other columns are ignored.  ``known`` and ``full`` are the
    registry as texts and as digests; ``marker`` is a pattern that every text of it
    holds (by default MARKER for the registry of this module, none for another).
    """
    if marker is None:
        marker = MARKER if known is KNOWN and full is FULL else ""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    marked = base.where(F.col("doc_id").isNotNull() & F.col("text").rlike(f"(?i){marker}"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"(?i){marker}"))
    units = marked.select("doc_id", F.explode_outer(F.array_append(F.transform(lines, lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole"))), F.struct(F.col("text").alias("unit"), F.lit(True).alias("whole")))).alias("u"))
    digests = units.select("doc_id", F.col("u.whole").alias("whole"), F.sha2(canonical(F.col("u.unit")), 256).alias("digest"))
    # the registry is a constant of this module or a list handed over by the caller: its size is known here
    found = digests.join(F.broadcast(known_digests(spark, known, full)) if len(known) + len(full) <= 10_000 else known_digests(spark, known, full), "digest")
    per_doc = found.groupBy("doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n_notices"),
    )
    return base.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace({x}, '{_PROSE_LINE}', '\\1copy right\\2', 'g')"
    out = f"lower(regexp_replace({out}, '{_NOTICE_LINE}', '', 'g'))"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        out = f"regexp_replace({out}, ' {a}(s? )', ' {b}\\1', 'g')"
    return f"trim({out})"


def oracle_sql(known=KNOWN) -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) AS k(i, t) GROUP BY 1),
units AS (
  SELECT doc_id, text AS unit, true AS whole FROM documents WHERE regexp_matches(text, '(?i){MARKER}')
  UNION ALL
  SELECT doc_id, unit, false FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents) WHERE regexp_matches(unit, '(?i){MARKER}')),
found AS (SELECT doc_id, whole, license_id FROM (SELECT doc_id, whole, sha256({_sql_canonical('unit')}) AS digest FROM units) JOIN known USING (digest)),
per_doc AS (
  SELECT doc_id, max(license_id) FILTER (whole) AS license_id,
    coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole), '') AS notices,
    count(*) FILTER (NOT whole) AS n_notices
  FROM found GROUP BY doc_id)
SELECT d.doc_id, p.license_id, coalesce(p.notices, '') AS notices, CAST(coalesce(p.n_notices, 0) AS BIGINT) AS n_notices
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""
