"""Operator 3: licence scans by canonical digest, DataFrame functions only.

A text is made canonical line by line: A-Z lower-cased, copyright statements
dropped, punctuation and white space turned into single spaces, equivalent
spellings replaced; a first line that is only the title of a licence does not
count for the text as a whole.  The digest of the whole canonical text, and of each
of its lines, is joined by hash to the digests of known licences and notices;
these are a fixed table, so their side is broadcast.  Nothing else is
compared: a text matches when all of it is a known licence, however wrapped,
and a notice when all of a line is one.

A copyright statement begins a line with the word, the sign or (c), and has a
sign, (c), a year or a place for one ("copyright holders be liable" is licence
text).  It ends with its line, or before the first words of a known licence.
Of licences that are known by their digest alone, those with statements inside
(the GNU ones) match where these begin lines, as published.

Nulls: a null or empty text, or one without letters or digits, has no digest
and no match; a null id is kept.  Repeated rows, and rows of one id (ties),
each get their row.  An empty table gives an empty one, a long text is
canonical as a whole.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import lower_ascii, table

#: Spellings that licence-matching guidelines treat as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior", "cancelled": "canceled", "centre": "center",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labour": "labor",
    "licence": "license", "licenced": "licensed", "licences": "licenses", "merchantibility": "merchantability", "noncommercial": "non commercial", "organisation": "organization", "organisations": "organizations",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "redistributions": "redistribution", "sublicence": "sublicense", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: Texts and notices of well-known licences.
TEXTS = {
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
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "Licensed under CC0 1.0.",
    "MIT-line": "Released under the MIT License.",
}

#: Titles that stand above licence texts, canonical.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "isc license isc", "bsd license", "new bsd license", "bsd 2 clause license", "the bsd 2 clause license", "bsd 3 clause license", "the bsd 3 clause license",
    "simplified bsd license", "zlib license", "the zlib license", "bsd zero clause license", "zero clause bsd license", "the unlicense", "license", "licence",
)
#: How known licences begin after a copyright statement on one line.
OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use", "this software is provided", "licensed under the", "this program is free software", "boost software license")

#: What separates words: ASCII other than letters and digits, and typographic quotes, dashes and signs.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F ©«»‐-―‘-‟•…]+"
COPYRIGHT = "^[^a-z0-9(©<\\[]*(copyright[ .:,]*(\\(c\\)|©|[<\\[]|(19|20)[0-9][0-9])|(copyright|copr) .*(19|20)[0-9][0-9]|\\(c\\) *(copyright|(19|20)[0-9][0-9])|©|all rights reserved[ .]*$)"
STATED = COPYRIGHT + ".*?[ .](" + "|".join(OPENINGS) + ")"


def canonical_line(line: Column) -> Column:
    """One line, already lower-cased, as words with single spaces; empty for a copyright statement."""
    rest = F.regexp_replace(line, STATED, f"${re.compile(STATED).groups}")
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(rest, BREAKS, " "), F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in sorted(SPELLINGS.items()):
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(rest.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(out, " +", " ")))


def canonical_lines(text: str) -> list[str]:
    """The same for a text on the driver, for the table of known digests."""
    lines = []
    for line in re.sub("[A-Z]", lambda m: m[0].lower(), text).split("\n"):
        line = re.sub(STATED, lambda m: m[m.re.groups], line)
        if re.search(COPYRIGHT, line):
            continue
        words = re.sub(BREAKS, " ", line).split()
        lines.append(" ".join(SPELLINGS.get(w, w) for w in words))
    return [x for x in lines if x]


def canonical(text: str) -> str:
    """A text as a whole."""
    lines = canonical_lines(text)
    return " ".join(lines[1:] if lines and lines[0] in TITLES else lines)


#: Digests of the canonical texts of longer licences (SHA-256; "terms" is the text up to the end of its terms and conditions).
DIGESTS: dict[str, str] = {
    "Apache-2.0": "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
    "Apache-2.0 (terms)": "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-1.0 (terms)": "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-2.0 (terms)": "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "GPL-3.0 (terms)": "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.0 (terms)": "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-2.1 (terms)": "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "af9120248ffd9feada62cb62d18d7104970bad23f2d265fd77eb0cd3c265583b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
}


def known_digests(texts: dict[str, str] | None = None) -> dict[str, str]:
    """digest -> licence: of given texts, or of ours and the longer licences."""
    out = {} if texts else {d: name for name, d in DIGESTS.items()}
    return out | {hashlib.sha256(canonical(t).encode()).hexdigest(): name for name, t in sorted((texts or TEXTS).items(), reverse=True)}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """(id, digest, license, notices, n_notices) for every row; notices are the distinct licences of matching lines, sorted and comma-joined."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(known_digests(texts).items()), "unit string, name string")
    lines = F.filter(F.transform(F.split(lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "\n"), canonical_line), lambda x: x != "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), lines.alias("lines"))
    body = F.when(F.get("lines", 0).isin(*TITLES), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    rows = rows.select("rid", "id", F.when(F.size(body) > 0, F.sha2(F.array_join(body, " "), 256)).alias("digest"), "lines")
    units = rows.select("rid", "id", "digest", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("unit"))), F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("unit"))))).alias("u"))
    found = units.select("rid", "id", "digest", "u.whole", "u.unit").join(F.broadcast(known), "unit", "left")
    return (
        found.groupBy("rid", "id", "digest")
        .agg(F.max(F.when(F.col("whole"), F.col("name"))).alias("license"), F.collect_set(F.when(~F.col("whole"), F.col("name"))).alias("names"), F.count(F.when(~F.col("whole"), F.col("name"))).alias("n_notices"))
        .select("id", "digest", "license", F.array_join(F.array_sort("names"), ",").alias("notices"), "n_notices")
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    spelled = "' ' || replace(regexp_replace(r, '" + BREAKS + "', ' ', 'g'), ' ', '  ') || ' '"
    for a, b in sorted(SPELLINGS.items()):
        spelled = f"replace({spelled}, ' {a} ', ' {b} ')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    return f"""
WITH known(unit, name) AS (VALUES {known}),
a AS (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, i, regexp_replace(l, '{STATED}', '\\{re.compile(STATED).groups}') AS r FROM a),
b AS (SELECT doc_id, i, CASE WHEN regexp_matches(r, '{COPYRIGHT}') THEN '' ELSE trim(regexp_replace({spelled}, ' +', ' ', 'g')) END AS c FROM r),
c AS (SELECT doc_id, i, c FROM b WHERE c <> ''),
whole AS (SELECT doc_id, sha256(string_agg(c, ' ' ORDER BY i)) AS digest FROM c WHERE NOT (i = (SELECT min(f.i) FROM c f WHERE f.doc_id = c.doc_id) AND c.c IN ({", ".join(f"'{x}'" for x in TITLES)})) GROUP BY doc_id),
line AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n_notices FROM c JOIN known ON known.unit = sha256(c) GROUP BY doc_id)
SELECT d.doc_id, w.digest, k.name AS license, coalesce(l.notices, '') AS notices, CAST(coalesce(l.n_notices, 0) AS BIGINT) AS n_notices
FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN known k ON k.unit = w.digest LEFT JOIN line l USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_license_digests": op3_license_digests}
SQL: dict[str, str] = {"op3_license_digests": _sql()}
