"""License scans by canonical digest.

A whole text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings), hashed, and joined to the digests of known licence texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.llm.license_digests import DIGESTS

# Short licences and notices as published, by SPDX name.
KNOWN = {
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
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
}
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
# Short licences that only whole() is matched with; longer ones are in DIGESTS.
SHORT = {
    "BSD-3-Clause": KNOWN["BSD-2-Clause"].replace("\nTHIS SOFTWARE", f"\n{_CLAUSE_3}\nTHIS SOFTWARE"),
    "MIT-0": KNOWN["MIT"].replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."),
}
# Equivalent spellings, brought to the first form.
SPELLINGS = [
    ("license", "licence"), ("licensed", "licenced"), ("sublicense", "sublicence"), ("organization", "organisation"),
    ("noninfringement", "non-infringement"), ("acknowledgment", "acknowledgement"), ("merchantability", "merchantibility"),
    ("copyright holder", "copyright owner"), ("https", "http"), ("program", "programme"), ("favor", "favour"), ("labor", "labour"),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)(?:[^\p{L}\n][^\n]*)?$"
# A line that is a copyright notice: the word with (c), a year, a field to fill in or a name, not a line of running text that begins with it.
NOTICE_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?i:portions|parts|modifications)\s+)?(?:"
    r"(?i:copyright)[ \t:,]*(?i:by[ \t]+)?(?:(?i:\(c\))|©|[<\[{]|(?:19|20)[0-9]{2}(?![0-9])|(?i:years?|yyyy)\b)[^\n]*"
    r"|Copyright[ \t:]+(?:by[ \t]+|the[ \t]+|The[ \t]+)?(?!(?:Holder|Owner|Licen[sc]e|Notice|Law|Statement|Act|Interest|Right|Protection|And|Or|In)s?\b)\p{Lu}[^\n]*"
    r"|(?i:\(c\))[ \t]*(?:(?i:copyright)\b|(?:19|20)[0-9]{2}(?![0-9]))[^\n]*"
    r"|©[^\n]*"
    r"|(?i:all rights reserved)[^\p{L}\p{N}\n]*"
    r")$"
)
# Titles that published files open with, in canonical form.
TITLES = [
    "license", "licensing", "license mit", "mit", "mit license", "mit license mit", "mit x11 license", "expat license",
    "isc", "isc license", "isc license isc", "internet systems consortium license",
    "0bsd", "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "bsd zero clause license 0bsd", "bsd 0 clause license",
    "zlib", "zlib license", "zlib libpng license",
    "bsd", "bsd license", "new bsd license", "modified bsd license", "simplified bsd license", "freebsd license", "revised bsd license",
    "bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "bsd 2 clause simplified license",
    "bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "bsd 3 clause new or revised license",
]
# The name in the third clause of BSD-3-Clause differs from file to file.
NAMED = r"\bneither the names? of (?:[^ ]+ ){1,20}?nor the names of"


def _plain(lower: Column) -> Column:
    """Each run of characters that are no letters or digits one space, equivalent spellings alike."""
    out = lower
    for standard, other in SPELLINGS:
        plain = " ".join("".join(c if c.isalnum() else " " for c in other).split())
        if plain != other:  # matched before punctuation goes
            out = F.replace(out, F.lit(other), F.lit(standard))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for standard, other in SPELLINGS:
        if other.replace(" ", "").isalnum():
            out = F.regexp_replace(out, rf"\b{other}\b", standard)
    return out


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, each run of characters that are no letters or digits one space, equivalent spellings alike."""
    return _plain(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""))


def whole(text: Column) -> Column:
    """As canonical(), but of lines that begin with the word copyright only notices go, and titles before the text go too: alike however the text is wrapped."""
    body = _plain(F.lower(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), NOTICE_LINE, "")))
    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    body = F.regexp_replace(body, rf"^(?:(?:the )?(?:{titles}) )+", "")
    return F.regexp_replace(body, NAMED, "neither the name of the copyright holder nor the names of")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of the known texts, a table of fixed size."""
    texts = spark.createDataFrame(list(KNOWN.items()), "license string, body string")
    return texts.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest"))


def whole_digests(spark: SparkSession) -> DataFrame:
    """(whole_license, whole): digests of whole() of the known texts, of short ones with and without numbers before their paragraphs; a table of fixed size."""
    texts = [(name, body) for name, body in (KNOWN | SHORT).items()]
    texts += [(name, re.sub(r"(?m)^[0-9]\. ", "", body)) for name, body in texts]
    short = spark.createDataFrame(texts, "whole_license string, body string").select("whole_license", F.sha2(whole(F.col("body")), 256).alias("whole"))
    full = spark.createDataFrame([(name, digest) for name, digests in DIGESTS.items() for digest in digests], "whole_license string, whole string")
    return short.unionByName(full).groupBy("whole").agg(F.min("whole_license").alias("whole_license"))


def scan(docs: DataFrame, text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest and license (null: no known licence is the whole text).

    The digest is that of canonical(). A text whose whole() is a known licence's has that licence too: canonical()
    loses licence wording in lines that begin with the word copyright, and keeps titles. A null or empty text has the
    digest of the empty string and no licence. Repeated rows each get a row, an empty table none. Only doc_id and the text are read.
    A long text is held a few times over. `more` (license, body) adds known texts, matched by whole(); of equal texts the smallest name holds.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digests = docs.select("doc_id", F.sha2(canonical(body), 256).alias("digest"), F.sha2(whole(body), 256).alias("whole"))
    known = known_digests(docs.sparkSession)
    full = whole_digests(docs.sparkSession)
    if more is not None:
        added = more.where("license IS NOT NULL AND body IS NOT NULL").select(F.col("license").alias("whole_license"), F.sha2(whole(F.col("body")), 256).alias("whole"))
        full = full.unionByName(added).groupBy("whole").agg(F.min("whole_license").alias("whole_license"))
    found = digests.join(F.broadcast(known), "digest", "left").join(F.broadcast(full) if more is None else full, "whole", "left")
    return found.select("doc_id", "digest", F.coalesce("license", "whole_license").alias("license"))
