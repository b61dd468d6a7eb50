"""License scans: canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines out,
equivalent spellings unified, punctuation to single spaces), digested, and
the digest is hash-joined with the digests of known licences, which the
same expression computes from their texts.  A document *is* a licence if
its entire text matches; besides, every line of it is looked up as an
entire short notice (``Released under the MIT License.``) and the notices
found are listed.  Built-in functions and joins only.

The known texts are this package's own (literals and ``licenses/*.txt``), of
fixed size and broadcast, or a table of the caller's, whose join is left to
the planner.  Only lines that match leave the first stage.

Defined results: a null or empty text, or one of punctuation only, has the
digest of the empty text and matches nothing; every input row gives one
output row; rows that share an id share their notices; notices of null ids
are matched among null ids; extra input columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal (found, used).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("organisation", "organization"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("fulfilment", "fulfillment"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organise", "organize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
)

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
          "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
          "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
          "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
          "PERFORMANCE OF THIS SOFTWARE.")

_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

_BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this "
              "list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above "
              "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
              "materials provided with the distribution.\n")

# Published licence texts (without their copyright lines).
LICENSES = {
    "MIT": ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
            "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    "ISC": ("ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            + _AS_IS),
    "0BSD": ("BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
             "without fee is hereby granted.\n\n" + _AS_IS),
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_START + "\n" + _BSD_END,
    "BSD-3-Clause": ("BSD 3-Clause License\n\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission.\n\n" + _BSD_END),
    "Zlib": ("zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone "
             "to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
             "freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you "
             "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
             "the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly "
             "marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed "
             "or altered from any source distribution."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize "
                  "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
                  "software to the public domain. We make this dedication for the benefit of the public at large and to the "
                  "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
                  "perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS "
                  'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
                  "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
                  "AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                  "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
                  "SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    # longer ones, a file each: Apache, GPL, LGPL, MPL, GFDL, CC0, Artistic
    **{f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files(__package__).joinpath("licenses").iterdir()
       if f.name.endswith(".txt")},
}

# Short notices that stand on a line of their own.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
}

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright\b[^\n]*(\d{4}|\(c\)|©)[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"


def canonical(text: Column) -> Column:
    """Canonical form, line by line: copyright lines emptied, other lines
    in lower case, words separated by single spaces, spellings unified."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    # one scan decides whether any spelling occurs; few texts pay for the replacements
    found = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"
    unified = t
    for a, b in SPELLINGS:
        unified = F.regexp_replace(unified, rf"\b{a}\b", b)
    return F.when(t.rlike(found), unified).otherwise(t)


def digest_of_lines(canon: Column) -> Column:
    """SHA-256 of the whole canonical text, line ends and blank lines folded."""
    return F.sha2(F.trim(F.regexp_replace(canon, r"[ \n]+", " ")), 256)


def license_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of this package's whole texts."""
    return spark.createDataFrame(sorted(LICENSES.items()), "license_id string, text string")


def known_licenses(texts: DataFrame) -> DataFrame:
    """(license_id, digest) of whole texts (license_id, text); of ids with
    the same digest the first."""
    return texts.select("license_id", digest_of_lines(canonical(F.col("text"))).alias("digest")) \
        .groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_notices(spark: SparkSession) -> DataFrame:
    """(notice_id, digest) of the known one-line notices."""
    rows = spark.createDataFrame([(k, t) for k, ts in sorted(NOTICES.items()) for t in ts], "notice_id string, text string")
    return rows.select("notice_id", digest_of_lines(canonical(F.col("text"))).alias("digest")).distinct()


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license_id (its entire text is
    that licence, else null), n_notices (lines that are a known notice) and
    notices (their distinct ids, sorted, comma-joined; null if none).
    ``licenses`` (license_id, text) takes the place of ``license_texts``."""
    spark = docs.sparkSession
    forms = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    whole = forms.select("doc_id", digest_of_lines(F.col("canon")).alias("digest"))
    known = F.broadcast(known_licenses(license_texts(spark))) if licenses is None else known_licenses(licenses)
    whole = whole.join(known, "digest", "left")
    # a notice is short: longer lines cannot match and are not digested
    longest = max(len(t) for ts in NOTICES.values() for t in ts) + 64
    lines = forms.select("doc_id", F.explode(F.split("canon", "\n")).alias("line")) \
        .where((F.length("line") <= longest) & F.col("line").contains("license")) \
        .select("doc_id", digest_of_lines(F.col("line")).alias("digest"))
    hits = lines.join(F.broadcast(known_notices(spark)), "digest").groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("notice_id")), ",").alias("ids"))
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "digest", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.col("ids").alias("notices"))
