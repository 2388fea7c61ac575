"""Licence scan: whole texts, normalised, are looked up by digest among known licences. DataFrame functions only."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of known digests of this many rows at most is broadcast; a larger one is joined by a shuffle.
BROADCAST_DIGESTS = 10_000

#: Spellings that count as equal, the first becoming the second.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"),
    ("centre", "center"), ("customised", "customized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"),
    ("optimisation", "optimization"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("copyright holder", "copyright owner"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TERMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TERMS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)

#: Texts of public licences and of the notices by which a whole file is put under one.
KNOWN = [
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TERMS),
    ("0BSD", "BSD Zero Clause License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TERMS),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TERMS),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission.\n" + _BSD_TERMS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Titles that short licences bear, besides the one above or none.
_TITLES = {
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)"),
    "ISC": ("The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
}
# not (a), (b), (c): normalized() takes a line that starts with (c) for a copyright line, which leaves BSD-3 the text of BSD-2
_NUMBERINGS = (("1.", "2.", "3."), ("(i)", "(ii)", "(iii)"))


def _variants(license_id: str, text: str) -> list[tuple[str, str]]:
    """A short licence without a title and with others, its conditions numbered in the usual ways."""
    title, body = text.split("\n", 1)
    bodies = [body]
    if license_id.startswith("BSD"):
        head, *conditions, terms = body.split("\n")
        bodies += ["\n".join([head, *(f"{n} {c}" for n, c in zip(ns, conditions)), terms]) for ns in _NUMBERINGS]
    return [(license_id, f"{t}\n{b}".strip()) for t in (title, "", *_TITLES[license_id]) for b in bodies]


def _full_texts() -> list[tuple[str, str]]:
    """The files of texts/, named by licence, and each without what follows its terms."""
    out = []
    for file in sorted(resources.files("maskspark.llm").joinpath("texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            license_id, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
            out += [(license_id, text), *([(license_id, terms + end), (license_id, terms)] if end else [])]
    return out


KNOWN += [v for i, t in KNOWN if i in _TITLES and "\n" in t for v in _variants(i, t)[1:]] + _full_texts()


def normalized(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, equivalent spellings made one, single spaces between words.

    A copyright line starts, after signs and blanks, with (c), the copyright sign, or copyright and a sign, a year or "by".
    """
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"(?m)^[ \t#*/;%\-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by|<)|\(c\)|©)[^\n]*$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t#*/;%\-]*all rights reserved[.]?[ \t\r]*$", "")
    t = F.regexp_replace(t, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")
    # two blanks between words: each word has its own, so that neighbours that are both replaced don't share one
    t = F.concat(F.lit(" "), F.replace(F.trim(t), F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of known licence texts; of equal digests the first id in order stands."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with license_id (string, null if the whole text is no known licence) and license_digest.

    `known` has columns digest and license_id, each digest once. Null and empty texts, and texts of punctuation alone,
    have the digest of nothing and match no licence. Texts are taken whole, whatever their length; equal rows get equal
    answers; columns of these two names are replaced. No rows give no rows.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    nothing = F.sha2(F.lit(""), 256)
    small = known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    names = [c for c in docs.columns if c not in ("license_id", "license_digest")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], digest(F.col(f"`{text_col}`")).alias("__digest"))
    side = known.select(F.col("digest").alias("__known"), F.col("license_id").alias("__license"))
    found = inner.join(F.broadcast(side) if small else side, (F.col("__digest") == F.col("__known")) & (F.col("__digest") != nothing), "left")
    return found.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__license").alias("license_id"), F.col("__digest").alias("license_digest"))
