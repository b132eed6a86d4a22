"""Licence scans by canonical digest.

Whole texts are brought to one canonical form (case, punctuation of any script, list marks, copyright lines, equivalent spellings)
with built-in string functions; the SHA-256 of that form is joined to the digests of known licences.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that go on after "copyright" inside a sentence; another word is a holder's name.
NOT_HOLDERS = (
    "a act all and any are as at claim claims condition conditions disclaimer disclaimers for from has holder holders in information "
    "infringement interest interests is it law laws licence license licenses licensee licensor management may notice notices of on or "
    "owner owners ownership permission permissions protection right rights shall statement statements status subject that the this "
    "to treaty under which with work works"
).split()


def _other_word(words: list[str], ended: str = "") -> str:
    """A pattern of any word but these; without look-around, so that it means the same in Java and RE2."""
    firsts = sorted({w[0] for w in words if w})
    ways = [f"[^\\W{''.join(firsts)}]\\w*"] + [f + _other_word([w[1:] for w in words if w[:1] == f], r"\b") for f in firsts]
    return "(?:" + "|".join(ways if "" in words or not ended else [*ways, ended]) + ")"


_HOLDER = (
    r"(?:copyright[ \t:]*(?:\(c\)|©|[0-9])|copyright[ \t:]+(?:by[ \t]|the[ \t][^\n]*\b(?:authors|contributors|developers|team|foundation|project)\b|"
    r"[^\x00-\x7F]|" + _other_word(NOT_HOLDERS) + r")"
    r"|\(c\)[ \t]*(?:copyright|[0-9])|©|all rights reserved)(?:[^\n]*(?:,|&|[ \t]and)[ \t\r]*\n)?[^\n]*"  # holders may go on in a second line
)
_PREFIX = r"[ \t#*/;>.|-]*"
_TITLE = (
    r"(?:the[ \t]+)?(?:mit|isc|expat|0bsd|(?:bsd[ \t]+)?zero[ -]clause[ \t]+bsd|bsd[ \t]+zero[ -]clause|"
    r"(?:new[ \t]+|modified[ \t]+|revised[ \t]+|simplified[ \t]+)?bsd(?:[ -][23][ -]clause)?|[23][ -]clause[ \t]+bsd)[ \t]+"
    r'(?:"?(?:new|revised|modified|simplified)"?[ \t]+)?licen[sc]e(?:[ \t]*\((?:mit|isc|expat|0bsd|bsd-[23]-clause)\))?'
)
# A short licence's title on the first line, and lines that name holders or years, not terms.
COPYRIGHT_LINE = rf"\A[ \t\r\n#*/=-]*{_TITLE}[^a-z0-9\n]*(?:\n[ \t\r\n#*/;>.|=-]*{_HOLDER})*(?:\n|\z)|(^|\n){_PREFIX}{_HOLDER}"
# A line that tags the file with an id, and addresses at the text's end.
TAG_LINE = rf"(\A|\n){_PREFIX}spdx-license-identifier:[^\n]*"
LAST_ADDRESS = r"(?:\n[ \t\r\n#*/;>.|-]*(?:see[ \t:]+)?<?https?://[^ \t\r\n]+)+[ \t\r\n]*\z"
# Who must not be named, in the canonical form, and the usual wording.
NAMED = r"neither the names? of (?:[^ ]+ ){1,12}?nor the names of its contributors"
UNNAMED = "neither the name of the copyright holder nor the names of its contributors"
# Spellings that count as the same, each with the form it takes.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("https://", "http://"),
)
# A list's number or letter, at a line's start or after a sentence: "1.", "(a)", "2)". Bullets are signs like any other.
LIST_MARK = r"(?:\A|\n|[.:;][ \t\r\n]+)[ \t#*/;>|-]*\(?(?:[0-9][0-9]?|[a-z])[.)][ \t\r\n]"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\p{P}\p{S}\p{Z}]+"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Public licence texts and notices by SPDX id. Callers with more pass their own table.
KNOWN = {
    "0BSD": f"{_ISC_GRANT}. {_ISC_AS_IS}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_TWO + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD + _BSD_AS_IS,
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        f"shall be included in all copies or substantial portions of the Software. {_AS_IS}"
    ),
    "MIT-notice": "Released under the MIT License.",
}
# The full texts as published, by file name. Ids without -text are those of the notices above.
KNOWN |= {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "known").glob("*.txt"))}
_TERMS_END = "END OF TERMS AND CONDITIONS"
KNOWN |= {
    "Apache-2.0-text-terms": KNOWN["Apache-2.0-text"].split(_TERMS_END)[0],
    "Apache-2.0-text-terms-end": KNOWN["Apache-2.0-text"].split(_TERMS_END)[0] + _TERMS_END,
}


def canonical(text: Column) -> Column:
    """The text's canonical form: lower case, no title, tag, copyright lines, last address or list marks, one spelling and
    one way to leave holders unnamed, words parted by one space."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for form in (TAG_LINE, LAST_ADDRESS, COPYRIGHT_LINE):
        out = F.regexp_replace(out, form, "\n")
    for found, form in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(form))
    out = F.regexp_replace(out, LIST_MARK, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(out, NOT_WORD, " ")), NAMED, UNNAMED)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(KNOWN.items()), "license_id string, text string")


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id, matched: the known licence whose whole text each document is, or null.

    Null, empty and purely formal texts have the empty canonical form and match nothing, on either side.
    If several known texts share a form, the smallest id stands for them, so each row stays one row. Repeated
    rows and null ids are kept, an empty table gives no rows, texts of any length are read whole, and other columns are not read. The known side is joined as it is: Spark broadcasts it only if its size is below the session's threshold.
    """
    known = known_licences(docs.sparkSession) if licences is None else licences
    forms = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    digests = forms.groupBy(F.sha2("form", 256).alias("known_digest")).agg(F.min("license_id").alias("license_id"))
    own = docs.select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", F.sha2("form", 256).alias("digest"))
    joined = own.join(digests, F.col("digest") == F.col("known_digest"), "left")
    return joined.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("matched"))
