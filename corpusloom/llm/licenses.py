"""License scans: canonical texts looked up by digest.

Built-in functions only. A text is put into a canonical form once - lower case, equivalent spellings made one, copyright
lines left out, punctuation and runs of white space turned into single spaces - and its digest is hash-joined to the
digests of known licence texts. Each whole line of a document is looked up too, because notices usually stand on a line
of their own: in the document's own row, against a literal of the known digests. The known texts are a parameter table;
beyond MAX_BROADCAST digests both joins are shuffled instead.

``known_texts`` has the notices of KNOWN and full public texts: those in ``license_texts``, with and without what follows
the end of their terms, and the usual forms of the MIT and BSD licences. A licence text is found when it is the whole
document, copyright lines aside.

Defined cases: null and empty texts, and lines of punctuation only, match nothing; every row is judged by its own text,
also where rows repeat an id or have none; two known texts with the same canonical form count as the one whose id is
first in order; columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

MAX_BROADCAST = 4096

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)

#: Fixed values: (licence id, text), public wordings.
KNOWN = (
    ("MIT", "The MIT License\n" + _PERMISSION),
    ("MIT", _PERMISSION),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n{}\n"
    "THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("REGENTS", "REGENTS"))


def _bsd() -> list[tuple[str, str]]:
    """The two- and three-clause licence by title, reserved rights, numbering and the names that their public forms differ in."""
    out = []
    for rights, numbered, (given, liable), named in product(("", "All rights reserved.\n"), (True, False), _HOLDERS, (None, "copyright holder", "University")):
        clauses = [*_CONDITIONS, *([_NAMES.format(named)] if named else [])]
        listed = "\n".join(f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(clauses, 1))
        kind = len(clauses)
        for title in ("", f"BSD {kind}-Clause License\n", f"The BSD {kind}-Clause License\n"):
            out.append((f"BSD-{kind}-Clause", title + rights + _BSD.format(listed, given, liable)))
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of all notices and full texts."""
    out = [*KNOWN, *(("MIT", title + "\n" + _PERMISSION) for title in ("MIT License", "The MIT License (MIT)")), *_bsd()]
    for file in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text, end = file.read_text(encoding="utf-8"), "END OF TERMS AND CONDITIONS"
            out.append((file.name.removesuffix(".txt"), text))
            if end in text:
                out.append((file.name.removesuffix(".txt"), text[: text.index(end) + len(end)]))
    return out


#: Fixed values: (pattern, the one spelling), applied in order to lower-case text.
SPELLINGS = (
    (r"licenc", "licens"),
    (r"\bv\.? ?([0-9])", "version $1"),
    (r"sub-license", "sublicense"),
    (r"non-?infringement", "noninfringement"),
    (r"organis", "organiz"),
    (r"favour", "favor"),
    (r"https?://", ""),
)

#: Punctuation and white space before a mark, however much of it: indentation and comment marks.
_LEAD = r"^[^\p{L}\p{N}\n]*"
#: The mark a few words into its line and a year a few words behind it.
COPYRIGHT_LINE = rf"(?md){_LEAD}[^\n]{{0,20}}(copyright|\(c\)|©)[^\p{{L}}\p{{N}}\n]*[^\n]{{0,20}}[0-9]{{4}}[^\n]*$"

#: Words that follow "copyright" in running text, where a wrapped line may start with it.
_PROSE = (
    "also|and|or|if|on|in|to|of|for|is|are|as|that|which|acts?|claims?|disclaimers?|doctrines?|holders?|infringements?|information|interests?|laws?|"
    "licen[sc](?:es?|ed|ing)|resulting|the (?:library|software)|those|lines?|like|materials?|notices?|owners?|ownership|patents?|permissions?|protections?|related|rights?|statements?|status|treat(?:y|ies)"
)

#: Besides those, lines that start with a mark, with or without a year. A bare "(c)" is also how lists are numbered and
#: needs a year; a bare "copyright" needs a holder or year.
COPYRIGHT_MARK = (
    COPYRIGHT_LINE + rf"|{_LEAD}(?:copyright[ \t]*(?:\(c\)|©)|©|\(c\)[^\n]*[0-9]{{4}}"
    r"|copyright(?!\p{L})[^\p{L}\p{N}\n]*(?!(?:" + _PROSE + r")(?!\p{L}))[\p{L}\p{N}])[^\n]*$"
)

#: The same for one line, without look-ahead: patterns of which one must match, and one that must match while others do not.
MARKED_LINE = (
    r"^[^\p{L}\p{N}]*.{0,20}(copyright|\(c\)|©)[^\p{L}\p{N}]*.{0,20}[0-9]{4}",
    r"^[^\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©)|©|\(c\).*[0-9]{4})",
)
NAMED_LINE = (r"^[^\p{L}\p{N}]*copyright[^\p{L}\p{N}]*[\p{L}\p{N}]", r"^[^\p{L}\p{N}]*copyright\p{L}", rf"^[^\p{{L}}\p{{N}}]*copyright[^\p{{L}}\p{{N}}]*({_PROSE})([^\p{{L}}]|$)")


def canonical(text: Column) -> Column:
    """Case, copyright lines, equivalent spellings, punctuation and white space normalised; lines stay lines."""
    out = F.lower(text)
    out = F.when(out.contains("copyright") | out.contains("(c)") | out.contains("©"), F.regexp_replace(out, COPYRIGHT_MARK, "")).otherwise(out)
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _digest(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"[ \n]+", " "))
    return F.when(flat != "", F.md5(flat))


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, text) to (digest, license_id), one row a digest."""
    return known.select("license_id", _digest(canonical(F.col("text"))).alias("digest")).filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text_digest, whole_license, licenses, n_license_lines) for every row of ``documents``.

    ``licenses`` has the ids found, sorted and distinct, of the whole text and of its lines.
    """
    digests = known_digests(known)
    few = digests.limit(max_broadcast + 1).collect()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    lines = lambda t: F.filter(F.transform(F.split(t, "\n"), _digest), lambda d: d.isNotNull())
    if len(few) <= max_broadcast:
        ids = {r["digest"]: r["license_id"] for r in few}
        names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]) if ids else F.create_map().cast("map<string,string>")
        found = lambda t: F.transform(F.filter(lines(t), lambda d: d.isin(*ids)), lambda d: F.element_at(names, d))
        judged = docs.select("doc_id", let(canonical(F.col("__text")), lambda t: F.struct(_digest(t).alias("digest"), found(t).alias("ids"))).alias("__r"))
        rows, digests = judged.select("doc_id", F.col("__r.digest").alias("digest"), F.col("__r.ids").alias("__ids")), F.broadcast(digests)
    else:
        judged = docs.select("doc_id", let(canonical(F.col("__text")), lambda t: F.struct(_digest(t).alias("digest"), lines(t).alias("lines"))).alias("__r"))
        rows = cut(judged.select("doc_id", F.col("__r.digest").alias("digest"), F.col("__r.lines").alias("__lines"), F.md5(F.array_join("__r.lines", "")).alias("__key")))
        each = rows.select("__key", F.posexplode("__lines").alias("__at", "digest")).join(digests, "digest").select("__key", "__at", "license_id").distinct()
        hits = each.groupBy("__key").agg(F.collect_list("license_id").alias("__ids"))
        rows = rows.join(hits, "__key", "left").select("doc_id", "digest", "__ids")
    none = F.array().cast("array<string>")
    whole = rows.join(digests, "digest", "left")
    both = F.array_union(F.coalesce("__ids", none), F.when(F.col("license_id").isNotNull(), F.array("license_id")).otherwise(none))
    return whole.select("doc_id", F.col("digest").alias("text_digest"), F.col("license_id").alias("whole_license"), F.array_sort(both).alias("licenses"), F.size(F.coalesce("__ids", none)).cast("long").alias("n_license_lines"))
