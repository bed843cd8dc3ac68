"""Licence recognition by sentences and ordered rules, in native expressions.

A text is normalised to its words, with a mark at each sentence end and each
line end.  Known licence sentences are found in it, wherever their lines are
wrapped: short ones only as a whole sentence or line, the distinctive ones of
the standard notices also within a longer sentence.  This gives the document
a sequence of sentence identifiers.  Rules, tried in order, match runs of identifiers in that
sequence; a match consumes its identifiers, so a specific rule goes before
the general one it contains.  The known sentences and rules are small fixed
tables; a document is scanned by one expression, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.common import text_of

# Normalised licence sentences (lower case, words by one space)
# and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "Apache2Grant",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitRelease",
    "licensed under the mit license": "MitRelease",
    "permission is hereby granted free of charge to any person obtaining a copy": "MitPermission",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Work",
    "this work is licensed under the gnu general public license version 2": "Gpl2Work",
    "this program is free software": "GplFree",
    "either version 3 of the license or at your option any later version": "Gpl3Later",
    "either version 2 of the license or at your option any later version": "Gpl2Later",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "redistribution and use in source and binary forms are permitted": "BsdRedistribute",
    "all rights reserved": "AllRights",
}

# Licence, run of sentence identifiers, kind; in the order in which
# they are tried.
RULES = [
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later"), "copyleft"),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later"), "copyleft"),
    ("GPL-3.0", ("Gpl3Work",), "copyleft"),
    ("GPL-2.0", ("Gpl2Work",), "copyleft"),
    ("Apache-2.0", ("Apache2Grant", "ApacheComply", "ApacheCopy"), "permissive"),
    ("Apache-2.0", ("Apache2Grant",), "permissive"),
    ("MIT", ("MitPermission", "AsIs"), "permissive"),
    ("MIT", ("MitRelease",), "permissive"),
    ("BSD", ("BsdRedistribute", "AsIs"), "permissive"),
    ("CC-BY-NC-4.0", ("CcByNc4",), "non-commercial"),
    ("CC-BY-SA-4.0", ("CcBySa4",), "copyleft"),
    ("CC-BY-4.0", ("CcBy4",), "permissive"),
]

_MIT_START = "permission is hereby granted free of charge to any person obtaining a copy"
_ISC_START = ("permission to use copy modify {} distribute this software for any purpose "
              "with or without fee is hereby granted")
_ISC_END = " provided that the above copyright notice and this permission notice appear in all copies"
_GNU = ("you can redistribute it and or modify it under the terms of the gnu {} "
        "as published by the free software foundation")
_CC = "licensed under {} creative commons {} 4 0 international license"

# Sentences of the standard notices and their identifiers; found
# anywhere, as a notice's sentences run on and may stand on one line.
NOTICES = {
    "licensed under the apache license version 2 0 the license": "Apache2Grant",
    "licenses this file to you under the apache license version 2 0": "Apache2Grant",
    "apache license version 2 0 january 2004": "Apache2Title",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    _MIT_START: "MitPermission",
    "the software is provided as is without warranty of any kind": "AsIs",
    "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met": "BsdGrant",
    "all advertising materials mentioning features or use of this software must display "
    "the following acknowledgement": "BsdAdvert",
    "may be used to endorse or promote products derived from this software "
    "without specific prior written permission": "BsdEndorse",
    **{f"this software is provided by the {who} as is": "BsdAsIs" for who in (
        "copyright holders and contributors", "copyright holder and contributors",
        "copyright owners and contributors", "regents and contributors",
        "author and contributors", "authors and contributors", "author", "authors")},
    **{_ISC_START.format(a) + _ISC_END: "IscPermission" for a in ("and or", "and")},
    **{_ISC_START.format(a): "ZeroBsdPermission" for a in ("and or", "and")},
    "the software is provided as is and the author disclaims all warranties": "IscAsIs",
    _GNU.format("general public license"): "GplTerms",
    _GNU.format("general public license version 2"): "Gpl2Terms",
    _GNU.format("general public license version 3"): "Gpl3Terms",
    _GNU.format("lesser general public license"): "LgplTerms",
    _GNU.format("library general public license"): "LgplTerms",
    _GNU.format("affero general public license"): "AgplTerms",
    "either version 3 of the license or at your option any later version": "Gpl3Later",
    "either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "either version 2 of the license or at your option any later version": "Gpl2Later",
    "this library is free software": "LgplFree",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2",
    "mozilla public license version 2 0": "Mpl2Title",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    **{_CC.format(a, "attribution" + long): "Cc" + short + "4" for a in ("a", "the")
       for long, short in (("", "By"), (" sharealike", "BySa"), (" noderivatives", "ByNd"),
                           (" noncommercial", "ByNc"), (" noncommercial sharealike", "ByNcSa"),
                           (" noncommercial noderivatives", "ByNcNd"))},
}

# Rules of the notices, tried before the others.
NOTICE_RULES = [
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms", "Gpl3Later"), "copyleft"),
    ("AGPL-3.0-or-later", ("AgplTerms", "Gpl3Later"), "copyleft"),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms", "Gpl3Later"), "copyleft"),
    ("LGPL-3.0-or-later", ("GplFree", "LgplTerms", "Gpl3Later"), "copyleft"),
    ("LGPL-3.0-or-later", ("LgplTerms", "Gpl3Later"), "copyleft"),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Lgpl21Later"), "copyleft"),
    ("LGPL-2.1-or-later", ("GplFree", "LgplTerms", "Lgpl21Later"), "copyleft"),
    ("LGPL-2.1-or-later", ("LgplTerms", "Lgpl21Later"), "copyleft"),
    ("LGPL-2.0-or-later", ("LgplFree", "LgplTerms", "Gpl2Later"), "copyleft"),
    ("LGPL-2.0-or-later", ("GplFree", "LgplTerms", "Gpl2Later"), "copyleft"),
    ("LGPL-2.0-or-later", ("LgplTerms", "Gpl2Later"), "copyleft"),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Gpl3Later"), "copyleft"),
    ("GPL-3.0-or-later", ("GplTerms", "Gpl3Later"), "copyleft"),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Gpl2Later"), "copyleft"),
    ("GPL-2.0-or-later", ("GplTerms", "Gpl2Later"), "copyleft"),
    ("GPL-3.0", ("GplFree", "Gpl3Terms"), "copyleft"),
    ("GPL-3.0", ("Gpl3Terms",), "copyleft"),
    ("GPL-2.0", ("GplFree", "Gpl2Terms"), "copyleft"),
    ("GPL-2.0", ("Gpl2Terms",), "copyleft"),
    ("BSD-4-Clause", ("BsdGrant", "BsdAdvert", "BsdEndorse", "BsdAsIs"), "permissive"),
    ("BSD-4-Clause", ("BsdGrant", "BsdAdvert"), "permissive"),
    ("BSD-3-Clause", ("BsdGrant", "BsdEndorse", "BsdAsIs"), "permissive"),
    ("BSD-3-Clause", ("BsdGrant", "BsdEndorse"), "permissive"),
    ("BSD-2-Clause", ("BsdGrant", "BsdAsIs"), "permissive"),
    ("BSD", ("BsdGrant",), "permissive"),
    ("ISC", ("IscPermission", "IscAsIs"), "permissive"),
    ("ISC", ("IscPermission",), "permissive"),
    ("0BSD", ("ZeroBsdPermission", "IscAsIs"), "permissive"),
    ("0BSD", ("ZeroBsdPermission",), "permissive"),
    ("MPL-2.0", ("Mpl2",), "copyleft"),
    ("MPL-2.0", ("Mpl2Title",), "copyleft"),
    ("Unlicense", ("Unlicense",), "permissive"),
    ("Apache-2.0", ("Apache2Title",), "permissive"),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",), "non-commercial"),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4",), "non-commercial"),
    ("CC-BY-ND-4.0", ("CcByNd4",), "no-derivatives"),
]

# SPDX short identifiers whose licence has another name here, and
# those of licences without a notice above.
_SPDX_ALSO = {"GPL-2.0-only": "GPL-2.0", "GPL-3.0-only": "GPL-3.0",
              "LGPL-2.0-only": "LGPL-2.0", "LGPL-2.1-only": "LGPL-2.1",
              "LGPL-3.0-only": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0"}
_SPDX_MORE = {"LGPL-2.0": "copyleft", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft",
              "AGPL-3.0": "copyleft", "CC0-1.0": "permissive", "Zlib": "permissive",
              "BSL-1.0": "permissive", "EPL-2.0": "copyleft"}
_KIND_OF = {name: kind for name, _, kind in NOTICE_RULES + RULES} | _SPDX_MORE
#: The normalised short identifier and its sentence identifier.
SPDX = {" ".join(re.findall("[a-z0-9]+", short.lower())): "Spdx:" + name for short, name in
        [*((n, n) for n in _KIND_OF), *_SPDX_ALSO.items()]}
ALL_RULES = NOTICE_RULES + RULES + [(n, ("Spdx:" + n,), k) for n, k in _KIND_OF.items()]

#: Marks of a sentence end and of a line end in a normalised text.
_STOP, _LINE = "\u0001", "\u0002"
#: Cheap test on the whole text; every known sentence holds one of these words.
TRIGGER = (r"(?i)licen[sc]e|permission|redistribut|warranty|warranties|free\W+software|reserved"
           r"|software\W+is\W+provided|unencumbered|advertising|either\W+version")


def _either(phrases, gap: str) -> str:
    """Pattern of any of the phrases, the longest first."""
    return "(?:" + "|".join(p.replace(" ", gap) for p in sorted(phrases, key=len, reverse=True)) + ")"


_ANY_GAP = f"[ {_STOP}{_LINE}]"
_SPDX_ID = _either(SPDX, " ") + "(?![a-z0-9])"
_FOUND = "|".join([
    f"(?<![a-z0-9])spdx license identifier{_ANY_GAP}{_SPDX_ID}"
    f"(?:(?: with [a-z0-9]+(?: [a-z0-9]+)*? exception(?: [0-9]+)*)? (?:or|and) {_SPDX_ID})*",
    f"(?<![a-z0-9]){_either(NOTICES, _ANY_GAP)}(?![a-z0-9])",
    f"(?<![^{_STOP}{_LINE}]){_either(SENTENCES, f'[ {_LINE}]')}(?![^{_STOP}{_LINE}])"])


def normalised(text: Column) -> Column:
    """The words of a text in lower case, parted by one space, or by one mark
    where a sentence (a mark before white space) or a line ends."""
    out = F.translate(F.lower(text), _STOP + _LINE, "  ")
    for pattern, by in ((r"(gpl-[0-9.]*[0-9])\+", "$1-or-later"),
                        (r"[.;:!?]+(?=[ \t\n\r])", _STOP), (r"[\n\r]+", _LINE),
                        (f"[^a-z0-9{_STOP}{_LINE}]+", " "),
                        (f"[ {_LINE}]*{_STOP}{_ANY_GAP}*", _STOP),
                        (f"[ {_LINE}]*{_LINE}[ {_LINE}]*", _LINE)):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for pair in (SENTENCES | NOTICES | SPDX).items()
                           for x in pair))
    found = F.regexp_extract_all(normalised(text), F.lit(_FOUND), F.lit(0))
    plain = F.transform(found, lambda s: F.translate(s, _STOP + _LINE, "  "))
    parts = F.flatten(F.transform(plain, lambda s: F.when(
        F.startswith(s, F.lit("spdx ")), F.regexp_extract_all(
            s, F.lit("(?<![a-z0-9])" + _SPDX_ID), F.lit(0))).otherwise(F.array(s))))
    ids = F.transform(parts, lambda s: F.try_element_at(known, s))
    return F.when(F.regexp_like(text, F.lit(TRIGGER)), ids).otherwise(
        F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (distinct, in rule order), kind (the
    strictest kind found, or 'none'), unmatched (known sentences that no rule
    used).

    Null text is the empty text: no sentences, kind 'none'.  Rows are
    independent, so repeated and null ids keep one result per row, an empty
    table gives no rows, and other columns are ignored.
    """
    found = docs.select("doc_id", F.concat_ws(" ", sentence_ids(text_of())).alias("ids"))
    # the sequence as " A B C ": a rule's run of identifiers is a substring
    rest, hits = F.concat(F.lit(" "), F.replace(F.col("ids"), F.lit(" "), F.lit("  ")),
                          F.lit(" ")), []
    out = found.withColumn("rest", rest)
    for n, (_, run, _) in enumerate(ALL_RULES):
        pattern = F.lit(" " + "  ".join(run) + " ")
        out = out.withColumn(f"hit{n}", F.contains("rest", pattern)).withColumn(
            "rest", F.replace(F.col("rest"), pattern, F.lit("")))
        hits.append(f"hit{n}")
    licences = F.array_distinct(F.filter(F.array(*(
        F.when(F.col(h), F.lit(name)) for h, (name, _, _) in zip(hits, ALL_RULES))),
        lambda x: x.isNotNull()))

    def any_of(kind: str) -> Column:
        return F.greatest(*(F.col(h) for h, r in zip(hits, ALL_RULES) if r[2] == kind),
                          F.lit(False))

    kind = (F.when(any_of("non-commercial"), "non-commercial")
            .when(any_of("no-derivatives"), "no-derivatives").when(any_of("copyleft"), "copyleft")
            .when(any_of("permissive"), "permissive").otherwise("none"))
    return out.select("doc_id", F.split(F.col("ids"), " ").alias("sentence_ids"),
                      licences.alias("licenses"), kind.alias("kind"),
                      F.trim(F.regexp_replace("rest", " +", " ")).alias("unmatched"))


def scan_sql() -> str:
    """The scan for ``SENTENCES`` on one line and their ``RULES`` over view
    ``documents``, for DuckDB: doc_id, n_sentences, licenses (joined by commas),
    kind.  Wrapped lines, notices and SPDX lines are not in it."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rest, steps = "s0", []
    for n, (_, run, _) in enumerate(RULES):
        pattern = quoted(" " + "  ".join(run) + " ")
        steps.append(f"t{n} AS (SELECT *, contains({rest}, {pattern}) AS hit{n}, "
                     f"replace({rest}, {pattern}, '') AS s{n + 1} "
                     f"FROM {f't{n - 1}' if n else 'seq'})")
        rest = f"s{n + 1}"
    names = ", ".join(f"CASE WHEN hit{n} THEN {quoted(r[0])} END" for n, r in enumerate(RULES))
    firsts = {name: n for n, (name, _, _) in reversed(list(enumerate(RULES)))}
    order = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in firsts.items())

    def any_of(kind: str) -> str:
        return " OR ".join(f"hit{n}" for n, r in enumerate(RULES) if r[2] == kind)

    return f"""
WITH known(sentence, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split_regex(
          regexp_replace(coalesce(text, ''), '([.;:!?]+)([ \\t\\n\\r])', chr(1) || '\\2', 'g'),
          '[\\n\\r]+|' || chr(1)) AS parts
        FROM documents)),
ids AS (
  SELECT doc_id, string_agg(id, '  ' ORDER BY pos) AS ids, count(*) AS n
  FROM parts JOIN known
    ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))
  GROUP BY doc_id),
seq AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_sentences, ' ' || coalesce(ids, '') || ' ' AS s0
  FROM documents d LEFT JOIN ids USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n_sentences,
  coalesce((SELECT string_agg(x, ',' ORDER BY CASE x {order} END)
            FROM (SELECT DISTINCT unnest([{names}]) AS x) WHERE x IS NOT NULL), '') AS licenses,
  CASE WHEN {any_of("non-commercial")} THEN 'non-commercial' WHEN {any_of("copyleft")}
    THEN 'copyleft' WHEN {any_of("permissive")} THEN 'permissive' ELSE 'none' END AS kind
FROM t{len(RULES) - 1}"""
