"""License scans: sentences, known licence sentences, ordered licence rules, in DataFrame operations only.

One pass without shuffles: each text is cut into sentences, each sentence is normalised and looked up in the table of
known sentences, and the sequence of identifiers found is matched against rules (identifiers in order, others between).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_title": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied",
    "apache_ref": "licensed under the apache license version 2 0",
    "apache_full": "licensed under the apache license version 2 0 the license",
    "apache_terms": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2_ref": "this work is licensed under the gnu general public license version 2",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl_ref": "this work is licensed under the gnu lesser general public license version 3",
    "mpl_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_ref": "licensed under cc by 4 0",
    "cc_by_sa_ref": "licensed under cc by sa 4 0",
    "cc_by_nc_ref": "licensed under cc by nc 4 0",
    "cc0_ref": "licensed under cc0 1 0",
    "all_rights": "all rights reserved",
}
# Licence rules as (licence, kind, identifiers in order).
RULES = [
    ("MIT", "permissive", ["mit_ref"]),
    ("MIT", "permissive", ["mit_under"]),
    ("MIT", "permissive", ["mit_title", "mit_grant"]),
    ("MIT", "permissive", ["mit_grant", "mit_notice", "as_is"]),
    ("Apache-2.0", "permissive", ["apache_ref"]),
    ("Apache-2.0", "permissive", ["apache_full", "apache_terms"]),
    ("GPL-3.0", "copyleft", ["gpl3_ref"]),
    ("GPL-3.0", "copyleft", ["gpl3_free", "gpl_warranty"]),
    ("GPL-2.0", "copyleft", ["gpl2_ref"]),
    ("LGPL-3.0", "copyleft", ["lgpl_ref"]),
    ("MPL-2.0", "copyleft", ["mpl_ref"]),
    ("BSD-2-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("CC-BY-4.0", "permissive", ["cc_by_ref"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc_by_sa_ref"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc_by_nc_ref"]),
    ("CC0-1.0", "public domain", ["cc0_ref"]),
    ("proprietary", "restricted", ["all_rights"]),
]
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
# Whole normalised sentences of the public texts that go on beyond those above, and the identifiers they stand for.
WHOLE = {
    SENTENCES["mit_grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    SENTENCES["as_is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    SENTENCES["apache_full"] + " " + SENTENCES["apache_terms"]: "apache_full apache_terms",
    _GPL + "either version 3 of the license or at your option any later version": "gpl3_free",
    _GPL + "either version 2 of the license or at your option any later version": "gpl2_free",
    SENTENCES["gpl_warranty"] + " without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl_ref",  # "v. " ends a sentence
}
WHOLE_RULES = [("GPL-2.0", "copyleft", ["gpl2_free", "gpl_warranty"])]
_LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
_AFFERO = "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
# More whole normalised sentences of public texts and notices, and their rules.
WHOLE |= {
    _LIBRARY + "either version 2 1 of the license or at your option any later version": "lgpl21_free",
    _LIBRARY + "either version 3 of the license or at your option any later version": "lgpl3_free",
    _AFFERO + "either version 3 of the license or at your option any later version": "agpl3_free",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
WHOLE_RULES += [
    ("LGPL-2.1", "copyleft", ["lgpl21_free"]),
    ("LGPL-3.0", "copyleft", ["lgpl3_free"]),
    ("AGPL-3.0", "copyleft", ["agpl3_free"]),
    ("BSD-3-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]),
    ("ISC", "permissive", ["isc_grant"]),
    ("Unlicense", "public domain", ["unlicense"]),
]
# Sentences of further public texts and notices (heads of the whole texts included), and their rules.
WHOLE |= {
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "boost software license version 1 0 august 17th 2003": "boost_title",
    "distributed under the boost software license version 1 0": "boost_ref",
    "eclipse public license v 2 0": "epl2_title",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl_provided",
}
WHOLE_RULES += [
    ("GPL-3.0", "copyleft", ["gpl3_title", "fsf_verbatim"]),
    ("GPL-2.0", "copyleft", ["gpl2_title", "fsf_verbatim"]),
    ("LGPL-3.0", "copyleft", ["lgpl3_title", "fsf_verbatim"]),
    ("LGPL-2.1", "copyleft", ["lgpl21_title", "fsf_verbatim"]),
    ("AGPL-3.0", "copyleft", ["agpl3_title", "fsf_verbatim"]),
    ("Zlib", "permissive", ["zlib_grant"]),
    ("BSL-1.0", "permissive", ["boost_ref"]),
    ("BSL-1.0", "permissive", ["boost_title", "boost_grant"]),
    ("EPL-2.0", "copyleft", ["epl2_title", "epl_provided"]),
    ("EPL-2.0", "copyleft", ["epl2_ref"]),
    ("MIT", "permissive", ["mit_or_apache"]),
    ("Apache-2.0", "permissive", ["mit_or_apache"]),
]
_ENDORSE = " be used to endorse or promote products derived from this software without specific prior written permission"
# Sentences with a slot for holders, places or wording, as (identifier, words every such sentence has, whole pattern).
SLOTS = [
    ("bsd_name", "endorse or promote products", f"neither the names? of .+ n?or the names of (?:(?:its|any|their|the|other) )?contributors may{_ENDORSE}"),
    ("bsd_name", "endorse or promote products", f"(?:the )?names? of .+ may not{_ENDORSE}"),
    ("fsf_verbatim", "verbatim copies", "(?:copyright .+ )?everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("boost_grant", "accompanying documentation", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .+"),
    ("epl2_ref", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0(?: which .+)?"),
    ("mit_or_apache", "licensed under", "(?:.+ )?licensed under (?:either |either of )?(?:the )?(?:mit(?: license)? (?:or|and) (?:the )?apache(?: license)?(?: version)? 2 0|apache(?: license)?(?: version)? 2 0 (?:or|and) (?:the )?mit)(?: license| licenses)?(?: at your option)?"),
    ("all_rights", "all rights reserved", ".+ all rights reserved"),
]
_FAMILY = {"GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft", "AGPL-3.0": "copyleft"}
# Identifiers of the SPDX list that are known, with their kind; those of the GNU family also end in -only or -or-later.
SPDX = _FAMILY | {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Zlib": "permissive",
    "BSL-1.0": "permissive", "MPL-2.0": "copyleft", "EPL-2.0": "copyleft", "Unlicense": "public domain", "CC0-1.0": "public domain",
    "CC-BY-4.0": "permissive", "CC-BY-SA-4.0": "copyleft", "CC-BY-NC-4.0": "noncommercial",
}
_TAG = "spdx license identifier "


def _spdx_ids() -> dict[str, str]:
    """Normalised tags and the identifiers they stand for."""
    out = {}
    for name in SPDX:
        plain = name.lower().replace("-", " ").replace(".", " ")
        for end in ("", " only", " orlater") if name in _FAMILY else ("",):
            out[_TAG + plain + end] = "spdx_" + plain.replace(" ", "_")
    return out


SPDX_IDS = _spdx_ids()
SPDX_RULES = [(name, kind, ["spdx_" + name.lower().replace("-", "_").replace(".", "_")]) for name, kind in SPDX.items()]
#: A licence whose text holds all of another's: where the key holds, the value is left out.
COVERS = {"BSD-3-Clause": "BSD-2-Clause"}
#: A notice that says nothing once a licence grants rights: left out where any other licence holds.
RESERVED = "proprietary"
BREAK = r"[.!?]+[ \t]+|\n+"
_SPACE = r"[ \t\n\x0b\x0c\r]"
#: Rewritings before a text is cut, in order: tags keep their identifier in one sentence; points of abbreviations inside a sentence go;
#: \x01 stands before numbered lines, \x02 where a sentence may begin inside a run without other marks (texts whose line ends were lost).
MARKS = [
    (r"(?i)(SPDX-License-Identifier):", "$1 "),
    (r"(?i)-or-later", "-orlater"),
    (rf"([^A-Za-z0-9](?:Inc|Ltd|Corp|Co|LLC|v))\.({_SPACE}+[^A-Za-z]*[a-z0-9])", "$1 $2"),
    (rf"\n([^A-Za-z0-9\n]*[0-9][0-9]?[.)]{_SPACE})", "\x01$1"),
    (rf":{_SPACE}+(?:[-*]{_SPACE}+)?([A-Z])", "\x02$1"),
    (rf"{_SPACE}+(Permission is hereby granted|Permission to use, copy|Redistribution and use in source)", "\x02$1"),
]
#: Ends of sentences that may be wrapped over lines: a mark and white space, a line without letters or digits, the start of a numbered line.
WRAPPED_BREAK = rf"\x01|[.!?]+{_SPACE}+|\n(?:[^A-Za-z0-9\n]*\n)+"
NOISE = r"[^a-z0-9]+"


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), NOISE, " "))


def cues(known: list[str]) -> list[str]:
    """A few long words so that each known sentence holds at least one: the word in most sentences first."""
    left, out = list(known), []
    while left:
        held = {w for s in left for w in s.split() if len(w) > 6} or {max(left[0].split(), key=len)}
        best = max(held, key=lambda w: (sum(w in s for s in left), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] | None = None, rules=None) -> DataFrame:
    """All rows of docs as (doc_id, n_sentences, sentence_ids, licenses, kinds): which licence rules each text satisfies.

    n_sentences counts lines and sentences.  A sentence wrapped over lines is looked up as a whole; where that is not known, its parts (`MARKS`)
    are, and where a part is not known, its lines; whatever their length.  Sentences with a slot (`SLOTS`) are known whoever the holder is;
    an SPDX tag stands for every identifier of its expression that is known.  With `known` given, only its sentences are looked up.
    A rule holds where its identifiers occur in order, anything between them.  licenses and kinds are sorted, distinct and
    joined by '+'; a licence whose text holds another's (`COVERS`) replaces it, and reserved rights count only where no licence holds.
    Null and empty texts have no sentences and no licence; very long texts are read whole; repeated rows each get their row;
    other columns, of whatever names, are ignored; an empty table gives an empty result.
    """
    table = {s: name for name, s in (known or SENTENCES).items()} | ({} if known else WHOLE | SPDX_IDS)
    rules = rules or RULES + WHOLE_RULES + SPDX_RULES
    slots = [] if known else SLOTS
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cue = F.contains(low, F.lit("spdx")) if not known else F.lit(False)
    for word in cues([s for s in table if not s.startswith(_TAG)] + [words for _, words, _ in slots]):  # texts without any of them hold no known sentence
        cue = cue | F.contains(low, F.lit(word))
    table = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    body = F.coalesce(F.col(text), F.lit(""))
    marked = body
    for pattern, by in MARKS:
        marked = F.regexp_replace(marked, pattern, by)

    def look(s: Column) -> Column:
        """The identifiers of a normalised sentence, joined by spaces; null where it is not known."""
        out = F.element_at(table, s)
        if known:
            return out
        tags = F.transform(F.split(F.substring(s, len(_TAG) + 1, 1 << 30), " (?:or|and|with) "), lambda x: F.element_at(table, F.concat(F.lit(_TAG), F.trim(x))))
        slot = F.when(F.startswith(s, F.lit(_TAG)), F.nullif(F.concat_ws(" ", F.array_compact(tags)), F.lit("")))
        for name, words, pattern in slots:
            slot = slot.when(F.contains(s, F.lit(words)) & s.rlike(f"^(?:{pattern})$"), F.lit(name))
        return F.coalesce(out, slot)

    said = docs.select(
        F.col(doc_id).alias("doc_id"), F.size(F.filter(F.split(body, BREAK), lambda s: F.lower(s).rlike("[a-z0-9]"))).cast("long").alias("n_sentences"),
        F.when(cue, F.transform(F.split(marked, WRAPPED_BREAK), lambda s: F.struct(look(_normal(s)).alias("known"), s.alias("s")))).alias("said"),
    )
    lines = lambda s: F.array_compact(F.transform(F.split(s, "\n"), lambda x: look(_normal(x))))
    held = lambda p, less: F.when(p["known"].isNotNull(), F.array(p["known"])).otherwise(less(p["s"]))
    parts = lambda s: F.flatten(F.transform(F.transform(F.split(s, "\x02"), lambda x: F.struct(look(_normal(x)).alias("known"), x.alias("s"))), lambda p: held(p, lines)))
    ids = F.flatten(F.transform("said", lambda p: held(p, parts)))
    said = said.select("doc_id", "n_sentences", F.coalesce(F.concat_ws(" ", ids), F.lit("")).alias("sentence_ids"))

    def met(ids: list[str]) -> Column:
        return F.col("sentence_ids").rlike("(^| )" + " (.* )?".join(ids) + "( |$)")

    none = F.array().cast("array<string>")
    hold = F.array_distinct(F.array_compact(F.array(*[F.when(met(ids), F.lit(name)) for name, _, ids in rules])))
    said = said.withColumn("hold", F.when(F.col("sentence_ids") == "", none).otherwise(hold))
    less = F.array_compact(F.array(*[F.when(F.array_contains("hold", more), F.lit(other)) for more, other in COVERS.items()], F.when(F.size("hold") > 1, F.lit(RESERVED))))
    said = said.withColumn("left", F.array_sort(F.array_except("hold", less)))
    kind = F.create_map(*[F.lit(x) for pair in {name: kind for name, kind, _ in rules}.items() for x in pair])
    kinds = F.array_sort(F.array_distinct(F.transform("left", lambda x: F.element_at(kind, x))))
    return said.select("doc_id", "n_sentences", "sentence_ids", F.concat_ws("+", "left").alias("licenses"), F.concat_ws("+", kinds).alias("kinds"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_oracle() -> str:
    """The same look-ups over the whole table of sentences, slots, tags and rules."""
    known = {s: name for name, s in SENTENCES.items()} | WHOLE | SPDX_IDS
    rules = RULES + WHOLE_RULES + SPDX_RULES
    kinds = {name: kind for name, kind, _ in rules}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = f"MAP {{{', '.join(f'{quote(s)}: {quote(name)}' for s, name in known.items())}}}"
    kind_of = f"MAP {{{', '.join(f'{quote(n)}: {quote(k)}' for n, k in kinds.items())}}}"
    marked = "coalesce(text, '')"
    for pattern, by in MARKS:
        marked = f"regexp_replace({marked}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    slots = " ".join(f"WHEN regexp_full_match(s, {quote(pattern)}) THEN {quote(name)}" for name, _, pattern in SLOTS)
    hold = ", ".join(f"CASE WHEN regexp_matches(sentence_ids, '(^| ){' (.* )?'.join(ids)}( |$)') THEN {quote(name)} END" for name, _, ids in rules)
    covered = " ".join(f"WHEN {quote(other)} THEN NOT list_contains(hold, {quote(more)})" for more, other in COVERS.items())
    normal = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body, {marked} AS marked FROM documents
), counted AS (
  SELECT row, doc_id, CAST(len(list_filter(string_split_regex(body, '[.!?]+[ \\t]+|\\n+'), lambda s: regexp_matches(lower(s), '[a-z0-9]'))) AS BIGINT) AS n_sentences FROM texts
), wholes AS (
  SELECT row, no, list_extract(cut, no) AS s FROM (SELECT row, cut, unnest(range(1, len(cut) + 1)) AS no FROM (SELECT row, string_split_regex(marked, {quote(WRAPPED_BREAK)}) AS cut FROM texts))
), pieces AS (
  SELECT row, no, part, list_extract(cut, part) AS s FROM (SELECT row, no, cut, unnest(range(1, len(cut) + 1)) AS part FROM (SELECT row, no, string_split(s, chr(2)) AS cut FROM wholes))
), lines AS (
  SELECT row, no, part, line, list_extract(cut, line) AS s FROM (SELECT row, no, part, cut, unnest(range(1, len(cut) + 1)) AS line FROM (SELECT row, no, part, string_split(s, chr(10)) AS cut FROM pieces))
), normal AS (
  SELECT DISTINCT {normal("s")} AS s FROM (SELECT s FROM wholes UNION ALL SELECT s FROM pieces UNION ALL SELECT s FROM lines)
), tags AS (
  SELECT s, nullif(array_to_string(list_filter(list_transform(string_split_regex(substr(s, {len(_TAG) + 1}), ' (?:or|and|with) '), lambda x: known['{_TAG}' || trim(x)]), lambda x: x IS NOT NULL), ' '), '') AS name
  FROM normal, (SELECT {table} AS known) WHERE starts_with(s, '{_TAG}')
), known AS (
  SELECT s, name FROM (SELECT s, coalesce(known[s], CASE {slots} END) AS name FROM normal, (SELECT {table} AS known) WHERE NOT starts_with(s, '{_TAG}')) WHERE name IS NOT NULL
  UNION ALL SELECT s, name FROM tags WHERE name IS NOT NULL
), w AS (SELECT row, no, name FROM wholes x JOIN known k ON k.s = {normal("x.s")}),
p AS (SELECT row, no, part, name FROM pieces x JOIN known k ON k.s = {normal("x.s")} ANTI JOIN w USING (row, no)),
l AS (SELECT row, no, part, line, name FROM lines x JOIN known k ON k.s = {normal("x.s")} ANTI JOIN w USING (row, no) ANTI JOIN p USING (row, no, part)),
ids AS (
  SELECT row, string_agg(name, ' ' ORDER BY no, part, line) AS sentence_ids
  FROM (SELECT row, no, 0 AS part, 0 AS line, name FROM w UNION ALL SELECT row, no, part, 0, name FROM p UNION ALL SELECT * FROM l) GROUP BY row
), held AS (
  SELECT doc_id, n_sentences, sentence_ids, list_distinct(list_filter([{hold}], lambda x: x IS NOT NULL)) AS hold
  FROM (SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids FROM counted LEFT JOIN ids USING (row))
), rest AS (
  SELECT *, list_sort(list_filter(hold, lambda x: CASE x {covered} WHEN '{RESERVED}' THEN len(hold) = 1 ELSE true END)) AS rest FROM held
)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(rest, '+') AS licenses,
  array_to_string(list_sort(list_distinct(list_transform(rest, lambda x: kinds[x]))), '+') AS kinds
FROM rest, (SELECT {kind_of} AS kinds)"""
