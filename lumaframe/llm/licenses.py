"""Licence recognition: normalised sentences to known identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = "as published by the free software foundation"
_TERMS = "free software you can redistribute it and or modify it under the terms of the gnu"

# Sentences of public licence texts and notices, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    "mit-notice": ["mit license", "the mit license", "the mit license mit", "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-notice": ["isc license", "licensed under the isc license", "released under the isc license"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["bsd endorsement clause"],
    "bsd-endorse-other": ["other endorsement clause"],
    "bsd-advertise": ["advertising materials clause"],
    "bsd-2-notice": ["bsd 2 clause license", "released under the bsd 2 clause license", "licensed under the bsd 2 clause license"],
    "bsd-3-notice": ["bsd 3 clause license", "released under the bsd 3 clause license", "licensed under the bsd 3 clause license", "use of this source code is governed by a bsd style license that can be found in the license file"],
    "apache-2-notice": ["apache license version 2 0", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0", "licensed under the apache 2 0 license"],
    "apache-2-header": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"],
    "apache-2-title": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses"],
    "gpl-2-only-notice": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", f"this program is {_TERMS} general public license version 2 {_GNU}"],
    "gpl-2-later-notice": [f"this program is {_TERMS} general public license {_GNU} either version 2 of the license or at your option any later version"],
    "gpl-2-title": ["gnu general public license version 2 june 1991"],
    "gpl-3-only-notice": ["licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3", f"this program is {_TERMS} general public license {_GNU} version 3 of the license", f"this program is {_TERMS} general public license {_GNU} version 3"],
    "gpl-3-later-notice": [f"this program is {_TERMS} general public license {_GNU} either version 3 of the license or at your option any later version"],
    "gpl-3-title": ["gnu general public license version 3 29 june 2007"],
    "lgpl-21-later-notice": [f"this library is {_TERMS} lesser general public license {_GNU} either version 2 1 of the license or at your option any later version"],
    "lgpl-21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3-only-notice": ["licensed under the gnu lesser general public license version 3"],
    "lgpl-3-later-notice": [f"this library is {_TERMS} lesser general public license {_GNU} either version 3 of the license or at your option any later version", f"this program is {_TERMS} lesser general public license {_GNU} either version 3 of the license or at your option any later version"],
    "lgpl-3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl-3-only-notice": ["licensed under the gnu affero general public license version 3"],
    "agpl-3-later-notice": [f"this program is {_TERMS} affero general public license {_GNU} either version 3 of the license or at your option any later version"],
    "agpl-3-title": ["gnu affero general public license version 3 19 november 2007"],
    "mpl-2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "mpl-2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mpl-2-title": ["mozilla public license version 2 0"],
    "epl-2-notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "bsl-1-notice": ["distributed under the boost software license version 1 0"],
    "bsl-1-title": ["boost software license version 1 0 august 17th 2003"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "unlicense-use": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "wtfpl-title": ["do what the fuck you want to public license version 2 december 2004"],
    "wtfpl-copy": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "cc0-notice": ["released under cc0 1 0", "licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related rights to this work", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by-notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under cc by 4 0"],
    "cc-by-sa-notice": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-notice": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd-notice": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc-by-nc-sa-notice": ["licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "all-rights": ["all rights reserved"],
}

_PROMOTE = "be used to endorse or promote products derived from this software without (?:specific )?prior written permission$"
#: Sentences with a slot for any name, applied in order, and the known sentence that each is read as; an endorsement clause of no such form is one of its own.
SLOTS = [
    (f"^neither the names? [a-z0-9 ]+ nor the names? of (?:(?:its|their|the|any|other) )*contributors may {_PROMOTE}", "bsd endorsement clause"),
    (f"^the names? [a-z0-9 ]+ may not {_PROMOTE}", "bsd endorsement clause"),
    ("^.*endorse or promote products.*$", "other endorsement clause"),
    ("^all advertising materials mentioning features or use of this software must display the following acknowledge?ments?$", "advertising materials clause"),
]

#: In order: (licence, identifiers that follow one another in the text, others in between allowed). What a rule matches is used up for later ones.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("LicenseRef-BSD-other", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-other"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-3-notice"]),
    ("BSD-2-Clause", ["bsd-2-notice"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-header"]),
    ("Apache-2.0", ["apache-2-header"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("GPL-3.0-or-later", ["gpl-3-later-notice"]),
    ("GPL-3.0-only", ["gpl-3-only-notice"]),
    ("GPL-3.0-only", ["gpl-3-title"]),
    ("GPL-2.0-or-later", ["gpl-2-later-notice"]),
    ("GPL-2.0-only", ["gpl-2-only-notice"]),
    ("GPL-2.0-only", ["gpl-2-title"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later-notice"]),
    ("LGPL-3.0-only", ["lgpl-3-only-notice"]),
    ("LGPL-3.0-only", ["lgpl-3-title"]),
    ("LGPL-2.1-or-later", ["lgpl-21-later-notice"]),
    ("LGPL-2.1-only", ["lgpl-21-title"]),
    ("AGPL-3.0-or-later", ["agpl-3-later-notice"]),
    ("AGPL-3.0-only", ["agpl-3-only-notice"]),
    ("AGPL-3.0-only", ["agpl-3-title"]),
    ("MPL-2.0", ["mpl-2-notice", "mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("BSL-1.0", ["bsl-1-notice"]),
    ("BSL-1.0", ["bsl-1-title"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-grant", "unlicense-use"]),
    ("Unlicense", ["unlicense-grant"]),
    ("WTFPL", ["wtfpl-title", "wtfpl-copy"]),
    ("WTFPL", ["wtfpl-title"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("all-rights-reserved", ["all-rights"]),
]


def _plain(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


def spdx_names() -> dict[str, str]:
    """Normalised names of SPDX tags to licences: each licence's own, and the older ones without -only."""
    names = {licence: licence for licence, _ in RULES if licence not in ("all-rights-reserved", "LicenseRef-BSD-other")}
    names |= {licence.removesuffix("-only"): licence for licence in names.values()}
    return {_plain(n): licence for n, licence in names.items()}


def known_sentences() -> dict[str, str]:
    """Every known sentence and its identifier, tags included."""
    tags = {f"spdx license identifier {n}": f"spdx-{licence.lower()}" for n, licence in spdx_names().items()}
    return {s: i for i, sentences in SENTENCES.items() for s in sentences} | tags


def rules() -> list[tuple[str, list[str]]]:
    """RULES, and one for each licence's tag before them."""
    return [(licence, [f"spdx-{licence.lower()}"]) for licence in dict.fromkeys(spdx_names().values())] + RULES


#: Every known sentence holds one of these inside a word, so a text without any of them holds none of the sentences.
STEMS = ["licen", "permission", "distribut", "warrant", "endorse", "unencumbered", "cc0", "copyright", "reserved", "advertising materials"]
#: Replacements before a text is cut, in order, on the text between two line feeds; written for Java's and for RE2's regular expressions.
_STEPS = [
    (r"\r\n?", "\n"),
    (r"(?i)</?(?:p|br|li|ul|ol|div|h[1-6]|pre|t[dr]|table|title|body|html|head|blockquote)\b[^<>]*>", "\n\n"),  # tags of blocks
    (r"(?i)</?(?:a|b|i|em|strong|code|span|tt|font|u|small)\b[^<>@]*>", ""),  # and inside a line
    (r"&(?:quot|amp|lt|gt|nbsp|copy|#[0-9]{1,6});", " "),
    (r"\n[ \t]*(?://+|/\*+|\*+/|\*+|#+|;+|-+|<!--|%+|>+|@?(?:REM|Rem|rem)\b|dnl\b)[ \t]*", "\n"),  # comment marks before
    (r"[ \t]*(?:\*+/|-->)[ \t]*\n", "\n"),  # and behind
    (r"SPDX-License-Identifier:[^\n]*", "\n"),  # tags are taken by themselves
    (r"\(LICENSE-(?:MIT|APACHE)[^()\n]*(?:\n[^()\n]*)?\)", " "),
    (r"(?i)\bunder[ \t\n]+either[ \t\n]+of[ \t\n]+(?:the[ \t\n]+)?(Apache[ \t\n]+License,?[ \t\n]+Version[ \t\n]+2\.0),?[ \t\n]+or[ \t\n]+(?:the[ \t\n]+)?(MIT[ \t\n]+License)", "under the $1. Licensed under the $2. "),
    (r"(?i)(?:[ \t\n](?:-+|–|—)|[,;(])[ \t\n]*(see[ \t\n])", ". $1"),
    (r":[ \t]*\n", ":\n\n"),
    (r"\n[ \t]*(?:\(?[0-9]{1,2}[.)]|\([a-z]\)|•)[ \t]+", "\n\n"),  # list items
    (r"\b(Inc|Corp|Ltd|Co|Dr|Prof)\.([ \t\n]+[a-z])", "$1$2"),  # no ends of sentences
    (r"([ ,\n])v\.[ \t\n]*([0-9])", "$1v $2"),
]
_TAG = r"SPDX-License-Identifier:[ \t]*([^\n]*)"
_OPERATOR = r"[ \t()]+(?:OR|AND|WITH)[ \t()]+"
_PARAGRAPH = r"\n[ \t]*(?:\n[ \t]*)+"
_SENTENCE = r"[.!?]+[\"')\]]*[ \t]+"


def _identified(sentences: Column) -> Column:
    """The identifiers of the known ones among raw sentences."""
    known = known_sentences()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def read(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for pattern, sentence in SLOTS:
            plain = F.regexp_replace(plain, pattern, sentence)
        return plain

    plain = F.transform(sentences, read)
    return F.transform(F.filter(plain, lambda s: s.isin(*known)), lambda s: F.element_at(table, s))


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order; those of SPDX tags come last.

    Comment marks are taken off, blank lines, colons at a line's end and list
    items end a paragraph, and the lines of a paragraph are joined before it is
    cut into sentences; a line of a paragraph may also hold sentences by itself.
    """
    cleaned = F.concat(F.lit("\n"), text, F.lit("\n"))
    for pattern, replacement in _STEPS:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)

    def paragraph(p: Column) -> Column:
        joined = _identified(F.split(F.regexp_replace(p, "\n", " "), _SENTENCE))
        alone = _identified(F.flatten(F.transform(F.split(p, "\n"), lambda line: F.split(line, _SENTENCE))))
        once = F.get(F.transform(F.array(joined), lambda j: F.concat(j, F.array_except(alone, j))), F.lit(0))
        return F.when(p.contains("\n"), once).otherwise(joined)

    tags = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)), lambda tag: F.split(tag, _OPERATOR)))
    tags = F.transform(tags, lambda t: F.concat(F.lit("SPDX-License-Identifier "), F.regexp_replace(t, r"\+", "-or-later")))
    return F.concat(F.flatten(F.transform(F.split(cleaned, _PARAGRAPH), paragraph)), _identified(tags))


def matched_licenses(ids: Column) -> Column:
    """The licences of the rules that match an array of identifiers, in rule order; each match uses up its identifiers."""
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.array(*map(F.lit, wanted)).alias("wanted")) for licence, wanted in rules()])

    def places(left: Column, wanted: Column) -> Column:
        """Where the wanted ones stand, each the first after the one before it; null where one is missing."""

        def step(at: Column, name: Column) -> Column:
            last = F.coalesce(F.array_max(at), F.lit(0))
            found = F.array_position(F.slice(left, last + 1, F.greatest(F.size(left) - last, F.lit(0))), name).cast("int")
            return F.when(found > 0, F.array_append(at, last + found))

        return F.aggregate(wanted, F.array().cast("array<int>"), step)

    def rule(acc: Column, r: Column) -> Column:
        def used(at: Column) -> Column:
            left = F.filter(acc["left"], lambda _, i: ~F.array_contains(at, i + 1))
            return F.when(at.isNull(), acc).otherwise(F.struct(left.alias("left"), F.array_append(acc["found"], r["licence"]).alias("found")))

        return F.get(F.transform(F.array(places(acc["left"], r["wanted"])), used), F.lit(0))

    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(table, start, rule, lambda acc: acc["found"]))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_sentences (known ones), sentence_ids and licenses (joined by a space, in rule order) of each text.

    A text may have several licences, also of one family; a rule hides a later
    one only by using up the sentences that it would need. A text with the
    three conditions of a BSD licence and an endorsement clause of no known
    form is LicenseRef-BSD-other, not the two-clause licence. A null text has
    none. Null or repeated ids and repeated rows are kept; other columns are
    ignored. The sentence table and the rules are literals of fixed size; there
    is no shuffle.
    """
    none = F.array().cast("array<string>")
    text = F.col(text_col).cast("string")
    ids = F.when(F.lower(text).rlike("|".join(STEMS)), sentence_ids(text)).otherwise(none)
    found = docs.select(F.col(id_col), F.explode(F.array(F.coalesce(ids, none))).alias("_ids"))  # generated, so computed once
    return found.select(id_col, F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", " ").alias("sentence_ids"), F.array_join(matched_licenses(F.col("_ids")), " ").alias("licenses"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(id_col: str = "doc_id", text_col: str = "text", table: str = "documents") -> str:
    """The same in DuckDB's SQL: paragraphs and sentences as rows, and a chain of steps on lists for the rules."""
    cleaned = f"chr(10) || {text_col} || chr(10)"
    for pattern, replacement in _STEPS:
        made = _quoted(replacement.replace("$", "\\")).replace("\n", "' || chr(10) || '")
        cleaned = f"regexp_replace({cleaned}, {_quoted(pattern)}, {made}, 'g')"
    plain = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, sentence in SLOTS:
        plain = f"regexp_replace({plain}, {_quoted(pattern)}, {_quoted(sentence)})"
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in known_sentences().items())
    chain, last = [], "every"
    for n, (licence, wanted) in enumerate(rules()):
        at = [f"list_position(l, {_quoted(wanted[0])})"]
        for name in wanted[1:]:
            at.append(f"{at[-1]} + list_position(l[{at[-1]} + 1:], {_quoted(name)})")
        hit = " AND ".join(f"coalesce({a}, 0) > 0" for a in at[:1]) + "".join(f" AND coalesce(list_position(l[{b} + 1:], {_quoted(name)}), 0) > 0" for b, name in zip(at, wanted[1:]))
        keep = f"list_filter(l, lambda x, i: i NOT IN ({', '.join(at)}))"
        chain.append(f"r{n} AS MATERIALIZED (SELECT d, n, ids, CASE WHEN {hit} THEN {keep} ELSE l END AS l, CASE WHEN {hit} THEN list_append(f, {_quoted(licence)}) ELSE f END AS f FROM {last})")
        last = f"r{n}"
    return f"""
        WITH known(s, i) AS (VALUES {known}),
        rows AS (SELECT row_number() OVER () AS d, {id_col}, {text_col} FROM {table}),
        pars AS (SELECT d, unnest(p) AS p, unnest(range(len(p))) AS np FROM (SELECT d, regexp_split_to_array({cleaned}, {_quoted(_PARAGRAPH)}) AS p FROM rows WHERE {text_col} IS NOT NULL)),
        joined AS (SELECT d, np, 0 AS how, unnest(s) AS s, unnest(range(len(s))) AS ns FROM (SELECT d, np, regexp_split_to_array(replace(p, chr(10), ' '), {_quoted(_SENTENCE)}) AS s FROM pars)),
        alone AS (SELECT d, np, 1 AS how, unnest(s) AS s, nl * 1000000 + unnest(range(len(s))) AS ns FROM (SELECT d, np, nl, regexp_split_to_array(q, {_quoted(_SENTENCE)}) AS s FROM (SELECT d, np, unnest(string_split(p, chr(10))) AS q, unnest(range(len(string_split(p, chr(10))))) AS nl FROM pars WHERE contains(p, chr(10))))),
        tags AS (SELECT d, 1000000000000 AS np, 0 AS how, 'spdx license identifier ' || replace(t, '+', '-or-later') AS s, nt * 1000000 + k AS ns FROM
            (SELECT d, nt, unnest(t) AS t, unnest(range(len(t))) AS k FROM (SELECT d, nt, regexp_split_to_array(g, {_quoted(_OPERATOR)}) AS t FROM
            (SELECT d, unnest(g) AS g, unnest(range(len(g))) AS nt FROM (SELECT d, regexp_extract_all({text_col}, {_quoted(_TAG)}, 1) AS g FROM rows WHERE {text_col} IS NOT NULL))))),
        hits AS (SELECT d, np, how, ns, i FROM (SELECT d, np, how, ns, {plain} AS s FROM (SELECT * FROM joined UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM tags)) JOIN known USING (s)),
        first AS (SELECT d, np, how, i, min(ns) AS ns FROM hits h WHERE how = 1 AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.how = 0 AND o.d = h.d AND o.np = h.np AND o.i = h.i) GROUP BY ALL),
        counted AS (SELECT d, count(*) AS n, list(i ORDER BY np, how, ns) AS l FROM (SELECT d, np, how, ns, i FROM hits WHERE how = 0 UNION ALL SELECT d, np, how, ns, i FROM first) GROUP BY d),
        every AS (SELECT d, n, array_to_string(l, ' ') AS ids, l, []::VARCHAR[] AS f FROM counted),
        {", ".join(chain)},
        done AS (SELECT d, n, ids, (SELECT coalesce(string_agg(x, ' ' ORDER BY k), '') FROM (SELECT x, min(k) AS k FROM (SELECT unnest(f) AS x, unnest(range(len(f))) AS k) GROUP BY x)) AS licenses FROM {last})
        SELECT {id_col}, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM rows LEFT JOIN done USING (d)"""
