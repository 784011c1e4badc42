"""Quality rules, token counts, licences, HTML and quotes."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumaframe.llm.html_text import extract_text, keeps, labelled_table, main_text, text_blocks, trained_tree
from lumaframe.llm.quality_rules import FEATURES, fit_rules, judge_quality, learn_rules, _covers
from lumaframe.llm.quotes import link_quotes
from lumaframe.llm.token_counts import count_tokens, token_counts
from lumaframe.llm.transducer import ChunkMap, Machine, Transducer, scan

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "é# *|", "a\n\n a\na\n"] + [" ".join(rng.choice("ab") + rng.choice(["", "\n", "!", "$"]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["w x y z " * 30_000]
    rows = judge_quality(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string"), []).collect()
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == brute_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)


def test_learned_list_on_held_out_rows():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 2] > 0.6) & (x[:, 3] < 0.3))
    rules = learn_rules(x[:2000], bad[:2000])
    found = np.any([_covers(r, x[2000:]) for r in rules], axis=0)
    assert (found == bad[2000:]).mean() > 0.97


def test_quality_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = judge_quality(docs, fit_rules(docs, learn)).join(held, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in judged) > 0.97 * len(judged)
    assert fit_rules(docs, labels.where("false")) == []


def test_token_counts(spark):
    library, counts = Tokenizer.from_file(PATH), Machine(Transducer(PATH))
    rng = random.Random(1)
    parts = ["a", "B", "é", "é", "'s", "'re", "1", "２", " ", "\n", "\x1c", "\x85", "　", "Σ", "İ", "J̌", "中文", "😀", "<|endoftext|>", "##", "...", ".", ",", "ing", "\x00", "한", "하"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [count_tokens(t, counts, chunk_chars=rng.choice([1, 2, 5, 99])) for t in texts] == want
    long = ["x" * 100_000, "The end. " * 20_000, "don't" * 40_000, "".join(rng.choice(parts) for _ in range(150_000)), ("é" * 70_000 + "<|endoftext|>") * 3]
    texts += [None, "", *long]
    want += [0, 0, *(len(library.encode(t, add_special_tokens=False).ids) for t in long)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in token_counts(frame, PATH).collect()}
    assert [rows[i].n_tokens for i in range(len(texts))] == want
    assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for i, r in rows.items())


MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful."""
MPL = """<!-- This Source Code Form is subject to the terms of the Mozilla Public
   - License, v. 2.0. If a copy of the MPL was not distributed with this
   - file, You can obtain one at http://mozilla.org/MPL/2.0/. -->"""
LICENSED = [
    (None, ""),
    ("", ""),
    ("this license is nothing", ""),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("x y.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.", "Apache-2.0 all-rights-reserved"),
    ("prose that does not end\nReleased under the MIT License.\nmore prose", "MIT"),
    (MIT, "MIT"),
    (MIT.replace("\n", "\r\n"), "MIT"),
    ("\n".join("// " + x for x in MIT.split("\n")), "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD + ENDORSE, "BSD-3-Clause"),
    (BSD + ENDORSE + "\n\n" + BSD, "BSD-3-Clause BSD-2-Clause"),
    (ISC, "ISC"),
    (APACHE, "Apache-2.0"),
    (GPL.format(3), "GPL-3.0-or-later"),
    (GPL.format(3) + "\n\n" + GPL.format(2), "GPL-3.0-or-later GPL-2.0-or-later"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright", "GPL-3.0-only"),
    (MPL, "MPL-2.0"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause */", "BSD-3-Clause GPL-2.0-only"),
    ("SPDX-License-Identifier: GPL-3.0+", "GPL-3.0-or-later"),
    ("To be free. Licensed under CC BY 4.0.\nReleased under CC0 1.0.", "CC0-1.0 CC-BY-4.0"),
    ("word " * 50_000 + "\n" + "Licensed under CC BY-SA 4.0. " + "x" * 100_000, "CC-BY-SA-4.0"),
]


def test_state_maps_compose_at_every_cut():
    library, machine = Tokenizer.from_file(PATH), Machine(Transducer(PATH))
    rng = random.Random(3)
    for text in ["I'll don't we've they're 'sam !'s it''s a1b2 x'r 'v 'l ll'l '", "ABC'dEF'Ré!=''m'mm<|endoftext|>'s", "supercalifragilistic-expialidocious!!! 12,345.67"]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        for at in range(len(text) + 1):
            if "<|" in text and text.index("<|") < at < text.index("|>") + 2:
                continue
            maps = [machine.map_of(text[:at]), machine.map_of(text[at:])]
            assert scan(maps, machine).total(machine) == want, (text, at)
        for _ in range(40):  # any grouping gives the same map
            pieces = machine.cut(text, rng.randint(1, 6))
            a, b, c = (scan([machine.map_of(p) for p in some], machine) for some in (pieces[: len(pieces) // 3], pieces[len(pieces) // 3 : len(pieces) // 2], pieces[len(pieces) // 2 :]))
            left, right = a.then(b, machine).then(c, machine), a.then(b.then(c, machine), machine)
            assert left.total(machine) == right.total(machine) == want
            assert left.apply(("L", *machine.run(("", (), 0), "ab")[0][1:]), machine) == right.apply(("L", *machine.run(("", (), 0), "ab")[0][1:]), machine)
    assert ChunkMap("").total(machine) == 0


def test_token_counts_odd_rows(spark):
    rows = [(None, "a b"), (3, "a b"), (3, None), (3, "a b"), (4, "y " * 70_000), (4, "y " * 70_000)]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 2), (3, 0), (3, 2), (3, 2), (4, 70_000), (4, 70_000)]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
PROMOTE = "used to endorse or promote products derived from this software without specific prior written permission."
NOTICE = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
HEADER = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
LICENSED += [
    (CONDITIONS + "3. Neither the name of Google Inc. nor the names of its contributors may be " + PROMOTE, "BSD-3-Clause"),
    (CONDITIONS + "3. Neither the name of the University nor the names of its\n   contributors may be " + PROMOTE, "BSD-3-Clause"),
    (CONDITIONS + "3. The name of the author may not be " + PROMOTE, "BSD-3-Clause"),
    (CONDITIONS + "3. No one may endorse or promote products by this software on Sundays.", "LicenseRef-BSD-other"),
    (CONDITIONS + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software.\n4. Neither the name of X nor the names of its contributors may be " + PROMOTE, "BSD-4-Clause"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement: none", ""),
    ("\n".join(f"dnl {x}" for x in NOTICE.split("\n")), "GPL-2.0-or-later"),
    ("\n".join(f"REM {x}" for x in HEADER.split("\n")), "Apache-2.0"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("This project is licensed under the MIT License (see the LICENSE file).", "MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT Apache-2.0"),
    ("Licensed under either of\n\n * Apache License, Version 2.0 (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license (LICENSE-MIT or http://opensource.org/licenses/MIT)\n\nat your option.", "MIT Apache-2.0"),
    ("<html><body><h1>Notice</h1><p>" + NOTICE + "</p></body></html>", "GPL-2.0-or-later"),
    ("<p>" + CONDITIONS.replace("\n\n", "</p><ol>").replace("1. ", "<li>").replace("2. ", "</li><li>") + "</li></ol>", "BSD-2-Clause"),
]


def test_licenses(spark):
    import duckdb

    from lumaframe.llm import licenses

    assert all(any(stem in s for stem in licenses.STEMS) for s in licenses.known_sentences())
    frame = spark.createDataFrame([(i, t, "c") for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string, licenses string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert {i: rows[i].licenses for i in rows} == {i: x for i, (_, x) in enumerate(LICENSED)}
    assert rows[6].sentence_ids.split() == ["mit-notice", "mit-grant", "mit-condition", "as-is"] and rows[6].n_sentences == 4
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(LICENSED)])
    found = con.execute(f"SELECT doc_id, n_sentences, sentence_ids, licenses FROM ({licenses.oracle()})").fetchall()
    assert sorted(found) == sorted(tuple(r) for r in rows.values())
    odd = [(None, "Licensed under CC BY 4.0."), (3, None), (3, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0.")]
    out = licenses.scan_licenses(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in out) == [(0, "CC-BY-4.0"), (3, ""), (3, "CC-BY-4.0"), (3, "CC-BY-4.0")]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_html(spark):
    x, y = labelled_table()
    assert np.mean([keeps(trained_tree(), tuple(r)) == v for r, v in zip(x, y, strict=True)]) > 0.99
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="no-sidebar">
    <nav><ul><li><a href="/x">One</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it now, it is cheap and good.</div>
    <article><h1>A &amp; B</h1><p><b>First&nbsp; par<br>goes   on &lt;here&gt;.<br><p>Two.</p><div id="cookie-notice">We use cookies</div><form><label>Mail</label><button>Go</button></form>
    <aside>Aside</aside><p>Three <a href="l">link</a> words of more text.</p><section class="comments"><p>Nice post, I liked it very much indeed.</p></section></article>
    <footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "A & B\nFirst par goes on <here>.\nTwo.\nThree link words of more text."
    rows = [(1, "u", page, "c"), (1, "u", page, "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<p" * 50_000, "c"), (4, "z", "<article>" + "<p>word " * 30_000, "c")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out) and [r.text for r in out if r.page_id == 2] == [""]
    assert text_blocks("a<p>b</p>c")[1][0] == "b"


def test_html_wrappers_links_and_unclosed_elements():
    words = "plain words of a long paragraph that goes on for a while"
    par, link = f"<p>{words}</p>", '<a href="l">link words here</a>'
    comments = f'<ol class="comments"><li><article class="comment">{par}</article></li></ol>'
    for wrapper in ("<div class='layout has-sidebar'>", "<div id='with-header'><div class='sidebar-left'>"):
        assert main_text(f"{wrapper}<nav>x</nav><article>{par}</article>{comments}<aside>z</aside></div>") == words
        assert main_text(f"{wrapper}<main class='search'>{par}</main>{comments}<aside>z</aside></div>") == words
    teaser = f'<div class="related"><article>{par}</article></div>'
    assert main_text(f"<article>{par}</article>{teaser}") == words
    for silent in ("select", "svg", "object", "video", "noscript"):
        assert main_text(f"<body><div><{silent}><i>gone</div>{par}</body>") == words
        assert main_text(f"<article><{silent}><div>no</div><p>no</{silent}>{par}</article>") == words
    assert main_text("<article><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> holds.</p></article>") == "Here x=2 holds."
    pars, want = f"<p>{words} {link} {words}.</p><p>{link} {words} {words}.</p>", f"{words} link words here {words}.\nlink words here {words} {words}."
    menu = "".join(f'<li><a href="{x}">{x}</a></li>' for x in ("Home", "News", "About us"))
    assert main_text(f"<body><ul>{menu}</ul><h2>T</h2>{pars}<div>{link}</div></body>") == f"T\n{want}"
    assert main_text(f"<article><ul>{menu}</ul>{pars}</article>") == want


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a list?"),
        (1, 1, "assistant", "Use sorted.\n\nOr sort in place."),
        (1, 2, "user", "> Hello there.\n> How do I\n> sort a list?\nMe too!"),
        (1, 3, "user", ">> How do I sort a list?\n> Use   SORTED\nThanks."),
        (1, 4, "assistant", "Welcome."),
        (1, 4, "assistant", "Welcome."),
        (2, 7, "user", None),
        (2, 9, None, "> nothing said\nok"),
        (None, 1, "user", "> lost"),
        (3, None, "user", "lost"),
    ]
    rows += [(5, i, "user", f"m {i}") for i in range(0, 5000, 5)]
    out = link_quotes(spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, message string")).collect()
    one = {r.turn: r for r in out if r.conv_id == 1}
    assert len([r for r in out if r.conv_id == 1]) == 5
    assert {t: (r.parent_turn, r.thread_turn, r.thread_place, r.place) for t, r in one.items()} == {0: (None, 0, 0, 0), 1: (0, 0, 0, 1), 2: (0, 2, 1, 0), 3: (1, 3, 2, 0), 4: (3, 3, 2, 1)}
    assert one[2].message == "Me too!" and one[3].message == "Thanks." and one[3].quote_depth == 2
    two = {r.turn: r for r in out if r.conv_id == 2}
    assert two[7].message == "" and two[9].parent_turn == 7 and two[9].message == "ok"
    assert sorted(r.place for r in out if r.conv_id == 5) == list(range(1000)) and len([r for r in out if r.place is None]) == 2
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quoted_mail(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nAt noon."),
        (1, 1, "user", "Yes.\nOn Mon, 3 Mar 2025, Ann Other\nwrote:\n\n> Shall we meet?\n> At noon."),
        (1, 2, "user", "No.\n\n-----Original Message-----\nFrom: Ann\nSubject: meeting\n\nShall we meet?\nAt noon."),
        (1, 3, "user", "Bob wrote:\n> Yes.\n> Ann wrote:\n>> At noon.\nFine."),
        (1, 4, "user", "He said:\nnothing\n>5"),
    ]
    out = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[t].message for t in range(5)] == ["Shall we meet?\nAt noon.", "Yes.", "No.", "Fine.", "He said:\nnothing"]
    assert [out[t].parent_turn for t in range(4)] == [None, 0, 0, 1] and out[3].quote_depth == 2
    assert [tuple(q) for q in out[3].quoted] == [(1, 1), (2, 0)]
