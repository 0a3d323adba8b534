import re

import pytest

from provlake.llm import html_text, licenses, toxicity


def page(body):
    return f"<!DOCTYPE html><html><head><title>No</title><script>var x='</p>';</script></head><body>{body}</body></html>"


LONG = "This is a sentence of the article with enough words to weigh. " * 6


@pytest.mark.parametrize(
    "body, want",
    [
        ("", ""),
        ("<article><h1>Title</h1><p>One  &amp;\n two&nbsp;three.</p><p>Four <b>bold</b> <a href='/'>link</a>.</p></article>", "Title\n\nOne & two three.\n\nFour bold link."),
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Short.</article><aside>Side</aside><footer>&copy; me</footer>", f"T\n\n{LONG.strip()}\n\nShort."),
        (f'<header>Site</header><div class="content"><p>{LONG}</p><p>Two.</p></div><div id="comments"><p>{LONG} by a reader</p></div>', f"{LONG.strip()}\n\nTwo."),
        (f'<div class="cookie-notice">We use cookies {LONG}</div><main><p>{LONG}</p></main><form><p>Mail</p></form>', LONG.strip()),
        ("<article><header><h1>Head</h1></header><p>Text<br>after</p><script>no()</script><style>p{}</style><!-- no --></article>", "Head\n\nText after"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x  y</pre></article>", "one\n\ntwo\n\na\n\nb\n\nx y"),
        ('<article><p title="a>b">quoted</p><p hidden>no</p><p style="display: none">no</p></article>', "quoted"),
        ("<article><p>&lt;tag&gt; &#233; &unknown; &amp;amp;</p></article>", "<tag> é &unknown; &amp;"),
        (f"<article><p>{LONG}</p><div class='ad'>Buy</div><p>End", f"{LONG.strip()}\n\nEnd"),
    ],
)
def test_main_text(body, want):
    assert html_text.extract(page(body)) == want


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("plain text") == "plain text"
    deep = "<div>" * 30_000 + "core" + "</div>" * 30_000
    assert html_text.extract(deep) == "core"
    assert html_text.extract("<p>a<p>b</p></p></div><b>c") == "a\n\nb\n\nc"
    assert html_text.extract("<article><p>x &lt; y <b") == "x < y"


@pytest.mark.parametrize(
    "body",
    [f"<div class='{c}'><h1>Title</h1><p>{LONG}</p></div>" for c in ("post no-sidebar", "entry with-sidebar", "content ad-free", "share-story", "search-results", "notice-board", "post has-sidebar", "story comments-open")]
    + [
        f"<section class='post has-sidebar'><h1>Title</h1><p>{LONG}</p></section>",
        f"<main><header><h1>Title</h1></header><p>{LONG}</p></main>",
        f"<div class='post'><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></div>",
        f"<div class='post'><header><h1>Title</h1></header><p>{LONG}</p><p>{LONG}</p></div>".replace(f"<p>{LONG}</p></div>", "</div>"),
        f"<form><main><h1>Title</h1><p>{LONG}</p></main></form>",
        f"<div class='share'><main><h1>Title</h1><p>{LONG}</p></main></div>",
        f"<header><h1>My Site</h1><nav>x</nav></header><article><h1>Title</h1><p title='the hidden cost' data-x='aria-hidden=true'>{LONG}</p></article>",
        f"<article><h1 class='banner'>Title</h1><p class=hidden-gem>{LONG}</p><p class='a' hidden>no</p><div hidden=''>no</div><div class='x' aria-hidden=\"true\">no</div></article>",
        f"<article><h1>Title</h1><p data-note=don't>{LONG}</p></article>",
    ],
)
def test_articles_stay_whole(body):
    assert html_text.extract(page(body)) == f"Title\n\n{LONG.strip()}"


@pytest.mark.parametrize("gone", ["<div class='ads'>{}</div>", "<div id=comments><article><p>{}</p></article></div>", "<ol class='comment-list'><li>{}</ol>", "<div class='sidebar left'><p>{}</div>", "<div class='sidebar-left'>{}</div>", "<div role=navigation>{}</div>", "<dialog open>{}</dialog>", "<footer><h2>More</h2>{}</footer>", "<div style='color:red; DISPLAY : none'>{}</div>", "<span class='ad'>{}</span>", "<SCRIPT>İİİİ</p>{}</Script >"])
def test_what_is_no_article_goes(gone):
    body = f"<article><h1>Title</h1><p>{LONG}</p>{gone.format('Words of another kind.')}<p>{LONG}</p></article>"
    assert html_text.extract(page(body)) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"
    assert html_text.extract(page(f"<h1>Title</h1><p>{LONG}</p>{gone.format('Words of another kind.')}")) == f"Title\n\n{LONG.strip()}"


def test_time_grows_with_length_only():
    import time

    def took(body):
        began = time.perf_counter()
        got = html_text.extract(body)
        return time.perf_counter() - began, got

    n = 200_000
    for body in ("<b>" * n + "core" + "</i>" * n, "<div>" * n + "core" + "</div>" * n, "<p><a href=x>" * n + "core", "<li><table><b>" * n + "core", "core" + "<p class='" * n, "<div " + "a" * 2 * n + ">core", "core" + "<" * n, "<ul><li>" * n + "core" + "</dt></li>" * n):
        seconds, got = took(body)
        assert seconds < 20 and "core" in got


def brute_main_text(root):
    """The definition, by recursion over an element tree without inline markup or noise; root: what holds the page."""
    import math

    parts = {e: [x for x in [e.text, *[y for c in e for y in (c, c.tail)]] if x is not None] for e in root.iter()}

    def total(e, of):
        return of(e) + sum(total(c, of) for c in e)

    def own(e):
        return sum(len(" ".join(x.split())) for x in parts[e] if isinstance(x, str))

    def linked(e):
        return total(e, own) if e.tag == "a" else sum(linked(c) for c in e)

    def density(e):
        c, t = total(e, own), max(1, sum(1 for _ in e.iter()) - 1)
        lc, lt = linked(e), max(1, sum(x.tag == "a" for x in e.iter()) - (e.tag == "a"))
        if not c:
            return 0.0
        ratio = linked(root) / max(1, total(root, own))
        if not ratio:
            return c / t
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e))

    def sums(e):
        return sum(map(density, e)) if len(e) else density(e)

    best = max(root.iter(), key=sums)  # the first, that is the outermost, on ties
    up = {c: e for e in root.iter() for c in e}
    path, e = [best], best
    while e in up:
        e = up[e]
        path.append(e)
    least = min(density(e) for e in path[:-1]) if len(path) > 1 else density(best)
    chosen = {max(e.iter(), key=sums) for e in root.iter() if density(e) >= least and density(e) > 0}
    blocks, held = [], []

    def flush():
        blocks.append(" ".join("".join(held).split()))
        held.clear()

    def walk(e, inside):
        inside = inside or e in chosen
        block = e.tag in html_text.BLOCK or e in chosen
        flush() if block else None
        for x in parts[e]:
            if not isinstance(x, str):
                walk(x, inside)
            elif inside:
                held.append(x)
        flush() if block else None

    walk(root, False)
    flush()
    return "\n\n".join(b for b in blocks if b)


def test_against_brute_force():
    import random
    from xml.etree import ElementTree

    rnd = random.Random(5)

    def node(depth):
        tag = rnd.choice(["div", "div", "section", "a", "p"]) if depth else "body"
        words = lambda: " ".join(rnd.choice(["one", "three", "seventeen", "x"]) for _ in range(rnd.choice([0, 0, 1, 4, 30])))
        if tag in ("p", "a") or depth > 4:
            return f"<{tag}>{words()}</{tag}>"
        return f"<{tag}>{words()}{''.join(node(depth + 1) + rnd.choice(['', ' ', words()]) for _ in range(rnd.randint(0, 4)))}</{tag}>"

    for _ in range(300):
        source = node(0)
        assert html_text.extract(source) == brute_main_text(ElementTree.fromstring(f"<root>{source}</root>")), source


def test_pages_of_the_test_tables():
    """The generated pages: the blocks of the article element, and nothing else."""
    import html
    import os
    import re

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    for source in pq.read_table(path, columns=["html"])["html"].to_pylist():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source or "", re.S)
        parts = re.split(r"</?(?:h1|p)>", body[1]) if body else []
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in parts]
        assert html_text.extract(source) == "\n\n".join(b for b in blocks if b)


def test_links_lower_density():
    tree = html_text.parse(page("<div><a href=/>menu words here</a> <a href=/>and here</a></div><div>plain words that stand here</div>"))
    density, _ = html_text.densities(tree)
    a, b = (k for k, t in enumerate(tree.tag) if t == "div")
    assert density[a] < density[b]


@pytest.mark.parametrize("text", ["you idiot", "You IDIOT!!", "1d10t", "ⅰdiot", "іdіоt", "id​iot", "ídiot".replace("́", "­"), "ＩＤＩＯＴ", "$tupid", "c1own", "m0r0n$ and l0ser"])
def test_folding_finds(text):
    found = toxicity._automaton(tuple((f" {w} ", 2.5) for w in toxicity.INSULTS), tuple(toxicity.EXCEPTIONS))
    assert toxicity.features(text, found)[0] > 0


@pytest.mark.parametrize("text", ["", "the trash can is full", "a clown fish", "idiotic-free", "trashed", "version 1.0 of 2024", "the&&& of###", "moronic"])
def test_folding_leaves_alone(text):
    found = toxicity._automaton(tuple((f" {w} ", 2.5) for w in toxicity.INSULTS), tuple(toxicity.EXCEPTIONS))
    assert toxicity.features(text, found)[0] == 0


def brute_features(text, terms, exceptions):
    """Hits by trying every place, and an exception by every span."""
    folded = toxicity.fold(text or "")
    forms = {(f, w) for t, w in terms for f in ({t, t.replace("l", "i")} if t[0] == t[-1] == " " else {t})}
    find = lambda x: [k for k in range(len(folded)) if folded.startswith(x, k)]
    spans = [(k, k + len(p) + 2) for p in exceptions for k in find(f" {p} ")]
    hits = [(k, k + len(f), w) for f, w in forms for k in find(f)]
    return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in spans)), len(folded.split())


def test_features_against_brute_force():
    import random

    rnd = random.Random(3)
    terms = tuple((f" {w} ", 2.5) for w in toxicity.INSULTS) + (("ras", 1.5), (" cl", 0.25), ("tup", 1.0))
    found = toxicity._automaton(terms, tuple(toxicity.EXCEPTIONS))
    words = ["trash", "can", "bag", "clown", "fish", "sore", "loser", "l0ser", "stupid", "question", "no", "idiot", "proof", "calm", "and", "іdіot", "class", "worthless", "check"]
    for _ in range(500):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))
        assert toxicity.features(text, found) == pytest.approx(brute_features(text, terms, toxicity.EXCEPTIONS)), text


def test_many_hits_in_linear_time():
    import time

    found = toxicity._automaton(tuple((f" {w} ", 2.5) for w in toxicity.INSULTS), tuple(toxicity.EXCEPTIONS))
    began = time.perf_counter()
    total, words = toxicity.features("trash can and then idiot " * 200_000, found)
    assert (total, words) == (2.5 * 200_000, 1_000_000) and time.perf_counter() - began < 20


@pytest.mark.parametrize("name, caught, clean", [("sf0.1", 0.9, 0.99), ("sf0.01", 0.6, 0.95)])
def test_held_out_rows_of_the_test_tables(spark, name, caught, clean):
    """Held-out accuracy. Of the toxic rows of sf0.1 that are missed, all but one hold no word that others share; sf0.01
    has 35 toxic rows to learn from and 6 held out."""
    import os

    if not os.path.isdir(f"/root/testdata/{name}"):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"/root/testdata/{name}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= caught * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= clean * (n[0, 0] + n.get((0, 1), 0))


def test_no_candidate_is_cut():
    """Terms are chosen by their own counts alone: more candidates beside them change nothing."""
    pos = {f"term{k:05d}x": (40, 60.0) for k in range(30_000)}
    few = {g: pos[g] for g in list(pos)[:5]}
    many = toxicity.chosen_terms(pos, {}, (10_000, 100_000))
    assert len(many) == 30_000 and all(many[g] == w for g, w in toxicity.chosen_terms(few, {}, (10_000, 100_000)).items())


def test_learns_planted_terms(spark):
    import random

    rnd = random.Random(1)
    clean = ["river stone cloud meadow window garden yellow quiet letter paper".split()[rnd.randrange(10)] for _ in range(20000)]
    rows = []
    for k in range(800):
        words = [rnd.choice(clean) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randint(20, 200))]
        toxic = int(k % 6 == 0)
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rnd.randrange(len(words)), "zorblag" + rnd.choice(["", "x", "ü"]))
        rows.append((k, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(r["predicted"] == r["toxic"] for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_rescoring_is_the_same_and_ignores_held_out_labels(spark):
    df = spark.createDataFrame([(k, "you idiot" if k % 4 == 0 else "a calm day", int(k % 4 == 0)) for k in range(60)], "doc_id long, text string, toxic int")
    flipped = df.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.learn(df, y) for y in (df, flipped))
    assert a == b


@pytest.mark.parametrize(
    "text, names, unknown",
    [
        ("Some words.\nReleased under the MIT License.", ["MIT"], 0),
        ("x\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 0),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], 0),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], 0),
        ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n", ["Apache-2.0"], 0),
        ("Copyright (c) 2020 A. Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including.\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.", ["MIT"], 0),
        ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-CLAUSE"], 0),
        ("This is licensed under the Frob terms.", [], 1),
        ("Released under the MIT License. Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"], 0),
        ("He has a driving licence.", [], 0),
        (None, [], 0),
        ("", [], 0),
    ],
)
def test_licenses(text, names, unknown):
    got = licenses.recognise(text)
    assert (got[0], got[2]) == (names, unknown)


def test_rules_are_ordered_and_known():
    known = {name for name, _ in licenses.SENTENCES}
    assert all(set(wanted) <= known for _, wanted in licenses.RULES)
    for k, (_, earlier) in enumerate(licenses.RULES):  # no rule hides a longer one after it
        assert not any(later[: len(earlier)] == earlier for _, later in licenses.RULES[k + 1 :])


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2").replace("program.  If not, see <https://www.gnu.org/licenses/>.", "program; if not, write to the Free Software\n    Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
LGPL = GPL2.replace("This program", "This library").replace("this program", "this library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
AGPL = GPL.replace("GNU General", "GNU Affero General")
MIT = """Copyright (c) 2020 A. Body

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
WRAPPED = {"GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "MIT": MIT, "BSD-3-Clause": BSD}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "; "])
@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_licenses(name, mark):
    text = "\n".join((mark + line).rstrip() for line in WRAPPED[name].splitlines())
    got = licenses.recognise(f"int main;\n{text}\n")
    assert (got[0], got[2]) == ([name], 0), got


TEXTS = {
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
""",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


@pytest.mark.parametrize("name", TEXTS)
def test_published_texts(name):
    assert licenses.recognise("Some words.\n\n" + TEXTS[name] + "\nMore words.")[::2] == ([name], 0)


@pytest.mark.parametrize(
    "text, names, unknown",
    [
        ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"], 0),
        ("Licensed under the GPL v3.", ["GPL-3.0"], 0),
        ("GPL v3", ["GPL-3.0"], 0),
        ("Licensed under GPLv2 or later.", ["GPL-2.0-or-later"], 0),
        ("Licensed under the EPL 1.0.", ["EPL-1.0"], 0),
        ("Licensed under either MIT or Apache-2.0, at your option.", ["MIT OR Apache-2.0"], 0),
        ("Dual licensed under the MIT license and the GNU GPL version 2 or later.", ["MIT AND GPL-2.0-or-later"], 0),
        ("License: MIT", ["MIT"], 0),
        ("The code is MIT licensed", ["MIT"], 0),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"], 0),
        ("Released under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"], 0),
        ("Licensed under the Foo License\nReleased under the MIT License", ["MIT"], 1),
        ("Apache License\nVersion 2.0, January 2004\n\nYou must give any other recipients a copy of this License.\n\nEND OF TERMS AND CONDITIONS\n", ["Apache-2.0"], 0),
        ("Apache License\nVersion 2.0, January 2004\n\nYou must give any other recipients a copy of this License.\n", ["Apache-2.0"], 1),
        ("Copyright 2020 A. All rights reserved.", [], 0),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\nint main;", ["MIT OR APACHE-2.0"], 0),
        ("The warranty on the car expired.", [], 0),
    ],
)
def test_notices(text, names, unknown):
    assert licenses.recognise(text)[::2] == (names, unknown)


def test_long_license_texts_in_linear_time():
    import time

    began = time.perf_counter()
    for part in ("licensed under the mit license. ", "this is free software you can\n", "license software under ", "Copyright 2020 A;\n"):
        licenses.recognise(part * 30_000)
    assert time.perf_counter() - began < 60


def test_foreign_sentences_within_a_license():
    parts = MIT.split("\n\n")
    for k in range(1, len(parts)):
        text = "\n\n".join([*parts[:k], "This fork is licensed under the Frob terms.", *parts[k:]])
        assert licenses.recognise(text)[::2] == (["MIT"], 1)


def brute_identify(words):
    """The longest entry at the beginning of the words, by trying every one of them."""
    best = (0, None)
    for name, pattern in licenses.SENTENCES:
        for form in licenses._expanded(pattern):
            parts = [r"\d{1,2}(?:\.\d+)*" if w == "<v>" else r"\S+(?: \S+){0,%d}?" % (licenses.GAP - 1) if w == "<x>" else re.escape(w) for w in form.removesuffix("...").split()]
            if m := re.match(" ".join(parts) + r"(?= |$)", " ".join(words)):
                if len(m[0].split()) > best[0]:
                    best = (len(m[0].split()), name)
    return best


def test_sentence_table_against_brute_force():
    import random

    rnd = random.Random(8)
    forms = [f for _, p in licenses.SENTENCES for f in licenses._expanded(p)]
    assert len(licenses.SENTENCES) < 200

    def filled():
        return rnd.choice(forms).replace("<v>", rnd.choice(["2", "2.1", "3"])).replace("<x>", rnd.choice(["this thing", "a", "our own library here"])).removesuffix("...").split()

    for _ in range(400):
        words = filled()
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = rnd.choice(["the", "license", "other"])
        words += rnd.choice([[], ["and", "more"], filled()])
        got, want = licenses._longest(words, 0), brute_identify(words)
        assert (got[0] if got else 0) == want[0] and (not got or got[1] == want[1] or want[0]), (words, got, want)


def test_unknown_wrapped_sentence_is_reported():
    assert licenses.recognise("Permission is hereby\nGranted to all who ask for it.")[2] == 1


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "search-results", "share-enabled", "comments-open", "search", "sidebar"])
def test_wrapper_names_do_not_drop_the_article(name):
    for attr in ("class", "id"):
        assert html_text.extract(page(f'<div {attr}="{name}"><p>{LONG}</p><p>{LONG}</p></div>')) == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_headings_and_fragments_stay():
    body = f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="search">Search</h2><section id="search-algorithms"><p>{LONG}</p></section></article>'
    assert html_text.extract(page(body)) == f"Related work\n\n{LONG.strip()}\n\nSearch\n\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["sidebar-left", "nav-main", "ad-slot ad-300x250", "comment-list", "footer-links"])
def test_noise_beside_an_article_stays_out(name):
    assert html_text.extract(page(f'<div class="content"><p>{LONG}</p><p>{LONG}</p></div><div class="{name}"><p>{LONG}</p></div>')) == f"{LONG.strip()}\n\n{LONG.strip()}"
