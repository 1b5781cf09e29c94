"""HTML extraction, license scans and chat formatting on small cases."""

from __future__ import annotations

import itertools
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import chat, html, licenses
from terrane.session import table

LONG = "A paragraph that is long enough to count as text of an article, and then some more words."
PAGES = {
    "<article><h1>T &amp; U</h1><p><b>a<br>b<p>c  d\n e</article><footer>f</footer>": "T & U\n\na b\n\nc d e",
    "<nav>menu</nav><main><p>x</p><div class='ad'>y</div><p>&lt;p&gt;&nbsp;z</p></main>": "x\n\n<p> z",
    f"<div id=menu><a href=x>{LONG}</a></div><div><p>{LONG}</p><p>short</p></div><div class=comments>{LONG}</div>": f"{LONG}\n\nshort",
    f"<script>var a='<p>{LONG}</p>'</script><style>p{{}}</style><p>{LONG}": LONG,
    f"<form>{LONG}</form><aside>{LONG}</aside><header>{LONG}</header>": "",
    f"<article><p>{LONG}</p><ul><li>one<li><a href=x>two</a></ul><table><tr><td>3<td>4</table></article>": f"{LONG}\n\none\n\ntwo\n\n3\n\n4",
    "": "",
    "plain words": "plain words",
    "<article><p>x<!-- <p>y</p> --> z</p><p>1 < 2</p></article>": "x z\n\n1 < 2",
    "<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>": "deep",
    "<article><p>unclosed <a href='x>y'>link</a": "unclosed link",
    "<header>site</header><article><header><h1>t</h1></header><div class='entry-header'>u</div><div class='reader-comments'>v</div>w</article>": "t\n\nu\n\nw",
    "<article><p>a</p><p class='note'>b</p></article><div class=sidebar>c</div>": "a\n\nb",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_pages(spark):
    rows = spark.createDataFrame([(i, f"u{i}", p, 0) for i, p in enumerate(PAGES)] + [(99, None, None, 0), (99, None, None, 0)], "page_id long, url string, html string, text int")
    got = html.extract(rows).collect()
    assert len(got) == len(PAGES) + 2
    by = {r["page_id"]: r for r in got}
    for i, want in enumerate(PAGES.values()):
        assert by[i]["text"] == want and by[i]["n_chars"] == len(want)
    assert by[99]["text"] == "" and by[99]["url"] is None
    assert html.extract(rows.limit(0)).count() == 0


def test_templates_are_found_whole_and_changed(spark):
    rows = []
    for k, text in enumerate(licenses.TEMPLATES.values()):
        words = text.split()
        rows.append((k, f"é before {text} after", 1))
        changed = [w for i, w in enumerate(words) if i % 11 != 7]
        rows.append((1000 + k, "# " + "\n# ".join(changed), 1))
    rows += [(5000, None, 1), (5001, "", 1), (5002, "the license of the software is not here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    texts = {i: t for i, t, _ in rows}
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        (hit,) = got[k]
        assert hit["license"] == name and hit["coverage"] == 1.0
        assert text.startswith(texts[k][hit["start"] : hit["end"]])
        if len(text.split()) > 20:
            assert [h["license"] for h in got[1000 + k]] == [name] and got[1000 + k][0]["coverage"] >= 0.8
    assert not set(got) & {5000, 5001, 5002}
    assert licenses.scan(docs.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_matches_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(1, 15))
        b = rng.integers(0, 6, rng.integers(1, 15))
        assert licenses.align(a, b, 0, 40)[0] == lcs(a.tolist(), b.tolist())


def test_winnowing_keeps_one_of_each_window():
    hashes = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    kept = set(licenses.winnow(hashes, 4))
    assert all(kept & set(range(a, a + 4)) for a in range(47))


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def train(n=200):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 4))):
            rows.append((c, 2 * t, "user", "short question?" if rng.random() < 0.8 else "please"))
            rows.append((c, 2 * t + 1, "assistant", "\n".join(["a long answer that goes on for quite a while and explains things"] * int(rng.integers(2, 5)))))
    return rows


def test_roles_are_recovered(spark):
    rows = train()
    model = chat.fit(turns(spark, rows[: len(rows) // 2]))
    held = rows[len(rows) // 2 :]
    hidden = [(c, t, None, x) for c, t, _, x in held]
    got = {(r["conv_id"], r["turn"]): r["role"] for r in chat.format_chat(turns(spark, hidden), model).where("part = 0").collect()}
    right = sum(got[c, t] == role for c, t, role, _ in held)
    assert right / len(held) > 0.95


def test_markers_in_a_transcript(spark):
    model = chat.fit(turns(spark, train()))
    text = "System: be brief\nUser: hi\nthere\nAI: hello\n**Human**: bye?\n<|assistant|> good bye"
    got = chat.format_chat(turns(spark, [(1, 0, None, text)]), model).orderBy("part").collect()
    assert [(r["role"], r["text"]) for r in got] == [("system", "be brief"), ("user", "hi\nthere"), ("assistant", "hello"), ("user", "bye?"), ("assistant", "good bye")]
    assert got[1]["rendered"] == "<|user|>\nhi\nthere\n<|end|>"


def test_blocks_decode_as_one(spark, monkeypatch):
    model = chat.fit(turns(spark, train()))
    rows = [(5, t, None if t % 3 else "user", x) for t, (_, _, _, x) in enumerate(train(60))]
    whole = chat.lines_of([(r, x) for _, _, r, x in sorted(rows, key=lambda x: x[1])], model)
    want = chat.viterbi(whole, model, -1, -1)
    first = [want[i] for i, s in enumerate(whole.row_start) if s]
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    got = {r["turn"]: r["role"] for r in chat.format_chat(turns(spark, rows), model).where("part = 0").collect()}
    assert [got[t] for t in range(len(rows))] == [chat.ROLES[k] for k in first]


def test_viterbi_is_the_best_path(spark):
    model = chat.fit(turns(spark, train()))
    lines = chat.lines_of([(None, "short?\nlonger line of text here"), (None, "a long answer that goes on and on"), ("user", "x")], model)
    step, stay = chat._moves(model)

    def value(path):
        total = model.first[path[0]] + lines.score[0][path[0]]
        for k in range(1, len(path)):
            total += (step if lines.begins[k] else stay)[path[k - 1]][path[k]] + lines.score[k][path[k]]
        return total

    best = max(itertools.product(range(3), repeat=len(lines.text)), key=value)
    assert np.isclose(value(best), value(chat.viterbi(lines, model, -1, -1)))


def test_chat_edge_cases(spark):
    rows = turns(spark, [(1, 0, "user", None), (1, 0, "user", None), (None, None, "nobody", ""), (2, 1, "USER ", "x")])
    got = chat.format_chat(rows).collect()
    assert len(got) == 4 and {r["conv_id"] for r in got} == {1, None, 2}
    assert chat.format_chat(rows.limit(0)).count() == 0


def test_siblings_are_told_apart():
    index = licenses.Index(licenses.TEMPLATES)
    names = lambda text: [x[0] for x in licenses.scan_text(f"some text before {text} and more after", index)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0 (line)"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0 (line)"]
    assert names("This work is licensed under the GNU General Public License, version 1.") == []
    cc = "This work is licensed under a Creative Commons {} License."
    assert names(cc.format("Attribution-NonCommercial 4.0 International")) == ["CC-BY-NC-4.0 (notice)"]
    assert names(cc.format("Attribution-Non-Commercial 4.0 International")) == ["CC-BY-NC-4.0 (notice)"]
    assert names(cc.format("Attribution-NonCommercial-NoDerivatives 4.0 International")) == ["CC-BY-NC-ND-4.0 (line)"]
    assert names(cc.format("Attribution-Unheard 4.0 International")) == []
    assert names("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0 (short)"]
    grant = licenses.TEMPLATES["AGPL-3.0-or-later"]
    assert names(grant) == ["AGPL-3.0-or-later"] and names(grant.replace("Affero ", "")) == ["GPL-3.0-or-later (grant)"]
    assert names(licenses.TEMPLATES["MIT"].replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")) == ["MIT-0"]
    assert names(grant.replace("Affero", "Lesser")) == ["LGPL-3.0-or-later"]
    assert names(licenses.TEMPLATES["BSD-3-Clause (text)"]) == ["BSD-3-Clause (text)"]


def test_short_blocks_of_the_text_are_kept():
    ads = "<div class=ad><p>buy</p><p>this</p><p>now</p><p>here</p></div>"
    long = f"<p>{LONG}</p>"
    assert html.main_text(f"<div>{long}{ads}<p>Short end.</p></div><div>Copyright</div>") == f"{LONG}\n\nShort end."
    assert html.main_text(f"<div><p>Short start.</p>{ads}{long}{ads}<ul><li>Item.</ul></div>") == f"Short start.\n\n{LONG}\n\nItem."
    assert html.main_text(f"<body>{long}{ads}<p>Short end.</p>{ads}<div><p>elsewhere</p></div>") == f"{LONG}\n\nShort end."


@pytest.mark.parametrize("name", ["svg", "object", "video", "noscript", "select", "template", "canvas"])
def test_unclosed_elements_do_not_swallow_the_page(name):
    assert html.main_text(f"<article><p>one<{name}></p><p>two</p></article>") == "one\n\ntwo"
    assert html.main_text(f"<article><p>one</p><{name}>x</{name}><p>two</p></article>") == "one\n\ntwo"
    assert html.main_text("<article><p>one</p><script>x<p>two</p></article>") == "one"


@pytest.mark.parametrize("name", ["social-science", "side-by-side", "comments-enabled", "post-with-sidebar"])
def test_a_class_word_does_not_lose_the_article(name):
    assert html.main_text(f'<div class="{name}"><p>{LONG}</p><p>end</p><div class="related">{LONG}</div></div><div class="social-links">{LONG}</div>') == f"{LONG}\n\nend"
    # Where it is the lesser part of the page, the word counts.
    assert html.main_text(f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="{name}"><p>{LONG}</p></div>') == f"{LONG}\n\n{LONG}"


def test_comments_longer_than_the_article_are_none_of_it():
    assert html.main_text(f"<article><p>{LONG}</p></article><div class='reader-comments'>{'<p>' + LONG + '</p>'}{'<p>' + LONG + '</p>' * 9}</div>") == LONG
    assert html.main_text(f"<div><p>{LONG}</p></div><div id='comment-list'>{('<p>' + LONG + '</p>') * 9}</div>") == LONG


def test_marks_are_weights():
    notice = "<div>Copyright of this site, all rights reserved.</div>"
    links = "".join(f"<li><a href=x>other page {k}</a></li>" for k in range(5))
    assert html.main_text(f"{notice}<article><p>Short.</p><p>{LONG}</p></article>{notice}") == f"Short.\n\n{LONG}"
    assert html.main_text(f"<ul>{links}</ul><div><h1>Title</h1><p>{LONG}</p></div><ul>{links}</ul>") == f"Title\n\n{LONG}"
    teaser, story = "<article><h2>Teaser</h2></article>", "".join(f"<p>{LONG} {k}{LONG}{LONG}</p>" for k in range(4))
    assert html.main_text(f"{teaser}<div>{story}</div>").endswith(f"3{LONG}{LONG}")  # a mark that holds nothing does not hide a long text


def plain_stretches(weights, parts, window, surge):
    """Surge and dive by looking at every window of every part anew."""
    n = len(weights)
    same = lambda a, b: all(parts[i] == parts[a] for i in range(min(a, b), max(a, b) + 1))
    total = lambda k: sum(weights[i] for i in range(k, min(n, k + window)) if same(k, i))
    surge = min([surge, max([total(k) for k in range(n)], default=0)]) or 1
    kept = [False] * n
    for k in range(n):
        if total(k) >= surge and not kept[k]:
            last = k
            while last < n and same(k, last) and total(last):
                last += 1
            first = next(i for i in range(k, n) if weights[i])
            while first and same(k, first - 1) and weights[first - 1] and not kept[first - 1]:
                first -= 1
            for i in range(first, last):
                kept[i] = True
    return kept


def test_stretches_match_a_plain_version():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(0, 40))
        weights = [float(x) for x in rng.choice([0, 0, 0, 5, 30, 90, 200], n)]
        parts = np.cumsum(rng.random(n) < 0.15).tolist()
        assert html.stretches(weights, parts, 3, 80) == plain_stretches(weights, parts, 3, 80)


def test_the_distribution_finds_the_article_without_its_mark():
    """On the real pages; with the mark gone, nothing but the windows tells the article from the rest."""
    folder = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test data here")
    pages = [row[0] for row in duckdb.sql(f"SELECT html FROM '{folder}'").fetchall()]
    bare = [x.replace("<article>", "<div>").replace("</article>", "</div>") for x in pages]
    same = [html.main_text(x) == html.main_text(y) for x, y in zip(pages, bare, strict=True)]
    assert all("<article>" in x for x in pages) and sum(same) >= 0.99 * len(pages)


@pytest.mark.parametrize("make", [lambda n: "<span>" * n + "<li>" * n, lambda n: "<li><ul>" + "<span>" * n + "<li>x</li>" * n, lambda n: "<p>" + "<b>" * n + "<p>" * n, lambda n: "<td>" * n + "<tr>" * n, lambda n: '<div class="social-x">' * n + "t"])
def test_awkward_pages_cost_in_proportion(make):
    def took(n):
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            html.main_text(make(n))
            best = min(best, time.perf_counter() - began)
        return best

    assert took(40_000) < 2.3 * max(took(20_000), 0.5)


def test_hidden_roles_are_recovered_on_the_real_table(spark):
    """Every conversation is decoded from its texts by a model of other conversations."""
    folder = "/root/testdata/sf0.01/conversations.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test data here")
    table = spark.read.parquet(folder)
    got = chat.format_chat(table, hide_roles=True).where("part = 0").collect()
    assert len(got) == table.count()
    right = sum(r["role"] == r["given_role"] for r in got)
    assert right / len(got) > 0.95
    # Whatever the rows' own roles are, they don't reach the decoder of their fold.
    wrong = table.withColumn("role", F.when(chat.fold_of(F.col("conv_id"), chat.FOLDS) == 0, F.lit("assistant")).otherwise(F.col("role")))
    again = {(r["conv_id"], r["turn"]): r["role"] for r in chat.format_chat(wrong, hide_roles=True).where(chat.fold_of(F.col("conv_id"), chat.FOLDS) == 0).collect()}
    assert all(again[r["conv_id"], r["turn"]] == r["role"] for r in got if (r["conv_id"], r["turn"]) in again) and again


def test_features_mean_the_same_to_spark_and_python(spark):
    lines = ["", "Hello there", "- item", "12) item", "    code", "x = {", "What is it?", "Sure, here is", "you are a bot", "é" * 5000, "* * *", "\ttab", "Hola", "good morning all", "TELL me;"]
    frame = spark.createDataFrame([(x,) for x in lines], "t string").select("t", *[c.alias(f"x{k}") for k, c in enumerate(chat.feature_columns(F.col("t")))])
    assert {tuple(r) for r in frame.collect()} == {(x, *chat.features(x)) for x in lines}


def test_counts_of_repeated_turns(spark):
    rows = turns(spark, [(1, 0, "user", "a")] * 3 + [(1, 1, "assistant", "b")] * 4 + [(1, 1, "user", "c"), (2, 5, "system", "d\ne"), (None, None, "user", "x")])
    found = chat.count(rows)[0]
    assert found.step.tolist() == [[0, 0, 0], [0, 3, 12], [0, 0, 0]] and found.first.tolist() == [1, 4, 0]
    assert found.ends.tolist() == [[1, 1], [0, 5], [0, 4]]
    halves = chat.count(rows, 2)
    assert (halves[0].step + halves[1].step).tolist() == found.step.tolist()


def test_a_turn_number_that_many_rows_share(spark):
    model = chat.fit(turns(spark, train(40)))
    rows = [(7, 3, None, f"what is {k % 30}?") for k in range(90)] + [(7, 4, None, "a long answer " * 9)] * 20 + [(8, 0, None, "short?")]
    rows += [(9, k // 30, [None, "user", "assistant"][k % 3], ["Sure, here it is.", "User: how?\nAssistant: so", "", "- one\n- two"][k % 4]) for k in range(120)]
    got = {n: sorted(map(str, chat.format_chat(turns(spark, rows), model, block_rows=n).collect())) for n in (8, 33, 4096)}
    assert got[8] == got[33] == got[4096]
    found = chat.format_chat(turns(spark, rows[:111]), model, block_rows=8).collect()
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in found) == sorted((c, t, x.strip()) for c, t, _, x in rows[:111])
    assert {r["part"] for r in found} == {0}


def test_clashing_names_of_conversations(spark):
    rows = turns(spark, train(6))
    more = rows
    for c in ("fold", "block", "sub", "number", "place", "given_role", "part", "times", "cc", "before", "last"):
        more = more.withColumn(c, F.lit("?"))
    model = chat.fit(rows)
    assert sorted(map(str, chat.format_chat(more, model).collect())) == sorted(map(str, chat.format_chat(rows, model).collect()))


def brute_scan(text, index):
    """Every template aligned with the whole text, without fingerprints or a band."""
    words, found = licenses.tokens(text), []
    numbers = np.array([index.vocabulary.get(w, 0) for w in words], dtype=np.int64)
    for k, item in enumerate(index.items):
        matched, first, last = licenses.align(item, numbers, 0, len(words) + len(item))
        if matched >= max(licenses.GRAM, licenses.MIN_COVERAGE * len(item)) and licenses.holds(words[first : last + 1], index.cores[k]) and last - first < 1.4 * len(item):
            found.append((matched, matched / len(item), first, last, index.names[k]))
    taken = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
        if all(x[3] < y[2] or x[2] > y[3] for y in taken):
            taken.append(x)
    return sorted(x[4] for x in taken)


def test_whole_scan_matches_brute_force():
    index, rng = licenses.Index(licenses.TEMPLATES), np.random.default_rng(12)
    noise = lambda n: [f"n{rng.integers(10**6)}" for _ in range(n)]
    some = 0
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        edited = []
        for w in words:
            edited += [] if rng.random() < 0.04 else [w]
            edited += noise(1) if rng.random() < 0.03 else []
        text = " ".join([*noise(9), *edited, *noise(9)])
        got = sorted(x[0] for x in licenses.scan_text(text, index))
        assert got == brute_scan(text, index), name
        some += bool(got)
    assert some > 0.7 * len(licenses.TEMPLATES)
    assert brute_scan(" ".join(noise(60)), index) == []


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "Mine-1.0.txt").write_text("This is the text of a licence of my own that nobody else has ever used before.")
    found = licenses.read_templates(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, f"# {found['Mine-1.0']}")], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(docs, found).collect()] == ["Mine-1.0"]
    with pytest.raises(ValueError):
        licenses.read_templates(spark, str(tmp_path), most_chars=3)


def test_repeated_phrases_of_a_licence_cost_little():
    index = licenses.Index(licenses.TEMPLATES)
    began = time.perf_counter()
    assert licenses.scan_text("the software without restriction " * 30_000, index) == []
    assert time.perf_counter() - began < 5


PROSE = "This is a long paragraph of the article with many words in it. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<form id="aspnetForm"><div><p>{PROSE}</p><p>Short end.</p></div></form>', [PROSE, "Short end."]),
        (f'<form id="aspnetForm"><nav><a href="x">Home</a></nav><main><article><p>{PROSE}</p></article></main><footer>Foot</footer></form>', [PROSE]),
        (f'<fieldset><p>{PROSE}</p></fieldset>', [PROSE]),
        (f'<article><p>{PROSE}</p><section id="discussion"><p>{PROSE}</p></section><h2 id="search">Search</h2><h2 id="navigation">Navigation</h2><p class="notice">A note.</p></article>', [PROSE, PROSE, "Search", "Navigation", "A note."]),
        (f'<div class="page side"><p>{PROSE}</p><p>{PROSE}</p></div><div class="footer">Foot</div>', [PROSE, PROSE]),
        (f'<article><p>{PROSE}</p></article><form><p>Sign up for letters</p></form>', [PROSE]),
        (f'<div><p>{PROSE}</p></div><form><p>Sign up for letters</p></form>', [PROSE]),
        (f'<article><p>{PROSE}</p></article><section class="comments"><p>{PROSE}</p><p>{PROSE}</p></section>', [PROSE]),
        (f'<div><p>{PROSE}</p></div><div>© 2024 Somebody · all rights</div>', [PROSE]),
        (f'<article><p>{PROSE}</p><p>© is a sign.</p></article>', [PROSE, "© is a sign."]),
    ],
)
def test_names_alone_lose_no_text(page, want):
    assert html.main_text(page) == "\n\n".join(x.strip() for x in want)


def test_pages_of_plain_containers(spark):
    """All semantic elements of the test pages as div: the same text."""
    import re

    names = "article|main|nav|header|footer|aside|section|form|menu|dialog|button|fieldset"
    extra = total = 0
    for row in table(spark, "/root/testdata/sf0.01", "pages").collect():
        want = html.main_text(row["html"])
        got = html.main_text(re.sub(rf"<(/?)(?:{names})\b", r"<\1div", row["html"] or ""))
        total += len(want)
        extra += abs(len(got) - len(want))
    assert extra <= 0.01 * total
