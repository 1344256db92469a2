"""Licences, pages, addresses, quality, mixing and suffix trees against brute force and planted cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents, words
from pyspark.sql import functions as F

from proofyard.llm import html_text, licenses, mixing, pst, quality, registry, shared, tokens, url_rules


# Words as hashes


def test_hashed_words_are_the_words():
    texts = [r[1] for r in ROWS] + ["", None, "x", " x", "x ", "É é", "a\u00a0b c"]
    seen = {}
    for chunk in tokens.words(pa.array(texts)):
        for i in range(chunk.hi - chunk.lo):
            got = chunk.hashes[chunk.first[i] : chunk.first[i + 1]].tolist()
            want = words(texts[chunk.lo + i])
            assert len(got) == len(want)
            for h, w in zip(got, want):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# Licences


def cosine(a, b, idf, unseen):
    x, y = Counter(a), Counter(b)
    w = lambda t: idf.get(t, unseen)
    dot = sum(x[t] * w(t) * y[t] * w(t) for t in x)
    return dot / math.sqrt(sum((x[t] * w(t)) ** 2 for t in x)) / math.sqrt(sum((y[t] * w(t)) ** 2 for t in y))


FILES = [
    ("a/LICENSE", "The MIT License\n\nReleased under the MIT License."), ("a/x.py", "code here"), ("a/b/c/y.py", "more code"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
    ("a/b/c/z.py", "Some header\nLicensed under CC BY-NC 4.0.\nrest of the file " + "word " * 400), ("d/w.py", "no licence near"), ("d/e/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("d/e/f/g/v.py", "deep"), ("root.txt", "at the root"), ("d/e/f/g/v.py", "deep"), (None, "Released under the MIT License."), (None, "nothing"), ("d/n.py", None), ("d/e/n.py", ""), ("t/two", "Released under the MIT License.\nReleased under the MIT License."),
] + [(f"z/{i}.txt", f"plain text number {i} of the set and more") for i in range(80)]


def test_licences(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumns({c: F.lit("x") for c in ("file", "dir", "licence", "token", "unit")})
    got = [tuple(r) for r in licenses.scan(df).collect()]
    assert len(got) == len(FILES)
    by = {p: (l, o, f) for p, l, _, o, f in got}
    assert by["a/LICENSE"][:2] == ("MIT", "file") and by["a/b/LICENSE.txt"][:2] == ("Apache-2.0", "file")
    assert by["a/x.py"] == ("MIT", "inherited", "a/LICENSE") and by["a/b/c/y.py"] == ("Apache-2.0", "inherited", "a/b/LICENSE.txt")
    assert by["a/b/c/z.py"] == ("CC-BY-NC-4.0", "header", None)
    assert by["d/e/f/g/v.py"] == ("GPL-3.0", "inherited", "d/e/COPYING") and by["d/e/n.py"] == ("GPL-3.0", "inherited", "d/e/COPYING")
    assert by["d/w.py"] == by["d/n.py"] == by["root.txt"] == by["z/3.txt"] == (None, None, None)
    assert sorted(str(l) for p, l, *_ in got if p is None) == ["MIT", "None"]
    # scores against cosines over the same weights
    tok = lambda t: re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", (t or "").lower())
    n = len(FILES)
    vocabulary = {t for texts in licenses.TEMPLATES.values() for x in texts for t in tok(x)}
    idf = {t: math.log((1 + n) / (1 + sum(t in tok(x) for _, x in FILES))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1
    for p, licence, score, origin, _ in got:
        if origin in ("file", "header", "text"):
            text = next(x for q, x in FILES if q == p)
            units = [tok(text)] + [tok(x) for x in text.split("\n")]
            best = max(cosine(u, tok(t), idf, unseen) for u in units if u for t in licenses.TEMPLATES[licence])
            assert score <= best + 1e-6 and score >= licenses.COSINE
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [80, 4000])
def test_notices_inside_lines_and_over_lines(spark, n):
    prose = "we went to the river and saw many boats there before noon "
    cases = {
        "Copyright 2024 Jane Doe. Released under the MIT License.": "MIT",
        prose * 20 + "Released under the MIT License. " + prose * 20: "MIT",
        "/* x=1 */ function f(){return 7} // Licensed under CC BY-NC 4.0. var y=f()": "CC-BY-NC-4.0",
        prose + "\n * This work is licensed under\n * the GNU General Public\n * License, version 3.\n" + prose: "GPL-3.0",
        prose * 3: None,
        "he lost his driving license under the bridge " + prose: None,
    }
    rows = [(f"f{i}/x", t) for i, t in enumerate(cases)] + [(f"z{i}/y", f"plain text number {i} of the set and more") for i in range(n)]
    got = {r["path"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"f{i}/x"] for i in range(len(cases))] == list(cases.values())
    assert not any(v for p, v in got.items() if p.startswith("z"))


def test_texts_without_the_name_of_a_licence_file_speak_for_themselves(spark):
    """Every text against every template, lines and wholes, and none for another."""
    rows = [("s/en/1", "Licensed under the ISC License."), ("s/en/2", "no licence"), ("s/en/3", "we met by the river and went on\nReleased under the MIT License.\nat noon the boats came back to the town"), ("s/en/LICENSE-x/4", "nothing here"), ("t/NOTICE", "This is ours. All rights reserved."), ("t/u/5", "nothing here")]
    rows += [(f"z/{i}", f"plain text number {i} of the set and more") for i in range(60)]
    got = {r["path"]: (r["licence"], r["origin"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["s/en/1"] == ("ISC", "text", None) and got["s/en/3"] == ("MIT", "header", None)
    assert got["t/NOTICE"] == ("All-Rights-Reserved", "file", None) and got["t/u/5"] == ("All-Rights-Reserved", "inherited", "t/NOTICE")
    assert all(v == (None, None, None) for p, v in got.items() if p not in ("s/en/1", "s/en/3", "t/NOTICE", "t/u/5"))


def test_no_text_that_reaches_a_template_is_left_out(spark):
    """Random mixtures of templates' and other words: those without a licence reach none by brute force."""
    rng = random.Random(4)
    vocabulary = sorted({t for texts in licenses.TEMPLATES.values() for x in texts for t in re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", x.lower())})
    rows = [(f"m/{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)) + rng.choices(["boat", "noon", "we"], k=rng.randrange(3)))) for i in range(150)]
    for i in range(150):
        text = rng.choice([x for xs in licenses.TEMPLATES.values() for x in xs]).split()
        rng.shuffle(text)
        rows.append((f"n/{i}", " ".join(text[: rng.randrange(1, len(text) + 1)])))
    rows += [(f"z/{i}", f"we saw the boat number {i} of the set and more under the license") for i in range(100)]
    tok = lambda t: re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", t.lower())
    n = len(rows)
    idf = {t: math.log((1 + n) / (1 + sum(t in tok(x) for _, x in rows))) + 1 for t in vocabulary}
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    found = 0
    for path, text in rows:
        best = max(cosine(tok(text), tok(x), idf, math.log(1 + n) + 1) for xs in licenses.TEMPLATES.values() for x in xs)
        if best >= licenses.COSINE + 1e-6:
            found += 1
            assert got[path]["score"] >= best - 1e-6, (path, text)
    assert found > 50


def test_near_templates_are_told_apart(spark):
    cases = {
        "All rights reserved.": "All-Rights-Reserved", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This is free and unencumbered software released into the public domain.": "Unlicense", "Licensed under the ISC License.": "ISC",
    }
    rows = [(f"f{i}/x", f"we saw boats\n{t}\nbefore noon") for i, t in enumerate(cases)] + [(f"z{i}/y", f"plain text number {i} of the set and more") for i in range(80)]
    got = {r["path"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"f{i}/x"] for i in range(len(cases))] == list(cases.values())
    assert not any(v for p, v in got.items() if p.startswith("z"))


# Pages


def test_pages_keep_the_article_and_nothing_else(spark):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav><div class="cookie-banner">We use cookies on this site to make it better for all.</div>
    <article><h1>Title &amp; more</h1><p>First  paragraph
    with <b>bold</b> &lt;tags&gt; and&nbsp;space.<p>Short.</p><!-- <p>hidden</p> --><ul><li>One item</li></ul><div class="comments"><p>A reader says that this is a very good article indeed, thanks.</p></div></article>
    <aside><p>Also read this other long story that has nothing to do with the article at all.</p></aside><form><p>Type your mail address here to get our letter every week.</p></form><footer>&copy; 2020 The Company and a long line of words.</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst paragraph with bold <tags> and space.\n\nShort.\n\nOne item"
    odd = [None, "", "plain words only, without any markup, but enough of them to be a paragraph of text.", "<p", "<<<>>>", "<p>a<b", "&#xD800;&#0;&bogus;", "<div>" * 3000 + "x" + "</div>" * 10, "<!-- never closed", "<script>never closed", "<p title='never closed>x</p>" * 50]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate([page, *odd])] + [(None, None, page), (1, "http://h/1", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "a", "b")})
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"] == html_text.main_text(page) for r in got) == 3
    assert html_text.extract(df.limit(0)).count() == 0


STORY = "The committee met again on Tuesday to settle how the river should be measured, who would keep the records, and what should happen next."


def test_elements_that_never_end_take_nothing_with_them():
    article = f"<article><h1>Rivers</h1><p>{STORY}</p><p>{STORY}</p></article>"
    want = f"Rivers\n\n{STORY}\n\n{STORY}"
    for before in ("<html><head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title>", "<svg/>", "<svg><path d='1'>", "<iframe src=x>", "<canvas/>", "<object data=x>", "<video src=x>", "<select><option>", "<title>", "<script>",
                   "<head><script>'<p>'</script></head><svg><text>never</text></svg>", "<head><noscript><p>never</p></noscript></head>"):
        for after in ("", "<svg></svg><iframe></iframe><canvas></canvas><object></object><video></video><select></select>"):
            assert html_text.main_text(before + article + after).endswith(want), (before, after)
            assert "never" not in html_text.main_text(before + article + after)
    assert html_text.blocks("<script>" * 100_000 + "<head>" * 100_000) == []  # in linear time


def test_names_of_wrappers_do_not_set_the_article_apart():
    inner = f"<h1>Rivers</h1><p>{STORY}</p><p>{STORY}</p>"
    want = f"Rivers\n\n{STORY}\n\n{STORY}"
    other = f'<div class="site-footer"><p>{STORY}</p></div><div id="sidebar-right"><p>{STORY}</p></div>'
    article = f"<article>{inner}</article>"
    for page in (f'<html class="no-touch menu"><body class="has-sidebar">{article}{other}</body></html>', f'<body class="sidebar"><div id="page" class="with-footer menu-open">{article}{other}</div></body>', f'<body style="display:none"><div class="sidebar">{article}</div>{other}</body>',
                 f'<body><article><div class="post-header"><h1>Rivers</h1></div><p>{STORY}</p><p>{STORY}</p></article>{other}</body>', f'<body><div class="navigation"><main>{inner}</main></div>{other}</body>'):
        assert html_text.main_text(page) == want, page
    # most of the words, without an article element
    assert html_text.main_text(f'<body><div class="sidebar"><div>{inner}<p>{STORY}</p></div></div>{other}</body>').startswith(want)
    # inside an article names count as before
    assert html_text.main_text(f'<body><article>{inner}<div class="comments"><article><p>{STORY}</p></article></div></article></body>') == want


def test_decision_tree_on_pages_it_has_not_seen():
    """Each labelled page by a tree grown from the others."""
    from proofyard.llm.html_training import PAGES

    right = total = 0
    for held in range(len(PAGES)):
        rest = [html_text.blocks(p) for i, p in enumerate(PAGES) if i != held]
        tree = html_text.grow(np.vstack([html_text.features(p) for p in rest]), np.array([b.label for p in rest for b in p]))
        page = html_text.blocks(PAGES[held])
        right += sum(html_text.is_main(tree, r) == b.label for b, r in zip(page, html_text.features(page).tolist()))
        total += len(page)
    assert right / total > 0.85


# Addresses


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in url_rules.CONTRACT if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    lower = host + path
    lower = "".join(c.lower() if c.isascii() else c for c in lower)
    found = [r for r in url_rules.PATTERNS if re.search(r.pattern, lower)]
    blocks = found and not any(r.action == "allow" for r in found)
    return host, path, best and best.name, best.action if best else "block" if blocks else "allow"


def test_addresses_against_every_rule(spark):
    rng = random.Random(2)
    urls = [None, "", "example.com/en/7", "http://", "http://com/en/", "http://x.com/en/1", "HTTP://A.Example.COM/en/77?x#y", "http://example.com/en/7", "http://badexample.com/en/7", "https://www.example.net/de/8/9", "http://net/de/", "http://a.org/es", "http://a.org/es/", "http://casino-win.example.org/x", "http://mycasinos.org/", "ftp://a?b://c", "http://u@x.com:80/en/", "x://é.com/en/é", "http://a.b/en/?u=http://casino.com/", "//no/scheme", "http://payday-loans.info", "http://paydayloans.info", "a\n://b.com/en/x"]
    part = ["com", "net", "org", "example", "en", "de", "es", "7", "8", "casino", "ads", "spam", "x", "WWW", "best-slots-", "stop-bets-now", "my-poker", "A.JS", "logo.png", "news", "payday-loans", "cart", "casino-help"]
    urls += ["http://" + ".".join(rng.choices(part, k=3)) + "/" + "/".join(rng.choices(part, k=rng.randrange(4))) + rng.choice(["", "/", "?q=1", "#f"]) for _ in range(600)]
    urls += ["http://hot.example.com/en/7"] * 50
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[6])], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "token", "action")})
    got = url_rules.judge(df, url_rules.CONTRACT + url_rules.PATTERNS).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = urls[6] if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(url), url
    assert url_rules.judge(df.limit(0), url_rules.CONTRACT).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(df, [url_rules.Rule("x", "block", pattern="x")])


def test_patterns_of_rules():
    fits = lambda rule, url: re.search(url_rules.pattern_rule(rule).pattern, url) is not None
    assert fits("||ads.", "ads.example.com/") and fits("||ads.", "x.ads.example.com") and not fits("||ads.", "loads.example.com/") and not fits("||ads.", "a.com/ads.html")
    assert fits("||*-casino.", "my-casino.com/") and not fits("||*-casino.", "a.com/my-casino.html") and not fits("||*-casino.", "casino.com")
    assert fits("/ads/*.js^", "a.com/x/ads/y/z.js?") and fits("/ads/*.js^", "a.com/ads/z.js") and not fits("/ads/*.js^", "a.com/ads/z.json")
    assert fits("|example.com/a|", "example.com/a") and not fits("|example.com/a|", "example.com/ab") and not fits("|example.com/a|", "x.example.com/a")
    assert fits("/a+b(c)[d]", "x/a+b(c)[d]") and not fits("a.b", "axb")
    assert url_rules.pattern_rule("||*-casino.").tokens == ("casino",) and url_rules.pattern_rule("/best-slots-").tokens == ("best", "slots")
    assert url_rules.pattern_rule("@@/stop-bets-").action == "allow" and url_rules.pattern_rule("foo").tokens == () and url_rules.pattern_rule("/foo*").tokens == ()
    assert len(url_rules.PATTERNS) > 300 and all(r.tokens for r in url_rules.PATTERNS) and len({r.name for r in url_rules.PATTERNS}) == len(url_rules.PATTERNS)
    # every token of a rule is whole in each URL that it fits
    rng = random.Random(1)
    for rule in rng.sample(url_rules.PATTERNS, 60):
        for _ in range(20):
            url = "".join(rng.choice([*rule.tokens, ".", "-", "/", "x", "7", ".com", "online", "help", "best"]) for _ in range(8))
            if re.search(rule.pattern, url):
                assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", url)), (rule, url)


def test_plans_of_native_operators_hold_no_python(spark, sf):
    for name in ("op1_personal_data", "op3_license_scan", "op7_url_filters"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_addresses_match_sql(spark, sf, duck):
    from comparing import same

    same(registry.QUERIES["op7_url_filters"](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL["op7_url_filters"]).df())


# Quality


def rated(seed, n):
    rng = random.Random(seed)
    good = ["stone", "river", "table", "green", "walk", "light", "paper", "window", "garden", "music"]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        text = rng.choices(good, k=rng.randrange(20, 60))
        if grade == 0:
            text = [w + rng.choice(["$$$", "###"]) for w in text] if i % 2 else [text[0]] * len(text)
        elif grade == 1:
            text[rng.randrange(len(text))] = rng.choice(["idiot,", "Moron", "scum."])
        rows.append((i, " ".join(text), "en", "s", grade))
    return rows


def test_grades_of_unseen_documents(spark, tmp_path):
    rows = rated(3, 900)
    docs = documents(spark, tmp_path, [r[:4] for r in rows])
    labels = spark.createDataFrame([(r[0], int(r[4] > 0), int(r[4] == 1)) for r in rows[:500]] + [(3, None, None), (None, 1, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.rate(docs, labels).collect()}
    unseen = [r for r in rows[500:]]
    assert np.mean([got[r[0]]["accepted"] == (r[4] == 2) for r in unseen]) > 0.95
    means = [np.mean([got[r[0]]["expected_grade"] for r in unseen if r[4] == g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2]
    again = {r["doc_id"]: r["p_top"] for r in quality.rate(docs, labels).collect()}
    assert all(abs(again[i] - got[i]["p_top"]) < 1e-6 for i in got)
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["accepted"]}


def test_quality_of_odd_rows(spark, tmp_path):
    docs = documents(spark, tmp_path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    alike = spark.createDataFrame([(1, 1, 0), (10, 1, 0)], none.schema)
    for labels in (none, alike):
        got = quality.rate(docs, labels).collect()
        assert len(got) == len(ROWS) and all(r["accepted"] and r["p_top"] is None for r in got)
        assert quality.accepted_documents(docs, labels).count() == len(ROWS)
    two = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 0), (12, 0, 0)], none.schema)
    got = {r["doc_id"]: r for r in quality.rate(docs, two).collect()}
    assert not any(got[i]["accepted"] or got[i]["p_top"] for i in (5, 6, 7)) and got[1]["p_top"] > got[12]["p_top"]
    assert quality.rate(docs.limit(0), two).count() == quality.accepted_documents(docs.limit(0), two).count() == 0


# Mixing


def water(sizes, weights):
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if 3 * sizes[i] < share * weights[i]}
        if not over:
            for i in free:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budget_is_filled_as_well_as_can_be(seed):
    rng = random.Random(seed)
    for _ in range(150):
        sizes = np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 6))))
        counts = np.array([rng.randrange(1, 4) for _ in sizes])
        budget = rng.randrange(0, int((sizes * counts).sum()) + 3)
        take = mixing.fill(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        total = int((take * sizes).sum())
        assert total <= budget
        reach = {0}
        for s, n in zip(sizes, counts):
            reach = {r + int(s) * k for r in reach for k in range(int(n) + 1)}
        assert total == max(r for r in reach if r <= budget)


def test_budgets_that_can_be_met_are_met():
    assert (mixing.fill(np.array([6, 15, 36, 37]), np.array([3, 3, 3, 1]), 118) * [6, 15, 36, 37]).sum() == 118
    sizes, counts = np.array([20_000, 7, 350, 9_999]), np.array([900, 2, 100_000, 5_000])
    for budget in (1, 7, 350, 40_357, 17_000_001):
        took = int((mixing.fill(sizes, counts, budget) * sizes).sum())
        want = max(a * 20_000 + b * 7 + d * 9_999 + min(100_000, (budget - a * 20_000 - b * 7 - d * 9_999) // 350) * 350
                   for a in range(min(900, budget // 20_000) + 1) for b in range(3) for d in range(0, min(5_000, budget // 9_999) + 1) if a * 20_000 + b * 7 + d * 9_999 <= budget)
        assert took == want


def test_budgets_beyond_the_programme_come_near(monkeypatch):
    monkeypatch.setattr(mixing, "WORK", 1000)
    monkeypatch.setattr(mixing, "WINDOW", 3000)
    rng = random.Random(5)
    for _ in range(60):
        sizes = np.array(sorted(rng.sample(range(1, 900), 60)))
        counts = np.array([rng.randrange(1, 50) for _ in sizes])
        budget = rng.randrange(1, int((sizes * counts).sum()))
        take = mixing.fill(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and budget - 2 <= (take * sizes).sum() <= budget


def test_mix_of_sources(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", s) for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["small"] * 12 + [None] * 40 + ["é"] * 30)]
    docs = documents(spark, tmp_path, rows)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    names = ["big", "mid", "small", "é", None]
    sizes = [sum(len(words(t)) for _, t, _, s in rows if s == n) for n in names]
    want = water(sizes, [5, 2, 1, 5, 2])
    for name, size, target in zip(names, sizes, want):
        own = [got[i] for i, _, _, s in rows if s == name]
        assert {r["source_size"] for r in own} == {size} and all(abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
    assert all(r["size"] == len(words(rows[i][1])) and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for i, r in got.items())
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == [{"taken": "_taken", "copies": "_copies"}.get(c, c) for c in docs.columns] + ["taken", "copies"]
    assert {r["doc_id"]: r["taken"] for r in out.collect()} == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_rows_of_one_id_and_none_are_drawn_to_the_number(spark, tmp_path, monkeypatch):
    """Many rows with one id, without one, and of one length; with and without broadcasts."""
    rows = [(7, "w w w", "en", "a")] * 300 + [(None, "w w w", "en", "a")] * 200 + [(i, "w w w", "en", "b") for i in range(100, 400)] + [(i, "w", "en", "b") for i in range(900, 905)]
    docs = documents(spark, tmp_path, rows)
    seen = []
    for most in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows)
        for source, size in (("a", 1500), ("b", 905)):
            own = [r for r in got if r["source_size"] == size]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 and {r["copies"] for r in own if r["size"] == 3} <= {own[0]["copies"], 0, 1, 2, 3}
        seen.append(sorted(map(str, got)))
        assert sum(r["taken"] for r in mixing.mixed_documents(docs).collect()) == sum(r["taken"] for r in got)
    assert seen[0] == seen[1]


def test_mix_of_odd_rows(spark, tmp_path):
    docs = documents(spark, tmp_path)
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0
    only = documents(spark, tmp_path / "e", [(1, None, "en", "s"), (2, " ", "en", None)])
    assert [(r["size"], r["taken"]) for r in mixing.mix(only).collect()] == [(0, 0), (0, 0)]


# Suffix trees


def base_scores(rows):
    train, held = Counter(), {}
    for i, text, *_ in rows:
        held[i] = zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
        if not held[i]:
            train.update([*words(text), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, text, *_ in rows:
        t = [*words(text), None]
        out[i] = (held[i], len(t), sum(train[w] > 0 for w in t), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t))
    return out, train


def test_base_scores_of_odd_rows(spark, tmp_path):
    got = pst.score(documents(spark, tmp_path)).collect()
    want, _ = base_scores(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6 * abs(w[4])
            assert math.isfinite(r["score"])
    assert pst.score(documents(spark, tmp_path / "e", []).limit(0)).count() == 0


def test_tree_scores_held_out_texts_better_and_its_distributions_sum_to_one(spark, tmp_path):
    rng = random.Random(7)
    follow = {w: rng.sample([f"w{j}" for j in range(60)], 3) for w in [f"w{j}" for j in range(60)]}
    rows = []
    for i in range(400):
        w, out = rng.choice(list(follow)), []
        for _ in range(60):
            out.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(list(follow))
        rows.append((i, " ".join(out), "en", "s"))
    docs = documents(spark, tmp_path, rows)
    got = pst.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > 0.75 * got["b"]
    model, vocabulary = pst.train(docs.where("doc_id % 2 = 0").select("text"))
    assert len(model.next1) and len(model.pair)
    a, root = model.alphabet, (model.count + 1) / (model.total + model.distinct + 1)
    assert abs(root.sum() + (model.distinct - len(root)) * 0 + 1 / (model.total + model.distinct + 1) - 1) < 1e-9
    for s in range(a):
        explicit = model.prob1[model.next1 // a == s].sum()
        assert abs(explicit + model.stay1[s] - 1) < 1e-9
    for s in range(len(model.pair)):
        assert abs(model.prob2[model.next2 // a == s].sum() + model.stay2[s] - 1) < 1e-9


def brute_tree_scores(rows, depth):
    """log10 probabilities of all texts, by counts of every run of words in a dictionary."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    texts = {i: [*words(t), None] for i, t, *_ in rows}
    n = Counter(tuple(t[j - k : j + 1]) for i, t in texts.items() if not held[i] for k in range(depth + 1) for j in range(k, len(t)))
    total, distinct = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    repeated = {}
    for g, c in n.items():
        if len(g) > 1 and c >= pst.LEAST:
            repeated.setdefault(g[:-1], {})[g[-1]] = c
    after, stay, open_ = {}, {}, {}

    def p(ctx, w):
        if not ctx:
            return (n[(w,)] + 1) / (total + distinct + 1)
        low = p(ctx[1:], w)
        if ctx not in stay:
            return low
        c = after[ctx].get(w, 0)
        return (c - pst.DISCOUNT if c else 0) / n[ctx] + stay[ctx] * low

    def may_gain(g):
        if g not in open_:
            c, known = n[g], len(g) == 1 or g[-1] in after.get(g[:-1], {})
            open_[g] = c >= pst.LEAST and known and c * -math.log(p(g[:-1], g[-1])) >= pst.GAIN
        return open_[g]

    for ctx in sorted(repeated, key=len):
        # a successor counts while its run in the shorter context may gain
        after[ctx] = {w: c for w, c in repeated[ctx].items() if may_gain((*ctx[1:], w))}
        if not after[ctx]:
            continue
        size, above = n[ctx], {w: p(ctx[1:], w) for w in after[ctx]}
        gain = sum(c / size * math.log(c / size / above[w]) for w, c in after[ctx].items())
        rest, rest_above = (max(1 - x, 1e-12) for x in (sum(after[ctx].values()) / size, sum(above.values())))
        if size * (gain + rest * math.log(rest / rest_above)) >= pst.GAIN:
            stay[ctx] = 1 - sum(c - pst.DISCOUNT for c in after[ctx].values()) / size
    return {i: sum(math.log10(p(tuple(t[max(0, j - depth) : j]), w)) for j, w in enumerate(t)) for i, t in texts.items()}, stay


def test_tree_grows_with_the_corpus_and_scores_like_counts_in_memory(spark, tmp_path, monkeypatch):
    """A passage that occurs in few documents is learned whatever else the corpus holds, also beyond two words."""
    monkeypatch.setattr(pst, "RUN_LOOKUP", 20)  # so that most values come by the exchange
    monkeypatch.setattr(pst, "LOOKUP", 20)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(100)), "en", "s") for i in range(300)]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2]
    passage = " ".join(f"w{rng.randrange(40)}" for _ in range(40))
    for i in [held[0], *[i for i in range(300) if i not in held][:3]]:
        rows[i] = (i, rows[i][1] + " " + passage, "en", "s")
    got = {r["doc_id"]: r["score"] for r in pst.score(documents(spark, tmp_path, rows)).collect()}
    want, stay = brute_tree_scores(rows, pst.DEPTH)
    assert {1, 2, 3} <= {len(c) for c in stay}
    assert all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)
    with monkeypatch.context() as m:
        m.setattr(pst, "BITS", 6)  # bit maps so full that they let every run through
        m.setattr(pst, "BLOCK", 6)
        got = {r["doc_id"]: r["score"] for r in pst.score(documents(spark, tmp_path / "full", rows)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)
    more = rows + [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(2000)), "en", "s") for i in range(300)]
    short = pst.score(documents(spark, tmp_path / "more", [*more, (held[0] + 10**6, "", "en", "s")])).where(F.col("doc_id") == held[0]).first()
    gap = short["score"] - short["base_score"]
    assert gap > 40  # the passage's 40 words, by their contexts of three words


# The pipeline


def test_pipeline_on_planted_documents(spark, sf, tmp_path):
    import corpus_pipeline as pipeline

    rows = rated(11, 300)
    docs = [r[:4] for r in rows if r[4] == 2]
    bench = "the committee on rivers measured every bridge in the valley twice before the flood"
    extra = [(1000, "stone river " * 3 + bench.upper() + " green walk", "en", "s"), (1001, docs[0][1], "en", "t"), (1002, docs[1][1] + " write to jo@corp.example.org now", "en", "t")]
    junk = [r[:4] for r in rows if r[4] == 0][:40]
    home = tmp_path / "sf"
    spark.createDataFrame(docs + junk + extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[4] > 0), int(r[4] == 1)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    now = shared.table(spark, str(home), "documents")
    seen = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, now, str(home))
        after.write.parquet(f"{tmp_path}/{name}")
        last, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        assert name == "source_mixing" or now.columns == last.columns
    clean = {d[0] for d in docs}
    kept = list(seen.values())
    assert len(clean & set(kept[0])) >= 0.97 * len(clean) and len(set(kept[0]) & {j[0] for j in junk}) <= 2
    assert 1001 not in kept[1] and 1000 not in kept[2] and (1000 in kept[1]) == (1000 in kept[0])
    if 1002 in kept[3]:
        assert "[EMAIL]" in kept[3][1002]["text"] and "@" not in kept[3][1002]["text"]
    assert set(kept[3]) == set(kept[2]) and set(kept[4]) <= set(kept[3])
    assert pipeline.run(spark, str(home)).count() == len(kept[4])
    assert set(registry.QUERIES) <= set(__import__("__spark_entry__").queries())
