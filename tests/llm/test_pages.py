"""Pages whose markup leaves things out, misleads or is hostile, and what the tree makes of blocks."""

import random
import re
import time

import numpy as np
import pytest

from proofyard.llm import html_text, html_training

STORY = "The committee met again on Tuesday to settle how the river should be measured, who would keep the records, and what should happen next."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>T</title><body><article><h1>Rivers</h1><p>{STORY}</p></article>", f"Rivers\n\n{STORY}"),
        (f"<article class='post-with-sidebar'><p>{STORY}</p></article>", STORY),
        (f"<body class='has-ads menu'><p>{STORY}</p><p>{STORY}</p></body>", f"{STORY}\n\n{STORY}"),
        (f"<article><p>{STORY}</p><p>Let <math><mi>x</mi></math> be <object>one</object> of <canvas>the</canvas> <noscript>few</noscript>.</p></article>", f"{STORY}\n\nLet x be one of the few."),
        (f"<article><p>{STORY}<p>The.<p>Is.</article><footer>&copy; A company of some name.</footer>", f"{STORY}\n\nThe.\n\nIs."),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><p><a href=x>See the survey.</a></p><p>{STORY}</p></article>", f"See the survey.\n\n{STORY}"),
        (f"<form><div class=menu><a href=x>Home</a></div><div><p>{STORY}</p><p>{STORY}</p></div></form>", f"{STORY}\n\n{STORY}"),
        (f"<div><a href=a>Home</a> <a href=b>News</a></div><div><p>{STORY}</p><p>{STORY}</p></div><div><a href=c><h3>Next</h3><p>Another story of ours</p></a></div>", f"{STORY}\n\n{STORY}"),
        ("<p>One short line.</p>", "One short line."),
        (f"<article><p>{STORY}</p><p title='a > b'>If a &lt; b then</p><p x=\"1\" y='2>3'>so</p></article>", f"{STORY}\n\nIf a < b then\n\nso"),
    ],
)
def test_articles_are_whole(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("unit", ["<p x ", "<a '", "<a x=\"'", "<div></section>", "<div><section></div>", "<!x", "<script>", "<head>", "<svg>", "</", "<a><b>", "&#x", "<p class=\"", "<article><p>x<div class=ad>", "<a 'x' \""])
def test_hostile_markup_takes_time_in_proportion(unit):
    for size in (100_000, 400_000):
        began = time.process_time()
        html_text.main_text(unit * (size // len(unit)))
        took = time.process_time() - began
    assert took < 8


def test_tree_rests_on_words_and_links():
    """Each feature of the method is used; names of classes put in at random change little."""
    used = set()

    def walk(node):
        if not isinstance(node, bool):
            used.add(html_text.FEATURES[node.feature])
            walk(node.left)
            walk(node.right)

    tree = html_text.trained()
    walk(tree)
    assert {"words", "link density", "words before", "words after", "link density before", "link density after"} <= used
    names = "menu footer content post sidebar comments related ad main x9".split()
    rng = random.Random(3)
    changed = [re.sub(r"class=('[^']*'|[^\s>]+)", lambda m: "class=" + rng.choice(names), p) for p in html_training.PAGES]
    share = lambda pages: np.mean([html_text.is_main(tree, x) == b.label for p in map(html_text.blocks, pages) for b, x in zip(p, html_text.features(p).tolist())])
    assert share(html_training.PAGES) > 0.97 and share(changed) > 0.94
    assert sum(len(html_text.blocks(p)) for p in html_training.PAGES) >= 100


def test_layouts_not_seen():
    """Blocks of each layout by a tree grown from the other layouts."""
    pages = [html_text.blocks(p) for p in html_training.PAGES]
    right = total = 0
    for held in range(len(html_training.LAYOUTS)):
        rest = [p for i, p in enumerate(pages) if i // html_training.FILLINGS != held]
        tree = html_text.grow(np.vstack([html_text.features(p) for p in rest]), np.array([b.label for p in rest for b in p]))
        for p in pages[held * html_training.FILLINGS : (held + 1) * html_training.FILLINGS]:
            right += sum(html_text.is_main(tree, x) == b.label for b, x in zip(p, html_text.features(p).tolist()))
            total += len(p)
    assert right / total > 0.88


def test_supplied_pages_keep_their_articles(spark, sf):
    """Against a cut at the article's tags and paragraphs, which these pages all have."""
    import html

    rows = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
        assert r["text"] == "\n\n".join(x for x in parts if x)
