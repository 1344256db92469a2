"""The small labelled table that the block classifier is trained on: pages written for it by a rule, main blocks marked.

Each layout is a page with marks for blocks of text; it is filled a few times with runs of sentences of other lengths and
with names of classes that say nothing, that tell, or that mislead, so that no single feature decides."""

from __future__ import annotations

import random

SENTENCES = [
    "The committee met again on Tuesday to settle how the river should be measured.",
    "Most of the stations were built by hand, and some of them still stand.",
    "Nobody could say who would keep the records.",
    "What should happen when two of them disagree about the height of the water was left open.",
    "It rained.",
    "Two boards of pine and eight screws are all that is needed for a shelf of this size, with a saw and an hour of time.",
    "She had walked the same road for thirty years without meeting anyone she knew.",
    "Prices rose by four per cent in the first half of the year.",
    "Why?",
    "The old bridge was closed to carts in the spring of that year, and the ferry took over until the new one opened.",
]
WORDS = "home news sports opinion archive about contact weather travel books music shop cart prices jobs events photos maps".split()
COUNTS = {"tiny": (0, 0), "short": (1, 1), "middle": (2, 3), "long": (4, 6)}
# Fields: {m:size} a main text, {o:size} one of another kind, {l:n} a list of n links, {t} a heading, {w} a linked word,
# {x:name} the attribute of a container that is no part of the article, {y} that of one that is.
LAYOUTS = [
    "<header><a href=/>{w}</a> {o:tiny}</header><nav>{l:6}</nav><article><h1 M>{t}</h1><p M>{m:long}</p><p M>{m:short}</p><p M>{m:tiny}</p><p M>{m:middle}</p></article><aside><h3>{t}</h3>{l:5}<p>{o:middle}</p></aside><footer>{o:short}</footer>",
    "<nav>{l:6}</nav><div{x:ad}>{o:tiny}</div><article><h1 M>{t}</h1><p M>{m:tiny}</p><p M>{m:short}</p><p M>{m:long}</p></article><footer>{o:tiny}</footer>",
    "<div{x:ad}>{o:short}</div><main{y}><h1 M>{t}</h1><p M>{m:middle}</p><ul><li M>{m:tiny}</li><li M>{m:tiny}</li><li M><a href=x>{m:tiny}</a></li></ul><p M>{m:long}</p><div class=comments><h2>{t}</h2><p>{o:middle}</p><p>{o:short}</p></div></main><div>{o:short}</div>",
    "<article{y}><header><h1 M>{t}</h1><p M>{m:short}</p></header><p M>{m:long}</p><h2 M>{t}</h2><p M><a href=x>{m:short}</a></p><p M>{m:middle}</p><div class=related><h3>{t}</h3>{l:4}</div></article><section class=comments><p>{o:long}</p></section>",
    "<article{y}><p M>{m:long}</p><ul><li M><a href=x>{m:short}</a></li><li M><a href=x>{m:tiny}</a></li><li M><a href=x>{m:short}</a></li></ul><p M>{m:middle}</p></article><div>{l:4}</div><p>{o:short}</p>",
    "<article{y}><h1 M>{t}</h1><p M>{m:middle}</p><aside><p>{o:middle}</p></aside><p M>{m:short}</p><form><p>{o:short}</p><label>{t}</label><button>{t}</button></form><nav>{l:3}</nav></article><footer><p>{o:long}</p></footer>",
    "<div{x:menu}>{l:7}</div><div{y}><h1 M>{t}</h1><p M>{m:long}</p><p M>{m:short}</p><p M>{m:long}</p><p M>{m:tiny}</p><p M>{m:middle}</p></div><div{x:related}>{l:5}</div><div{x:footer}><p>{o:tiny}</p><p><a href=x>{w}</a> <a href=y>{w}</a></p></div>",
    "<table><tr><td{x:sidebar}>{l:5}</td><td{y}><h2 M>{t}</h2><p M>{m:long}</p><p M>{m:middle} <a href=x>{w}</a></p><p M>{m:long}</p></td></tr></table><p><a href=x>{w}</a> | <a href=y>{w}</a> | {o:tiny}</p>",
    "<div>{l:4}</div><div{y}><p M>{m:long}</p><p M>{m:long}</p><h3 M>{t}</h3><p M>{m:long}</p><p M>{m:middle}</p></div><div>{l:8}</div>",
    "<div{x:header}><p><a href=/>{w}</a></p><p>{o:tiny}</p></div><div>{l:5}</div><div{y}><h1 M>{t}</h1><p M>{m:middle}</p><p M>{m:long}</p><blockquote M>{m:middle}</blockquote><p M>{m:middle}</p></div><div class=comments><p>{o:middle}</p><p>{o:long}</p></div><div{x:footer}>{o:short}</div>",
    "<form><div>{l:6}</div><div{y}><h1 M>{t}</h1><p M>{m:long}</p><p M>{m:long}</p><p M>{m:long}</p></div><div{x:newsletter}><p>{o:short}</p></div></form>",
    "<div{y}><p M>{m:long}</p><p M>{m:middle}</p></div>",
    "<div{y}><h1 M>{t}</h1><p M>{m:short}</p><p M>{m:tiny}</p><p M>{m:middle}</p></div><ul>{l:3}</ul>",
    "<div class=cookie-notice><p>{o:middle}</p><button>{w}</button></div><div>{l:6}</div><article><h1 M>{t}</h1><p M>{m:long}</p><p M>{m:tiny}</p><figure><figcaption M>{m:short}</figcaption></figure><p M>{m:long}</p></article><div>{o:middle}</div><div class=comment-list><article><p>{o:middle}</p></article><article><p>{o:short}</p></article></div>",
    "<nav>{l:5}</nav><article{y}><h1 M>{t}</h1><p M>{m:tiny}</p><p M>{m:tiny}</p><p M>{m:long}</p><p M>{m:tiny}</p></article><footer>{o:middle}</footer>",
    "<p>{o:tiny}</p><article{y}><p M>{m:tiny}</p><p M>{m:tiny}</p><p M>{m:tiny}</p><p M>{m:tiny}</p><p M>{m:short}</p></article><p>{o:tiny}</p><p>{o:short}</p>",
    "<div{x:ad}>{o:tiny}</div><main><p M>{m:long}</p><p M>{m:long}</p><p M>{m:tiny}</p><ol><li M>{m:tiny}</li><li M>{m:tiny}</li></ol></main><div>{o:tiny}</div><footer>{o:tiny}</footer>",
    "<article><h1 M><a href=x>{t}</a></h1><p M><a href=x>{m:tiny}</a></p><p M>{m:middle}</p><p M><a href=x>{m:short}</a></p></article><nav>{l:4}</nav><p><a href=x>{w}</a></p>",
    "<nav>{l:4}</nav><article><h1 M>{t}</h1><p M>{m:middle}</p><p M>{m:tiny}</p><p M>{m:short}</p></article>",
    "<p>{o:short}</p><main><p M>{m:long}</p><p M>{m:long}</p><p M>{m:long}</p><p M>{m:long}</p><p M>{m:tiny}</p></main>",
    "<p M>{m:short}</p>",
    "<p M>{m:tiny}</p>",
    "<h1 M>{t}</h1><p M>{m:short}</p>",
    "<div{y}><p M>{m:short}</p><p M>{m:middle}</p><p M>{m:short}</p></div>",
    "<div{y}><h2 M>{t}</h2><p M>{m:middle}</p><p M>{m:long}</p><p M>{m:short}</p></div>",
    "<div{y}><p>{w} <a href=x>{w}</a> <a href=y>{w}</a></p><p M>{m:long}</p><p M>{m:long}</p><p><a href=x>{w}</a> <a href=y>{w}</a> <a href=z>{w}</a></p></div>",
]
NAMES = [" class=c{i}", "", " class={name}"]
MISLEADING = ["", " class=content", " class=post-with-sidebar", " class='has-menu post'", " id=a7"]
FILLINGS = 6


def _filled(layout: str, rng: random.Random) -> str:
    out = []
    for part in layout.replace(" M>", " data-main>").split("{"):
        code, brace, rest = part.partition("}")
        if not brace:
            out.append(part)
            continue
        kind, _, what = code.partition(":")
        if kind in "mo":
            low, high = COUNTS[what]
            n = rng.randint(low, high)
            text = " ".join(rng.choices(SENTENCES, k=n)) if n else " ".join(rng.choices(WORDS, k=rng.randint(1, 4))).capitalize() + rng.choice([".", ""])
        elif kind == "l":
            text = "<ul>" + "".join(f"<li><a href=/{w}>{w.title()}{rng.choice(['', ' ' + rng.choice(WORDS)])}</a></li>" for w in rng.sample(WORDS, int(what))) + "</ul>"
        elif kind == "t":
            text = " ".join(rng.choices(WORDS, k=rng.randint(1, 7))).capitalize()
        elif kind == "w":
            text = rng.choice(WORDS)
        elif kind == "x":
            text = rng.choice(NAMES).format(i=rng.randint(1, 9), name=what)
        else:
            text = rng.choice(MISLEADING)
        out.append(text + rest)
    return "<html><head><title>Page</title></head><body>" + "".join(out) + "</body></html>"


PAGES = [_filled(layout, random.Random(1000 * i + j)) for i, layout in enumerate(LAYOUTS) for j in range(FILLINGS)]
