"""Main text of pages, and benchmark decontamination against exact edit distances."""

from __future__ import annotations

import random
import time

import pytest

from cadenza.llm import decontamination as dc
from cadenza.llm import tag_paths

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p {color: red}</style><script>var a = "<p>no</p>";</script></head>
<body><header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>Fine</button></div>
<main><article><h1>The  headline</h1><p>First &eacute;t&eacute; of the&nbsp;story, with <b>bold</b> words, commas, and more.
Second line of it.</p><div class="ad">Buy now!</div><p>Second paragraph, a good deal longer than a menu entry &lt;b&gt;, really.</p>
<ul><li>point one, short</li><li>point two, short</li></ul></article>
<section id="comments"><p>Great article, thanks, I liked it very much, truly!</p></section></main>
<aside><p>Related: other stories, many of them.</p></aside><form><p>Sign up, please.</p></form><footer>All rights reserved.</footer></body></html>"""


def test_a_page():
    assert tag_paths.main_text(PAGE).split("\n\n") == [
        "The headline",
        "First été of the story, with bold words, commas, and more. Second line of it.",
        "Second paragraph, a good deal longer than a menu entry <b>, really.",
        "point one, short",
        "point two, short",
    ]


def test_a_page_without_landmarks():
    links = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(20))
    body = "".join(f"<p>Paragraph {k} of the story, which has some length, some commas, and an end.</p>" for k in range(6))
    text = tag_paths.main_text(f'<html><body><div class="x1"><ul>{links}</ul></div><div class="x2">{body}</div><div class="x3"><span>Terms</span></div></body></html>')
    assert text.split("\n\n") == [f"Paragraph {k} of the story, which has some length, some commas, and an end." for k in range(6)]


STORY = [f"Paragraph {k} of the story, which has some length, some commas, and an end." for k in range(6)]
LINKS = "".join(f'<li><a href="/{k}">Another story to read, number {k}</a></li>' for k in range(20))


@pytest.mark.parametrize("tag", ["article", "main", "div role='main'", "div class='x'"])
def test_paths_are_scored_inside_landmarks_too(tag):
    body = "".join(f"<p>{p}</p>" for p in STORY)
    extra = "<div><div>Sign up</div><div>Share it</div></div><div><span>By us</span></div>"
    html = f"<html><body><{tag}><h1>The headline</h1>{body}<ul><li>a plain point</li></ul><ul>{LINKS}</ul>{extra}</{tag.split()[0]}></body></html>"
    assert tag_paths.main_text(html).split("\n\n") == ["The headline", *STORY, "a plain point"]


@pytest.mark.parametrize("name", ["site has-sidebar", "no-sidebar", "content with-sidebar", "header-fixed", "comments-open"])
@pytest.mark.parametrize("tag", ["main", "article", "div role='main'", "div"])
def test_a_name_does_not_remove_the_wrapper_of_the_story(name, tag):
    body = "".join(f"<p>{p}</p>" for p in STORY)
    page = f"<div class='{name}'><div class='top'>Site</div><{tag}>{body}<div class='related'>Other stories</div></{tag.split()[0]}></div>"
    assert tag_paths.main_text(f"<html><body>{page}</body></html>").split("\n\n") == STORY


def test_names_do_not_remove_parts_of_the_story():
    body = ["".join(f"<p>{p}</p>" for p in part) for part in (STORY[:4], STORY[4:])]
    for head in ("<div class='entry-header'><h1>The headline</h1></div>", "<header class='post-header'><h1>The headline</h1></header>", "<div class='top'><h1>The headline</h1></div>"):
        html = f"<html><body><article>{head}{body[0]}<section class='legal-news'>{body[1]}</section><section id='comments'><p>Well said, all of it, I think.</p></section></article></body></html>"
        assert tag_paths.main_text(html).split("\n\n") == ["The headline", *STORY]


@pytest.mark.parametrize("around", ["form id='page'", "div role='dialog'", "dialog", "form class='search'", "div role='search' class='popup'"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_what_holds_the_story_is_no_form(around, inner):
    body = "".join(f"<p>{p}</p>" for p in STORY)
    tag = around.split()[0]
    assert tag_paths.main_text(f"<body><{around}><div>Site</div><{inner}>{body}</{inner}><input></{tag}></body>").split("\n\n") == STORY
    assert tag_paths.main_text(f"<body><article>{body}<{around}><p>Sign up, please, for all of our letters.</p></{tag}></article></body>").split("\n\n") == STORY


def test_classed_parts_of_the_story_stay():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    parts = "<pre class='code'>x = 1</pre><table class='data'><tr><td>one two</td></tr></table><figure class='fig'><figcaption>The caption</figcaption></figure>"
    text = tag_paths.main_text(f"<body><article><p class='lead'>Short lead</p>{body}{parts}<p class='ad'>Buy</p></article></body>")
    assert text.split("\n\n") == ["Short lead", *STORY, "x = 1", "one two", "The caption"]


@pytest.mark.parametrize("unit", ["<div>x, y. ", "<div class=c{}><section>x, y. ", "<li>x, y. ", "<b>x, y. <p>", "<form><article>x. ", "<div></p></b></td>x. ", "<td>x. </ul>"])
def test_deep_markup_takes_seconds(unit):
    html = "".join(unit.replace("{}", str(k)) for k in range(10_000))
    began = time.perf_counter()
    assert tag_paths.main_text(html)
    assert time.perf_counter() - began < 15  # on a machine that tests share; about 3 s on its own


def test_scores_by_brute_force():
    """Aggregation, smoothing over all pairs of paths, fusion and threshold, written out."""
    rng = random.Random(12)
    for _ in range(30):
        parts = [f"<{t} class='{rng.choice(['', 'x', 'sidebar', 'share'])}'>" + "".join(f"<p>{'word, ' * rng.randrange(1, 30)}<a>{'link ' * rng.randrange(0, 6)}</a></p>" for _ in range(rng.randrange(1, 4))) + f"</{t}>" for t in rng.choices(["div", "main", "section", "form"], k=6)]
        reader = tag_paths.Reader()
        reader.feed(f"<html><body>{''.join(parts)}</body></html>")
        reader.close()
        tag_paths.split_links(reader.nodes)
        nodes = [x for x in reader.nodes if x.text.strip() and not x.out]
        paths = {x.path for x in nodes}

        def of(p, f, nodes=nodes):
            return sum(f(x) for x in nodes if x.path == p)

        ratio = {}
        for p in paths:
            blocks = len({x.block for x in nodes if x.path == p})
            ratio[p] = of(p, lambda x: len(x.text.strip())) / blocks, of(p, lambda x: x.text.count(",")) / blocks
        found = tag_paths.scores(reader.nodes)
        assert set(found) == paths
        for p in paths:
            weight = {q: tag_paths.kernel(next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))), len(p), len(q)) for q in paths}
            text, marks = (sum(w * ratio[q][k] for q, w in weight.items()) / sum(weight.values()) for k in range(2))
            chars = of(p, lambda x: len(x.text.strip()))
            want = (ratio[p][0] * (1 + ratio[p][1]) * text * (1 + marks)) ** 0.25 * (1 - of(p, lambda x: x.link * len(x.text.strip())) / chars)
            if any(x.main for x in nodes):
                want *= 0.5 + 0.5 * of(p, lambda x: x.main * len(x.text.strip())) / chars
            want *= min(0.2 if label.endswith("!") else 0.6 if label.endswith("^") else 1.0 for label in p)
            assert found[p] == pytest.approx(want)


def test_a_landmark_does_not_outweigh_the_text_beside_it():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    html = f"<html><body><article>Teaser</article><div class='story'>{body}</div></body></html>"
    assert tag_paths.main_text(html).split("\n\n") == STORY


def test_smoothing_by_brute_force():
    rng = random.Random(4)
    ratio = {tuple(rng.choice("abc") for _ in range(rng.randrange(0, 9))): (rng.random() * 90, rng.random()) for _ in range(300)}
    found = tag_paths.smoothed(ratio)
    for p in ratio:
        weight = {}
        for q in ratio:
            shared = next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
            weight[q] = tag_paths.kernel(shared, len(p), len(q))
        total = sum(weight.values())
        for k in range(2):
            assert found[p][k] == pytest.approx(sum(weight[q] * ratio[q][k] for q in ratio) / total)


def test_many_paths_take_seconds():
    body = "".join(f"<div class='c{k}'><p>Text number {k}, of its own.</p></div>" for k in range(10000))
    began = time.perf_counter()
    assert tag_paths.main_text(f"<html><body>{body}</body></html>")
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("html", ["", "<", "<p", "&amp", "<!-- open", "<p>a<p>b</b></i>", "</div></div>", "<script>x", "<" * 2000, "<div>" * 3000 + "deep", "\x00<p>\x00</p>"])
def test_broken_markup_is_no_crash(html):
    assert isinstance(tag_paths.main_text(html), str)


def test_page_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, tag_paths.extract(df).collect()), key=str)
    text = tag_paths.main_text(PAGE)
    assert out == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", text, len(text))], key=str)
    assert tag_paths.extract(df.limit(0)).count() == 0


def edit_distance(item: list[str], text: list[str]) -> int:
    """To the nearest stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        nxt = [0]
        for i, x in enumerate(item):
            nxt.append(min(row[i] + (x != w), row[i + 1] + 1, nxt[i] + 1))
        row = nxt
        best = min(best, row[-1])
    return best


def test_nearest_stretch():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(5) for _ in range(rng.randrange(0, 30))]
        assert dc.best_match(item, text)[0] == edit_distance(item, text)


def leaky(seed: int, docs: int = 250):
    rng = random.Random(seed)
    vocab = [f"q{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 9, 15, 30, 60])))) for k in range(30)]
    texts = []
    for i in range(docs):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 200))]
        if rng.random() < 0.5:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, dc.edits(len(item)) + 2)):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append((i, ", ".join(words).title()))
    return items, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_by_brute_force(spark, seed):
    items, texts = leaky(seed)
    truth = {(i, k): edit_distance(dc.word_list(a), dc.word_list(t)) for i, t in texts for k, a in items}
    truth = {x: d for x, d in truth.items() if d <= dc.edits(len(items[x[1]][1].split()))}
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(truth.get(x) is not None and d >= truth[x] for x, d in found.items())  # nothing false
    assert len(truth) > 60 and len(found) >= 0.95 * len(truth)
    assert all(x in found for x, d in truth.items() if d == 0)


@pytest.mark.parametrize("words", [10, 30, 42, 43, 60, 120, 250, 500, 1000])
@pytest.mark.parametrize("kind", ["substitutions", "moves"])
def test_recall_at_the_largest_distance(words, kind):
    rng = random.Random(words)
    vocab = [f"q{k}" for k in range(4000)]
    n = 120 if words <= 250 else 40
    items = [(k, [rng.choice(vocab) for _ in range(words)]) for k in range(n)]
    texts = []
    for _, item in items:
        out = list(item)
        for e, at in enumerate(sorted(rng.sample(range(words), dc.edits(words)), reverse=True)):
            if kind == "substitutions":
                out[at] = rng.choice(vocab)
            elif e % 2:
                del out[at]
            else:
                out.insert(at, rng.choice(vocab))
        texts.append(" ".join([rng.choice(vocab) for _ in range(30)] + out + [rng.choice(vocab) for _ in range(30)]))
    index = dc.Index([(k, " ".join(w)) for k, w in items])
    found = {(i, k) for i, k, *_ in dc.scan(index, list(range(n)), texts)}
    assert sum((k, k) in found for k in range(n)) >= 0.95 * n


def test_memory_does_not_follow_the_longest_item():
    index = dc.Index([(0, " ".join(f"w{k}" for k in range(20000)))])
    assert max(index.lengths) <= dc.PIECE and sum(x.nbytes for x in index.random) == 8 * dc.REPEATS * 20002


def test_leaks_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A b, c d e!", 1), (1, "a b c d e", 1), (None, "z a b c d e", 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([("i", "a b c d e"), ("i", "a b c d e"), ("n", None), ("e", " .")], "item_id string, text string")
    found = sorted([(r["doc_id"], r["item_id"], r["distance"]) for r in dc.leaks(docs, bench).collect()], key=str)
    assert found == sorted([(1, "i", 0)] * 4 + [(None, "i", 0)] * 2, key=str)
    assert dc.leaks(docs, bench.limit(0)).count() == dc.leaks(docs.limit(0), bench).count() == 0
    assert sorted([r["doc_id"] for r in dc.without_leaks(docs, bench).collect()], key=str) == [2, 3, None]
    assert dc.without_leaks(docs, bench).columns == docs.columns
