"""Boilerplate on large hosts."""

import random

from tapeloom.llm import htmltext


def test_large_host_without_markup_keeps_its_text(spark):
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}w{i}" for i in range(6)) for k in range(150)]  # each stands on many pages
    menu, legal = "Home Products About Contact", " ".join(f"legal{i}" for i in range(25))
    texts = [[" ".join([f"n{page}b{b}"] + rng.sample(phrases, 3)) + "." for b in range(3)] for page in range(3000)]
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>" + "</div><div>".join(t) + f" {legal}</div>") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert all(found[i] == "\n".join(t) for i, t in enumerate(texts))


def main_text_of(page):
    return [text for zone, text in htmltext.blocks(page) if zone == "main"]


def test_names_alone_delete_nothing_that_is_not_furniture():
    page = (
        '<article><div class="article-header"><h1>Head</h1></div><p class="social-policy">one</p><p class="ad-hoc">two</p><div id="form-of-life">three</div>'
        '<header class="header">four</header><div class="ad">x</div><div class="ad-banner">x</div><div class="user-responses">x</div><section class="discussion">x</section>'
        '<div class="share-buttons">x</div><ul class="comment-list"><li>x</ul></article>')
    assert main_text_of(page) == ["Head", "one", "two", "three", "four"]


def test_attribute_values_of_any_length():
    value = "data:image/svg+xml,<svg><p>leak</p></svg>" * 4000
    assert main_text_of(f'<article><p>a<img src="{value}" alt="z"> b</p><p title=\'{value}\'>c</p></article>') == ["a b", "c"]
    assert main_text_of('<article><p alt="5" 3">kept</p><p>x = "y" > z</p></article>') == ["kept", 'x = "y" > z']


def test_broken_markup_is_read_in_linear_time():
    import time

    start = time.perf_counter()
    for part in ('<a "', '<a b="', "<a b='\"", "<", "<a =", "<!--", '<a b="x">', "</", "<p x='>"):
        htmltext.blocks("<article>" + part * 200_000)
    assert time.perf_counter() - start < 60
