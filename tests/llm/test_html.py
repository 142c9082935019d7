"""Main text of odd and damaged pages."""

import time

import pytest

from framegauge.llm.html_extract import extract_pages, main_text

SENTENCES = "This is a long paragraph, with marks; and words of all kinds. " * 5
P = f"<p>{SENTENCES}</p>"


def _count(html):
    return main_text(html).count("This is")


def test_link_lists_between_parts_of_the_content_go():
    page = f"<body><div>{P}</div><ul><li><a href=1>link one</a><li><a href=2>link two</a></ul><div><h2>Part two</h2>{P}</div></body>"
    assert main_text(page) == " ".join(f"{SENTENCES} Part two {SENTENCES}".split())


def test_forms_around_a_page_are_content_and_others_not():
    wrapped = f'<form id="aspnetForm"><div class="sidebar">side text here</div><div>{P}{P}</div><div class="search">find it <input></div></form>'
    assert main_text(wrapped) == " ".join((SENTENCES * 2).split())
    assert main_text(f"<div>{P}</div><form><p>Your name, please, and all the rest of it.</p></form>") == SENTENCES.strip()


def test_a_word_of_the_article_outweighs_a_weak_name():
    page = f'<div class="content"><div class="post-header"><h1>The headline</h1></div>{P}<div class="share-story">{P}</div><div class="share-buttons">Share it</div></div>'
    assert main_text(page) == " ".join(f"The headline {SENTENCES} {SENTENCES}".split())


def test_reader_comments_go_even_where_they_are_most_of_the_page():
    assert _count(f'<div class="content">{P}</div><div class="post-comments">{P * 9}</div>') == 5


@pytest.mark.parametrize("wrapper", ['<div class="post has-comments">', '<div id="page" class="single comments-open">', '<div class="post no-comments">', '<body class="comments-closed"><div>', '<div class="comments-wrapper"><div class="comments"><p>A reader says this, and that.</p></div>'])
def test_wrappers_that_tell_of_comments_are_content(wrapper):
    assert main_text(f"<nav>menu</nav>{wrapper}<h1>The headline</h1>{P}{P}</div><footer>foot</footer>") == " ".join(f"The headline {SENTENCES} {SENTENCES}".split())


def test_threads_of_comments_go_with_all_inside():
    thread = f'<div class="comments"><h3>9 comments</h3>{"".join(f"<div class=comment>{P}</div>" for _ in range(9))}</div>'
    assert main_text(f'<div class="content"><h1>The headline</h1>{P}</div>{thread}') == " ".join(f"The headline {SENTENCES}".split())


@pytest.mark.parametrize("page", [
    "<h1>The headline</h1><div class=content>{0}{0}</div>", '<div class="title"><h1>The headline</h1></div><div class="content">{0}{0}</div>',
    '<div class="post"><header class="entry-header"><h1>The headline</h1></header>{0}{0}</div>', '<div class="hentry"><header><h1>The headline</h1></header><div class="text">{0}{0}</div></div>',
    '<header><h1>The site</h1></header><h1><a href="/">The site</a></h1><h1>The headline</h1><ul class="menu"><li>a menu</ul><div>{0}{0}</div><h1>Something else</h1>',
    '<main><h1>The headline</h1><div class="meta"><a href="/a">An author</a></div><div class="body">{0}{0}</div></main>',
])
def test_headlines_belong_to_the_content(page):
    text = main_text(f"<html><body>{page.format(P)}<div class=sidebar>side text</div></body></html>")
    assert text == " ".join(f"The headline {SENTENCES} {SENTENCES}".split())


def test_damaged_markup_does_not_leak():
    assert main_text(f"<a href=it's>x</a>{P}") == "x " + SENTENCES.strip() or main_text(f"<a href=it's>x</a>{P}") == SENTENCES.strip()
    assert "it's" not in main_text(f"<a href=it's>x</a>{P}") and main_text("<p>x</p><b") == "x"
    assert main_text(f"<head><title>t</title>{P}") == SENTENCES.strip()
    assert main_text("a < b and c > d, 1 <2 <3") == "a < b and c > d, 1 <2 <3"


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div>x y ", "<b>x ", "<script></script ", "<!--", "<ul><li>a ", '<a b="c ', "<p></i>", "<i><div></i>"])
def test_time_grows_in_proportion(piece):
    def seconds(n):
        began = time.process_time()
        main_text(piece * (n // len(piece)))
        return time.process_time() - began

    seconds(10_000)
    assert seconds(1 << 20) < 6


def test_rows_of_pages(spark):
    rows = [(1, "u", f"<div>{P}</div>"), (1, "u", f"<div>{P}</div>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "Words, and more. " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), str(r.url), r.n_chars) for r in extract_pages(pages).collect())
    size = len(SENTENCES.strip())
    assert got == [("1", "u", size), ("1", "u", size), ("2", "None", 0), ("3", "w", 1_699_999), ("None", "v", 0)]
    assert extract_pages(pages.limit(0)).count() == 0
