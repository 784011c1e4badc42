"""HTML extraction on generated pages whose article is known, since the generator writes it."""

import random

import pytest

from lumaframe.llm.html_text import FEATURES, extract_text, main_text, trained_tree

WORDS = "time river stone green paper music hill cloud bread light winter garden ship letter north story market glass road horse".split()


class Page:
    def __init__(self, seed: int, container: str, wrapper: str):
        self.rng, self.want, self.container, self.wrapper = random.Random(seed), [], container, wrapper

    def words(self, low, high):
        return " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(low, high)))

    def link(self, low=1, high=3):
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high)}</a>'

    def links(self, n=6):
        return "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(4, n)))

    def nuisance(self, kinds):
        r = self.rng
        made = {
            "menu": lambda: r.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="main-nav">{}</ul>']).format(self.links()),
            "header": lambda: r.choice(["<header><p>{}</p></header>", '<div class="site-header">{}</div>', '<div id="masthead"><h2>{}</h2></div>']).format(self.words(1, 6)),
            "footer": lambda: r.choice(["<footer><p>&copy; {}</p></footer>", '<div class="footer">&copy; {}</div>']).format(self.words(2, 14)),
            "sidebar": lambda: r.choice(["<aside><h3>{}</h3><p>{}</p></aside>", '<div class="sidebar"><h3>{}</h3><p>{}</p></div>']).format(self.words(1, 3), self.words(5, 50)),
            "notice": lambda: r.choice(['<div class="cookie-notice"><p>{}</p></div>', '<div id="gdpr">{}</div>', '<p class="notice">{}</p>']).format(self.words(4, 30)),
            "advert": lambda: r.choice(['<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<section class="sponsored">{}</section>']).format(self.words(4, 40)),
            "form": lambda: f"<form><label>{self.words(1, 2)}</label><input name=q><button>{self.words(1, 2)}</button><p>{self.words(2, 9)}</p></form>",
            "script": lambda: f'<script>var t = "<p>{self.words(3, 9)}</p>";</script>',
            "style": lambda: "<style>p > a { margin: 0 }</style>",
            "markup": lambda: f"<!-- <p>{self.words(3, 20)}</p> -->",
            "comments": lambda: r.choice(['<section class="comments">{}</section>', '<div id="comments"><ol>{}</ol></div>']).format("".join(f'<div class="comment"><p>{self.words(3, 60)}</p></div>' for _ in range(r.randint(1, 4)))),
        }
        return "".join(made[k]() for k in kinds if r.random() < 0.7)

    def paragraph(self, low, high):
        plain, parts = [], []
        for _ in range(self.rng.randint(1, 3)):
            text = self.words(low, high)
            plain.append(text + " &amp; co")
            parts.append(f"{text}\n  &amp; co")
            if self.rng.random() < 0.3:
                linked = self.words(1, 3)
                plain.append(linked)
                parts.append(f'<a href="/x"><b>{linked}</b></a>')
        self.want.append(" ".join(plain).replace("&amp;", "&"))
        return f"<p>{' '.join(parts)}</p>"

    def article(self, nuisances):
        title, out = self.words(3, 9), []
        self.want.append(title)
        for k in range(self.rng.randint(3, 7)):
            out.append(self.paragraph(15, 60))
            if self.rng.random() < 0.3:
                self.want.append(short := self.words(2, 7))
                out.append(f"<h2>{short}</h2>" + self.paragraph(12, 40) if self.rng.random() < 0.5 else f"<p>{short}</p>" + self.paragraph(12, 40))
            if nuisances and self.rng.random() < 0.3:
                out.append(self.nuisance([self.rng.choice(nuisances)]))
        return f"<h1>{title}</h1>" + "".join(out)

    def html(self):
        before = self.nuisance(["menu", "header", "notice", "script", "style"])
        inside = ["advert", "form", "script", "markup", "sidebar", "notice"] if self.container != "none" else ["script", "markup", "advert"]
        body = self.article(inside)
        after = self.nuisance(["sidebar", "comments", "advert", "form", "menu", "footer"])
        holder = {"article": "<article>{}</article>", "main": "<main><div class='post'>{}</div></main>", "none": "<div class='story'>{}</div>"}[self.container]
        around = {"": "{}", "sidebar": "<div class='layout-with-sidebar'>{}</div>", "header": "<div class='has-header'>{}</div>", "search": "<div id='search-result-page'>{}</div>", "form": "<form id='page' method=post>{}</form>"}[self.wrapper]
        page = around.format(before + holder.format(body) + after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{page}</body></html>", "\n".join(self.want)


CASES = [(seed, container, wrapper) for seed, container in enumerate(["article", "main", "none"] * 34) for wrapper in ("", "sidebar", "header", "search", "form")]


@pytest.fixture(scope="module")
def pages():
    return {case: Page(*case).html() for case in CASES}


def test_tree_reads_words_and_both_neighbours():
    used = set()

    def walk(tree):
        if not isinstance(tree, bool):
            used.add(FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(trained_tree())
    assert {"words", "links", "place", "tag", "hint", "share"} <= used
    assert used & {"words_before", "links_before"} and used & {"words_after", "links_after"}


def test_pages_with_an_article(pages):
    wrong = [case for case, (html, want) in pages.items() if case[1] != "none" and main_text(html) != want]
    assert not wrong


def test_pages_without_an_article(pages):
    plain = {case: page for case, page in pages.items() if case[1] == "none"}
    lost = kept = right = 0
    for html, want in plain.values():
        got, lines = main_text(html).split("\n"), want.split("\n")
        right += len(set(got) & set(lines))
        lost += len(set(lines) - set(got))
        kept += len(set(got) - set(lines))
    assert lost <= 0.01 * right and kept <= 0.03 * right, (right, lost, kept)


def test_query_form_of_the_same(spark, pages):
    some = list(pages.items())[:60]
    rows = extract_text(spark.createDataFrame([(i, "u", html, 3) for i, (_, (html, _)) in enumerate(some)], "page_id long, url string, html string, n_chars int")).collect()
    assert {r.page_id: r.text for r in rows} == {i: main_text(html) for i, (_, (html, _)) in enumerate(some)}
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
