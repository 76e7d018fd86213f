"""Names, links and languages of pages, and both passes against a plain form."""

import random
import time

import pytest

from tabloom.llm import html
from tabloom.llm.html import Block

ONE = "It was the best of times and it was the worst of times for all of the people that were in the city on that day."
TWO = "And so it was that they had to go to the river and to the hill and to the sea, for there was no other way to be in the house."


@pytest.mark.parametrize("name", ["ad-hoc-analysis", "cookie-recipe", "cookies-of-the-world", "newsletter-history", "sponsor-history", "widget", "related", "ad-free-media", "history-of-advertising", "share-of-the-market"])
def test_names_of_subjects_are_text(name):
    for page in ("<article><div class='{}'><p>{}</p></div></article>", "<div class='{}'><p>{}</p></div>", "<article><p>" + TWO + "</p><div class='{}'><p>{}</p></div></article>"):
        assert html.main_text(page.format(name, ONE)).endswith(ONE), page


@pytest.mark.parametrize("name", ["cookie-bar", "ad-top", "ads", "newsletter-signup-form", "cookie-consent-banner", "google-ads", "related-posts", "site-footer", "reader-comments", "ad-slot-3", "sponsored-links", "comments", "related-articles-list"])
def test_names_of_parts_are_not(name):
    for page in ("<article><p>{1}</p><div class='{0}'><p>{2}</p></div></article>", "<p>{1}</p><div class='{0}'><p>{2}</p></div>"):
        assert html.main_text(page.format(name, ONE, TWO)) == ONE, page


def test_links_hold_blocks():
    cards = "".join(f"<a href='/{i}'><div><h3>Story {i}</h3><p>{TWO}</p></div></a>" for i in range(4))
    items = "<ul>" + "".join(f"<li><A HREF='/{i}'><p>{TWO}</p></A></li>" for i in range(4)) + "</ul>"
    for more in (cards, items, cards + items):
        assert html.main_text(f"<body><p>{ONE}</p>{more}</body>") == ONE and html.main_text(f"<article><p>{ONE}</p>{more}</article>") == ONE
    assert html.main_text(f"<article><p>{ONE} <a href=x>more</p><p>{TWO}</p></article>") == f"{ONE} more\n{TWO}"  # unclosed
    assert html.main_text(f"<article><p>{ONE} <a href=x>more</p><p>{TWO} <a href=y>x</a></p></article>") == f"{ONE} more\n{TWO} x"
    for part in ("<a href=x>", "</a>", "<a href=x><p>", "<a></a>"):
        began = time.perf_counter()
        html.main_text(part * 20_000)
        assert time.perf_counter() - began < 3, part


def test_roles_and_what_stands_beside_an_article():
    for part in (f"<div role='alert'><p>{TWO}</p></div>", f"<section id='reader-comments'><p>{TWO}</p></section>", f"<div role=status>{TWO}</div>"):
        assert html.main_text(f"<article><p>{ONE}</p>{part}</article>") == ONE and html.main_text(f"<p>{ONE}</p>{part}") == ONE
    assert html.main_text(f"<article><p>{ONE}</p><p>{TWO}</p></article><div><p>{TWO}</p></div>") == f"{ONE}\n{TWO}"
    assert html.main_text(f"<article><p>{ONE}</p></article><div><p>{TWO}</p><p>{TWO}</p></div>").count(TWO) == 2  # a teaser is no page
    assert html.main_text(f"<article><section id='discussion'><h2>Discussion</h2><p>{ONE}</p></section></article>") == f"Discussion\n{ONE}"


def test_other_languages_go_by_length_and_links():
    text = "Tämä on pitkä suomenkielinen kappale, jossa kerrotaan kaupungin historiasta ja sen asukkaista monella lauseella, jotta teksti olisi riittävän pitkä. Vanha satama rakennettiin kauan sitten ja kauppiaat saapuivat sinne laivoilla kesäisin."
    menu = "<ul>" + "".join(f"<li><a href={i}>Etusivu ja muut sivut {i}</a></li>" for i in range(9)) + "</ul>"
    for page in (f"<body>{menu}<p>{text}</p>{menu}</body>", f"<body><nav>{menu}</nav><article><p>{text}</p></article></body>"):
        assert html.main_text(page) == text
    assert html.main_text(f"<body>{menu}<h1>Otsikko</h1><p>{text}</p><p>Lyhyt.</p></body>") == f"Otsikko\n{text}\nLyhyt."
    assert html.main_text("<p>" + "日本語の文章は空白を使わずに書かれる。" * 20 + "</p>").startswith("日本語")
    assert html.main_text("<p>" + "zzz qqq " * 40 + f"</p><p>{ONE}</p><p>{TWO}</p>") == f"{ONE}\n{TWO}"  # not where the page has a language


def plain_labels(blocks):
    """The rules of both passes, block by block, each looking at all others."""
    density = lambda b: b.linked / max(1, len(b.text.replace(" ", "")))
    words = lambda b: html._WORD.findall(b.text.lower())
    stops = lambda b: sum(w in html.STOP_WORDS for w in words(b))
    rest = [b for b in blocks if b.bad < 2 and density(b) <= 0.33]
    other = any(len(b.text) >= 200 for b in rest) and sum(map(stops, rest)) < 0.05 * sum(len(words(b)) for b in rest)

    def alone(b):
        if b.bad == 2 or density(b) > (0.8 if b.main else 0.33) or (len(b.text) < 70 and b.linked and not b.main):
            return "bad"
        share = stops(b) / max(1, len(words(b)))
        if len(b.text) < 70:
            return "short"
        if other or share >= 0.32 or (share >= 0.30 and len(b.text) >= 200) or (b.main and share >= 0.15):
            return "good"
        return "short" if b.main or share >= 0.15 else "bad"

    first = [alone(b) for b in blocks]
    article = any(b.main and x == "good" for b, x in zip(blocks, first, strict=True))
    first = ["bad" if b.bad == 1 and (article or x == "short") else x for b, x in zip(blocks, first, strict=True)]
    if "good" not in first:
        return ["good" if x == "short" else x for x in first]
    size = lambda inside: sum(len(b.text) for b, x in zip(blocks, first, strict=True) if x == "good" and bool(b.main) == inside)
    if size(True) >= size(False):
        first = [x if b.main else "bad" for b, x in zip(blocks, first, strict=True)]
    out = []
    for i, b in enumerate(blocks):
        if first[i] != "short":
            out.append(first[i])
            continue
        speaks = [j for j in range(len(blocks)) if first[j] != "short" and (not b.main or (blocks[j].main == b.main and blocks[j].bad != 2))]
        left, right = max((j for j in speaks if j < i), default=None), min((j for j in speaks if j > i), default=None)
        if left is None and right is None:
            out.append("good" if b.main else "bad")
        elif right is None or (left is not None and not b.heading and i - left < right - i):
            out.append(first[left])
        elif left is None or b.heading or right - i < i - left:
            out.append(first[right])
        else:
            out.append("good" if "good" in (first[left], first[right]) else "bad")
    return out


def test_both_passes_are_the_plain_ones():
    rng = random.Random(5)
    texts = [ONE, TWO, ONE + " " + TWO, "Short one.", "zzz qqq " * 20, "zzz the qqq of www to " * 8, "x" * 75, "a b c " * 50]
    seen = set()
    for _ in range(3000):
        blocks = []
        for _ in range(rng.randint(1, 9)):
            text = rng.choice(texts).strip()
            blocks.append(Block(linked=rng.choice([0, 0, 0, 5, len(text.replace(" ", ""))]), main=rng.choice([0, 0, 1, 2]), bad=rng.choice([0, 0, 0, 1, 2]), heading=rng.random() < 0.2, text=text))
        got = html.labels_of(blocks)
        assert got == plain_labels(blocks), blocks
        seen |= {tuple(got)}
    assert len(seen) > 100
