"""Labelled pages for the extraction model, put together by rule from parts whose role is known.

Their prose is made of syllables; what the model can learn are tags, names, lengths, links and nesting.
"""

from __future__ import annotations

import random

# Page parts: opening and closing markup. {x} is filled with paragraphs, {l} with a list of links, {s} with a short sentence.
CONTAINERS = (
    "<article>{x}</article>", "<main>{x}</main>", "<main><article class='post'>{x}</article></main>", "<div class='content'>{x}</div>",
    "<div id='main-content'>{x}</div>", "<div class='post-body'>{x}</div>", "<div class='entry-content'>{x}</div>",
    "<section class='story'>{x}</section>", "<div class='article-text'>{x}</div>", "<div id='page'><div class='body'>{x}</div></div>",
    "<table><tr><td class='text'>{x}</td></tr></table>", "<div>{x}</div>", "<div role='main'>{x}</div>", "{x}")
BLOCKS = ("<p>{p}</p>",) * 8 + ("<h2>{s}</h2>", "<ul><li>{s}</li><li>{s}</li></ul>", "<ol><li>{p}</li><li>{s}</li></ol>",
                                "<blockquote><p>{p}</p></blockquote>", "<pre>{s}</pre>", "<div>{p}</div>", "<p><b>{s}<br>",
                                "<table><tr><td>{s}</td><td>{s}</td></tr></table>", "<p><a href='/a'>{s}</a> {p}</p>", "<p>{s}</p>",
                                "<figure><figcaption>{s}</figcaption></figure>", "<h3>{s}</h3>", "<dl><dt>{s}</dt><dd>{p}</dd></dl>")
BEFORE = (
    "<nav><ul>{l}</ul></nav>", "<header><a href='/'>{s}</a><p>{s}</p></header>", "<div class='menu'><ul>{l}</ul></div>",
    "<div id='navbar'>{l}</div>", "<ul class='breadcrumb'>{l}</ul>", "<div class='header'>{s}</div>", "<div class='masthead'><h2>{s}</h2></div>",
    "<div class='ad'>{s}</div>", "<div class='banner advert'><p>{p}</p></div>", "<div class='cookie-notice'><p>{p}</p><button>{s}</button></div>",
    "<div class='notice'>{p}</div>", "<div class='alert warning'>{s}</div>", "<form action='/search'><input name='q'><button>{s}</button></form>",
    "<div role='navigation'>{l}</div>", "<div role='banner'>{s}</div>", "<div class='skip'><a href='#c'>{s}</a></div>",
    "<div id='top-bar'>{s}</div>", "<section class='promo'><p>{p}</p></section>", "<div hidden>{p}</div>", "<menu>{l}</menu>")
INSIDE = ("<div class='ad'>{s}</div>", "<div class='advertisement'><p>{p}</p></div>", "<aside><p>{p}</p></aside>", "<div class='share social'>{l}</div>",
          "<div class='related'><h3>{s}</h3><ul>{l}</ul></div>", "<form><label>{s}</label><input></form>", "<div class='sponsored'>{p}</div>",
          "<div class='notice'><p>{p}</p></div>", "<div class='newsletter'><p>{p}</p><form><input><button>{s}</button></form></div>")
AFTER = (
    "<footer><p>&copy; {s}</p></footer>", "<footer>&copy; example &middot; {s}</footer>", "<div class='footer'>{l}{s}</div>",
    "<div id='copyright'>&copy; {s}</div>", "<aside><h3>{s}</h3><p>{p}</p></aside>", "<div class='sidebar'><p>{p}</p><ul>{l}</ul></div>",
    "<div id='sidebar'><div class='widget'><h3>{s}</h3><p>{p}</p></div></div>", "<div class='related-posts'><ul>{l}</ul></div>",
    "<section class='comments'><h3>{s}</h3><div class='comment'><p>{p}</p></div><div class='comment'><p>{p}</p><p>{p}</p></div></section>",
    "<div id='comments'><ol class='comment-list'><li><p>{p}</p></li><li><p>{p}</p></li></ol></div>", "<div class='replies'><article class='comment'><p>{p}</p></article></div>",
    "<div class='discussion'><p>{p}</p><p>{p}</p></div>", "<form class='signup'><p>{s}</p><label>{s}</label><input><select><option>{s}</option></select></form>",
    "<form method='post'><p>{p}</p><textarea>{s}</textarea><button>{s}</button></form>", "<div class='pagination'>{l}</div>",
    "<div role='contentinfo'>{s}</div>", "<div role='complementary'><p>{p}</p></div>", "<div class='subscribe'><p>{s}</p></div>",
    "<div class='popup modal'><p>{p}</p></div>", "<div class='promo-box'><a href='/x'>{p}</a></div>", "<div class='legal disclaimer'><p>{p}</p></div>",
    "<div class='author-bio'><p>{p}</p></div>", "<div class='tags'>{l}</div>")
# Words in names of blocks with the main text, and of others.
CONTENT_WORDS = "article body content entry main page post story text".split()
OTHER_WORDS = (
    "ad ads advert advertisement alert banner bio breadcrumb captcha comment comments consent cookie copyright disclaimer discussion "
    "disqus feedback foot footer form gdpr header legal links login masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination popup privacy promo promotion recommended related replies reply search share sharing side sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar top warning widget").split()
SYLLABLES = "ka to mi ren sol ba du fer lin gor sa pel ne vi tor".split()
MARK = "⁣"  # stands at the start of a run that is content


def _sentence(r: random.Random, low: int, high: int, content: bool) -> str:
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
    return (MARK if content else "") + " ".join(words).capitalize() + r.choice((".", ".", ".", "", "!"))


def _filled(r: random.Random, part: str, content: bool) -> str:
    out = part
    while "{" in out:
        out = out.replace("{s}", _sentence(r, 1, 9, content), 1).replace("{p}", " ".join(
            _sentence(r, 4, 18, content and i == 0) for i in range(r.randint(1, 5))), 1).replace("{l}", "".join(
                f"<li><a href='/{i}'>{_sentence(r, 1, 2, content)}</a></li>" for i in range(r.randint(2, 7))), 1)
    return out


def _named(r: random.Random, words: list[str], inner: str) -> str:
    """A block whose name, of one word or two, holds one of the words."""
    tag, attribute = r.choice(("div", "div", "section")), r.choice(("class", "class", "id"))
    name = r.choice(words)
    if r.random() < 0.4:
        other = r.choice(("wrapper", "box", "inner", "area", "list", "item", "left", "block"))
        name = f"{name}-{other}" if r.random() < 0.5 else f"{other} {name}"
    return f"<{tag} {attribute}='{name}'>{inner}</{tag}>"


def _other(r: random.Random, parts: tuple[str, ...]) -> str:
    """A part that isn't main text: one of the given, or one that only its name tells."""
    if r.random() < 0.5:
        return _filled(r, r.choice(parts), False)
    inner = r.choice(("{s}", "<p>{p}</p>", "<p>{p}</p><p>{p}</p>", "<h3>{s}</h3><p>{p}</p>", "<ul>{l}</ul>", "{p}", "<div><p>{p}</p></div>"))
    return _named(r, OTHER_WORDS, _filled(r, inner, False))


def labelled_pages(count: int = 500) -> list[str]:
    """Pages whose content runs start with MARK; the same for every call."""
    pages = []
    for n in range(count):
        r = random.Random(n)
        blocks = ["<h1>{s}</h1>"] * (r.random() < 0.85) + [r.choice(BLOCKS) for _ in range(r.randint(1, 12))]
        inner = [_filled(r, b, True) for b in blocks]
        if r.random() < 0.4:
            inner.insert(r.randint(0, len(inner)), _other(r, INSIDE))
        if r.random() < 0.2:
            inner[0] = f"<header>{inner[0]}</header>"
        if r.random() < 0.25:
            inner.append(_other(r, AFTER))
        held = "".join(inner)
        body = _named(r, CONTENT_WORDS, held) if r.random() < 0.5 else r.choice(CONTAINERS).replace("{x}", held)
        before = [_other(r, BEFORE) for _ in range(r.randint(0, 5))]
        after = [_other(r, AFTER) for _ in range(r.randint(0, 5))]
        whole = "".join([*before, body, *after])
        if r.random() < 0.3:
            whole = f"<div class='{r.choice(('wrapper', 'page', 'container', 'site'))}'>{whole}</div>"
        pages.append(f"<html><head><title>x</title></head><body>{whole}</body></html>")
    return pages
