"""HTML to text lines with the zone that the markup proves for each.

Zones: ``article`` (inside <article> or <main>), ``chrome`` (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments: by element, role, class or id), and
``plain`` (neither).  Scripts, styles, templates, comments and the head give no text.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)", re.I)
_SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements whose content is no text, without an end tag, and that end a block.
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav header footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
#: An article never is inside of these, so that one there means a missing end tag.
MENUS = frozenset("nav header menu".split())
#: Words of a class, id or role that mark text around the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related reply replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_WORD = re.compile(r"[a-z0-9]+")


def _marked_chrome(attributes: str) -> bool:
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and not CHROME_WORDS.isdisjoint(_WORD.findall(value)):
            return True
    return False


def parse(page: str | None) -> list[tuple[str, str]]:
    """(text, zone) of every non-empty block, in page order; broken markup is read leniently."""
    page = page or ""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    #: Name, chrome from here on (1: by a menu element alone), main from here on.
    open_tags: list[tuple[str, int, bool]] = []
    at = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                top = open_tags[-1] if open_tags else ("", 0, False)
                zone = "chrome" if top[1] else "article" if top[2] else "plain"
                out.append((text, zone))

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    break
                if open_tags[i][0] in MAIN or open_tags[i][0] in CHROME:
                    break  # a stray end tag doesn't close an outer zone
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name == "p" and open_tags and open_tags[-1][0] == "p":
                open_tags.pop()
        if name in VOID or m[3].endswith("/"):
            continue
        if name in BLOCK or name in CHROME or m[3]:
            main = bool(open_tags) and open_tags[-1][2]
            dull = open_tags[-1][1] if open_tags else 0
            if name in MAIN and dull == 1:
                dull = 0
            if _marked_chrome(m[3]) or name in CHROME - MENUS:
                dull = 2
            elif not dull and name in MENUS and not (name == "header" and main):
                dull = 1
            open_tags.append((name, dull, main or name in MAIN))
    flush()
    return out
