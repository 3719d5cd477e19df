"""A page's text blocks in order, each with what its place in the markup says of it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

#: Elements whose text is never part of an article, and elements that separate blocks of text.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "object", "canvas")
ASIDE = frozenset("nav header footer aside form head menu button dialog fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole names of a class, id or role that name page furniture, without hyphens, underscores and numbers at the end.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary search "
    # known compounds
    "adbanner adblock adbox adcontainer adslot adunit adwrapper bannerad googlead sidebarad topad breadcrumbnav commentarea commentform commentsarea commentsection "
    "commentssection commentthread cookiebanner cookiebar cookieconsent cookiemessage cookienotice cookiepopup disqusthread bottombar bottomnav footerlinks footermenu "
    "footernav footerwidgets globalfooter globalheader globalnav headermenu headernav leftsidebar mainmenu mainnav mainnavigation menubar mobilemenu mobilenav navlinks "
    "navmenu newsletterform newslettersignup pagefooter pagination postnavigation primarymenu primarynav primarynavigation promobox promobanner relatedarticles "
    "relatedcontent relatedlinks relatedposts relatedstories rightsidebar searchbar searchbox searchform secondarymenu secondarynav sharebar sharebuttons sharelinks "
    "sharetools sidemenu sidenav signupform sitefooter siteheader sitemenu sitenav sitenavigation skiplink skiplinks skipnav skiptocontent socialbar socialbuttons "
    "sociallinks socialmedia socialshare sponsoredcontent subscribeform topbar topmenu topnav widgetarea widgets".split()
)
#: Elements that no such name makes furniture; an article inside an article (a comment, by the standard) may be.
_BODIES = frozenset(("html", "body", "main", "article"))
#: Furniture by kind, but for those that hold the page's article.
_WRAPPERS = frozenset(("form", "fieldset", "label"))
#: Start tags that end an open element of the same row without an end tag.
_CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}

#: A tag as it should be. No part of it crosses an angle bracket and none gives back what it took, so a try costs no more than its length.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/<>]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=]++))?+)*+\s*+/?+)>"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_GAP = re.compile(r"[\s/]*+")
_TELLING = re.compile(r"class|id|role|style", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_JOINT = re.compile(r"[-_]+|[-_]*\d+(?:x\d+)?$")

#: What a block's place says: article body, page furniture, or nothing.
ARTICLE, ASIDE_BLOCK, OPEN = 1, 0, 2


def _attributes(rest: str) -> dict[str, str]:
    """Of a tag's inside, the attributes by lower-case name; of two with one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def _crooked(html: str, at: int, last: int) -> tuple[int, str]:
    """A start or end tag that is not as it should be: where the next token starts, and the inside of the tag.

    Attributes are read as browsers read them. Where a quote or the tag is never closed, it ends with the next ``>``, or
    with its line if none follows (``last`` is the place of the last one), so that no markup is taken for text.
    """
    name = _NAME.match(html, at).end()
    if at < last:
        place = name
        while m := _ATTRIBUTE.match(html, place):
            if m.end() < len(html) and html[m.end()] in "\"'" and m[2] is None and m[3] is None and m[4] is None:
                break  # a quote without its end
            place = m.end()
        place = _GAP.match(html, place).end()
        if place < len(html) and html[place] == ">":
            return place + 1, html[name:place]
        end = html.find(">", name)
        return end + 1, html[name:end]
    end = html.find("\n", name)
    end = len(html) if end < 0 else end
    return end, html[name:end]


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, inside)`` from front to back, each character looked at a fixed number of times."""
    place, size, last = 0, len(html), html.rfind(">")
    while place < size:
        at = html.find("<", place)
        if at < 0:
            yield "text", html[place:], ""
            return
        if at > place:
            yield "text", html[place:at], ""
        if m := _TAG.match(html, at):
            end, tag, rest, place = m[1], m[2].lower(), m[3], m.end()
        elif m := _NAME.match(html, at):
            end, tag = "/" if html[at + 1] == "/" else "", m[1].lower()
            place, rest = _crooked(html, at, last)
        else:
            if html.startswith("<!--", at):
                place = html.find("-->", at + 2)
                place = size if place < 0 else place + 3
            elif html.startswith("<![CDATA[", at) and (end := html.find("]]>", at)) >= 0:
                yield "data", html[at + 9 : end], ""
                place = end + 3
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                place = html.find(">", at)
                place = size if place < 0 else place + 1
            else:
                yield "text", "<", ""
                place = at + 1
            continue
        if not end and tag in _RAW_END and not (tag == "svg" and rest.endswith("/")):
            m = _RAW_END[tag].search(html, place)
            place = size if m is None else (html.find(">", m.end()) + 1 or size)
            continue
        yield ("end" if end else "start"), tag, rest


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(attributes.get("style", "").lower().split())


def _is_named_furniture(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class, id or role names furniture; inside an article a header is the article's own."""
    names = {_JOINT.sub("", n) for a in ("class", "id", "role") for n in attributes.get(a, "").lower().split()}
    return not FURNITURE.isdisjoint(names - {"header"} if in_article else names)


def blocks(html: str) -> list[tuple[int, str]]:
    """``(place, text)`` of each block that has text: references decoded, white space inside as one space, trimmed.

    A name makes an element furniture, with all that is inside, unless a main element is inside, or the page's articles are: where some
    article stands outside named furniture, named furniture may hold others (teasers, comments); where none does, what holds one is none.
    A form, fieldset or label is furniture unless an article or a main element is inside. Time and memory are in proportion to the page, however
    crooked its markup.
    """
    out: list[tuple[int, str, int]] = []
    pending: list[str] = []
    #: open elements: (tag, inside an article or main, inside furniture, the innermost element around that may be furniture)
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where each tag stands open
    #: of elements that may be furniture (0: none): the next one around, whether it wraps only, whether all around it do, what it holds
    outer, wraps_only, all_wrap, holds = [0], [True], [True], [0]
    free = False

    def close() -> None:
        if pending:
            body = " ".join("".join(pending).split())
            pending.clear()
            if body:
                _, article, aside, named = stack[-1]
                out.append((ASIDE_BLOCK if aside else ARTICLE if article else OPEN, body, named))

    def push(element: tuple[str, bool, bool, int]) -> None:
        opened[element[0]].append(len(stack))
        if element[0] in BLOCK:
            opened[""].append(len(stack))
        stack.append(element)

    def pop(place: int) -> None:
        for tag, *_ in reversed(stack[place:]):
            opened[tag].pop()
            if tag in BLOCK:
                opened[""].pop()
        del stack[place:]

    for kind, tag, rest in _tokens(html):
        if kind == "text":
            pending.append(unescape(tag))
        elif kind == "data":
            pending.append(tag)
        elif kind == "end":
            if tag in BLOCK:
                close()
            # An inline element does not end the blocks in it.
            if opened[tag] and (tag in BLOCK or not opened[""] or opened[""][-1] < opened[tag][-1]):
                close()
                pop(opened[tag][-1])
        elif tag in VOID:
            if tag in BLOCK:
                close()
        else:
            if tag in BLOCK:
                close()
            ends = _CLOSES.get(tag)
            if tag in BLOCK and stack[-1][0] == "p":
                ends = _CLOSES["p"]
            while ends and stack[-1][0] in ends:
                pop(len(stack) - 1)
            _, article, aside, named = stack[-1]
            attributes = _attributes(rest) if rest and _TELLING.search(rest) else {}
            stray = tag in ASIDE and tag not in _WRAPPERS and not (article and tag == "header") or bool(attributes) and _is_hidden(attributes)
            inner = tag == "article" and bool(opened["article"])
            by_name = not stray and bool(attributes) and (tag not in _BODIES or inner) and _is_named_furniture(attributes, article)
            wraps = not stray and not by_name and tag in _WRAPPERS
            if tag in BLOCK or stray or by_name or wraps:
                if tag not in BLOCK:
                    close()
                if by_name or wraps:
                    outer.append(named)
                    wraps_only.append(wraps)
                    all_wrap.append(wraps and all_wrap[named])
                    holds.append(0)
                    named = len(outer) - 1
                if not (aside or stray):
                    if tag == "main":
                        holds[named] |= 2
                    elif tag == "article" and not inner:
                        holds[named] |= 1
                        free = free or all_wrap[named]
                if not rest.endswith("/") or tag in BLOCK:
                    push((tag, article or tag in ("article", "main"), aside or stray, named))
    close()
    for n in range(len(outer) - 1, 0, -1):
        holds[outer[n]] |= holds[n]
    furniture = [False]
    for n in range(1, len(outer)):
        lifted = holds[n] if wraps_only[n] or not free else holds[n] & 2
        furniture.append(furniture[outer[n]] or not lifted)
    return [(ASIDE_BLOCK if furniture[named] else place, body) for place, body, named in out]
